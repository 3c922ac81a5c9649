"""End-to-end train / evaluate entry points composed from the operators (the reference's two commands).

    python -m tabreg.workflow train    --data T --target Y --key K --numeric a,b --categorical c --out DIR
    python -m tabreg.workflow evaluate --data T --target Y --key K --numeric a,b --categorical c --out DIR

``--data`` is a parquet or CSV path. Outputs are tables written with the sinks (CSV / JSON folders) and
the winning ``PipelineModel``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.operators import explain as X
from tabreg.operators import models as M
from tabreg.operators.evaluate import (learning_curve, residual_summary, residual_table,
                                       train_test_metrics)
from tabreg.operators.prep import feature_names
from tabreg.operators.rank import rank_models
from tabreg.operators.split import hash_split
from tabreg.sources.io import sink_csv, sink_json


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A parquet or CSV table; a CSV needs its declared schema (no second pass over the file to guess it)."""
    if path.endswith(".csv"):
        if not schema:
            raise ValueError("a CSV needs --schema, for example 'id bigint, x double'")
        return spark.read.option("header", True).schema(schema).csv(path)
    return spark.read.parquet(path)


def train(df: DataFrame, target: str, key: str, numeric, categorical, interaction, out_dir: str,
          rounds: float = 1.0, folds: int = 5, workers: int = 1) -> DataFrame:
    """Split, fit and cross-validate the pool, rank it, save results, failures, winner and its model."""
    data = hash_split(df, key)
    results, failures, fitted = M.train_all(data, M.catalogue(rounds), numeric, categorical, interaction, target,
                                            key, folds=folds, workers=workers)
    ranked = rank_models(results)
    sink_csv(ranked.orderBy("deployment_rank"), os.path.join(out_dir, "model_comparison"))
    sink_csv(failures, os.path.join(out_dir, "model_failures"))
    best = ranked.where(F.col("deployment_rank") == 1).first()
    winner = M.winner_row(ranked)
    sink_json(winner, os.path.join(out_dir, "model_metadata"))
    model = fitted[best["algorithm"]]
    M.save_model(model, os.path.join(out_dir, "model"))
    return ranked


def evaluate(df: DataFrame, target: str, key: str, numeric, categorical, interaction, out_dir: str,
             model_path: str, folds: int = 5, rounds: float = 1.0, algorithm: str | None = None) -> DataFrame:
    """Score train + test with the saved model; write residual table, metrics, residual shape,
    importances, CV scores and the learning curve of the named candidate."""
    data = hash_split(df, key)
    model = M.load_model(model_path)
    scored = M.score(model, data).persist()
    test = scored.where(F.col("split") == "test")
    sink_csv(residual_table(test, key, label=target), os.path.join(out_dir, "unseen_test_predictions"))
    metrics = train_test_metrics(scored, label=target)
    sink_json(metrics, os.path.join(out_dir, "evaluation_metrics"))
    sink_csv(residual_summary(test, label=target), os.path.join(out_dir, "residual_summary"))
    last = model.stages[-1]
    if hasattr(last, "featureImportances") or hasattr(last, "coefficients"):
        sink_csv(X.importance_native(last, feature_names(model)), os.path.join(out_dir, "feature_importance"))
    inputs = [*numeric, *categorical]
    raw_test = data.where(F.col("split") == "test")
    sink_csv(X.importance_permutation(model, raw_test, inputs, key, target),
             os.path.join(out_dir, "permutation_importance"))
    background = X.background_rows(data.where(F.col("split") == "train"), key, X.BACKGROUND)
    try:
        shap = X.shap_tree(model, raw_test, background, key)
    except ValueError:  # no trees
        shap = X.shap_sampled(model, raw_test, background, inputs, key)
    sink_csv(shap, os.path.join(out_dir, "shap_values"))
    sink_csv(X.shap_global(shap), os.path.join(out_dir, "shap_importance"))
    if algorithm:
        cand = M.catalogue(rounds)[algorithm]
        train_rows = data.where(F.col("split") == "train")
        sink_csv(M.cross_validate(cand, train_rows, numeric, categorical, interaction, target, key, folds),
                 os.path.join(out_dir, "cross_validation_scores"))
        sink_csv(learning_curve(cand, train_rows, numeric, categorical, interaction, target, key),
                 os.path.join(out_dir, "learning_curve"))
    scored.unpersist()
    return metrics


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tabreg.workflow")
    ap.add_argument("command", choices=["train", "evaluate"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--target", required=True)
    ap.add_argument("--key", required=True)
    ap.add_argument("--numeric", required=True)
    ap.add_argument("--categorical", default="")
    ap.add_argument("--interaction", default="", help="name,a,b")
    ap.add_argument("--out", required=True)
    ap.add_argument("--rounds", type=float, default=1.0)
    ap.add_argument("--folds", type=int, default=5)
    ap.add_argument("--algorithm", default=None)
    ap.add_argument("--schema", default=None, help="columns and types of a CSV")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    df = read_table(spark, a.data, a.schema)
    numeric = [c for c in a.numeric.split(",") if c]
    categorical = [c for c in a.categorical.split(",") if c]
    inter = tuple(a.interaction.split(",")) if a.interaction else None
    if a.command == "train":
        train(df, a.target, a.key, numeric, categorical, inter, a.out, a.rounds, a.folds)
    else:
        evaluate(df, a.target, a.key, numeric, categorical, inter, a.out, os.path.join(a.out, "model"),
                 a.folds, a.rounds, a.algorithm)


if __name__ == "__main__":
    main()

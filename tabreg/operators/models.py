"""Model pool: candidate catalogue, fit/compare loop, winner selection, persistence.

Each candidate is ``preparation pipeline + regressor`` (a ``Pipeline``) fitted on the training rows.
Training data are prepared once and cached (``persist`` spills to disk when needed); every candidate is
a distributed Spark ML fit (tree learners aggregate split statistics per partition; GBT and forest
tree-building is distributed). Metrics come from one ``transform`` and one aggregation per candidate.
"""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.operators.boosting import AdaBoostR2, BoostedTrees
from tabreg.operators.evaluate import regression_metrics, train_test_metrics
from tabreg.operators.forest import UnlimitedForest
from tabreg.operators.linear import MomentRegression, fold_scores
from tabreg.operators.columns import require_columns
from tabreg.operators.prep import preparation_pipeline, prepare_input
from tabreg.operators.svr import KernelSVR


@dataclass(frozen=True)
class Candidate:
    name: str
    scaled: bool  # linear models see standardised inputs
    build: Callable[[Mapping[str, float]], Estimator]  # receives training facts (n, label std)

    def moments(self, facts) -> tuple[str, float] | None:
        """(kind, alpha) of a candidate that can be fitted from second moments."""
        if not self.scaled:
            return None
        est = self.build(facts or {"n": 1.0, "label_std": 1.0})
        if not isinstance(est, MomentRegression):
            return None
        return est.getOrDefault("kind"), est.getOrDefault("alpha")


# Candidate settings (rounds, depth, rate, alpha) as in the reference pool; boosters carry
# names of their own. ``rounds`` scales the iteration counts
# (1.0 = reference sizes) so small checks can run the same pool quickly.
def catalogue(rounds: float = 1.0, seed: int = 42) -> dict[str, Candidate]:
    def it(n: int) -> int:
        return max(1, int(round(n * rounds)))

    return {
        "Linear Regression": Candidate("Linear Regression", True, lambda f: MomentRegression(kind="ols")),
        "Ridge Regression": Candidate("Ridge Regression", True, lambda f: MomentRegression(kind="ridge", alpha=1.0)),
        "Lasso Regression": Candidate("Lasso Regression", True, lambda f: MomentRegression(kind="lasso", alpha=0.001)),
        "Decision Tree": Candidate("Decision Tree", False, lambda f: DecisionTreeRegressor(
            maxDepth=10, maxBins=256, seed=seed)),
        "Random Forest": Candidate("Random Forest", False, lambda f: UnlimitedForest(
            numTrees=it(300), randomThresholds=False, bootstrap=True, seed=seed)),
        "Gradient Boosting": Candidate("Gradient Boosting", False, lambda f: BoostedTrees(
            rounds=it(300), rate=0.05, depth=3, l2=0.0, minChild=1.0, seed=seed)),
        # second-order gain, depth 5, row and column shares 0.9
        "gbt_subsampled": Candidate("gbt_subsampled", False, lambda f: BoostedTrees(
            rounds=it(300), rate=0.05, depth=5, l2=1.0, minChild=1.0, rowShare=0.9, columnShare=0.9, seed=seed)),
        # leaf-wise to 31 leaves of 20 rows at least
        "gbt_wide": Candidate("gbt_wide", False, lambda f: BoostedTrees(
            rounds=it(300), rate=0.05, grow="leaf", maxLeaves=31, l2=0.0, minChild=20.0, maxBins=255, seed=seed)),
        # oblivious trees, 500 rounds, rate 0.05, depth 6
        "gbt_deep": Candidate("gbt_deep", False, lambda f: BoostedTrees(
            rounds=it(500), rate=0.05, depth=6, grow="oblivious", l2=3.0, maxBins=255, seed=seed)),
        "SVR": Candidate("SVR", True, lambda f: KernelSVR(c=100.0, epsilon=0.05, seed=seed)),
        # extremely randomised trees: all rows, one random threshold per node and feature
        "Extra Trees": Candidate("Extra Trees", False, lambda f: UnlimitedForest(
            numTrees=it(300), randomThresholds=True, bootstrap=False, seed=seed)),
        "AdaBoost": Candidate("AdaBoost", False, lambda f: AdaBoostR2(rounds=it(300), rate=0.05, depth=3, seed=seed)),
    }


def training_facts(train: DataFrame, label: str) -> dict[str, float]:
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(label).alias("sd")).first()
    return {"n": float(r["n"]), "label_std": float(r["sd"] or 1.0)}


def candidate_pipeline(c: Candidate, numeric: Sequence[str], categorical: Sequence[str],
                       interaction, label: str, facts: Mapping[str, float]) -> Pipeline:
    prep = preparation_pipeline(numeric, categorical, c.scaled, interaction)
    model = c.build(facts)
    model.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")
    return Pipeline(stages=[*prep.getStages(), model])


def fit_candidate(c: Candidate, train: DataFrame, numeric, categorical, interaction, label: str,
                  facts=None) -> tuple[PipelineModel, float]:
    facts = facts or training_facts(train, label)
    pipe = candidate_pipeline(c, numeric, categorical, interaction, label, facts)
    t0 = time.perf_counter()
    model = pipe.fit(train)
    return model, time.perf_counter() - t0


def predict_batch(model: PipelineModel, batch: DataFrame, required: Sequence[str], interaction=None,
                  prediction: str = "prediction") -> DataFrame:
    """Validated batch scoring: the required inputs must be there, the engineered column is derived if absent,
    every other column of the batch is kept, the prediction is appended under ``prediction``."""
    require_columns(batch, required)
    ready = prepare_input(batch, interaction) if interaction else batch
    kept = {f"__kept_{i}": c for i, c in enumerate(ready.columns)}  # stages overwrite their inputs
    scored = model.transform(ready.withColumns({k: F.col(f"`{c}`") for k, c in kept.items()}))
    return scored.select(*[F.col(k).alias(c) for k, c in kept.items()], F.col("prediction").alias(prediction))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions with every input column kept (the last stage appends ``prediction``)."""
    return model.transform(df)


def train_all(split_df: DataFrame, candidates: Mapping[str, Candidate], numeric, categorical, interaction,
              label: str, key: str, folds: int = 0,
              workers: int = 1) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel]]:
    """Fit every candidate on the train rows, time it, compute train/test metrics and optional k-fold CV.

    The table is prepared once per training set (the train rows, and the rest of each fold) and kind of preparation, and all
    candidates are fitted on it. One failure does not stop the rest; failures are returned as an (algorithm, failure)
    DataFrame and an error is raised only if nothing trained. Returns (results, failures, fitted models).
    """
    spark = split_df.sparkSession
    data = split_df.persist()
    train = data.where(F.col("split") == "train")
    facts = training_facts(train, label)
    frames = _Prepared(numeric, categorical, interaction)
    failed: dict[str, str] = {}

    def attempt(item, work):
        name, c = item
        if name in failed:
            return None
        try:
            return work(name, c)
        except Exception as exc:  # noqa: BLE001 - one candidate's failure must not stop the pool
            failed[name] = f"{type(exc).__name__}: {exc}"[:1000]
            return None

    def whole(name, c):
        prep, ready = frames.of("train", c.scaled, train, data)
        t0 = time.perf_counter()
        last = _final(c, facts, label).fit(ready.where(F.col("split") == "train"))
        secs = time.perf_counter() - t0
        metrics = train_test_metrics(last.transform(ready), label=label).first().asDict()
        return {"algorithm": name, **{k: _f(v) for k, v in metrics.items()}, "training_seconds": secs}, PipelineModel([*prep.stages, last])

    # workers > 1 overlaps the candidates' jobs (fit times then include contention)
    items = list(candidates.items())
    done = {i[0]: r for i, r in zip(items, run_concurrently(lambda i: attempt(i, whole), items, workers)) if r is not None}
    frames.release("train")
    cv: dict[str, list[dict]] = {n: [] for n in done}
    if folds:
        tagged = _folded(train, key, folds).persist()
        linear = [i for i in items if i[0] in done and i[1].moments(facts)]
        others = [i for i in items if i[0] in done and not i[1].moments(facts)]
        for name, rows in zip([i[0] for i in linear], run_concurrently(
                lambda i: attempt(i, lambda n, c: cross_validate(c, train, numeric, categorical, interaction, label, key, folds).collect()),
                linear, workers)):
            cv[name] = [r.asDict() for r in rows or []]
        for f in range(folds if others else 0):
            rest = tagged.where(F.col("fold") != f)
            own = training_facts(rest, label)

            def held_out(name, c):
                _, ready = frames.of(f, c.scaled, rest, tagged)
                last = _final(c, own, label).fit(ready.where(F.col("fold") != f))
                return regression_metrics(last.transform(ready.where(F.col("fold") == f)), label=label).first().asDict()
            for (name, _), r in zip(others, run_concurrently(lambda i: attempt(i, held_out), others, max(workers, 4))):
                if r is not None:
                    cv[name].append(r)
            frames.release(f)
        tagged.unpersist()
    data.unpersist()
    rows = []
    for name, (row, _) in done.items():
        if name not in failed:
            got = {k: [r[k] for r in cv[name] if r[k] is not None] for k in ("r2", "mae", "rmse")}
            mean = lambda v: float(np.mean(v)) if v else None
            rows.append(row | {"cv_r2_mean": mean(got["r2"]), "cv_r2_std": float(np.std(got["r2"])) if got["r2"] else None,
                               "cv_mae_mean": mean(got["mae"]), "cv_rmse_mean": mean(got["rmse"])})
    failures = [(n, failed[n]) for n in candidates if n in failed]
    if not rows:
        raise RuntimeError("every candidate failed: " + "; ".join(m for _, m in failures))
    cols = ["algorithm", "train_mae", "train_mse", "train_rmse", "train_r2", "train_n", "mae", "mse", "rmse", "r2",
            "n", "r2_gap", "cv_r2_mean", "cv_r2_std", "cv_mae_mean", "cv_rmse_mean", "training_seconds"]
    schema = T.StructType([T.StructField(c, T.StringType() if c == "algorithm" else T.DoubleType()) for c in cols])
    results = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)  # one row per model
    fails = spark.createDataFrame(failures, "algorithm string, failure string")
    return results, fails, {n: m for n, (_, m) in done.items() if n not in failed}


def _final(c: Candidate, facts: Mapping[str, float], label: str) -> Estimator:
    return c.build(facts).setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")


class _Prepared:
    """Preparations fitted once per training set and kind, and the persisted rows that went through them."""

    def __init__(self, numeric, categorical, interaction):
        self.how, self.held, self.lock = (numeric, categorical, interaction), {}, threading.Lock()

    def of(self, name, scaled: bool, rows: DataFrame, data: DataFrame) -> tuple[PipelineModel, DataFrame]:
        numeric, categorical, interaction = self.how
        with self.lock:
            if (name, scaled) not in self.held:
                prep = preparation_pipeline(numeric, categorical, scaled, interaction).fit(rows)
                self.held[name, scaled] = prep, prep.transform(data).persist()
            return self.held[name, scaled]

    def release(self, name) -> None:
        for k in [k for k in self.held if k[0] == name]:
            self.held.pop(k)[1].unpersist()


def _folded(train: DataFrame, key: str, folds: int, salt: str = "fold42") -> DataFrame:
    from tabreg.functions.stats import hash_bucket
    return train.withColumn("fold", hash_bucket(F.col(key), salt, folds))


def _f(v):
    return None if v is None else float(v)


def cross_validate(c: Candidate, train: DataFrame, numeric, categorical, interaction, label: str, key: str,
                   folds: int = 5, salt: str = "fold42") -> DataFrame:
    """k-fold CV: for each fold the whole pipeline (preparation included) is refitted on the other folds, with
    the facts (row count, label std) of those rows; linear candidates get all folds from one read's moments.
    Returns (fold, n, mae, mse, rmse, r2) per fold."""
    data = _folded(train, key, folds, salt)
    if how := c.moments(None):
        rows = fold_scores(data, F.col("fold"), folds, numeric, categorical, interaction, label, *how)
        return train.sparkSession.createDataFrame(rows, "fold int, n bigint, mae double, mse double, rmse double, r2 double")
    used = dict.fromkeys([*numeric, *categorical, *(interaction or ()), label, "fold"])
    data = data.select(*[f"`{u}`" for u in used if u in data.columns]).persist()  # no keys, no texts

    def one(f: int) -> dict:
        model, _ = fit_candidate(c, data.where(F.col("fold") != f), numeric, categorical, interaction, label)
        pred = score(model, data.where(F.col("fold") == f))
        return regression_metrics(pred, label=label).withColumn("fold", F.lit(f)).first().asDict()

    out = run_concurrently(one, range(folds))
    data.unpersist()
    return train.sparkSession.createDataFrame(
        [(r["fold"], r["n"], r["mae"], r["mse"], r["rmse"], r["r2"]) for r in out],
        "fold int, n bigint, mae double, mse double, rmse double, r2 double")


def run_concurrently(fn, items, workers: int = 4) -> list:
    """Submit independent Spark jobs (one fit each) from a few driver threads so small fits overlap on
    the cluster; results keep the input order."""
    items = list(items)
    if len(items) <= 1 or workers <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as pool:
        return list(pool.map(fn, items))


def winner_row(ranked: DataFrame) -> DataFrame:
    """Rank-1 row with a justification sentence (top-1 of the ranking, one row per pool)."""
    best = ranked.where(F.col("deployment_rank") == 1)
    return best.select(
        "algorithm", "deployment_score", "r2", "rmse", "mae", "cv_r2_mean",
        F.format_string("%s ranked first with deployment score %.2f/100 (test R2 %.4f, RMSE %.4f, CV R2 %.4f).",
                        "algorithm", "deployment_score", "r2", "rmse", "cv_r2_mean").alias("justification"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Model explanation: native and permutation importance, exact linear and tree contributions, sampled Shapley
values for any other model, global importance and the value x weight fallback.

Scale notes:
- permutation importance numbers the rows once (a distributed sort); a repeat's permutation is a keyed bijection on these
  numbers, computed row by row, so a join on it gives each row its donor. The feature variants are exploded
  after that shuffle, scored and aggregated map-side;
- tree contributions are computed in place, batch by batch (``treeshap``); no row is copied;
- sampled Shapley (models without trees or coefficients) crosses the explained rows with a bounded broadcast grid
  (background rows x orders x steps, sizes fixed by the call) and scores it; sums per (row, feature) collapse map-side.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabreg.cluster import ship
from tabreg.functions.stats import r2_expr
from tabreg.operators.prep import feature_names
from tabreg.operators.split import global_rank
from tabreg.operators.treeshap import Explainer, model_trees


BACKGROUND = 100  # fixed value: background rows of the sampled Shapley values


def importance_native(model, names: Sequence[str]) -> DataFrame:
    """Tree importances (sum to 1) or absolute linear coefficients, one row per feature."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        raise ValueError("model exposes neither featureImportances nor coefficients")
    if len(vals) != len(names):
        raise ValueError(f"{len(names)} names for {len(vals)} features")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")


def permuted(rank: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection on 0..n-1: four Feistel rounds over the next even number of bits, walked back into range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (right + np.uint64(key * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask)
        return left << np.uint64(half) | right
    out = once(rank.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def importance_permutation(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str,
                           label: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and population std over repeats of the drop in R2 when one input column is permuted over the whole table.

    In each repeat every row takes the value of the row whose number the repeat's bijection gives, one column at a
    time, so each value is used exactly once.
    """
    ship(df.sparkSession)
    ranked = global_rank(df.select(key, label, *features), [key])
    n = ranked.count()

    @F.arrow_udf("array<long>")
    def donors(rank: pa.Array) -> pa.Array:
        r = rank.to_numpy(zero_copy_only=False)
        each = np.stack([permuted(r, n, seed * 1000 + i) for i in range(repeats)], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * repeats, pa.int32()), pa.array(each.ravel()))
    own = ranked.select("rank", F.struct(*features).alias("__donor"))
    asked = ranked.select(key, label, *features, F.posexplode(donors("rank")).alias("__repeat", "__rank"))
    paired = asked.join(own.withColumnRenamed("rank", "__rank"), "__rank")
    variants = F.array(*[F.struct(F.lit(f).alias("__feature"), *[
        (F.col(f"__donor.{g}") if g == f else F.col(g)).alias(g) for g in features]) for f in features])
    shuffled = paired.select(key, label, "__repeat", F.explode(variants).alias("__x")).select(key, label, "__repeat", "__x.*")
    per_rep = model.transform(shuffled).groupBy("__feature", "__repeat").agg(r2_expr(label, "prediction").alias("r2"))
    base_r2 = model.transform(df.select(key, label, *features)).agg(r2_expr(label, "prediction").alias("base_r2"))
    return (per_rep.crossJoin(F.broadcast(base_r2))
            .withColumn("drop", F.col("base_r2") - F.col("r2"))
            .groupBy(F.col("__feature").alias("feature"))
            .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")))


def shap_tree(model: PipelineModel, rows: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """Exact Shapley values of the pipeline's tree model on its own (prepared) features, against the background rows
    (a bounded sample). Long form: key, feature, value, contribution; a row's contributions sum to f(x) - mean f(background)."""
    ship(rows.sparkSession)
    prep, last, names = PipelineModel(model.stages[:-1]), model.stages[-1], feature_names(model)
    vector = last.getFeaturesCol()
    known = prep.transform(background).select(vector_to_array(vector).alias("x")).collect()
    if not known:
        raise ValueError("no background rows")
    explainer = rows.sparkSession.sparkContext.broadcast(Explainer(model_trees(last), np.array([r["x"] for r in known]).T))

    @F.arrow_udf("array<double>")
    def contributions(x: pa.Array) -> pa.Array:
        n = len(x)
        flat = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T)
        phi = explainer.value(flat)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(phi), pa.int32()), pa.array(phi.T.ravel()))
    x = prep.transform(rows).select(key, vector_to_array(vector).alias("__x"))
    both = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("__x").alias("value"), F.col("__phi").alias("contribution"))
    return (x.withColumn("__phi", contributions("__x")).select(key, F.explode(both).alias("kv"))
            .select(key, F.col("kv").getField("feature").alias("feature"), F.col("kv").getField("contribution").alias("contribution"),
                    F.col("kv").getField("value").alias("value")))


def shap_linear(prepared: DataFrame, names: Sequence[str], coefficients: Sequence[float], key: str,
                background_means: Sequence[float]) -> DataFrame:
    """Exact Shapley values of a linear model on its own (prepared) features:
    contribution_j = coef_j * (x_j - mean_j). Long form: key, feature, value, contribution."""
    return prepared.select(key, F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                 (F.lit(c) * (F.col(n) - F.lit(m))).alias("contribution"))
        for n, c, m in zip(names, coefficients, background_means)])).alias("kv")).select(key, "kv.*")


def shap_sampled(model: PipelineModel, rows: DataFrame, background: DataFrame, features: Sequence[str],
                 key: str, permutations: int = 2, seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley values for any fitted pipeline.

    For every explained row, background row z and random feature order, features are switched from z
    to the row's values one at a time; each switch's change in prediction is that feature's marginal
    contribution. Averages over background rows and orders give (key, feature, value, contribution);
    contributions of a row sum to f(x) - mean_z f(z) exactly.
    """
    spark = rows.sparkSession
    rng = random.Random(seed)
    k = len(features)
    perms = []
    for p in range(permutations):
        order = list(features)
        rng.shuffle(order)
        perms.append((p, order))
    steps = spark.createDataFrame([(p, s, order) for p, order in perms for s in range(k + 1)],
                                  "__p int, __step int, __order array<string>")
    bg = background.select(F.col(key).alias("__bg"), *[F.col(f).alias(f"__z_{f}") for f in features])
    grid = F.broadcast(bg.crossJoin(steps))  # background rows x permutations x (k+1): bounded by the call
    x = rows.select(key, *features)
    comp = x.crossJoin(grid)
    pos = {f: F.array_position(F.col("__order"), f) for f in features}  # 1-based position in the order
    mixed = comp.select(key, "__bg", "__p", "__step", "__order",
                        *[F.when(pos[f] <= F.col("__step"), F.col(f)).otherwise(F.col(f"__z_{f}")).alias(f)
                          for f in features], *[F.col(f).alias(f"__x_{f}") for f in features])
    scored = model.transform(mixed.withColumn("__own", F.struct(*[F.col(f"__x_{f}").cast("string").alias(f) for f in features])))
    at, order = F.col("__step"), F.col("__order")
    feature = lambda i: F.get(order, i)  # noqa: E731 - null outside the order
    signs = F.array(F.struct(feature(at - 1).alias("feature"), F.col("prediction").alias("d")),
                    F.struct(feature(at).alias("feature"), (-F.col("prediction")).alias("d")))
    parts = scored.select(key, "__own", F.explode(signs).alias("__s")).where("__s.feature is not null")
    times = F.lit(float(permutations)) * F.lit(background.count())
    value = F.coalesce(*[F.when(F.col("__s.feature") == f, F.col(f"__own.{f}")) for f in features])
    return (parts.groupBy(key, F.col("__s.feature").alias("feature"))
            .agg((F.sum("__s.d") / times).alias("contribution"), F.max(value).alias("value"))
            .select(key, "feature", "contribution", "value"))


def shap_global(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
            .orderBy(F.col("mean_abs_contribution").desc(), "feature"))


def local_fallback(rows: DataFrame, weights: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Contribution = value x weight per (row, feature) with a per-feature weight table (importances,
    coefficients or ones; features without a weight get 1). Ranked by absolute contribution per row."""
    long = rows.select(key, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("kv")
    ).select(key, "kv.*")
    w = F.broadcast(weights.select("feature", "weight"))  # one row per feature
    out = long.join(w, "feature", "left").withColumn(
        "contribution", F.col("value") * F.coalesce(F.col("weight"), F.lit(1.0)))
    rank = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")  # k rows per key
    return out.withColumn("position", F.row_number().over(rank)).drop("weight")


def background_rows(df: DataFrame, key: str, n: int, salt: str = "bg42") -> DataFrame:
    """A fixed-size, deterministic background sample: the n rows with the smallest key hash
    (TakeOrderedAndProject: each task keeps only n rows)."""
    return df.withColumn("__h", F.xxhash64(F.col(key), F.lit(salt))).orderBy("__h", key).limit(n).drop("__h")

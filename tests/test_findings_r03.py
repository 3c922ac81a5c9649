"""Tests of the findings of round 3."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabreg.functions.stats import sig_round
from tabreg.plans.registry import rounded


def test_rounding_many_columns_stays_out_of_the_whole_stage_method(spark):
    rows = [(1, None, float("nan"), -0.0), (2, float("inf"), -1.23456789012e-7, 1e300), (3, 0.0, -5e-324, 99999999.95), (4, 2.5, 1 / 3, -2 / 3e5)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    plain = df.select("i", *[sig_round(F.col(c)).alias(c) for c in "abc"])
    assert rounded(df).dtypes == plain.dtypes
    assert [repr(r) for r in rounded(df).orderBy("i").collect()] == [repr(r) for r in plain.orderBy("i").collect()]
    plan = rounded(df.withColumns({f"d{i}": F.col("b") * i for i in range(9)}))._jdf.queryExecution().executedPlan().toString()
    fused = [line for line in plan.splitlines() if "*(" in line]
    assert max(line.count("SIGNUM") for line in fused) < plan.count("SIGNUM") / 4


def test_a_boosting_round_is_one_job_per_level(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from tabreg.operators import boosting as B
    rows = spark.range(0, 4000, 1, 3).select(array_to_vector(F.array(F.rand(1), F.rand(2), F.rand(3))).alias("features"), "id")
    df = rows.withColumn("label", F.pmod("id", F.lit(17)).cast("double")).drop("id").persist()
    track, fits = spark.sparkContext.statusTracker(), {}
    for way, limit in (("driver", B.DRIVER_BYTES), ("shuffle", 0)):
        monkeypatch.setattr(B, "DRIVER_BYTES", limit)
        monkeypatch.setattr(B, "WRITE_EVERY", 3)
        for rounds in (2, 7):
            spark.sparkContext.setJobGroup(f"{way}{rounds}", "boosting")
            m = B.BoostedTrees(rounds=rounds, depth=2, maxBins=16, localRows=10, seed=3).fit(df)
            fits[way, rounds] = m, len(track.getJobIdsForGroup(f"{way}{rounds}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    small = B.BoostedTrees(rounds=7, depth=2, maxBins=16, seed=3).fit(df)
    for way in ("driver", "shuffle"):
        assert np.allclose(fits[way, 7][0].getOrDefault("value"), small.getOrDefault("value"))
        assert fits[way, 7][1] - fits[way, 2][1] <= 5 * 2 + 2  # two levels a round, and two checkpoints
    df.unpersist()


def test_a_bracket_between_two_common_values_is_not_sketched_again_and_again(spark, monkeypatch):
    from tabreg.operators import quantile as Q
    calls, plain = [], Q.sketches
    monkeypatch.setattr(Q, "sketches", lambda *a: calls.append(1) or plain(*a))
    df = spark.range(0, 5000, 1, 3).select((F.col("id") % 50).cast("double").alias("v"))
    got = Q.exact_quantiles(df, ["v"], [0.25, 0.5], bracket_rows=20).orderBy("p").collect()
    assert [r["value"] for r in got] == [12.0, 24.5]
    assert len(calls) <= 2  # the median lies between two values: nothing can narrow that bracket


def test_column_summary_groups_values_by_kind_without_text(spark):
    from tabreg.operators.profile import column_summary, describe_numeric, moment_table
    rows = [(1, 0.0, "a", 1.5), (None, -0.0, None, None), (1, float("nan"), "a", 2.5), (2, None, "", None), (3, 2.5, "b", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "i int, d double, s string, f float, e double")
    got = {r["column"]: (r["data_type"], r["missing"], r["unique_with_null"], r["unique"]) for r in column_summary(df).collect()}
    assert got == {"i": ("float64", 1, 4, 3), "d": ("float64", 2, 3, 2), "s": ("object", 1, 4, 3), "f": ("float64", 3, 3, 2),
                   "e": ("float64", 5, 1, 0)}
    plan = column_summary(df.select("d", "f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan
    d = {r["column"]: r for r in describe_numeric(df, ["i", "d", "e"]).collect()}
    assert (d["i"]["count"], d["i"]["mean"], d["i"]["min"], d["i"]["max"]) == (4, 1.75, 1.0, 3.0)
    assert (d["d"]["count"], d["d"]["max"], d["e"]["count"], d["e"]["mean"]) == (3, 2.5, 0, None)
    assert sorted(r["column"] for r in moment_table(df, ["i", "d", "e"]).collect()) == ["d", "i"]


def test_findings_read_their_source_once(spark):
    from tabreg.operators.report import findings
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = (spark.range(0, 1000, 1, 2).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") < 990, F.col("id") % 7).otherwise(500.0)
                                            .cast("double").alias("b"), (F.col("id") * 2.0).alias("y")).mapInArrow(count, "a double, b double, y double"))
    got = {(r["finding"], r["subject"]): r["value"] for r in findings(df, "y", ["a", "b"]).collect()}
    assert seen.value == 1000
    assert got["strong positive correlation", "a"] == "1.0000" and got["outliers", "b"] == "10"
    assert ("highly skewed", "b") in got and ("target shape", "y") in got


def test_linear_predictions_are_written_out(spark):
    from pyspark.ml.functions import array_to_vector

    from tabreg.operators.linear import UNROLLED, LinearModel
    for k in (3, UNROLLED + 1):
        x, w = np.random.default_rng(k).normal(size=(20, k)), np.random.default_rng(1).normal(size=k)
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, a array<double>").select("id", array_to_vector("a").alias("features"))
        out = LinearModel()._set(weights=w.tolist(), intercept_=0.5, featuresCol="features", predictionCol="prediction").transform(df)
        assert np.allclose([r["prediction"] for r in out.orderBy("id").collect()], 0.5 + x @ w, rtol=1e-12)
        assert out.columns == ["id", "features", "prediction"]
        assert ("lambda" in out._jdf.queryExecution().optimizedPlan().toString()) == (k > UNROLLED)


def test_cross_validation_holds_only_the_columns_it_uses(spark, monkeypatch):
    from tabreg.operators import models as M
    held = []
    cls = type(spark.range(1))
    plain = cls.persist
    monkeypatch.setattr(cls, "persist", lambda self, *a: held.append(set(self.columns)) or plain(self, *a))
    df = spark.range(0, 400, 1, 2).select(F.concat_ws("-", F.lit("key"), "id").alias("key"), F.rand(1).alias("a"), F.rand(2).alias("b"),
                                          F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("c"), F.lit("long text").alias("text"))
    df = df.withColumn("label", F.col("a") * 2 + F.col("b"))
    rows = M.cross_validate(M.catalogue()["Decision Tree"], df, ["a", "b"], ["c"], ("ab", "a", "b"), "label", "key", folds=3).collect()
    assert sum(r["n"] for r in rows) == 400 and len(rows) == 3
    assert {"a", "b", "c", "label", "fold"} in held and not any("text" in h or "key" in h for h in held)


def test_few_rows_are_broadcast_to_a_forest_and_both_ways_of_scoring_agree(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tabreg.operators import forest as T
    rng = np.random.default_rng(4)
    x = rng.random((700, 3))
    df = spark.createDataFrame([(i, Vectors.dense(r), float(r[0] + 3 * (r[1] > 0.4))) for i, r in enumerate(x)], ["id", "features", "label"]).repartition(3, "id")
    # a table of 0.1 GB (480,000 rows of nine features) is grown whole by tasks, its rows are not shuffled per tree
    assert T.LOCAL_ROWS >= 600_000 and T.LOCAL_BYTES >= 600_000 * 10 * 8
    for local in (10_000, 400):  # trees of one part and of several
        model = T.UnlimitedForest(numTrees=7, seed=2, localRows=local).fit(df)
        out = {}
        for limit in (T.LOCAL_BYTES, 0):
            monkeypatch.setattr(T, "LOCAL_BYTES", limit)
            scored = model.transform(df)
            assert ("Generate" in scored._jdf.queryExecution().executedPlan().toString()) == (limit == 0)  # blocks multiplied by groups of trees
            out[limit > 0] = [r.prediction for r in scored.orderBy("id").collect()]
            assert model.transform(df.where("id < 0")).count() == 0
        monkeypatch.undo()
        assert np.allclose(out[True], out[False])


def test_a_scoring_pass_looks_up_only_its_own_shard(monkeypatch):
    import pyarrow as pa

    from tabreg.llm import bytesops as B
    from tabreg.llm import ppm
    rng = np.random.default_rng(8)
    texts = pa.array(["".join(rng.choice(list("abcdé 🙂\n"), rng.integers(0, 90))) for _ in range(60)] + [None, "", "a"])
    data, off = B.text_bytes(texts)
    code, starts, _ = ppm._symbols(data, off, 0, len(texts), 4)
    u, n = np.unique(code, return_counts=True)
    whole = ppm.Trie(u, n, 4)
    want = np.add.reduceat(whole.log10(code), starts)
    short = [np.unique(code & ppm._mask(2), return_counts=True)][0]
    names = ["__text", "__tokens", "__known", "__base", "__score"]
    zeros = [np.zeros(len(texts), t) for t in (np.int64, np.int64, float, float)]
    row = pa.RecordBatch.from_arrays([texts, *map(pa.array, zeros)], names)
    asked, hashed, real = [], [], ppm.Trie.log10
    monkeypatch.setattr(ppm.Trie, "log10", lambda self, c: asked.append(len(c)) or real(self, c))
    words = ppm._word_hashes
    monkeypatch.setattr(ppm, "_word_hashes", lambda *a: hashed.append(1) or words(*a))
    for i in range(3):
        own = ppm._shard(u, 3) == i
        trie = ppm.Trie(u[own], n[own], 4)
        trie.replace_short(ppm.Trie(*short, 1))
        table = {"trie": trie.packed(), "words": np.zeros(0, np.int64) if i == 0 else None, "counts": np.zeros(0, np.int64), "shard": i, "of": 3}
        row = next(ppm._score(type("T", (), {"value": table}), 10, 5)(iter([row])))
    assert sum(asked) == len(u) and len(hashed) == 1  # each distinct place once over all passes, words in one of them
    assert np.allclose(row.column("__score").to_numpy(), want)
    assert row.column("__tokens").to_pylist()[-3:] == [1, 1, 2]


def test_a_large_svr_starts_at_the_optimum_of_drawn_rows_and_ends_at_that_of_all(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tabreg.operators import svr as S
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    y = 20 * np.sin(x[:, 0]) + 5 * x[:, 1] + rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"]).coalesce(1)
    small = S.KernelSVR(c=10.0, components=30).fit(df)
    monkeypatch.setattr(S, "START_ROWS", 600)
    passes, parts, real = [], [], S._summed
    monkeypatch.setattr(S, "_summed", lambda d, one: passes.append(1) or parts.append(d.rdd.getNumPartitions()) or real(d, one))
    large = S.KernelSVR(c=10.0, components=30, localRows=100).fit(df)
    assert len(passes) <= 9 and max(parts) > 1  # from zero: some twenty; one file does not mean one task
    a, b = (m.transform(df).select("prediction").toPandas().prediction.to_numpy() for m in (small, large))
    assert np.abs(a - b).max() < 1e-3 * y.std()


def test_newton_from_a_bad_start_falls_back_to_the_whole_path():
    from tabreg.operators import svr as S
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (1, 150))
    y = np.sin(2 * x[0]) + rng.normal(0, 0.1, 150)
    f = S.Cosines(1, 12, 1.0, 3)
    solve = lambda steps, **k: S.newton(lambda t, d: S._terms(x, y, f, t, 0.0, 0.05, d), 13, 10.0, y.std(), 0.05, steps, **k)
    assert np.array_equal(solve(2, start=np.full(13, 1e3)), solve(2))
    assert np.allclose(solve(30, start=solve(30) + 0.01), solve(30), atol=1e-3)

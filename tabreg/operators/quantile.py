"""Exact, linearly interpolated quantiles that never gather a whole column into one task.

Spark's ``percentile`` is exact but its final aggregation holds every distinct value of the column in
one task; ``percentile_approx`` scales but is approximate. This operator gets the exact pandas /
DuckDB ``quantile_cont`` answer in a distributed way, over the wide rows (nothing is copied per column or
probability):

1. one pass: per column count, min, max and a quantile sketch, read a little beside each p, which brackets each
   wanted quantile. Tasks sort their Arrow batches into summaries of ``accuracy`` points, which merge (and shrink
   again) as they stream in, one column after another;
2. a bracket that the sketch says holds over ``bracket_rows`` values is narrowed by a sketch of the values inside it, while
   that moves one of its ends (the rule is the same at every size);
3. one pass: per (column, p) the number of values below the bracket, and the values inside it, counted per distinct value
   in each task. A bracket that turns out not to hold the wanted ranks is widened to [min, max], and goes again from 2;
4. a window over the distinct values inside gives the exact order statistics at floor/ceil of (n-1)p.

The steps bring a few numbers per (column, p) to the driver; the result of step 4 is lazy.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabreg.cluster import arrow, written

ACCURACY = 10_000
HELD = 1 << 17  # values that a task holds of a column before it makes them a summary
BRACKET_ROWS = 1_000_000
ROUNDS = 8


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) pairs of the non-missing values (NULL and NaN are missing), as doubles."""
    stacked = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
        ])).alias("kv")
    ).select("kv.column", "kv.value")
    return stacked.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


class _Bracket:
    """A value interval meant to hold the order statistics ``klo`` and ``khi`` (0-based) of a column."""

    def __init__(self, column: str, p: float, n: int, low, high):
        self.column, self.p, self.n, self.low, self.high = column, p, n, low, high
        self.h = (n - 1) * p
        self.klo, self.khi = math.floor(self.h), math.ceil(self.h)
        self.min, self.max = low, high
        self.below, self.settled, self.crowded = 0, n == 0, 0.0

    def inside(self) -> Column:
        v = _value(self.column)
        return (v >= F.lit(self.low)) & (v <= F.lit(self.high))


def prune(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A summary of at most ``size`` points: distinct values in order, each with the weight up to it from the one before."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    if len(values) <= size:
        return values, weights
    upto = np.cumsum(weights)
    pick = np.searchsorted(upto, upto[-1] * (np.arange(1, size + 1) / size) * (1 - 1e-12))
    pick = np.unique(np.concatenate([[0], pick, [len(values) - 1]]))  # least and greatest stay
    return values[pick], np.diff(np.append(0.0, upto[pick]))


SUMMARY = "column int, n long, v binary, w binary"


def _summary_rows(held: dict[int, tuple]):
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([int(n) for n, _, _ in held.values()], pa.int64()),
             *(pa.array([x[i].tobytes() for x in held.values()], pa.binary()) for i in (1, 2))], ["column", "n", "v", "w"])


def _summaries(size: int):
    def run(batches):
        raw: dict[int, list] = {}
        held: dict[int, tuple] = {}

        def settle(i):
            v = np.concatenate(raw.pop(i))
            n, old, w = held.get(i, (0, np.zeros(0), np.zeros(0)))
            held[i] = (n + len(v), *prune(np.append(old, v), np.append(w, np.ones(len(v))), size))
        for batch in batches:
            for i, c in enumerate(batch.columns):
                v = c.drop_null().to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)]
                if len(v):
                    raw.setdefault(i, []).append(v)
                    if sum(map(len, raw[i])) >= HELD:
                        settle(i)
        for i in list(raw):
            settle(i)
        yield from _summary_rows(held)
    return run


def _merged(size: int):
    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for i, n, v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                v, w = (np.frombuffer(x.as_buffer(), float) for x in (v, w))
                if i in held:
                    m, v0, w0 = held[i]
                    held[i] = (n + m, *prune(np.append(v0, v), np.append(w0, w), size))
                else:
                    held[i] = (n, v, w)
        yield from _summary_rows(held)
    return run


def sketches(df: DataFrame, values: Sequence[Column], size: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(count, values, weights) of a summary per expression that has values; ``size`` points each at most."""
    slim = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    rows = (slim.transform(arrow, _summaries(size), SUMMARY).repartition("column").transform(arrow, _merged(size), SUMMARY)).collect()
    return {r["column"]: (r["n"], np.frombuffer(r["v"], float), np.frombuffer(r["w"], float)) for r in rows}


def _at(summary: tuple, p: float) -> float:
    _, v, w = summary
    upto = np.cumsum(w)
    return float(v[min(int(np.searchsorted(upto, p * upto[-1])), len(v) - 1)])


def _weigh(summary: tuple, low: float, high: float) -> float:
    """About how many values lie in [low, high]."""
    n, v, w = summary
    return float(w[np.searchsorted(v, low):np.searchsorted(v, high, "right")].sum())


def _narrowed(df: DataFrame, crowded: list[_Bracket], accuracy: int, margin: float) -> None:
    """Brackets of too many values, from a sketch of the values inside them (which also counts those below)."""
    low = df.agg(*[F.count_if(_value(b.column) < F.lit(b.low)).alias(f"b{i}") for i, b in enumerate(crowded)]).first()
    got = sketches(df, [F.when(b.inside(), _value(b.column)) for b in crowded], accuracy)
    for i, b in enumerate(crowded):
        n = got[i][0] if i in got else 0
        if not low[i] <= b.klo <= b.khi < low[i] + n:
            b.low, b.high = b.min, b.max
            continue
        before = b.low, b.high
        first, last = (b.klo - low[i]) / n - margin, (b.khi - low[i]) / n + margin
        b.low, b.high = (b.low if first <= 0 else _at(got[i], first)), (b.high if last >= 1 else _at(got[i], last))
        # ends that stay are common values (another sketch would end there too), and those are counted, not kept
        b.crowded = _weigh(got[i], b.low, b.high) if (b.low, b.high) != before else 0.0


VALUES = "pair int, v double, c long, below long"


def _inside(brackets: list[tuple[int, int, float, float]]):
    """Per task and bracket (pair, column, low, high): values below it, and the distinct ones inside with their counts."""
    def run(batches):
        below, held = {p: 0 for p, *_ in brackets}, {p: (np.zeros(0), np.zeros(0)) for p, *_ in brackets}
        raw: dict[int, list] = {p: [] for p, *_ in brackets}

        def settle(p):
            v, at = np.unique(np.concatenate([held[p][0], *raw[p]]), return_inverse=True)
            held[p] = v, np.bincount(at, np.concatenate([held[p][1], np.ones(sum(map(len, raw[p])))]), len(v))
            raw[p] = []
        for batch in batches:
            columns: dict[int, np.ndarray] = {}
            for p, c, low, high in brackets:
                if c not in columns:
                    v = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                    columns[c] = v[~np.isnan(v)]
                v = columns[c]
                below[p] += int((v < low).sum())
                raw[p].append(v[(v >= low) & (v <= high)])
                if sum(map(len, raw[p])) >= HELD:
                    settle(p)
        for p, *_ in brackets:
            settle(p)
            v, c = held[p]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v) + 1, p), pa.int32()), pa.array([None, *v.tolist()], pa.float64()),
                 pa.array(np.append(0, c).astype(np.int64)), pa.array(np.append(below[p], np.zeros(len(v))).astype(np.int64))],
                ["pair", "v", "c", "below"])
    return run


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int | None = None,
                    bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (column, p) with ``n`` and ``value`` (NULL if no values).

    ``accuracy`` is the sketch accuracy; it sizes the brackets and never changes the result.
    """
    acc = int(accuracy or ACCURACY)
    cols, probs = list(dict.fromkeys(cols)), list(dict.fromkeys(float(p) for p in probs))
    margin = 4.0 / acc
    near = lambda p: [min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin))]
    first = sketches(df, [_value(c) for c in cols], acc)
    pairs = []
    for i, c in enumerate(cols):
        for p in probs:
            known = first.get(i)
            b = _Bracket(c, p, known[0] if known else 0, float(known[1][0]) if known else None, float(known[1][-1]) if known else None)
            if not b.settled:
                low, high = near(p)
                b.low = b.min if low <= 0 else _at(known, low)
                b.high = b.max if high >= 1 else _at(known, high)
            pairs.append(b)
    names, tables, wide = {c: i for i, c in enumerate(cols)}, [], Counter()
    slim = df.select(*[_value(c).alias(f"v{i}") for i, c in enumerate(cols)])
    for b in pairs:
        if not b.settled:
            b.crowded = _weigh(first[names[b.column]], b.low, b.high)
    while open_ := [(i, b) for i, b in enumerate(pairs) if not b.settled]:
        for _ in range(ROUNDS):  # a bracket of one value is settled, however many there are
            if not (crowded := [b for _, b in open_ if b.crowded > bracket_rows and b.low < b.high]):
                break
            _narrowed(df, crowded, acc, margin)
        found = written(slim.transform(arrow, _inside([(i, names[b.column], b.low, b.high) for i, b in open_]), VALUES), "brackets")
        sums = {r["pair"]: r for r in found.groupBy("pair").agg(F.sum("below").alias("below"), F.sum("c").alias("c")).collect()}
        for i, b in open_:
            r = sums[i]
            if r["below"] <= b.klo <= b.khi < r["below"] + r["c"]:
                b.below, b.settled = r["below"], True
            elif wide[i] > 1:
                raise RuntimeError(f"the values of {b.column} changed between two reads")
            else:  # at the second time without a sketch
                b.low, b.high, b.crowded = b.min, b.max, 0.0 if wide[i] else float(b.n)
                wide[i] += 1
        tables.append(found.where(F.col("pair").isin([i for i, b in open_ if b.settled])))
    return _picked(df, pairs, tables)


def _picked(df: DataFrame, pairs: list[_Bracket], tables: list[DataFrame]) -> DataFrame:
    """Order statistics from the counted values inside the brackets, interpolated."""
    spark = df.sparkSession
    goals = F.broadcast(spark.createDataFrame(
        [(i, b.column, b.p, b.n, float(b.h), b.klo, b.khi, b.below) for i, b in enumerate(pairs)],
        "pair int, column string, p double, n bigint, h double, klo bigint, khi bigint, below bigint"))
    if not tables:
        return goals.select("column", "p", "n", F.lit(None).cast("double").alias("value"))
    counts = functools.reduce(DataFrame.unionByName, tables).where("v is not null").groupBy("pair", "v").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("pair").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).join(goals.select("pair", "klo", "khi", "below"), "pair")
    holds = lambda k: (F.col("below") + F.col("upto") - F.col("c") <= F.col(k)) & (F.col(k) < F.col("below") + F.col("upto"))
    found = ranked.groupBy("pair").agg(F.max(F.when(holds("klo"), F.col("v"))).alias("lo"),
                                       F.max(F.when(holds("khi"), F.col("v"))).alias("hi"))
    return goals.join(found, "pair", "left").select(
        "column", "p", "n", (F.col("lo") + (F.col("h") - F.col("klo")) * (F.col("hi") - F.col("lo"))).alias("value"))

"""Least squares, ridge and lasso from second moments: one aggregation per table, any number of fits from it.

Tasks reduce their rows to (count, means, centred cross products) per cell, which merge exactly. A cell is a
fold, or a (fold, size level) of a learning curve; the moments of any union of cells follow without another read. Missing
values enter as (value or 0, is missing) pairs, and categories as one dummy per level, so medians, scales and kept levels of
each training set are linear maps on its moments: every fold is prepared by its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.cluster import arrow
from tabreg.operators.prep import sorted_levels
from tabreg.operators.quantile import exact_quantiles

KINDS = ("ols", "ridge", "lasso")


@dataclass
class Moments:
    """Count, means and centred cross products of some columns."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> "Moments":
        mean = z.mean(0)
        return cls(float(len(z)), mean, (z - mean).T @ (z - mean))

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def mapped(self, a: np.ndarray) -> "Moments":
        return Moments(self.n, a @ self.mean, a @ self.cross @ a.T)


def total(cells: Sequence[Moments]) -> Moments:
    out = cells[0]
    for c in cells[1:]:
        out = out + c
    return out


ROWS = "cell int, n double, mean binary, cross binary"


def _rows(held: dict[int, Moments]):
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([m.n for m in held.values()]), pa.array([m.mean.tobytes() for m in held.values()], pa.binary()),
             pa.array([m.cross.tobytes() for m in held.values()], pa.binary())], ["cell", "n", "mean", "cross"])


def _reduce(batches):
    held: dict[int, Moments] = {}
    for batch in batches:
        if not len(batch):
            continue
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        z = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
        for c in np.unique(cell).tolist():
            m = Moments.of(z[cell == c])
            held[c] = held[c] + m if c in held else m
    yield from _rows(held)


def _merge(batches):
    held: dict[int, Moments] = {}
    for batch in batches:
        for c, n, mean, cross in zip(*(x.to_pylist() for x in batch.columns)):
            mean = np.frombuffer(mean)
            m = Moments(n, mean, np.frombuffer(cross).reshape(len(mean), -1))
            held[c] = held[c] + m if c in held else m
    yield from _rows(held)


def cell_moments(df: DataFrame, z: Column, cell: Column | None = None) -> dict[int, Moments]:
    """Moments of the array ``z`` per cell, in one read; cells x columns^2 numbers return."""
    sent = df.select((F.lit(0) if cell is None else cell).cast("int").alias("cell"), z.alias("z")).transform(arrow, _reduce, ROWS)
    got = sent.repartition("cell").transform(arrow, _merge, ROWS).collect()
    return {r["cell"]: Moments(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["cross"]).reshape(len(r["mean"]) // 8, -1)) for r in got}


def solve(m: Moments, kind: str, alpha: float = 0.0, rounds: int = 20_000, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """(weights, intercept) for moments whose last column is the label. Ridge: SSE + alpha |w|^2; lasso: SSE / 2n + alpha |w|_1."""
    xx, xy = m.cross[:-1, :-1], m.cross[:-1, -1]
    if kind == "lasso":
        w, diag = np.zeros(len(xy)), np.diag(xx) / m.n
        for _ in range(rounds):
            most = 0.0
            for j in np.flatnonzero(diag > 0):
                rho = (xy[j] - xx[j] @ w) / m.n + diag[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
                most, w[j] = max(most, abs(new - w[j])), new
            if most <= tol * max(1.0, np.abs(w).max(initial=0.0)):
                break
    elif kind == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
    else:
        scale = np.sqrt(np.diag(xx))
        scale[scale == 0] = 1.0
        w = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-13)[0] / scale
    return w, float(m.mean[-1] - w @ m.mean[:-1])


class MomentRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Linear regression (``ols``, ``ridge``, ``lasso``) solved from one aggregation."""

    kind = Param(Params._dummy(), "kind", "ols, ridge or lasso", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", kind="ols", alpha=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", kind="ols", alpha=0.0)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "LinearModel":
        if self.getOrDefault(self.kind) not in KINDS:
            raise ValueError("kind must be one of " + ", ".join(KINDS))
        z = F.concat(vector_to_array(self.getFeaturesCol()), F.array(F.col(self.getLabelCol()).cast("double")))
        cells = cell_moments(df, z)
        if not cells:
            raise ValueError("no rows to fit")
        w, b = solve(cells[0], self.getOrDefault(self.kind), self.getOrDefault(self.alpha))
        return LinearModel()._set(weights=w.tolist(), intercept_=b, featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


UNROLLED = 64  # terms of a prediction that are written out as one expression


class LinearModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    intercept_ = Param(Params._dummy(), "intercept_", "intercept", TypeConverters.toFloat)

    @property
    def coefficients(self):
        return Vectors.dense(self.getOrDefault(self.weights))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.intercept_)

    def _transform(self, df: DataFrame) -> DataFrame:
        x, weights = vector_to_array(self.getFeaturesCol()), [float(v) for v in self.getOrDefault(self.weights)]
        if len(weights) <= UNROLLED:  # written out, it is compiled; lambdas are interpreted row by row
            dot = F.lit(self.intercept)
            for i, v in enumerate(weights):
                dot = dot + F.get(x, F.lit(i)) * F.lit(v)
        else:
            w = F.array(*[F.lit(v) for v in weights])
            dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(self.intercept), lambda s, v: s + v)
        return df.withColumn(self.getPredictionCol(), dot)


# ---- folds and sizes from cells ------------------------------------------------------------------

class Design:
    """Raw columns as one array per row: per numeric column (value or 0, is missing), a dummy per level, the label."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], interaction, label: str):
        self.numeric = [*numeric, *([interaction[0]] if interaction else [])]
        self.label, self.interaction = label, interaction
        found = sorted_levels(train, categorical) if categorical else {}
        self.levels = [(c, v) for c in categorical for v in found[c]]

    def value(self, c: str) -> Column:
        if self.interaction and c == self.interaction[0]:
            v = self.value(self.interaction[1]) * self.value(self.interaction[2])
        else:
            v = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(v), v)

    def array(self) -> Column:
        return F.array(*[x for c in self.numeric for x in (F.coalesce(self.value(c), F.lit(0.0)), self.value(c).isNull().cast("double"))],
                       *[F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("double"), F.lit(0.0)) for c, v in self.levels],
                       F.col(self.label).cast("double"))

    def prepared(self, m: Moments, medians: dict[str, float], scaled: bool) -> np.ndarray:
        """The map from raw arrays to (features, label) that these training moments call for."""
        k, rows = len(self.numeric), []
        for i, c in enumerate(self.numeric):
            a = np.zeros(len(m.mean))
            a[2 * i], a[2 * i + 1] = 1.0, medians.get(c, 0.0)
            if scaled:
                sd = np.sqrt(max(float(a @ m.cross @ a), 0.0) / m.n)
                a = a / (sd if sd > 0 else 1.0)
            rows.append(a)
        seen: set[str] = set()
        for j, (c, _) in enumerate(self.levels):
            if m.mean[2 * k + j] > 0:  # this training set has the level; its first one is dropped
                if c in seen:
                    rows.append(np.eye(len(m.mean))[2 * k + j])
                seen.add(c)
        rows.append(np.eye(len(m.mean))[-1])
        return np.stack(rows)

    def medians(self, rows: DataFrame, m: Moments) -> dict[str, float]:
        """Medians of the columns with missing values in these training rows (others need none)."""
        gaps = [c for i, c in enumerate(self.numeric) if m.mean[2 * i + 1] > 0]
        if not gaps:
            return {}
        named = rows.select(*[self.value(c).alias(c) for c in gaps])
        return {r["column"]: r["value"] or 0.0 for r in exact_quantiles(named, gaps, [0.5]).collect()}


def fitted(design: Design, m: Moments, medians: dict[str, float], kind: str, alpha: float) -> tuple[np.ndarray, float]:
    """(weights on raw arrays without the label, intercept) of the regression on the prepared features."""
    a = design.prepared(m, medians, scaled=True)
    w, b = solve(m.mapped(a), kind, alpha)
    return (w @ a[:-1])[:-1], b


def sse_r2(m: Moments, w: np.ndarray, b: float) -> tuple[float, float | None]:
    """Squared error and R2 of a model on the rows behind some moments."""
    v = np.append(-w, 1.0)
    sse = max(float(v @ m.cross @ v), 0.0) + m.n * float(v @ m.mean - b) ** 2
    sst = float(m.cross[-1, -1])
    return sse, (1.0 - sse / sst if sst > 0 else None)


def _absolute_errors(models: dict[int, tuple[np.ndarray, float]]):
    def run(batches):
        held = {c: 0.0 for c in models}
        for batch in batches:
            if not len(batch):
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            z = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
            for c, (w, b) in models.items():
                at = cell == c
                held[c] += float(np.abs(z[at, -1] - z[at, :-1] @ w - b).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()))], ["cell", "e"])
    return run


def fold_scores(train: DataFrame, fold: Column, folds: int, numeric, categorical, interaction, label: str, kind: str,
                alpha: float) -> list[tuple]:
    """(fold, n, mae, mse, rmse, r2) per fold: one read for all fits and squared errors, one for the absolute errors."""
    design = Design(train, numeric, categorical, interaction, label)
    cells = cell_moments(train, design.array(), fold)
    models = {}
    for f in sorted(cells):
        rest = [m for c, m in cells.items() if c != f]
        if not rest:
            raise ValueError("one fold holds all rows")
        m = total(rest)
        models[f] = fitted(design, m, design.medians(train.where(fold != f), m), kind, alpha)
    sent = train.select(fold.cast("int").alias("cell"), design.array().alias("z")).transform(arrow, _absolute_errors(models), "cell int, e double")
    mae = {r["cell"]: r["e"] for r in sent.groupBy("cell").agg(F.sum("e").alias("e")).collect()}  # a row per fold
    out = []
    for f, (w, b) in models.items():
        sse, r2 = sse_r2(cells[f], w, b)
        n = cells[f].n
        out.append((f, int(n), mae[f] / n, sse / n, float(np.sqrt(sse / n)), r2))
    return out


def curve_scores(train: DataFrame, fold: Column, folds: int, level: Column, levels: int, numeric, categorical, interaction, label: str,
                 kind: str, alpha: float) -> list[tuple]:
    """(level, fold, n_train, train R2, validation R2): sizes are nested, level l trains on the rows of levels 0..l."""
    design = Design(train, numeric, categorical, interaction, label)
    cells = cell_moments(train, design.array(), fold * levels + level)
    out = []
    for top in range(levels):
        for f in range(folds):
            rest = [m for c, m in cells.items() if c // levels != f and c % levels <= top]
            held = [m for c, m in cells.items() if c // levels == f]
            if not rest or not held:
                continue
            m = total(rest)
            w, b = fitted(design, m, design.medians(train.where((fold != f) & (level <= top)), m), kind, alpha)
            out.append((top, f, int(m.n), sse_r2(m, w, b)[1], sse_r2(total(held), w, b)[1]))
    return out

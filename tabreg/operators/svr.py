"""Support vector regression with a Gaussian kernel, for tables of any size.

The kernel ``exp(-gamma |x - z|^2)`` is replaced by random Fourier features (``components`` cosines of random
projections), so the model is linear in a fixed number of features and no pairs of rows are looked at. The primal

    |w|^2 / 2 + C sum max(0, |y - w f(x) - b| - epsilon)

is solved by Newton steps on a smoothed loss (quadratic within ``delta`` beyond epsilon), with ``delta`` shrinking
from the labels' spread towards zero. A step is one aggregation: tasks send the objective, gradient and Hessian of their
blocks, added up as they stream in; its size is that of the features, whatever the rows. Tables of ``localRows`` rows at most
run the same steps in one task. Larger ones are held in partitions of ``PART_BYTES`` or so, start at the optimum of about
``START_ROWS`` rows, drawn by all tasks and solved by one, and go
straight to the last ``delta``, whose optimum (over all rows) is one and the same from any start; should the steps not suffice there,
they are run from zero through all of ``SMOOTH``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.cluster import BLOCK_TABLE, arrow, ship, written
from tabreg.operators.forest import _open_block, blocks

LOCAL_ROWS = 200_000
START_ROWS = 1 << 15
PART_BYTES = 32 << 20  # rows that a task holds at once, however many there are
SLICE = 2048  # rows whose features are held at once, small enough for a core's cache
SMOOTH = (1.0, 0.3, 0.1, 0.03, 0.01)  # delta in units of the labels' spread
ADDERS = 16


class Cosines:
    """Random Fourier features of a Gaussian kernel, and a constant for the intercept."""

    def __init__(self, width: int, components: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0.0, np.sqrt(2.0 * gamma), (components, width))
        self.b = rng.uniform(0.0, 2 * np.pi, components)[:, None]

    def __call__(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        if out is None:
            out = np.empty((len(self.b) + 1, x.shape[1]))
        np.matmul(self.w, x, out=out[:-1])
        out[:-1] += self.b
        np.cos(out[:-1], out=out[:-1])
        out[:-1] *= np.sqrt(2.0 / len(self.b))
        out[-1] = 1.0
        return out


def loss(r: np.ndarray, epsilon: float, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed epsilon-insensitive loss of residuals, its slope and curvature."""
    over = np.abs(r) - epsilon
    inner, outer = (over > 0) & (over <= delta), over > delta
    value = np.where(inner, over ** 2 / (2 * delta), np.where(outer, over - delta / 2, 0.0))
    slope = np.sign(r) * np.where(inner, over / delta, outer.astype(float))
    return value, slope, inner / delta


def _terms(x: np.ndarray, y: np.ndarray, features: Cosines, theta: np.ndarray, center: float, epsilon: float, delta: float):
    """(loss, gradient, Hessian) sums over some rows, in slices."""
    k = len(theta)
    total, grad, hess = 0.0, np.zeros(k), np.zeros((k, k))
    held = np.empty((k, min(SLICE, len(y))))
    for a in range(0, len(y), SLICE):
        part = y[a:a + SLICE]
        f = features(x[:, a:a + SLICE], held if len(part) == held.shape[1] else None)
        value, slope, bend = loss(part - center - theta @ f, epsilon, delta)
        total += float(value.sum())
        grad -= f @ slope
        some = bend > 0
        hess += (f[:, some] * bend[some]) @ f[:, some].T
    return total, grad, hess


def newton(evaluate: Callable, width: int, c: float, spread: float, epsilon: float, steps: int, tol: float = 1e-7,
           start: np.ndarray | None = None) -> np.ndarray:
    """Minimise |w|^2 / 2 + c * loss over theta = (w, b); ``evaluate(theta, delta)`` gives the loss's sums. With ``start`` only the
    last delta is solved, unless that does not end within ``steps``."""
    theta, ridge = np.zeros(width) if start is None else start, np.ones(width)
    ridge[-1] = 0.0
    whole = lambda t, s: 0.5 * float(ridge @ t ** 2) + c * s[0]
    for share in SMOOTH if start is None else SMOOTH[-1:]:
        delta = max(share * spread, 1e-12)
        at = evaluate(theta, delta)
        for _ in range(steps):
            grad = ridge * theta + c * at[1]
            hess = np.diag(ridge) + c * at[2]
            hess[np.diag_indices(width)] += 1e-9 * (1.0 + np.trace(hess) / width)
            step = np.linalg.solve(hess, -grad)
            value, fall, length = whole(theta, at), float(grad @ step), 1.0
            if -fall <= tol * max(1.0, abs(value)):
                break
            while True:
                new = evaluate(theta + length * step, delta)
                if whole(theta + length * step, new) <= value + 1e-4 * length * fall or length < 1e-6:
                    break
                length /= 2
            theta, at = theta + length * step, new
        else:
            if start is not None:
                return newton(evaluate, width, c, spread, epsilon, steps, tol)
    return theta


def _add(batches):
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            part = pickle.loads(raw)
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["s"])


def _summed(df: DataFrame, one: Callable):
    """Sum of ``one(x, y)`` (a tuple of numbers or arrays) over all blocks: per task, then by a few adders, then once."""
    def run(batches):
        total = None
        for batch in batches:
            for i in range(len(batch)):
                _, x, y = _open_block(batch, i)
                part = one(x, y)
                total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["s"])
    sent = df.transform(arrow, run, "s binary").repartition(ADDERS).transform(arrow, _add, "s binary").collect()  # ADDERS rows at most
    parts = [pickle.loads(r["s"]) for r in sent]
    return tuple(sum(p[i] for p in parts[1:]) + parts[0][i] if len(parts) > 1 else parts[0][i] for i in range(len(parts[0])))


def _drawn(share: float, seed: int):
    """About ``share`` of each block's rows."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block, x, y = _open_block(batch, i)
                take = np.random.default_rng([seed, block]).random(len(y)) < share
                if take.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([int(take.sum())], pa.int32()), pa.array([x[:, take].tobytes()], pa.binary()),
                         pa.array([y[take].tobytes()], pa.binary())], ["block", "n", "x", "y"])
    return run


def dealt_out(data: DataFrame, rows: int, width: int) -> DataFrame:
    """Blocks dealt to all cores, however few files the table came in, ``PART_BYTES`` or so to a partition."""
    parts = max(2 * data.sparkSession.sparkContext.defaultParallelism, -(-rows * (width + 1) * 8 // PART_BYTES))
    return data.drop("rid").repartition(parts, "block")


def gathered(held: DataFrame, share: float, seed: int) -> DataFrame:
    """Drawn rows in one partition: every task draws from its own blocks, and only drawn rows are moved."""
    return held.transform(arrow, _drawn(share, seed), held.schema).repartition(1)


class KernelSVR(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Epsilon-insensitive regression on random Fourier features. ``gamma`` -1: 1 / (features x variance of all inputs)."""

    c = Param(Params._dummy(), "c", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this cost nothing", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width; -1: from the inputs' variance", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "random Fourier features", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "Newton steps per smoothing level", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows that one task may fit", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the projections", TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, gamma=-1.0, components=256,
                 steps=15, localRows=LOCAL_ROWS, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, gamma=-1.0, components=256,
                         steps=15, localRows=LOCAL_ROWS, seed=42)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "KernelSVRModel":
        get = self.getOrDefault
        data = written(blocks(df, self.getFeaturesCol(), self.getLabelCol()), "svr-rows", **BLOCK_TABLE)
        if data.isEmpty():
            raise ValueError("no rows to fit")
        n = data.agg(F.sum("n")).first()[0]
        few, one = n <= self.getOrDefault(self.localRows), data.select("n", F.length("x").alias("bytes")).first()
        held = data if few else dealt_out(data, n, one["bytes"] // 8 // one["n"]).persist()
        n, cells, sx, sxx, sy, syy = _summed(held, lambda x, y: (len(y), x.size, x.sum(), (x ** 2).sum(), y.sum(), (y ** 2).sum()))
        width = cells // n
        var = max(sxx / cells - (sx / cells) ** 2, 0.0)
        gamma = get(self.gamma) if get(self.gamma) > 0 else 1.0 / (width * var) if var > 0 else 1.0
        center, spread = sy / n, float(np.sqrt(max(syy / n - (sy / n) ** 2, 0.0))) or 1.0
        components, c, epsilon, steps, seed = get(self.components), get(self.c), get(self.epsilon), get(self.steps), get(self.seed)
        features = Cosines(width, components, gamma, seed)

        def fitted(rows: DataFrame, c: float) -> np.ndarray | None:
            """The optimum of rows that one task may hold, in one partition."""
            def run(batches):
                rows = [_open_block(b, i) for b in batches for i in range(len(b))]
                if rows:
                    rows.sort(key=lambda r: r[0])
                    x, y = np.concatenate([r[1] for r in rows], 1), np.concatenate([r[2] for r in rows])
                    theta = newton(lambda t, d: _terms(x, y, features, t, center, epsilon, d), components + 1, c, spread, epsilon, steps)
                    yield pa.RecordBatch.from_arrays([pa.array([theta.tobytes()], pa.binary())], ["theta"])
            got = rows.transform(arrow, run, "theta binary").first()
            return np.frombuffer(got["theta"]) if got else None

        if few:
            theta = fitted(held.coalesce(1), c)
        else:
            share = min(1.0, START_ROWS / n)
            theta = newton(lambda t, d: _summed(held, lambda x, y: _terms(x, y, features, t, center, epsilon, d)), components + 1, c,
                           spread, epsilon, steps, start=fitted(gathered(held, share, seed), c / share))
            held.unpersist()
        return KernelSVRModel()._set(theta=theta.tolist(), center=float(center), width=int(width), gamma=float(gamma), seed=int(seed),
                                     featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class KernelSVRModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The weights; the projections follow from the seed."""

    theta = Param(Params._dummy(), "theta", "weights and intercept", TypeConverters.toListFloat)
    center = Param(Params._dummy(), "center", "mean label", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "input features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the projections", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        get = self.getOrDefault
        theta, center = np.array(get(self.theta)), get(self.center)
        features = Cosines(get(self.width), len(theta) - 1, get(self.gamma), get(self.seed))

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T
            return pa.array(center + theta @ features(flat))
        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))

"""Support vector regression: the smoothed loss, the optimum, the kernel, and the two ways to run."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabreg.operators import svr as S


def test_loss_slope_and_curvature():
    r = np.linspace(-3, 3, 601) + 1e-4
    value, slope, bend = S.loss(r, 0.5, 0.7)
    h = 1e-6
    assert np.allclose(slope, (S.loss(r + h, 0.5, 0.7)[0] - S.loss(r - h, 0.5, 0.7)[0]) / (2 * h), atol=1e-5)
    inner = (np.abs(r) > 0.5) & (np.abs(r) <= 1.2)
    assert np.allclose(bend[inner], 1 / 0.7) and not bend[~inner].any()
    exact = np.maximum(np.abs(r) - 0.5, 0)
    assert np.all(value <= exact + 1e-12) and np.all(exact - value <= 0.35 + 1e-12)


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 40))
    f = S.Cosines(3, 20_000, 0.4, 1)(x)[:-1]
    want = np.exp(-0.4 * ((x[:, :, None] - x[:, None, :]) ** 2).sum(0))
    assert np.abs(f.T @ f - want).max() < 0.05


def test_newton_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (1, 150))
    y = np.sin(2 * x[0]) + rng.normal(0, 0.1, 150)
    f = S.Cosines(1, 12, 1.0, 3)
    theta = S.newton(lambda t, d: S._terms(x, y, f, t, 0.0, 0.05, d), 13, 10.0, y.std(), 0.05, 30)

    def objective(t):
        return 0.5 * (t[:-1] ** 2).sum() + 10.0 * np.maximum(np.abs(y - t @ f(x)) - 0.05, 0).sum()
    best = objective(theta)
    t, low = theta.copy(), best
    for i in range(20_000):  # a long plain search around it finds next to nothing better
        trial = t + rng.normal(0, 0.02 / (1 + i / 2000), 13)
        if objective(trial) < low:
            t, low = trial, objective(trial)
    assert low > best * 0.995


def frame(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = 50 + 10 * np.sin(x[:, 0]) + 3 * x[:, 1]
    return spark.createDataFrame([(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", "features", "label"]), y


def test_small_and_large_ways_agree(spark, scratch):
    df, y = frame(spark)
    df = df.repartition(3, "id").persist()
    make = lambda local: S.KernelSVR(c=100.0, epsilon=0.05, components=40, localRows=local).fit(df)
    a, b = make(1000), make(10)
    assert np.allclose(a.getOrDefault(a.theta), b.getOrDefault(b.theta), rtol=1e-4, atol=1e-4)
    p = np.array([r.prediction for r in a.transform(df).orderBy("id").collect()])
    assert 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.97
    a.write().overwrite().save(f"{scratch}/svr")
    back = S.KernelSVRModel.load(f"{scratch}/svr")
    assert np.allclose(p, [r.prediction for r in back.transform(df).orderBy("id").collect()])


def test_flat_inputs_and_empty_tables(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 4.0), (Vectors.dense([1.0]), 4.0)], ["features", "label"])
    assert [r.prediction for r in S.KernelSVR(components=4).fit(df).transform(df).collect()] == pytest.approx([4.0, 4.0])
    with pytest.raises(ValueError, match="no rows"):
        S.KernelSVR().fit(df.where("label < 0"))

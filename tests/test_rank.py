"""Golden check: the published comparison table (FIXTURES.md §3) must give the published scores."""
import pytest
from pyspark.sql import functions as F

from tabreg.operators.rank import deployment_score, evidence_tier, minmax_scaled, rank_models

# Published results (algorithm, r2, rmse, mae, cv_r2_mean, cv_r2_std, r2_gap, score,
# generalisation, stability) from FIXTURES.md §3.
PUBLISHED = [
    ("CatBoost", 0.9988009547635476, 0.35352276195785715, 0.25706123678850257, 0.9985884731481185,
     0.00030811199455376613, 0.0008889791247453926, 99.09091247367279, "Strong", "Very stable"),
    ("XGBoost", 0.9986236104846126, 0.378765378903583, 0.2737935639666272, 0.9985436119786119,
     0.00022735077985072612, 0.0010473906385738418, 98.5888772565627, "Strong", "Very stable"),
    ("LightGBM", 0.9981348060184712, 0.44092182900064086, 0.3243754589408799, 0.9969297684048574,
     0.0006959430308525539, 0.0003687501114417735, 98.04725262029183, "Strong", "Very stable"),
    ("Gradient Boosting", 0.9975890534843315, 0.5012950146426812, 0.364531881384632, 0.9978490760920049,
     0.0003699716183612855, 0.0010871638660061578, 96.6194301359155, "Strong", "Very stable"),
    ("Random Forest", 0.9976937226939964, 0.49029263462406625, 0.35331233766233444, 0.9972706195358876,
     0.0003278707861228198, 0.0020047817378804345, 95.29424466752137, "Strong", "Very stable"),
    ("Extra Trees", 0.9975547144179847, 0.5048523604065649, 0.3504989177489146, 0.9976317615940665,
     0.0001388942367220303, 0.0024452832971536553, 94.72165307287885, "Strong", "Very stable"),
    ("Decision Tree", 0.9963553734529637, 0.6163481753663407, 0.416856601731602, 0.9964133337696351,
     0.0007538121984788071, 0.003422920370968252, 90.97836563117463, "Strong", "Very stable"),
    ("SVR", 0.992467422810332, 0.8860768556573269, 0.6507661438505657, 0.9810993835726123,
     0.00669606285950249, 0.0009041297308266527, 82.25160387849188, "Strong", "Stable"),
    ("AdaBoost", 0.9527544601862242, 2.2191160027862815, 1.7413338508362857, 0.9580933472161067,
     0.007041925991584736, 0.004803188491523613, 39.060676542286096, "Strong", "Stable"),
    ("Linear Regression", 0.9190551196455038, 2.9046532192531616, 2.1536603393966125, 0.9220319157551708,
     0.008070767292441307, 0.005262538081265533, 7.387196548115776, "Strong", "Stable"),
    ("Lasso Regression", 0.9183974352098443, 2.916429630918014, 2.1166985976255, 0.9211768885128526,
     0.0091151270106753, 0.005117785269161068, 6.46116396368318, "Strong", "Stable"),
    ("Ridge Regression", 0.9123724742383298, 3.0221768332401684, 2.181400408857973, 0.9150866662755697,
     0.010426597808566446, 0.005334514675263247, 0.0, "Strong", "Stable"),
]
COLS = "algorithm string, r2 double, rmse double, mae double, cv_r2_mean double, cv_r2_std double, " \
       "r2_gap double, score double, generalisation_ref string, stability_ref string"


def test_published_scores_bands_and_rank(spark):
    df = spark.createDataFrame(PUBLISHED, COLS)
    out = rank_models(df).orderBy("deployment_rank").collect()
    assert [r["algorithm"] for r in out] == [p[0] for p in PUBLISHED]
    for r in out:
        assert r["deployment_score"] == pytest.approx(r["score"], abs=1e-6)
        assert r["generalisation"] == r["generalisation_ref"]
        assert r["stability"] == r["stability_ref"]
    by = {r["algorithm"]: r["complexity"] for r in out}
    assert by["CatBoost"] == "High" and by["SVR"] == "Medium" and by["Ridge Regression"] == "Low"


def test_partitioned_pools_rank_independently(spark):
    df = spark.createDataFrame(PUBLISHED, COLS)
    two = df.withColumn("pool", F.lit("a")).unionByName(df.withColumn("pool", F.lit("b")))
    out = rank_models(two, partition_by=["pool"]).collect()
    for r in out:
        assert r["deployment_score"] == pytest.approx(r["score"], abs=1e-6)


def test_span_zero_gives_one_and_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5)], "algorithm string, r2 double")
    assert [r["n"] for r in minmax_scaled(df, "r2", "n").collect()] == [1.0, 1.0]
    tie = spark.createDataFrame([(n, 0.9, 1.0, 1.0, 0.9, 0.01, 0.0) for n in ("zeta", "alpha")],
                                "algorithm string, r2 double, rmse double, mae double, cv_r2_mean double, "
                                "cv_r2_std double, r2_gap double")
    ranked = rank_models(tie).orderBy("deployment_rank").collect()
    assert [r["algorithm"] for r in ranked] == ["alpha", "zeta"]
    assert all(r["deployment_score"] == 100.0 for r in ranked)


@pytest.mark.parametrize("gap,label", [(0.01, "Strong"), (-0.03, "Good"), (0.07, "Moderate"), (0.0701, "Possible overfitting")])
def test_generalisation_band_edges(spark, gap, label):
    from tabreg.functions.bands import band_generalisation
    df = spark.createDataFrame([(gap,)], "g double")
    assert df.select(band_generalisation(F.col("g"))).first()[0] == label


@pytest.mark.parametrize("std,label", [(0.005, "Very stable"), (0.015, "Stable"), (0.035, "Moderate"), (0.04, "Variable")])
def test_stability_band_edges(spark, std, label):
    from tabreg.functions.bands import band_stability
    df = spark.createDataFrame([(std,)], "s double")
    assert df.select(band_stability(F.col("s"))).first()[0] == label


def test_skew_band_right_closed_vs_target_shape_left_closed(spark):
    from tabreg.functions.bands import band_demand, band_skew, band_target_shape
    df = spark.createDataFrame([(0.5,), (1.0,)], "x double")
    assert [r[0] for r in df.select(band_skew(F.col("x"))).collect()] == ["Approximately symmetric", "Moderately skewed"]
    assert [r[0] for r in df.select(band_target_shape(F.col("x"))).collect()] == ["moderately skewed", "highly skewed"]
    d = spark.createDataFrame([(15.0,), (30.0,), (40.0,), (14.99,)], "x double")
    assert [r[0] for r in d.select(band_demand(F.col("x"))[0]).collect()] == [
        "Moderate heating demand", "Elevated heating demand", "High heating demand", "Low heating demand"]


def test_evidence_tier(spark):
    df = spark.createDataFrame(PUBLISHED, COLS)
    out = {r["algorithm"]: r["tier"] for r in evidence_tier(deployment_score(df)).collect()}
    assert out["CatBoost"] == "leader" and out["XGBoost"] == "leader" and out["LightGBM"] == "leader"
    assert out["Decision Tree"] == "strong" and out["AdaBoost"] == "lower"

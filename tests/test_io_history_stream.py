import os

import pytest
from pyspark.sql import functions as F

from tabreg.operators import history as H
from tabreg.sources import io
from tabreg.sources.tables import load

from conftest import SF_SMALL


def test_scan_csv_first_existing_strips_names_and_rejects_empty(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w") as f:
        f.write(" a , b\n1,2\n3,4\n")
    df = io.scan_csv(spark, [os.path.join(scratch, "missing.csv"), path])
    assert df.columns == ["a", "b"] and df.count() == 2
    empty = os.path.join(scratch, "e.csv")
    with open(empty, "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        io.scan_csv(spark, empty)


def test_scan_batch_keeps_extra_columns_and_requires(spark, scratch):
    path = os.path.join(scratch, "batch.csv")
    with open(path, "w") as f:
        f.write("x,note\n1.5,hello\n")
    df = io.scan_batch(spark, path, ["x"])
    assert df.first()["x"] == 1.5 and df.first()["note"] == "hello"
    with pytest.raises(ValueError, match="y"):
        io.scan_batch(spark, path, ["x", "y"])


def test_json_sink_rejects_non_finite_and_scan_json(spark, scratch):
    bad = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(ValueError, match="v"):
        io.sink_json(bad, os.path.join(scratch, "bad"))
    good = spark.createDataFrame([(1.0, "a")], "v double, s string")
    io.sink_json(good, os.path.join(scratch, "good"))
    back = io.scan_json(spark, os.path.join(scratch, "good"), schema=good.schema)
    assert back.first()["s"] == "a"
    assert io.scan_json(spark, os.path.join(scratch, "nope.json"), required=False) is None
    with pytest.raises(FileNotFoundError):
        io.scan_json(spark, os.path.join(scratch, "nope.json"))
    io.sink_csv(good, os.path.join(scratch, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(scratch, "csv")).count() == 1


def test_history_append_latest_clear_delete(spark, scratch):
    e = load(spark, SF_SMALL, "events")
    rec = H.history_records(e, "event_id", "user_id", "ts", "value", F.col("event_type"), ["event_type", "value"])
    path = os.path.join(scratch, "history")
    H.history_append(rec, path)
    h = H.history_read(spark, path)
    assert h.count() == e.count()
    assert h.where("inputs_json is null").count() == 0
    latest = H.history_latest(h, 5000)
    assert latest.count() == h.count()
    with pytest.raises(ValueError, match="99999"):
        H.history_latest(h, 99999)
    assert H.history_latest(h, 99999, most=100_000).count() == h.count()
    one = H.history_latest(h, 2, user_id=8).collect()
    ids = sorted((r["id"] for r in h.where("user_id = 8").collect()), reverse=True)[:2]
    assert [r["id"] for r in one] == ids
    users = spark.createDataFrame([(8,)], "user_id long")
    remaining, deleted = H.history_clear(h, users)
    n8 = h.where("user_id = 8").count()
    assert remaining.count() == h.count() - n8 and deleted.first()["deleted"] == n8
    first = h.where("user_id = 8").select("id", "user_id").limit(1)
    wrong = first.withColumn("user_id", F.col("user_id") + 1)
    rem1, gone1 = H.history_delete_one(h, first)
    rem2, gone2 = H.history_delete_one(h, wrong)
    assert gone1.count() == 1 and gone2.count() == 0 and rem2.count() == h.count()


def test_upsert_inserts_updates_and_rejects_duplicates(spark):
    users = spark.createDataFrame([(1, "Ann", "ann@x.io", None), (2, "bob", "bob@x.io", None)],
                                  "id int, username string, email string, last_login_at string")
    batch = spark.createDataFrame([(1, None, None, "2024-01-02"), (3, "ANN", "new@x.io", "2024-01-03"),
                                   (4, "cy", "cy@x.io", None), (5, "Cy", "c2@x.io", None)],
                                  "id int, username string, email string, last_login_at string")
    out = {r["id"]: r["action"] for r in H.dimension_upsert(users, batch, "id", "username", "email",
                                                             ["last_login_at"]).collect()}
    assert out == {1: "updated", 2: "unchanged", 3: "rejected", 4: "inserted", 5: "rejected"}


def test_stream_scoring_appends_history(spark, scratch):
    from tabreg.operators import models as M
    from tabreg.sources.tables import CATEGORICAL_FEATURES, INTERACTION, NUMERIC_FEATURES, line_charge_split
    from tabreg.streaming.scoring import append_history_stream, history_stream, score_stream
    data = line_charge_split(spark, SF_SMALL)
    model, _ = M.fit_candidate(M.catalogue(0.02)["Linear Regression"], data.where("split = 'train'"),
                               NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, "charge")
    src = os.path.join(scratch, "in")
    batch = load(spark, SF_SMALL, "lineitem").limit(50)
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    scored = score_stream(model, stream)
    rows = history_stream(scored, "l_orderkey", "l_suppkey", "l_shipdate", ["l_quantity"], "Linear Regression")
    q = append_history_stream(rows, os.path.join(scratch, "hist"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(scratch, "hist")).count() == 50


def test_workflow_train_then_evaluate(spark, scratch):
    from tabreg.operators import models as M
    from tabreg.sources.tables import CATEGORICAL_FEATURES, INTERACTION, NUMERIC_FEATURES, line_charge
    from tabreg import workflow as W
    lc = line_charge(spark, SF_SMALL)
    small_pool = {k: v for k, v in M.catalogue(0.02).items() if k in ("Linear Regression", "Decision Tree")}
    orig = M.catalogue
    M.catalogue = lambda rounds=1.0, seed=42: small_pool  # keep the smoke test short
    try:
        ranked = W.train(lc, "charge", "row_key", NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, scratch,
                         folds=2)
        assert ranked.count() == 2
        metrics = W.evaluate(lc, "charge", "row_key", NUMERIC_FEATURES, CATEGORICAL_FEATURES, INTERACTION, scratch,
                             os.path.join(scratch, "model"), folds=2, algorithm="Linear Regression")
        assert metrics.first()["r2"] > 0.9
    finally:
        M.catalogue = orig
    for sub in ("model_comparison", "model_metadata", "unseen_test_predictions", "evaluation_metrics",
                "learning_curve", "cross_validation_scores", "permutation_importance"):
        assert os.path.isdir(os.path.join(scratch, sub)), sub


USERS = "id long, name string, mail string, seen string"


def test_upsert_rejected_rows_claim_nothing(spark):
    users = spark.createDataFrame([(1, "Ann", "ann@x.io", None)], USERS)
    batch = spark.createDataFrame([(2, "ANN", "bob@x.io", None), (3, "Bob", "bob@x.io", None), (4, "bob", "c@x.io", None),
                                   (5, None, None, None), (6, None, None, None)], USERS)
    got = {r["id"]: r["action"] for r in H.dimension_upsert(users, batch, "id", "name", "mail", ["mail"]).collect()}
    assert got == {1: "unchanged", 2: "rejected", 3: "inserted", 4: "rejected", 5: "inserted", 6: "inserted"}


def test_upsert_keeps_emails_of_updates_unique(spark):
    users = spark.createDataFrame([(1, "Ann", "ann@x.io", None), (2, "Bob", "bob@x.io", None), (3, "Cy", None, None)], USERS)
    batch = spark.createDataFrame([(2, None, "ANN@x.io", "now"), (3, None, "new@x.io", None), (9, "Di", "NEW@x.io", None)], USERS)
    rows = {r["id"]: r for r in H.dimension_upsert(users, batch, "id", "name", "mail", ["mail", "seen"]).collect()}
    assert rows[2]["action"] == "rejected" and rows[2]["mail"] == "bob@x.io" and rows[2]["seen"] is None
    assert rows[3]["action"] == "updated" and rows[3]["mail"] == "new@x.io" and rows[9]["action"] == "rejected"


def test_upsert_settles_chains(spark):
    users = spark.createDataFrame([], USERS)
    batch = spark.createDataFrame([(i, f"n{i // 2}", f"m{(i + 1) // 2}", None) for i in range(8)], USERS)
    taken, want = set(), {}
    for i in range(8):  # in key order, a row is taken if both its values are free
        mine = {f"n{i // 2}", f"m{(i + 1) // 2}"}
        want[i] = "rejected" if mine & taken else "inserted"
        taken |= mine if want[i] == "inserted" else set()
    got = {r["id"]: r["action"] for r in H.dimension_upsert(users, batch, "id", "name", "mail", []).collect()}
    assert got == want


def test_orphan_check_counts_null_keys_as_orphans(spark):
    facts = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert tuple(H.orphan_check(facts, spark.createDataFrame([(1,), (None,)], "id long"), "k", "id").first()) == (2, 2)

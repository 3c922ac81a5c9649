"""Prediction history and user dimension as parquet tables (no database server).

History rows: (id, user_id, created_at, prediction, model_name, inputs_json). Deletes are rewrites
(``left_anti``) to a new path; counts come from ``left_semi``. Per-user reads are filtered scans
(partition pruning by date, pushed-down user filter).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Allowed range for the newest-N limit.
LATEST_MIN, LATEST_MAX = 1, 5000


def checked_limit(n: int, most: int = LATEST_MAX) -> int:
    """``n`` if it lies in 1..``most``; else an error (a silently smaller answer would be incomplete)."""
    if not LATEST_MIN <= int(n) <= most:
        raise ValueError(f"the newest-N limit must lie in {LATEST_MIN}..{most}, not {n}")
    return int(n)


def history_records(df: DataFrame, id_col: str, user_col: str, ts_col: str, prediction: str,
                    model_name: Column, inputs: Sequence[str]) -> DataFrame:
    """Shape scored rows as history rows; the inputs are kept as one JSON object string."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(user_col).cast("bigint").alias("user_id"),
        F.col(ts_col).alias("created_at"), F.col(prediction).cast("double").alias("prediction"),
        model_name.alias("model_name"), F.to_json(F.struct(*inputs)).alias("inputs_json"))


def history_append(records: DataFrame, path: str) -> None:
    """Append history rows, partitioned by creation date (later reads prune by date).

    Rows are clustered by date first, large days split by a salt that follows the rows (``rebalance``), so
    the number of files follows the data and not tasks x dates."""
    (records.withColumn("created_date", F.to_date("created_at")).hint("rebalance", "created_date")
     .write.mode("append").partitionBy("created_date").parquet(path))


def history_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def history_latest(history: DataFrame, n: int, user_id=None, user_col: str = "user_id",
                   order: Sequence[str] = ("id",), most: int = LATEST_MAX) -> DataFrame:
    """Newest N rows (by ``order`` descending) per user; N must lie in 1..``most``.

    One user: filter + TakeOrderedAndProject. All users: ``row_number() <= N`` per user, which Spark
    plans with a map-side window group limit, so even a user holding a third of all rows sends at most
    N rows per input partition to the final window.
    """
    k = checked_limit(n, most)
    sort = [F.col(c).desc() for c in order]
    if user_id is not None:
        return history.where(F.col(user_col) == user_id).orderBy(*sort).limit(k)
    w = Window.partitionBy(user_col).orderBy(*sort)
    return history.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)


def history_summary(history: DataFrame, value: str = "prediction", user_col: str = "user_id") -> DataFrame:
    """count, avg, min, max of predictions per user (partial aggregation: skew-safe)."""
    return history.groupBy(user_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_predictions"), F.avg(value).alias("avg_prediction"),
        F.min(value).alias("min_prediction"), F.max(value).alias("max_prediction"))


def history_trend(history: DataFrame, ts: str = "created_at", value: str = "prediction",
                  user_col: str = "user_id", key: str = "id") -> DataFrame:
    """The saved predictions over time: every row with its position among its user's rows, by (time, id).

    Positions are counts of the user's earlier days plus the place within the day, so no task holds all rows
    of a heavy user."""
    day = F.to_date(ts)
    counts = history.groupBy(F.col(user_col).alias("__u"), day.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__u").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__u", "__d", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(user_col, day).orderBy(ts, key)
    rows = history.select(user_col, key, ts, value, F.row_number().over(within).alias("__i"))
    return rows.join(base, F.col(user_col).eqNullSafe(F.col("__u")) & F.to_date(ts).eqNullSafe(F.col("__d"))).select(
        user_col, key, ts, value, (F.col("__base") + F.col("__i")).cast("bigint").alias("position"))


def history_daily(history: DataFrame, ts: str = "created_at", value: str = "prediction",
                  user_col: str = "user_id") -> DataFrame:
    """Daily count and mean per user (aggregated, so a heavy user stays cheap)."""
    return history.groupBy(user_col, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(value).alias("avg_prediction"))


def history_clear(history: DataFrame, users: DataFrame, user_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Remove every row of the given users: (remaining rows, per-user deleted counts)."""
    remaining = history.join(users, user_col, "left_anti")
    deleted = history.join(users, user_col, "left_semi").groupBy(user_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("deleted"))
    return remaining, deleted


def history_delete_one(history: DataFrame, requests: DataFrame, id_col: str = "id",
                       user_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Delete (id, user) pairs only where the owner matches: (remaining rows, deleted rows)."""
    keys = [id_col, user_col]
    return history.join(requests, keys, "left_anti"), history.join(requests, keys, "left_semi")


def orphan_check(facts: DataFrame, dims: DataFrame, fk: str, pk: str) -> DataFrame:
    """Counts of fact rows whose key exists in the dimension (valid) and does not (orphans).

    Facts are counted per key before the join, so a heavy key is one row there."""
    d = dims.select(F.col(pk).alias(fk)).where(F.col(fk).isNotNull()).distinct()
    per_key = facts.groupBy(fk).agg(F.count(F.lit(1)).alias("__n"))
    flagged = per_key.join(d.withColumn("__ok", F.lit(1)), fk, "left")
    zero = F.lit(0).cast("bigint")
    return flagged.agg(F.coalesce(F.sum(F.when(F.col("__ok").isNotNull(), F.col("__n"))), zero).alias("n_valid"),
                       F.coalesce(F.sum(F.when(F.col("__ok").isNull(), F.col("__n"))), zero).alias("n_orphans"))


def identity_lookup(users: DataFrame, identifier: str, name_col: str, email_col: str, key: str) -> DataFrame:
    """The user whose name or email equals the identifier case-insensitively (first by key)."""
    x = identifier.strip().lower()
    return (users.where((F.lower(F.col(name_col)) == x) | (F.lower(F.col(email_col)) == x))
            .orderBy(key).limit(1))


def dimension_upsert(users: DataFrame, batch: DataFrame, key: str, name_col: str, email_col: str,
                     updates: Sequence[str]) -> DataFrame:
    """Batch upsert that keeps names and emails unique (case-insensitively).

    Existing keys take non-null batch values for ``updates``; new keys are inserted. A batch row that brings a
    name or email is rejected as a whole if another existing user holds it, or if an accepted batch row before
    it (changes of existing users first, then new rows, each by key) brings it too; a rejected row claims
    nothing. Output has ``action`` in inserted / updated / unchanged / rejected; rejected changes leave the
    user as it was. NULL names and emails are never claimed.

    Values are settled in rounds: a row whose claims are all the first in line is accepted, rows that share a
    claim with an accepted one are rejected, the rest (a chain of conflicts) goes on. Minima per claim are
    pre-aggregated, so a value that many rows want stays cheap.
    """
    cols = [c for c in users.columns if c != key]
    brought = [c for c in cols if c in batch.columns]
    b = batch.select(key, *[F.col(c).alias(f"__b_{c}") for c in brought], F.lit(True).alias("__in_batch"))
    j = users.withColumn("__in_users", F.lit(True)).join(b, key, "full_outer")
    is_new = F.col("__in_users").isNull()

    def value(c: str) -> Column:
        if c not in brought:
            return F.col(c)
        return F.when(is_new, F.col(f"__b_{c}")).otherwise(
            F.coalesce(F.col(f"__b_{c}"), F.col(c)) if c in updates else F.col(c))

    merged = j.select(key, *[F.col(c).alias(f"__old_{c}") for c in cols], *[value(c).alias(f"__new_{c}") for c in cols],
                      is_new.alias("__is_new"), F.coalesce("__in_batch", F.lit(False)).alias("__in_batch"))
    claims = [F.when(F.col(f"__new_{c}").isNotNull() & (F.col("__is_new") | ~F.lower(f"__new_{c}").eqNullSafe(F.lower(f"__old_{c}"))),
                     F.concat(F.lit(f"{i}:"), F.lower(f"__new_{c}"))) for i, c in enumerate((name_col, email_col))]
    wanted = (merged.where("__in_batch").select(F.struct("__is_new", key).alias("line"), F.explode(F.array_compact(F.array(*claims))).alias("claim")))
    held = users.select(F.col(key).alias("owner"), F.explode(F.array_compact(F.array(
        *[F.concat(F.lit(f"{i}:"), F.lower(c)) for i, c in enumerate((name_col, email_col))]))).alias("claim"))
    taken = wanted.join(held, "claim").where(F.col("owner") != F.col(f"line.{key}")).select("line")
    rejected = _settle(wanted, taken)
    lost = rejected.select(F.col(f"line.{key}").alias(key), F.lit(True).alias("__lost")).distinct()
    out = merged.join(lost, key, "left").withColumn("__lost", F.coalesce("__lost", F.lit(False)))
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"__new_{c}").eqNullSafe(F.col(f"__old_{c}"))
    action = (F.when(F.col("__lost"), "rejected").when(F.col("__is_new"), "inserted")
              .when(F.col("__in_batch") & changed, "updated").otherwise("unchanged"))
    return out.select(key, *[F.when(F.col("__lost") & ~F.col("__is_new"), F.col(f"__old_{c}")).otherwise(F.col(f"__new_{c}"))
                             .alias(c) for c in cols], action.alias("action"))


def _settle(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows (line) that lose: those ``taken``, then rounds over the contested rest."""
    from tabreg.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(wanted.sparkSession)
    rejected = taken.distinct().checkpoint()
    live = wanted.join(rejected, "line", "left_anti")
    contested = live.groupBy("claim").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("claim")
    open_ = live.join(contested, "claim", "left_semi").checkpoint()  # claims of one row decide nothing
    while not open_.isEmpty():
        first = open_.groupBy("claim").agg(F.min("line").alias("first"))
        in_line = open_.join(first, "claim").withColumn("wins", F.col("line") == F.col("first"))
        accepted = in_line.groupBy("line").agg(F.min("wins").alias("wins")).where("wins").select("line")
        gone = open_.join(accepted, "line", "left_semi").select("claim").distinct()
        losers = open_.join(accepted, "line", "left_anti").join(gone, "claim", "left_semi").select("line").distinct().checkpoint()
        rejected = rejected.unionByName(losers)
        open_ = open_.join(accepted, "line", "left_anti").join(losers, "line", "left_anti").checkpoint()
    return rejected

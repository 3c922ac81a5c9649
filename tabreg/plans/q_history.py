"""Registered queries: prediction history (events as history, customer as users), identity rules,
JSON inputs, timestamps and label lookups (SURVEY §2.1 history_append, §2.2-2.3, §2.5-2.6, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.text import identity_error, identity_error_sql, iso_seconds, report_time
from tabreg.operators import history as H
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import load

HISTORY_SQL = ("(select event_id as id, user_id, ts as created_at, value as prediction, event_type as model_name, "
               "props as inputs_json from events)")
USERS_SQL = ("(select c_custkey as id, c_name as username, "
             "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' as email, "
             "c_mktsegment as segment, cast(null as timestamp) as last_login_at, true as is_active from customer)")


def history(spark, sf_dir):
    """events shaped as the prediction history table."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
                    F.col("value").alias("prediction"), F.col("event_type").alias("model_name"),
                    F.col("props").alias("inputs_json"))


def users(spark, sf_dir):
    """customer shaped as the users dimension."""
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                    F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"),
                             F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
                    F.col("c_mktsegment").alias("segment"),
                    F.lit(None).cast("timestamp_ntz").alias("last_login_at"), F.lit(True).alias("is_active"))


@query("history_append", sql=f"""
  select event_id as id, user_id, ts as created_at, value as prediction, event_type as model_name,
         cast(to_json({{'event_type': event_type, 'value': value}}) as varchar) as inputs_json from events""")
def q_history_append(spark, sf_dir):
    """History rows built from scored events with the inputs as a JSON object (the rows an append writes)."""
    e = load(spark, sf_dir, "events")
    return H.history_records(e, "event_id", "user_id", "ts", "value", F.col("event_type"), ["event_type", "value"])


@query("json_inputs", sql="""
  select event_id, cast(json_extract_string(props, '$.k') as integer) as k,
         json_extract_string(props, '$.missing') as missing from events""")
def q_json_inputs(spark, sf_dir):
    """Fields read back from the JSON inputs column (absent keys give NULL)."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                    F.get_json_object("props", "$.missing").alias("missing"))


@query("history_latest", sql=f"""
  select id, user_id, prediction, cast(recency as integer) as recency from (
    select *, row_number() over (partition by user_id order by id desc) as recency from {HISTORY_SQL})
  where recency <= 3""")
def q_history_latest(spark, sf_dir):
    """Newest 3 history rows per user (window group limit, clamp 1..5000)."""
    return H.history_latest(history(spark, sf_dir), 3).select("id", "user_id", "prediction", "recency")


@query("history_summary", sql=f"""
  select user_id, cast(count(*) as bigint) as n_predictions, {r6('avg(prediction)')} as avg_prediction,
         {r6('min(prediction)')} as min_prediction, {r6('max(prediction)')} as max_prediction
  from {HISTORY_SQL} group by user_id""")
def q_history_summary(spark, sf_dir):
    """Count, mean, min and max prediction per user."""
    return rounded(H.history_summary(history(spark, sf_dir)))


@query("history_trend", sql=f"""
  select user_id, id, created_at, prediction,
         row_number() over (partition by user_id order by created_at, id) as position from {HISTORY_SQL}""")
def q_history_trend(spark, sf_dir):
    """Every saved prediction with its place among its user's rows, by (time, id)."""
    return H.history_trend(history(spark, sf_dir))


@query("history_daily", sql=f"""
  select user_id, strftime(cast(created_at as date), '%Y-%m-%d') as day, cast(count(*) as bigint) as n,
         {r6('avg(prediction)')} as avg_prediction
  from {HISTORY_SQL} group by user_id, cast(created_at as date)""")
def q_history_daily(spark, sf_dir):
    """Daily count and mean per user."""
    t = H.history_daily(history(spark, sf_dir))
    return rounded(t.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query("history_clear", sql=f"""
  select user_id, cast(count(*) as bigint) as deleted from {HISTORY_SQL} h
  where user_id in (select id from {USERS_SQL} where segment = 'BUILDING') group by user_id""")
def q_history_clear(spark, sf_dir):
    """Clear the history of every user in the BUILDING segment: deleted rows per user."""
    u = users(spark, sf_dir).where(F.col("segment") == "BUILDING").select(F.col("id").alias("user_id"))
    _, deleted = H.history_clear(history(spark, sf_dir), u)
    return deleted


_REQUESTS_SQL = f"""(select id, user_id from {HISTORY_SQL} where model_name = 'error'
                   union all select id, user_id + 1 from {HISTORY_SQL} where model_name = 'purchase')"""


@query("history_delete_one", sql=f"""
  select id, user_id, model_name from {HISTORY_SQL} h
  where not exists (select 1 from {_REQUESTS_SQL} r where r.id = h.id and r.user_id = h.user_id)""")
def q_history_delete_one(spark, sf_dir):
    """Owner-checked deletes: requests for every error row (right owner) and every purchase row (wrong
    owner); only owner-matching rows go. Remaining rows."""
    h = history(spark, sf_dir)
    req = (h.where(F.col("model_name") == "error").select("id", "user_id")
           .unionByName(h.where(F.col("model_name") == "purchase").select("id", (F.col("user_id") + 1).alias("user_id"))))
    remaining, _ = H.history_delete_one(h, req)
    return remaining.select("id", "user_id", "model_name")


@query("orphan_check", sql="""
  select cast(count(*) filter (where c.c_custkey is not null) as bigint) as n_valid,
         cast(count(*) filter (where c.c_custkey is null) as bigint) as n_orphans
  from events e left join (select distinct c_custkey from customer) c on e.user_id = c.c_custkey""")
def q_orphan_check(spark, sf_dir):
    """History rows whose user exists in the users dimension, and orphans."""
    return H.orphan_check(load(spark, sf_dir, "events"), load(spark, sf_dir, "customer"), "user_id", "c_custkey")


@query("identity_lookup", sql=f"""
  select id, username, email from {USERS_SQL}
  where lower(username) = 'customer#000000042' or lower(email) = 'customer#000000042' order by id limit 1""")
def q_identity_lookup(spark, sf_dir):
    """User whose username or email equals the identifier, case-insensitively."""
    return H.identity_lookup(users(spark, sf_dir), " Customer#000000042 ", "username", "email", "id").select(
        "id", "username", "email")


@query("validate_identity", sql=f"""
  select id, {identity_error_sql('username', 'email', "replace(username, '#', 'x')")} as error from {USERS_SQL}""")
def q_validate_identity(spark, sf_dir):
    """First failing identity rule per user (username length/charset, email shape, password shape)."""
    u = users(spark, sf_dir)
    return u.select("id", identity_error(F.col("username"), F.col("email"),
                                         F.replace("username", F.lit("#"), F.lit("x"))).alias("error"))


# A batch derived from customer and events: logins of event users; changes of email to another user's (rejected)
# and to a fresh one; new users, some under a name in use, some sharing an email (the first that is not
# rejected for its name gets it).
_BATCH_SQL = f"""(
  select user_id as id, cast(null as varchar) as username, cast(null as varchar) as email, max(ts) as last_login_at
  from events where user_id % 7 <> 0 and user_id % 11 <> 0 group by user_id
  union all
  select c.id, null, case when c.id % 7 = 0 then upper(o.email) else 'fresh' || c.id || '@new.example' end, null
  from {USERS_SQL} c left join {USERS_SQL} o on o.id = c.id + 1 where c.id % 7 = 0 or c.id % 11 = 0
  union all
  select 1000000 + id, case when id % 10 = 0 then upper(username) else 'new ' || id end,
         'share' || (id // 20) || '@new.example', null from {USERS_SQL} where id % 5 = 0)"""


def _batch(spark, sf_dir):
    u = users(spark, sf_dir).select("id", "username", "email")
    none = F.lit(None).cast("string")
    when = F.lit(None).cast("timestamp_ntz")
    logins = (load(spark, sf_dir, "events").where("user_id % 7 <> 0 and user_id % 11 <> 0").groupBy(F.col("user_id").alias("id"))
              .agg(F.max("ts").cast("timestamp_ntz").alias("last_login_at")).select("id", none.alias("username"), none.alias("email"), "last_login_at"))
    other = u.select((F.col("id") - 1).alias("id"), F.upper("email").alias("other"))
    moves = (u.where("id % 7 = 0 or id % 11 = 0").join(other, "id", "left").select(
        "id", none.alias("username"), F.when(F.col("id") % 7 == 0, F.col("other")).otherwise(
            F.concat(F.lit("fresh"), "id", F.lit("@new.example"))).alias("email"), when.alias("last_login_at")))
    new = u.where("id % 5 = 0").select(
        (F.col("id") + 1000000).alias("id"),
        F.when(F.col("id") % 10 == 0, F.upper("username")).otherwise(F.concat(F.lit("new "), "id")).alias("username"),
        F.concat(F.lit("share"), F.floor(F.col("id") / 20), F.lit("@new.example")).alias("email"), when.alias("last_login_at"))
    return logins.unionByName(moves).unionByName(new)


@query("dimension_upsert", sql=f"""
  with u as {USERS_SQL}, b as {_BATCH_SQL},
  held as (select id, lower(username) as v from u union all select id, lower(email) from u),
  lost1 as (select distinct b.id from b join held h on h.v in (lower(b.username), lower(b.email)) and h.id <> b.id),
  first_new as (select lower(email) as e, min(id) as id from b where id >= 1000000 and id not in (select id from lost1) group by 1),
  lost3 as (select b.id from b join first_new f on lower(b.email) = f.e where b.id >= 1000000 and b.id <> f.id),
  lost as (select id from lost1 union select id from lost3)
  select coalesce(u.id, b.id) as id, coalesce(u.username, b.username) as username,
         case when u.id is null then b.email when l.id is not null then u.email else coalesce(b.email, u.email) end as email,
         case when l.id is not null then u.last_login_at else coalesce(b.last_login_at, u.last_login_at) end as last_login_at,
         u.is_active,
         case when l.id is not null then 'rejected' when u.id is null then 'inserted'
              when b.id is not null and (b.last_login_at is distinct from u.last_login_at and b.last_login_at is not null
                   or b.email is not null and b.email <> u.email) then 'updated' else 'unchanged' end as action
  from u full outer join b on u.id = b.id left join lost l on l.id = coalesce(u.id, b.id)""")
def q_dimension_upsert(spark, sf_dir):
    """Upsert of logins, email changes and new users into the users dimension, names and emails kept unique."""
    u = users(spark, sf_dir).drop("segment")
    return H.dimension_upsert(u, _batch(spark, sf_dir), "id", "username", "email", ["email", "last_login_at"])


@query("lookup_label", sql="""
  select e.event_id, e.user_id, coalesce(n.n_name, 'Unknown') as nation
  from events e left join customer c on e.user_id = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""")
def q_lookup_label(spark, sf_dir):
    """Code -> label lookup: each history row's user nation name, 'Unknown' when absent."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # nation is a fixed 25-row code table: broadcast; customer grows with the data: planner's choice.
    # users are labelled once each; the label then joins the rows, heavy users by a salt on both sides
    label = c.join(F.broadcast(n), "c_nationkey", "left").select("user_id", "n_name")
    salts = F.array(*[F.lit(i) for i in range(8)])
    salted = label.withColumn("__salt", F.explode(salts))
    return (e.withColumn("__salt", F.pmod(F.xxhash64("event_id"), F.lit(8)).cast("int")).join(salted, ["user_id", "__salt"], "left")
            .select("event_id", "user_id", F.coalesce("n_name", F.lit("Unknown")).alias("nation")))


@query("timestamps", sql="""
  select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as report_time, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso_time,
         strftime(ts, '%Y-%m-%d') as day from events""")
def q_timestamps(spark, sf_dir):
    """Report-time and ISO-seconds text of history timestamps, and their date."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", report_time(F.col("ts")).alias("report_time"), iso_seconds(F.col("ts")).alias("iso_time"),
                    F.date_format("ts", "yyyy-MM-dd").alias("day"))

"""Queries by name, each with the SQL that DuckDB runs over the same tables.

The SQL takes other roads than the operators where there are any: islands by running
sums, spines by cross product, literals where a rule's outcome is known by construction.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import dlq, loads, scores, times
from ..operators import adherence, canonical, dedup, delta, merge, parity, quality, rolling, serialize, serving, wellness
from ..sources import demo, files
from ..streaming import late
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _date(text: str):
    return F.lit(text).cast("date")


# ---- loads and metrics


@query(f"WITH {X.TRAINING_SQL} SELECT * FROM event_days")
def daily_load(spark, sf_dir):
    return rolling.daily_load(X.training_events(spark, sf_dir))


@query("SELECT 'u' || user_id AS athlete_id, CAST(ts AS DATE) AS day, max(value) AS daily_load FROM events GROUP BY ALL")
def largest_of_day(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("athlete_id"), F.col("ts").cast("date").alias("day"), F.col("value").alias("daily_load"))
    return rolling.largest_of_day(rows)


@query(f"WITH {X.TRAINING_SQL} SELECT athlete_id, count(*) FILTER (WHERE session_load IS NOT NULL AND NOT isnan(session_load)) AS kept, count(*) FILTER (WHERE session_load IS NULL OR isnan(session_load)) AS rejected FROM training GROUP BY athlete_id")
def finite_guard(spark, sf_dir):
    ok = loads.finite(F.col("session_load"))
    return X.training_events(spark, sf_dir).groupBy("athlete_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


_METRIC_COLUMNS = "athlete_id, metric_date, acute_load, chronic_load_28d, chronic_load_42d, acute_chronic_ratio, deload_flag, fatigue_score, readiness_score, coaching_flags"


@query(f"WITH {X.METRICS_SQL} SELECT {_METRIC_COLUMNS} FROM metrics")
def athlete_metrics(spark, sf_dir):
    return X.metrics(spark, sf_dir)


@query(f"WITH {X.EVENT_METRICS_SQL} SELECT {_METRIC_COLUMNS} FROM metrics")
def athlete_metrics_dense(spark, sf_dir):
    return X.event_metrics(spark, sf_dir)


@query(f"WITH {X.METRICS_SQL} SELECT athlete_id, metric_date, acute_load, chronic_load_28d, chronic_load_42d, acute_chronic_ratio FROM metrics")
def rolling_load(spark, sf_dir):
    return rolling.rolling_load_of_days(X.order_days(spark, sf_dir))


@query(f"WITH {X.EVENT_METRICS_SQL} SELECT athlete_id, metric_date, deload_flag FROM metrics")
def deload_flags(spark, sf_dir):
    return rolling.deload_flag(rolling.rolling_load(rolling.load_spine(rolling.daily_load(X.training_events(spark, sf_dir))))).select("athlete_id", "metric_date", "deload_flag")


@query(f"WITH {X.METRICS_SQL} SELECT athlete_id, metric_date FROM metrics WHERE deload_flag = 1")
def deload_days(spark, sf_dir):
    return serving.deload_days(X.metrics(spark, sf_dir))


@query(f"WITH {X.EVENT_METRICS_SQL} SELECT athlete_id, metric_date, fatigue_score FROM metrics")
def fatigue_score(spark, sf_dir):
    m = X.event_metrics(spark, sf_dir)
    return m.select("athlete_id", "metric_date", scores.fatigue(F.col("acute_load"), F.col("chronic_load_42d")).alias("fatigue_score"))


@query(f"WITH {X.EVENT_METRICS_SQL} SELECT athlete_id, metric_date, readiness_score FROM metrics")
def readiness_score(spark, sf_dir):
    m = X.event_metrics(spark, sf_dir)
    return m.select("athlete_id", "metric_date", scores.readiness(F.col("acute_chronic_ratio"), F.col("chronic_load_28d")).alias("readiness_score"))


@query(f"WITH {X.METRICS_SQL} SELECT coaching_flags, count(*) AS n FROM metrics GROUP BY coaching_flags")
def coaching_flags(spark, sf_dir):
    return X.metrics(spark, sf_dir).groupBy("coaching_flags").agg(F.count("*").alias("n"))


@query(f"WITH {X.TRAINING_SQL} SELECT athlete_id, day, sum(session_load) AS daily_load FROM good GROUP BY ALL")
def tumbling_day(spark, sf_dir):
    e = X.training_events(spark, sf_dir).where(loads.finite(F.col("session_load"))).withColumn("event_ts", F.timestamp_millis("event_time"))
    return rolling.tumbling_day(e)


@query(f"""WITH {X.TRAINING_SQL}
SELECT athlete_id, CAST(day + CAST(k AS INTEGER) AS DATE) AS metric_date, sum(daily_load) AS window_load FROM event_days, range(0, 42) AS t(k) GROUP BY ALL""")
def sliding_42d(spark, sf_dir):
    # Events are summed to days first, so that each is copied into 42 windows as part of a sum.
    days = rolling.daily_load(X.training_events(spark, sf_dir)).select("athlete_id", F.col("day").cast("timestamp").alias("event_ts"), F.col("daily_load").alias("session_load"))
    return rolling.sliding_windows(days)


@query(f"WITH {X.WELLNESS_SQL} SELECT athlete_id, metric_date, recovery_score FROM recovery")
def recovery_score(spark, sf_dir):
    return wellness.recovery_scores(X.wellness_events(spark, sf_dir))


_ADHERENCE_SQL = f"""{X.ORDER_DAYS_SQL}, {X.PLANS_SQL},
blocks AS (SELECT *, CAST(greatest(1, ceil(date_diff('day', start_date, end_date) / 7.0)) AS INTEGER) AS weeks, least(end_date, DATE '1996-06-30') AS metric_date FROM latest_plans WHERE planned_sessions_per_week > 0),
done AS (SELECT b.athlete_id, b.block_id, any_value(b.metric_date) AS metric_date, count(d.day) AS actual_sessions, any_value(planned_sessions_per_week * weeks) AS planned_sessions,
    coalesce(sum(d.daily_load), 0.0) AS actual_volume, any_value(total * weeks) AS target
  FROM blocks b LEFT JOIN order_days d ON b.athlete_id = d.athlete_id AND d.day BETWEEN b.start_date AND b.metric_date GROUP BY b.athlete_id, b.block_id),
adherence AS (SELECT athlete_id, block_id, metric_date, planned_sessions, actual_sessions, actual_volume, CASE WHEN target > 0
    THEN 0.5 * least(actual_sessions / CAST(planned_sessions AS DOUBLE), 1.0) + 0.5 * least(actual_volume / target, 1.0) ELSE least(actual_sessions / CAST(planned_sessions AS DOUBLE), 1.0) END AS adherence_score FROM done)"""


@query(f"WITH {_ADHERENCE_SQL} SELECT * FROM adherence")
def adherence_score(spark, sf_dir):
    return adherence.adherence_scores(X.plans(spark, sf_dir), X.order_days(spark, sf_dir), _date("1996-06-30"))


@query(f"WITH {X.PLANS_SQL} SELECT athlete_id, block_id, ingest_time, total AS weekly_target FROM revisions")
def weekly_volume_sum(spark, sf_dir):
    return X.plans(spark, sf_dir).select("athlete_id", "block_id", "ingest_time", loads.volume_target(F.col("weekly_volume_targets")).alias("weekly_target"))


@query(f"WITH {X.PLANS_SQL} SELECT athlete_id, block_id, ingest_time, goal, start_date, end_date, planned_sessions_per_week, weekly_volume_targets FROM latest_plans")
def latest_revision(spark, sf_dir):
    return adherence.latest_plans(X.plans(spark, sf_dir))


@query(f"WITH {X.PLANS_SQL} SELECT athlete_id, block_id, ingest_time, planned_sessions_per_week FROM revisions WHERE ingest_time <= 1 QUALIFY row_number() OVER (PARTITION BY athlete_id, block_id ORDER BY ingest_time DESC) = 1")
def plan_as_of(spark, sf_dir):
    return adherence.latest_plans(X.plans(spark, sf_dir), F.lit(1)).select("athlete_id", "block_id", "ingest_time", "planned_sessions_per_week")


@query(f"""WITH {X.EVENT_METRICS_SQL} SELECT athlete_id AS key, epoch_ms(CAST(metric_date AS TIMESTAMP)) AS metric_date, acute_load, deload_flag, fatigue_score, coaching_flags FROM metrics""")
def metrics_messages(spark, sf_dir):
    """The messages, read back."""
    shape = "metric_date BIGINT, acute_load DOUBLE, deload_flag INT, fatigue_score DOUBLE, coaching_flags ARRAY<STRING>"
    read = serialize.metrics_messages(X.event_metrics(spark, sf_dir)).select("key", F.from_json("value", shape).alias("m")).select("key", "m.*")
    return read.withColumn("coaching_flags", F.to_json("coaching_flags"))


# ---- canonical records


def _raw(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def _strength_raw(spark, sf_dir) -> DataFrame:
    line, k = X.table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    reps = F.when(k % 13 == 0, F.lit("six")).when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit("5.5")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    payload = F.struct(
        F.concat(F.lit("w"), k).alias("workout_id"), F.concat(F.lit("x"), F.col("l_partkey") % 7).alias("exercise_id"), F.col("l_linenumber").alias("set_number"), reps.alias("reps"),
        F.col("l_suppkey").cast("double").alias("weight_kg"), F.when(k % 5 == 0, F.lit(None)).when(k % 23 == 0, F.lit(-1.0)).otherwise((k % 11).cast("double")).alias("rpe"), (k % 4).cast("double").alias("rir"),
    )
    return _raw(
        line, F.when(k % 29 != 0, F.concat_ws("-", k, "l_linenumber", "l_partkey", "l_suppkey")).alias("event_id"), F.when(k % 31 == 0, F.lit("soon")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("event_time"),
        F.lit("2024-02-01 00:00:00.500+00:00").alias("ingest_time"), F.lit("strong_csv").alias("source"), F.concat(F.lit("a"), F.col("l_suppkey")).alias("athlete_id"), payload.alias("payload"),
    )


_STRENGTH_SQL = """
s AS (SELECT l_orderkey AS k, * FROM lineitem),
judged AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'missing required field: ''event_id''' WHEN k % 17 = 0 AND k % 13 <> 0 THEN 'missing required field: ''payload.reps''' WHEN k % 31 = 0 THEN 'unparseable time: ''event_time'''
    WHEN k % 13 = 0 OR k % 19 = 0 THEN 'cannot read ''payload.reps'' as int' WHEN k % 23 = 0 AND k % 5 <> 0 THEN 'rpe must not be negative' END AS message FROM s)"""


@query(f"""WITH {_STRENGTH_SQL}
SELECT k || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id, epoch_ms(l_shipdate) AS event_time, CAST(1706745600500 AS BIGINT) AS ingest_time, 'strong_csv' AS source, CAST(1 AS INTEGER) AS schema_version,
  'a' || l_suppkey AS athlete_id, 'STRENGTH_SET' AS event_type, 'w' || k AS workout_id, 'x' || (l_partkey % 7) AS exercise_id, l_linenumber AS set_number, CAST(l_quantity AS INTEGER) AS reps, CAST(l_suppkey AS DOUBLE) AS weight_kg,
  CASE WHEN k % 5 <> 0 THEN CAST(k % 11 AS DOUBLE) END AS rpe, CAST(k % 4 AS DOUBLE) AS rir, CAST(NULL AS VARCHAR) AS activity_type, CAST(NULL AS DOUBLE) AS distance_km, CAST(NULL AS INTEGER) AS duration_sec, CAST(NULL AS INTEGER) AS avg_hr, CAST(NULL AS DOUBLE) AS tss,
  CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN l_quantity * l_suppkey ELSE l_quantity * l_suppkey * ((k % 11) / CAST(10.0 AS DOUBLE)) END AS session_load FROM judged WHERE message IS NULL""")
def canonical_strength(spark, sf_dir):
    return canonical.valid_records(canonical.canonicalize(_strength_raw(spark, sf_dir), "strength"))


@query(f"""WITH {_STRENGTH_SQL} SELECT CASE WHEN message LIKE 'cannot%' OR message LIKE 'unparse%' THEN 'TRANSFORM_ERROR' ELSE 'VALIDATION_FAILURE' END AS error_type, message AS error_message, count(*) AS n
FROM judged WHERE message IS NOT NULL GROUP BY ALL""")
def dlq_validation(spark, sf_dir):
    bad = canonical.rejected(canonical.canonicalize(_strength_raw(spark, sf_dir), "strength"), "raw.strength", F.lit(X.NOW_MS))
    return bad.groupBy("error_type", "error_message").agg(F.count("*").alias("n"))


@query("""SELECT 'e' || event_id AS event_id, (epoch_us(ts) // 1000) AS event_time, event_type AS activity_type, CAST(event_id % 7200 AS INTEGER) AS duration_sec,
  CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 60 + 120 AS INTEGER) END AS avg_hr, CASE WHEN event_id % 2 = 0 THEN value END AS tss,
  CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(event_id % 7200 AS DOUBLE) / CAST(3600.0 AS DOUBLE) * (CAST(event_id % 60 + 120 AS DOUBLE) / CAST(220.0 AS DOUBLE)) * CAST(100.0 AS DOUBLE) END AS session_load
FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0""")
def canonical_cardio(spark, sf_dir):
    e, i = X.table(spark, sf_dir, "events"), F.col("event_id")
    payload = F.struct(F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("activity_type"), (i % 7200).alias("duration_sec"), F.when(i % 3 != 0, i % 60 + 120).alias("avg_hr"), F.when(i % 2 == 0, F.col("value")).alias("tss"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    raw = _raw(e, F.concat(F.lit("e"), i).alias("event_id"), ms.alias("event_time"), ms.alias("ingest_time"), F.lit("strava").alias("source"), F.col("user_id").cast("string").alias("athlete_id"), payload.alias("payload"))
    return canonical.valid_records(canonical.canonicalize(raw, "cardio")).select("event_id", "event_time", "activity_type", "duration_sec", "avg_hr", "tss", "session_load")


def _daily_raw(spark, sf_dir, *payload):
    e = X.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _raw(e, F.col("event_id").cast("string").alias("event_id"), ms.alias("event_time"), ms.alias("ingest_time"), F.lit("app").alias("source"), F.col("user_id").cast("string").alias("athlete_id"), F.struct(*payload).alias("payload"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 4 WHEN 0 THEN 'WELLNESS_DAILY' WHEN 1 THEN 'NUTRITION_DAILY' WHEN 2 THEN 'RECOVERY_SNAPSHOT' END AS event_type, value AS hrv, CAST(event_id % 10 AS INTEGER) AS energy FROM events WHERE event_id % 4 < 3""")
def canonical_wellness(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 4 == 1, "NUTRITION_DAILY").when(i % 4 == 2, "RECOVERY_SNAPSHOT").when(i % 4 == 3, "SOMETHING_ELSE")
    raw = _daily_raw(spark, sf_dir, kind.alias("event_type"), F.col("value").alias("hrv"), (i % 10).alias("energy"))
    return canonical.valid_records(canonical.canonicalize(raw, "wellness")).select("event_id", "event_type", "hrv", "energy")


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'NUTRITION_DAILY' AS event_type, CAST(event_id % 4000 AS INTEGER) AS calories, value AS protein_g, CASE WHEN event_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS nutrition_adherence FROM events WHERE event_id % 7 <> 0""")
def canonical_nutrition(spark, sf_dir):
    i = F.col("event_id")
    calories = F.when(i % 7 == 0, F.lit("2400.5")).otherwise((i % 4000).cast("string"))
    raw = _daily_raw(spark, sf_dir, calories.alias("calories"), F.col("value").alias("protein_g"), F.when(i % 2 == 0, F.lit(0.5)).alias("adherence_score"))
    return canonical.valid_records(canonical.canonicalize(raw, "nutrition")).select("event_id", "event_type", "calories", "protein_g", "nutrition_adherence")


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'RECOVERY_SNAPSHOT' AS event_type, value AS sleep_hours, CAST(event_id % 100 AS INTEGER) AS resting_hr, CAST(event_id AS INTEGER) AS steps FROM events WHERE event_id % 9 <> 0""")
def canonical_recovery(spark, sf_dir):
    i = F.col("event_id")
    payload = [F.col("value").alias("sleep_hours"), F.when(i % 9 != 0, (i % 100).cast("string")).otherwise(F.lit("true")).alias("resting_hr"), i.alias("steps")]
    return canonical.valid_records(canonical.canonicalize(_daily_raw(spark, sf_dir, *payload), "recovery")).select("event_id", "event_type", "sleep_hours", "resting_hr", "steps")


@query(f"""WITH {X.PLANS_SQL} SELECT athlete_id || '-' || block_id || '-' || ingest_time AS event_id, block_id, epoch_ms(CAST(start_date AS TIMESTAMP)) AS start_date, epoch_ms(CAST(end_date AS TIMESTAMP)) AS end_date, planned_sessions_per_week
FROM revisions WHERE planned_sessions_per_week > 0 AND weekly_volume_targets <> 'not json'""")
def canonical_planning(spark, sf_dir):
    p = X.plans(spark, sf_dir)
    fields = ["block_id", "goal", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "planned_sessions_per_week", "weekly_volume_targets"]
    raw = _raw(p, F.concat_ws("-", "athlete_id", "block_id", "ingest_time").alias("event_id"), F.lit(1704067200000).alias("event_time"), F.col("ingest_time"), F.lit("coach").alias("source"), "athlete_id", F.struct(*fields).alias("payload"))
    return canonical.valid_records(canonical.canonicalize(raw, "planning")).select("event_id", "block_id", "start_date", "end_date", "planned_sessions_per_week")


@query("SELECT event_id % 3 AS kind, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY ALL")
def raw_validators(spark, sf_dir):
    i = F.col("event_id")
    payload = F.when(i % 3 != 1, F.struct(F.lit("run").alias("activity_type"), F.when(i % 3 != 2, F.lit(60)).alias("duration_sec")))
    raw = X.table(spark, sf_dir, "events").select((i % 3).alias("kind"), F.to_json(F.struct(i.cast("string").alias("event_id"), F.lit(5).alias("event_time"), F.lit("a").alias("athlete_id"), payload.alias("payload"))).alias("value"))
    return canonical.validate_raw(raw, "cardio").where("error is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {X.TRAINING_SQL} SELECT event_id, CASE WHEN session_load IS NULL THEN 'missing required field: ''session_load''' ELSE 'session_load must be a finite number' END AS message FROM training WHERE session_load IS NULL OR isnan(session_load)""")
def canonical_validation(spark, sf_dir):
    e = X.training_events(spark, sf_dir).withColumns({"ingest_time": F.col("event_time"), "source": F.lit("s"), "schema_version": F.lit(1), "event_type": F.lit("STRENGTH_SET")})
    return canonical.validate_training(e).where("error is not null").select("event_id", F.col("error.error_message").alias("message"))


# ---- time, cells, text


@query("""SELECT event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(date_trunc('second', ts)) // 1000) AS iso_ms, CAST(ts AS DATE) AS day, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_ms, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS from_micros FROM events""")
def epoch_conversions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    ms = F.unix_millis(ts)
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return X.table(spark, sf_dir, "events").select("event_id", times.flexible_ms(ms.cast("string")).alias("ms"), times.iso_to_ms(iso).alias("iso_ms"), times.ms_to_date(ms).alias("day"), times.date_to_ms(times.ms_to_date(ms)).alias("day_ms"), times.day_start_ms(F.unix_micros(ts)).alias("from_micros"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN 'missing required field: ''workout_id''' WHEN l_orderkey % 5 = 0 THEN 'unparseable int for ''reps'': ''' || l_quantity || ''''
  WHEN l_orderkey % 3 = 0 THEN 'unparseable double for ''rpe'': ''hard''' WHEN l_orderkey % 11 = 0 THEN 'unparseable timestamp for ''timestamp'': ''2026-13-01''' END AS error,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_quantity AS INTEGER) END AS reps, l_extendedprice AS weight_kg FROM lineitem""")
def csv_typed_parse(spark, sf_dir):
    line, k = X.table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    cells = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("a").alias("athlete_id"), F.when(k % 7 == 0, F.lit("  ")).otherwise("w").alias("workout_id"), F.lit("squat").alias("exercise_id"), F.col("l_linenumber").cast("string").alias("set_number"),
        F.when(k % 5 == 0, F.col("l_quantity").cast("string")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("reps"), F.col("l_extendedprice").cast("string").alias("weight_kg"),
        F.when(k % 3 == 0, F.lit("hard")).otherwise("").alias("rpe"), F.lit(None).cast("string").alias("rir"), F.when(k % 11 == 0, F.lit("2026-13-01")).otherwise("2026-06-20T09:00:00").alias("timestamp"),
    )
    errors = F.coalesce(*[C.cell_error(n, kind, required) for n, (kind, required) in files.COLUMNS["strength"].items()])
    return cells.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", errors.alias("error"), C.cell_value("reps", "int").alias("reps"), C.cell_value("weight_kg", "double").alias("weight_kg"))


@query("SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Team' AS label FROM customer")
def sport_label(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").select("c_custkey", scores.label(F.concat(F.lower("c_mktsegment"), F.lit("_team"))).alias("label"))


@query("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 1) AS one, round(sqrt(abs(c_acctbal)), 3) AS three FROM customer")
def api_rounding(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").select("c_custkey", scores.api_round(F.sqrt(F.abs("c_acctbal"))).alias("one"), scores.api_round(F.sqrt(F.abs("c_acctbal")), 3).alias("three"))


# ---- duplicates and late data


@query("SELECT CAST(event_id // 2 AS VARCHAR) AS event_id, min(event_id) AS arrival FROM events WHERE event_id // 2 % 50 <> 0 GROUP BY event_id // 2 UNION ALL SELECT '' AS event_id, event_id AS arrival FROM events WHERE event_id // 2 % 50 = 0")
def dedup_events(spark, sf_dir):
    i = F.col("event_id")
    pair = F.floor(i / 2)
    e = X.table(spark, sf_dir, "events").select(F.when(pair % 50 == 0, F.lit("")).otherwise(pair.cast("string")).alias("event_id"), i.alias("arrival"))
    return dedup.first_by_id(e, "arrival")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT c_custkey FROM customer)")
def unseen_events(spark, sf_dir):
    seen = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"))
    return dedup.unseen(X.table(spark, sf_dir, "events").select("event_id"), seen)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 83 = 0 THEN (epoch_us(ts) // 1000) - 5 * 86400000 ELSE (epoch_us(ts) // 1000) END AS event_time FROM events),
m AS (SELECT *, max(event_time) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS largest FROM e)
SELECT event_id, coalesce((event_time // 86400000 + 1) * 86400000 + 86400000 <= largest - 86400000, false) AS late FROM m""")
def late_events(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = X.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 83 == 0, ms - 5 * X.DAY_MS).otherwise(ms).alias("event_time"))
    return late.late_by_arrival(e, "event_id").select("event_id", "late")


# ---- serving


@query(f"WITH {X.METRICS_SQL} SELECT {_METRIC_COLUMNS} FROM metrics QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY metric_date DESC) = 1")
def latest_row(spark, sf_dir):
    return serving.latest_metrics(X.latest_metrics(spark, sf_dir))


_LATEST = f"{X.METRICS_SQL}, {X.ATHLETES_SQL}, latest AS (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY metric_date DESC) = 1)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {_LATEST} SELECT sport, count(*) AS athlete_count, round(avg(acute_load), 6) AS avg_acute_load, round(avg(chronic_load_28d), 6) AS avg_chronic_load, round(avg(acute_chronic_ratio), 6) AS avg_acr,
  round(avg(fatigue_score), 6) AS avg_fatigue, round(avg(readiness_score), 6) AS avg_readiness FROM latest JOIN athletes USING (athlete_id) GROUP BY sport""")
def by_sport(spark, sf_dir):
    return _rounded(serving.by_sport(X.latest_metrics(spark, sf_dir), X.athletes(spark, sf_dir)))


@query(f"""WITH {_LATEST} SELECT sport, count(*) FILTER (WHERE acute_chronic_ratio < 1.3) AS safe, count(*) FILTER (WHERE acute_chronic_ratio BETWEEN 1.3 AND 1.5) AS caution,
  count(*) FILTER (WHERE acute_chronic_ratio > 1.5) AS danger, count(*) FILTER (WHERE acute_chronic_ratio IS NULL) AS unknown FROM latest JOIN athletes USING (athlete_id) GROUP BY sport""")
def risk_distribution(spark, sf_dir):
    return serving.risk_distribution(X.latest_metrics(spark, sf_dir), X.athletes(spark, sf_dir))


def _metrics_between(spark, sf_dir, some: DataFrame, start, end) -> DataFrame:
    """A metrics table whose rows of some athletes from start to end are those of `metrics`, made from the days these depend on."""
    days = rolling.days_between(X.order_days(spark, sf_dir), start, end)
    return rolling.metrics_of_days(days.join(some.select("athlete_id"), "athlete_id", "left_semi"))


_RANGE = "DATE '1997-01-01' AND DATE '1997-03-31'"


@query(f"""WITH {X.METRICS_SQL}, {X.ATHLETES_SQL} SELECT metric_date, round(avg(acute_load), 6) AS avg_acute_load, round(avg(chronic_load_28d), 6) AS avg_chronic_load, round(avg(acute_chronic_ratio), 6) AS avg_acr, count(DISTINCT athlete_id) AS athlete_count
FROM metrics JOIN athletes USING (athlete_id) WHERE sport = 'building' AND metric_date BETWEEN {_RANGE} GROUP BY metric_date""")
def sport_daily_average(spark, sf_dir):
    athletes, start, end = X.athletes(spark, sf_dir), _date("1997-01-01"), _date("1997-03-31")
    metrics = _metrics_between(spark, sf_dir, athletes.where("sport = 'building'"), start, end)
    return _rounded(serving.sport_daily_average(metrics, athletes, "building", start, end))


@query(f"WITH {X.METRICS_SQL} SELECT DISTINCT athlete_id FROM metrics")
def athlete_list(spark, sf_dir):
    return serving.athlete_list(X.metrics(spark, sf_dir))


@query(f"WITH {X.ORDER_DAYS_SQL}, {X.ATHLETES_SQL} SELECT athlete_id, name, sport FROM (SELECT DISTINCT athlete_id FROM order_days) LEFT JOIN athletes USING (athlete_id)")
def athlete_directory(spark, sf_dir):
    return serving.athlete_directory(X.order_days(spark, sf_dir), X.athletes(spark, sf_dir))


@query(f"WITH {X.ATHLETES_SQL} SELECT sport, count(*) AS athlete_count FROM athletes GROUP BY sport")
def sports(spark, sf_dir):
    return serving.sports(X.athletes(spark, sf_dir))


@query(f"WITH {X.ORDER_DAYS_SQL}, {X.ATHLETES_SQL} SELECT coalesce(sport, 'Other') AS sport, count(*) AS athlete_count FROM (SELECT DISTINCT athlete_id FROM order_days) LEFT JOIN athletes USING (athlete_id) GROUP BY ALL")
def sport_facets(spark, sf_dir):
    return serving.sport_facets(serving.athlete_directory(X.order_days(spark, sf_dir), X.athletes(spark, sf_dir)))


@query(f"WITH {X.METRICS_SQL} SELECT {_METRIC_COLUMNS} FROM metrics WHERE athlete_id = 'c7' AND metric_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def metrics_range(spark, sf_dir):
    return serving.metrics_range(X.metrics(spark, sf_dir), "c7", _date("1996-01-01"), _date("1998-12-31")).withColumn("coaching_flags", F.to_json("coaching_flags"))


@query(f"WITH {X.ORDER_DAYS_SQL}, {X.ATHLETES_SQL} SELECT athlete_id, name, sport FROM (SELECT DISTINCT athlete_id FROM order_days) LEFT JOIN athletes USING (athlete_id) WHERE contains(lower(athlete_id), '99') OR contains(lower(name), '99') ORDER BY athlete_id LIMIT 200")
def athlete_search(spark, sf_dir):
    return serving.athlete_search(serving.athlete_directory(X.order_days(spark, sf_dir), X.athletes(spark, sf_dir)), " 99")


@query(f"""WITH {X.METRICS_SQL}, ends AS (SELECT athlete_id, min(metric_date) AS a, max(metric_date) AS z FROM metrics GROUP BY athlete_id),
days AS (SELECT athlete_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS metric_date FROM ends)
SELECT athlete_id, metric_date, acute_load, deload_flag FROM days LEFT JOIN metrics USING (athlete_id, metric_date)""")
def densify_series(spark, sf_dir):
    return serving.densify(X.metrics(spark, sf_dir), ["acute_load", "deload_flag"])


_VS = "DATE '1996-01-01' AND DATE '1998-12-31'"


# The SQL makes the metrics of the sport's athletes only, from the days that any window of the range holds.
@query(f"""WITH {X.ORDER_DAYS_SQL}, {X.ATHLETES_SQL}, one AS (SELECT min(athlete_id) AS id FROM athletes WHERE sport IS NOT NULL),
peers AS (SELECT athlete_id FROM athletes WHERE sport = (SELECT sport FROM athletes WHERE athlete_id = (SELECT id FROM one))),
peer_days AS (SELECT * FROM order_days WHERE athlete_id IN (SELECT athlete_id FROM peers) AND day BETWEEN DATE '1995-11-01' AND DATE '1998-12-31'),
{X.metrics_sql("peer_days")},
mean AS (SELECT metric_date, round(avg(acute_load), 6) AS sport_acute_load FROM metrics WHERE metric_date BETWEEN {_VS} GROUP BY metric_date)
SELECT athlete_id, metric_date, acute_load, sport_acute_load FROM metrics LEFT JOIN mean USING (metric_date) WHERE athlete_id = (SELECT id FROM one) AND metric_date BETWEEN {_VS}""")
def athlete_vs_sport(spark, sf_dir):
    athletes = X.athletes(spark, sf_dir)
    one = athletes.where("sport is not null").agg(F.min("athlete_id").alias("athlete_id"))
    start, end = _date("1996-01-01"), _date("1998-12-31")
    metrics = _metrics_between(spark, sf_dir, serving.peers(athletes, one), start, end)
    return _rounded(serving.athlete_vs_sport(metrics, athletes, one, start, end))


@query(f"WITH {X.METRICS_SQL} SELECT CASE WHEN acute_chronic_ratio > 1.5 THEN 'danger' WHEN acute_chronic_ratio >= 1.3 THEN 'caution' WHEN acute_chronic_ratio IS NOT NULL THEN 'safe' ELSE 'none' END AS zone, count(*) AS n FROM metrics GROUP BY ALL")
def acr_zone(spark, sf_dir):
    return X.metrics(spark, sf_dir).groupBy(scores.ratio_zone(F.col("acute_chronic_ratio")).alias("zone")).agg(F.count("*").alias("n"))


@query(f"""WITH {X.EVENT_METRICS_SQL} SELECT athlete_id, metric_date, CASE WHEN fatigue_score >= 80 THEN 'danger' WHEN fatigue_score >= 60 THEN 'warn' WHEN fatigue_score IS NOT NULL THEN 'ok' END AS fatigue_band,
  CASE WHEN readiness_score >= 66 THEN 'ok' WHEN readiness_score >= 33 THEN 'warn' WHEN readiness_score IS NOT NULL THEN 'danger' END AS readiness_band FROM metrics""")
def severity_bands(spark, sf_dir):
    m = X.event_metrics(spark, sf_dir)
    return m.select("athlete_id", "metric_date", scores.fatigue_band(F.col("fatigue_score")).alias("fatigue_band"), scores.readiness_band(F.col("readiness_score")).alias("readiness_band"))


@query(f"WITH {_LATEST} SELECT sport, round(avg(acute_load), 6) AS avg_acute_load, CAST(row_number() OVER (ORDER BY avg(acute_load) DESC NULLS LAST, sport) AS INTEGER) AS place FROM latest JOIN athletes USING (athlete_id) WHERE sport IS NOT NULL GROUP BY sport")
def sport_ranking(spark, sf_dir):
    from pyspark.sql import Window

    summary = serving.by_sport(X.latest_metrics(spark, sf_dir), X.athletes(spark, sf_dir)).where("sport is not null")
    # A row a sport, so one task may number them.
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("avg_acute_load"), "sport"))
    return _rounded(serving.sport_ranking(summary, "avg_acute_load").select("sport", "avg_acute_load", place.alias("place")))


def _placed(ranked: DataFrame, *order) -> DataFrame:
    from pyspark.sql import Window

    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row a sport


@query(f"""WITH {_LATEST}, risks AS (SELECT sport, count(*) FILTER (WHERE acute_chronic_ratio > 1.5) AS danger FROM latest JOIN athletes USING (athlete_id) WHERE sport IS NOT NULL GROUP BY sport)
SELECT sport, danger, CAST(row_number() OVER (ORDER BY danger DESC, sport) AS INTEGER) AS place FROM risks""")
def risk_ranking(spark, sf_dir):
    risks = serving.risk_distribution(X.latest_metrics(spark, sf_dir), X.athletes(spark, sf_dir)).where("sport is not null")
    return _placed(serving.danger_ranking(risks).select("sport", "danger"), F.desc("danger"), "sport")


@query(f"""WITH {_LATEST}, means AS (SELECT sport, round(avg(CASE WHEN sport <> 'building' THEN readiness_score END), 6) AS readiness FROM latest JOIN athletes USING (athlete_id) WHERE sport IS NOT NULL GROUP BY sport)
SELECT sport, readiness, CAST(row_number() OVER (ORDER BY coalesce(readiness, 0) DESC, sport) AS INTEGER) AS place FROM means""")
def metric_ranking(spark, sf_dir):
    """A sport without the metric counts as 0: here, one sport's is left out."""
    m = X.latest_metrics(spark, sf_dir)
    summary = serving.by_sport(m, X.athletes(spark, sf_dir)).where("sport is not null").select("sport", F.when(F.col("sport") != "building", F.round("avg_readiness", 6)).alias("readiness"))
    return _placed(serving.metric_ranking(summary, "readiness"), F.desc(F.coalesce("readiness", F.lit(0.0))), "sport")


@query(f"WITH {X.METRICS_SQL} SELECT CAST(ceil(max(acute_load) * 1.1) AS DOUBLE) AS upper FROM metrics")
def chart_domain(spark, sf_dir):
    return serving.chart_domain(X.metrics(spark, sf_dir))


@query("SELECT 'c' || c_custkey AS athlete_id FROM customer WHERE c_custkey < 10 OR CAST(c_custkey AS VARCHAR) NOT LIKE '1%'")
def drop_prefix(spark, sf_dir):
    ids = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("athlete_id"))
    return serving.drop_prefix(ids, "c1").unionByName(ids.where("athlete_id = 'c1'"))


# ---- stores


@query(f"""WITH {X.ORDER_DAYS_SQL}, {X.TRAINING_SQL}, pg AS (SELECT DISTINCT athlete_id, epoch_ms(CAST(day AS TIMESTAMP)) AS d FROM event_days), lake AS (SELECT DISTINCT athlete_id, epoch_ms(CAST(day AS TIMESTAMP)) AS d FROM training)
SELECT athlete_id, d AS day_epoch_ms, 'iceberg_missing' AS side FROM (SELECT * FROM pg EXCEPT SELECT * FROM lake) UNION ALL SELECT athlete_id, d, 'pg_missing' FROM (SELECT * FROM lake EXCEPT SELECT * FROM pg)""")
def parity_check(spark, sf_dir):
    events = X.training_events(spark, sf_dir)
    return parity.parity(rolling.daily_load(events), events, times.date_to_ms(F.col("day")), times.day_start_ms(F.col("event_time")))


@query(f"""WITH {X.ORDER_DAYS_SQL}, {X.TRAINING_SQL}, pg AS (SELECT DISTINCT athlete_id, epoch_ms(CAST(day AS TIMESTAMP)) AS d FROM event_days), lake AS (SELECT DISTINCT athlete_id, epoch_ms(CAST(day AS TIMESTAMP)) AS d FROM training)
SELECT athlete_id, d AS day_epoch_ms, 'iceberg_missing' AS side FROM (SELECT * FROM pg EXCEPT SELECT * FROM lake) UNION ALL SELECT athlete_id, d, 'pg_missing' FROM (SELECT * FROM lake EXCEPT SELECT * FROM pg)""")
def parity_by_digests(spark, sf_dir):
    """As parity_check: digests a bucket and month first, then the athletes of differing buckets only."""
    events = X.training_events(spark, sf_dir)
    return parity.parity_by_digests(rolling.daily_load(events), events, times.date_to_ms(F.col("day")), times.day_start_ms(F.col("event_time")))


@query(f"""WITH {X.METRICS_SQL} SELECT athlete_id, metric_date, acute_load, chronic_load_28d, chronic_load_42d, acute_chronic_ratio, deload_flag, fatigue_score, readiness_score, coaching_flags FROM metrics""")
def corrected_metrics(spark, sf_dir):
    """The metrics table made without the urgent orders of each day, then corrected by them: what all orders give."""
    orders = X.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    athlete = F.concat(F.lit("c"), F.col("o_custkey"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    loads = lambda rows: rows.groupBy(athlete.alias("athlete_id"), day.alias("day")).agg(F.sum(F.round("o_totalprice")).alias("daily_load"))
    before = rolling.metrics_of_days(loads(orders.where(~urgent)))
    changes = delta.corrections(before, loads(orders), orders.where(urgent).select(athlete.alias("athlete_id"), day.alias("day")).distinct())
    return delta.corrected(before, changes)


@query(f"""WITH {X.PLANS_SQL} SELECT athlete_id, block_id, ingest_time, goal, planned_sessions_per_week FROM revisions WHERE block_id = 'q1'
UNION ALL SELECT athlete_id, block_id, ingest_time, 'again', planned_sessions_per_week FROM revisions WHERE block_id <> 'q1'""")
def plan_insert_if_absent(spark, sf_dir):
    plans = X.plans(spark, sf_dir)
    return merge.insert_absent(plans.where("block_id = 'q1'"), plans.withColumn("goal", F.lit("again")), ["athlete_id", "block_id", "ingest_time"]).select("athlete_id", "block_id", "ingest_time", "goal", "planned_sessions_per_week")


@query(f"""WITH {X.EVENT_METRICS_SQL}, {X.WELLNESS_SQL} SELECT coalesce(m.athlete_id, r.athlete_id) AS athlete_id, coalesce(m.metric_date, r.metric_date) AS metric_date, m.acute_load, r.recovery_score
FROM metrics m FULL JOIN recovery r ON m.athlete_id = r.athlete_id AND m.metric_date = r.metric_date""")
def partial_upsert(spark, sf_dir):
    table = X.event_metrics(spark, sf_dir).select("athlete_id", "metric_date", "acute_load", F.lit(None).cast("double").alias("recovery_score"))
    return merge.upsert_columns(table, wellness.recovery_scores(X.wellness_events(spark, sf_dir)), ["athlete_id", "metric_date"], ["recovery_score"])


@query(f"""WITH {_ADHERENCE_SQL}, days AS (SELECT athlete_id, day AS metric_date, daily_load FROM order_days WHERE day BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'),
scores AS (SELECT athlete_id, metric_date, arg_max(adherence_score, block_id) AS adherence_score FROM adherence GROUP BY ALL)
SELECT coalesce(d.athlete_id, s.athlete_id) AS athlete_id, coalesce(d.metric_date, s.metric_date) AS metric_date, d.daily_load, s.adherence_score FROM days d FULL JOIN scores s ON d.athlete_id = s.athlete_id AND d.metric_date = s.metric_date""")
def adherence_upsert(spark, sf_dir):
    """Adherence scores as a partial upsert into a table that has other columns."""
    table = X.order_days(spark, sf_dir).where(F.col("day").between(_date("1996-03-01"), _date("1996-06-30"))).select("athlete_id", F.col("day").alias("metric_date"), "daily_load", F.lit(None).cast("double").alias("adherence_score"))
    scored = adherence.adherence_scores(X.plans(spark, sf_dir), X.order_days(spark, sf_dir), _date("1996-06-30"))
    return merge.upsert_columns(table, scored, ["athlete_id", "metric_date"], ["adherence_score"], arrival="block_id")


@query(f"""WITH {X.EVENT_METRICS_SQL}, {X.WELLNESS_SQL} SELECT athlete_id, metric_date, acute_load, recovery_score FROM metrics JOIN recovery USING (athlete_id, metric_date)""")
def training_by_wellness(spark, sf_dir):
    return X.event_metrics(spark, sf_dir).join(wellness.recovery_scores(X.wellness_events(spark, sf_dir)), ["athlete_id", "metric_date"]).select("athlete_id", "metric_date", "acute_load", "recovery_score")


# ---- dead letters


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS original_key, CASE WHEN event_id % 10 = 0 THEN '' ELSE to_base64(encode(props)) END AS original_value, event_id % 10 = 0 AS original_value_truncated, CAST(CASE WHEN event_id % 10 = 0 THEN octet_length(encode(props)) * 100 ELSE octet_length(encode(props)) END AS INTEGER) AS original_value_size_bytes FROM events")
def dlq_envelope(spark, sf_dir):
    e, i = X.table(spark, sf_dir, "events"), F.col("event_id")
    value = F.when(i % 10 == 0, F.repeat("props", 100)).otherwise(F.col("props"))
    made = dlq.envelope(F.lit("raw.strength"), i.cast("string"), value, F.lit("TRANSFORM_ERROR"), F.lit("m"), F.lit(X.NOW_MS), max_bytes=200)
    return e.select("event_id", *made).select("event_id", "original_key", "original_value", "original_value_truncated", "original_value_size_bytes")


def _letters(spark, sf_dir):
    return dlq.decode(X.letters(spark, sf_dir))


@query(f"""WITH {X.LETTERS_SQL} SELECT "offset", corrupt, CASE WHEN NOT corrupt THEN payload_size END AS payload_size, CASE WHEN NOT corrupt THEN error_type END AS error_type FROM letters""")
def dlq_decode(spark, sf_dir):
    return _letters(spark, sf_dir).select("offset", "corrupt", F.when(~F.col("corrupt"), F.octet_length("payload").cast("long")).alias("payload_size"), F.when(~F.col("corrupt"), F.col("error_type")).alias("error_type"))


@query(f"""WITH {X.LETTERS_SQL} SELECT topic, coalesce(error_type, 'NULL') AS error_type, count(*) AS n FROM readable GROUP BY ALL UNION ALL SELECT 'ALL', coalesce(error_type, 'NULL'), count(*) FROM readable GROUP BY ALL""")
def dlq_error_types(spark, sf_dir):
    return quality.error_types(_letters(spark, sf_dir))


_AGE_SQL = f"""{X.LETTERS_SQL}, aged AS (SELECT topic, ts_ms, CASE WHEN ts_ms IS NULL THEN 'null_ts' WHEN {X.NOW_MS} < ts_ms THEN 'clock_skew' WHEN {X.NOW_MS} - ts_ms < 86400000 THEN '<1d' WHEN {X.NOW_MS} - ts_ms < 259200000 THEN '1-3d'
  WHEN {X.NOW_MS} - ts_ms < 518400000 THEN '3-6d' WHEN {X.NOW_MS} - ts_ms < 604800000 THEN '>6d' ELSE 'expired' END AS bucket FROM readable)"""


@query(f"WITH {_AGE_SQL} SELECT topic, bucket, count(*) AS n, min(ts_ms) AS oldest, max(ts_ms) AS newest FROM aged GROUP BY ALL")
def dlq_age(spark, sf_dir):
    return quality.ages(_letters(spark, sf_dir), F.lit(X.NOW_MS))


@query(f"WITH {X.LETTERS_SQL} SELECT topic, min(ts_ms) AS oldest, max(ts_ms) AS newest FROM readable GROUP BY topic")
def dlq_age_extremes(spark, sf_dir):
    return quality.age_extremes(_letters(spark, sf_dir))


@query(f"WITH {_AGE_SQL} SELECT topic, CAST(count(*) AS BIGINT) AS n FROM aged WHERE bucket IN ('>6d', 'expired') GROUP BY topic")
def dlq_retention_warning(spark, sf_dir):
    return quality.retention_warning(quality.ages(_letters(spark, sf_dir), F.lit(X.NOW_MS)))


@query(f"""WITH {X.LETTERS_SQL} SELECT topic, CASE error_type WHEN 'VALIDATION_FAILURE' THEN 'DATA_FIX' WHEN 'TRANSFORM_ERROR' THEN 'DATA_FIX' WHEN 'SCHEMA_INCOMPATIBILITY' THEN 'INFRA_FIX' WHEN 'LATE_DATA' THEN 'LATE_ARRIVAL' ELSE 'UNKNOWN' END AS fixability,
  CASE WHEN coalesce(original_topic, '') = '' THEN 'UNKNOWN_ORIGIN' ELSE original_topic END AS origin, count(*) AS n FROM readable GROUP BY ALL""")
def dlq_triage(spark, sf_dir):
    return quality.triage(_letters(spark, sf_dir))


@query(f"""WITH {X.LETTERS_SQL}, k AS (SELECT topic, coalesce(error_type, 'NULL') AS error_type, CASE WHEN coalesce(original_topic, '') = '' THEN 'UNKNOWN_ORIGIN' ELSE original_topic END AS origin, "offset" FROM readable)
SELECT *, CAST(row_number() OVER (PARTITION BY topic, error_type, origin ORDER BY "offset") AS INTEGER) AS n FROM k QUALIFY n <= 3""")
def dlq_samples(spark, sf_dir):
    return quality.samples(_letters(spark, sf_dir), "offset")


@query(f"WITH {X.LETTERS_SQL} SELECT count(*) AS scanned, count(*) FILTER (WHERE corrupt) AS corrupt FROM letters")
def dlq_scan(spark, sf_dir):
    return quality.scan_counters(_letters(spark, sf_dir))


_PLAN_SQL = f"""{X.LETTERS_SQL}, planned AS (SELECT "offset", topic, original_key, CASE WHEN corrupt THEN 'skipped_unrecoverable' WHEN error_type IS DISTINCT FROM 'TRANSFORM_ERROR' AND error_type IS DISTINCT FROM 'x' AND {{other}} THEN 'filtered'
  WHEN truncated OR payload_size = 0 THEN 'skipped_unrecoverable' WHEN payload_size > 8 THEN 'skipped_oversized' WHEN original_topic IS NULL OR NOT starts_with(original_topic, 'raw.') THEN 'skipped_unrecoverable' ELSE 'replayed' END AS outcome FROM letters)"""


@query(f"""WITH {_PLAN_SQL.format(other="false")} SELECT "offset", topic, outcome, outcome = 'replayed' AND original_key IS NULL AS null_key FROM planned""")
def dlq_replay_plan(spark, sf_dir):
    return quality.replay_plan(_letters(spark, sf_dir), "offset", max_bytes=8).select("offset", "topic", "outcome", "null_key")


_REPORT = """SELECT topic, count(*) FILTER (WHERE outcome = 'replayed') AS replayed, count(*) FILTER (WHERE outcome = 'skipped_oversized') AS skipped_oversized, count(*) FILTER (WHERE outcome = 'skipped_unrecoverable') AS skipped_unrecoverable"""


@query(f"""WITH {_PLAN_SQL.format(other="true")} {_REPORT} FROM planned WHERE outcome <> 'filtered' GROUP BY topic""")
def dlq_replay_report(spark, sf_dir):
    """The replay of one error type, over all letters."""
    return quality.replay_report(quality.replay_plan(_letters(spark, sf_dir), "offset", error_type="TRANSFORM_ERROR", max_bytes=8))


@query(f"""WITH {_PLAN_SQL.format(other="true")}, numbered AS (SELECT *, count(*) FILTER (WHERE outcome <> 'filtered') OVER (ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS done FROM planned)
{_REPORT} FROM numbered WHERE outcome <> 'filtered' AND done <= 500 GROUP BY topic""")
def dlq_replay_first(spark, sf_dir):
    """The replay's option to stop after so many letters: here 500."""
    return quality.replay_report(quality.replay_plan(_letters(spark, sf_dir), "offset", error_type="TRANSFORM_ERROR", max_count=500, max_bytes=8))


# Offsets are the topics' own here, so that letters of three topics share each, and each is there three times.
@query(f"""WITH {_PLAN_SQL.format(other="true")} SELECT least(400, count(*)) AS processed FROM planned WHERE outcome <> 'filtered'""")
def dlq_replay_tied(spark, sf_dir):
    letters = _letters(spark, sf_dir).withColumns({"offset": F.floor(F.col("offset") / 9), "partition": F.lit(0)})
    planned = quality.replay_plan(letters, ("topic", "partition", "offset"), error_type="TRANSFORM_ERROR", max_count=400, max_bytes=8)
    return planned.where("outcome != 'filtered'").agg(F.count("*").alias("processed"))


@query(f"""WITH {X.LETTERS_SQL} SELECT DISTINCT coalesce(error_type, 'NULL') AS error_type FROM readable WHERE topic <> 'dlq.canonical.planning_block'""")
def dlq_label_keys(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    reports = [quality.error_types(letters.where(F.col("topic") == t)) for t in ("dlq.canonical.training_event", "dlq.canonical.wellness_event")]
    return quality.label_keys(*reports, key="error_type")


@query("""WITH p AS (SELECT 'dlq.' || l_returnflag AS topic, l_suppkey AS part, min(l_orderkey) AS a, max(l_orderkey) - 10 AS z FROM lineitem GROUP BY ALL)
SELECT topic, CAST(sum(greatest(z - a, 0)) AS BIGINT) AS depth, CASE WHEN sum(greatest(z - a, 0)) <= 0 THEN 'ok' ELSE 'warning' END AS status FROM p GROUP BY topic""")
def dlq_depth(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem")
    offsets = line.groupBy(F.concat(F.lit("dlq."), "l_returnflag").alias("topic"), F.col("l_suppkey").alias("part")).agg(F.min("l_orderkey").alias("earliest"), (F.max("l_orderkey") - 10).alias("latest"))
    return quality.depth(offsets)


@query(f"WITH {X.LETTERS_SQL} SELECT topic, count(*) AS n FROM letters GROUP BY topic")
def union_dlq(spark, sf_dir):
    letters = X.letters(spark, sf_dir)
    parts = [letters.where(F.col("topic") == t) for t in ("dlq.canonical.training_event", "dlq.canonical.wellness_event", "dlq.canonical.planning_block")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("topic").agg(F.count("*").alias("n"))


# ---- made-up rows, and ids


_SPORT_ROWS = ", ".join(f"({i}, '{sport}', {load})" for i, (sport, load) in enumerate(demo.SPORTS.items()))
_NOISE = lambda seed, text: f"CAST(('0x' || substr(md5('{seed}-' || {text}), 1, 8)) AS UBIGINT) / 4294967296.0"


@query(f"""WITH sports AS (SELECT i, sport, CAST(base AS DOUBLE) AS base FROM (VALUES {_SPORT_ROWS}) AS t(i, sport, base)),
squad AS (SELECT 'demo-' || lpad(CAST(id AS VARCHAR), 5, '0') AS athlete_id, sport, base FROM range(0, (SELECT count(*) FROM customer)) AS r(id), sports WHERE i = id % {len(demo.SPORTS)}),
days AS (SELECT *, CAST(1 AS DOUBLE) + 0.05 * CAST({_NOISE(7, "athlete_id || '-' || k")} AS DOUBLE) AS c, {_NOISE(8, "athlete_id || '-' || k")} AS a, {_NOISE(9, "athlete_id")} AS s FROM squad, range(0, 45) AS t(k))
SELECT sport, count(*) AS n, round(avg(base * c * 7 * (1 + sin(k * 2 * 3.141592653589793 / 14) * 0.2 + CASE WHEN k >= 38 AND s < 0.25 THEN 0.35 ELSE 0 END + 0.1 * (a - 0.5))), 4) AS avg_acute_load FROM days GROUP BY sport""")
def demo_squad(spark, sf_dir):
    """A made-up squad of the size of the customer table, and its metrics by sport."""
    n = X.table(spark, sf_dir, "customer").count()
    squad = demo.athletes(spark, n)
    return demo.metrics(spark, squad, "2024-06-30").join(squad.select("athlete_id", "sport"), "athlete_id").groupBy("sport").agg(F.count("*").alias("n"), F.round(F.avg("acute_load"), 4).alias("avg_acute_load"))


_CELLS = """'"workout_id":"' || l_orderkey || '","exercise_id":"x","set_number":' || l_linenumber || ',"reps":' || CAST(l_quantity AS INTEGER) || ',"weight_kg":' || CAST(l_extendedprice AS VARCHAR)"""


@query(f"""WITH r AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)
SELECT CAST(l_suppkey AS VARCHAR) AS key, '{{{{"event_id":"' || sha256('{{{{"domain":"strength","athlete_id":"' || l_suppkey || '",' || {_CELLS} || ',"timestamp":"' || d || '"}}}}') || '","event_time":"' || d || 'T00:00:00","ingest_time":"2024-01-31T00:00:00","source":"strong_csv","athlete_id":"' || l_suppkey
  || '","payload":{{{{' || {_CELLS} || ',"rpe":null,"rir":null,"timestamp":"' || d || '"}}}}}}}}' AS value FROM r""".replace("{{", "{").replace("}}", "}"))
def envelope_ids(spark, sf_dir):
    """Envelopes of strength rows: the same row always gets the same id, the digest of its JSON."""
    line = X.table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_suppkey").cast("string").alias("athlete_id"), F.col("l_orderkey").cast("string").alias("workout_id"), F.lit("x").alias("exercise_id"), F.col("l_linenumber").alias("set_number"), F.col("l_quantity").cast("int").alias("reps"), F.col("l_extendedprice").alias("weight_kg"), F.lit(None).cast("double").alias("rpe"), F.lit(None).cast("double").alias("rir"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"))
    return files.envelopes(rows, "strength", F.lit(X.NOW_MS))

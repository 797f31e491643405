"""The domain's tables, taken from star-schema tables: whole tables, with faults injected by rule.

events -> training and wellness events; orders -> sparse loads; customer -> athletes and
plans; lineitem -> strength sets. Loads are whole numbers, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rolling

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_events(spark, sf_dir) -> DataFrame:
    """Dense events: (event_id, athlete_id, event_time, session_load); some loads are null or NaN."""
    e = table(spark, sf_dir, "events")
    load = F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(F.col("event_id") % 101 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("value") * 100))
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("u"), F.col("user_id")).alias("athlete_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time"), load.cast("double").alias("session_load"))


TRAINING_SQL = """
training AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'u' || user_id AS athlete_id, (epoch_us(ts) // 1000) AS event_time, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN CAST('nan' AS DOUBLE) ELSE round(value * 100) END AS session_load FROM events),
good AS (SELECT * FROM training WHERE session_load IS NOT NULL AND NOT isnan(session_load)),
event_days AS (SELECT athlete_id, day, sum(session_load) AS daily_load FROM good GROUP BY ALL)"""


def order_days(spark, sf_dir) -> DataFrame:
    """Sparse daily loads with long gaps."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("athlete_id"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.round("o_totalprice")).alias("daily_load"))


ORDER_DAYS_SQL = """
order_days AS (SELECT 'c' || o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS day, sum(round(o_totalprice)) AS daily_load FROM orders GROUP BY ALL)"""


def metrics_sql(days: str = "order_days") -> str:
    """The metrics table over daily loads, by another road than the operators': a spine of all windows, islands by running sums."""
    return f"""
spine AS (SELECT DISTINCT athlete_id, CAST(day + CAST(k AS INTEGER) AS DATE) AS metric_date FROM {days}, range(0, 42) AS t(k)),
filled AS (SELECT s.athlete_id, s.metric_date, d.daily_load FROM spine s LEFT JOIN {days} d ON s.athlete_id = d.athlete_id AND s.metric_date = d.day),
rolled AS (SELECT athlete_id, metric_date, coalesce(sum(daily_load) OVER a, 0.0) AS acute_load, coalesce(avg(daily_load) OVER b, 0.0) AS chronic_load_28d,
    coalesce(avg(daily_load) OVER c, 0.0) AS chronic_load_42d FROM filled
  WINDOW a AS (PARTITION BY athlete_id ORDER BY metric_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY athlete_id ORDER BY metric_date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW),
    c AS (PARTITION BY athlete_id ORDER BY metric_date RANGE BETWEEN INTERVAL 41 DAYS PRECEDING AND CURRENT ROW)),
ratios AS (SELECT *, CASE WHEN chronic_load_28d <> 0 THEN acute_load / chronic_load_28d END AS acr FROM rolled),
signs AS (SELECT *, CASE WHEN acr > 1.3 THEN 1 WHEN acr < 0.8 THEN -1 ELSE 0 END AS sg FROM ratios),
turns AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER (PARTITION BY athlete_id ORDER BY metric_date) THEN 1 ELSE 0 END AS turned FROM signs),
islands AS (SELECT *, sum(turned) OVER (PARTITION BY athlete_id ORDER BY metric_date) AS island FROM turns),
streaks AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, island ORDER BY metric_date) AS pos FROM islands),
flagged AS (SELECT athlete_id, metric_date, acute_load, chronic_load_28d, chronic_load_42d, acr AS acute_chronic_ratio, CAST(CASE WHEN pos >= 3 THEN sg ELSE 0 END AS INTEGER) AS deload_flag,
    CASE WHEN chronic_load_42d <> 0 THEN least(greatest(acute_load / greatest(chronic_load_42d, 1.0), 0.0), 5.0) * 20.0 END AS fatigue_score,
    CASE WHEN acr IS NULL THEN NULL ELSE least(80.0, CASE WHEN acr <= 0.8 THEN 40.0 + acr / 0.8 * 20.0 WHEN acr <= 1.0 THEN 60.0 + (acr - 0.8) / 0.2 * 20.0
      WHEN acr <= 1.3 THEN 80.0 - (acr - 1.0) / 0.3 * 20.0 ELSE greatest(0.0, 60.0 - (acr - 1.3) / 0.7 * 60.0) END) END AS readiness_score FROM streaks),
metrics AS (SELECT *, '[' || concat_ws(',', CASE deload_flag WHEN 1 THEN '"deload"' WHEN -1 THEN '"undertrained"' END,
    CASE WHEN fatigue_score >= 80 THEN '"high_fatigue"' WHEN fatigue_score >= 70 THEN '"monitor"' END) || ']' AS coaching_flags FROM flagged)"""


METRICS_SQL = ORDER_DAYS_SQL + "," + metrics_sql()
EVENT_METRICS_SQL = TRAINING_SQL + "," + metrics_sql("event_days")


def metrics(spark, sf_dir) -> DataFrame:
    return rolling.metrics_of_days(order_days(spark, sf_dir))


def latest_metrics(spark, sf_dir) -> DataFrame:
    """A metrics table whose latest row of each athlete is that of `metrics`, made from the days these depend on."""
    return rolling.metrics_of_days(rolling.recent_days(order_days(spark, sf_dir)))


def event_metrics(spark, sf_dir) -> DataFrame:
    return rolling.athlete_metrics(training_events(spark, sf_dir))


def athletes(spark, sf_dir) -> DataFrame:
    """Customers in the black are athletes of the directory; those of one nation have no sport."""
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("athlete_id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") != 0, F.lower("c_mktsegment")).alias("sport"))


ATHLETES_SQL = """
athletes AS (SELECT 'c' || c_custkey AS athlete_id, c_name AS name, CASE WHEN c_nationkey <> 0 THEN lower(c_mktsegment) END AS sport FROM customer WHERE c_acctbal >= 0)"""

#: Volume targets of plans, by customer number modulo their count, and what they sum to.
TARGETS = (
    ('{"strength_kg": 50000, "cardio_min": 90.5}', 50090.5),
    ("{}", 0.0),
    ("not json", None),
    ('{"a": true, "b": "7", "c": 200000}', 200001.0),
    ("[1, 2]", None),
    ('{"nested": {"x": 4}, "none": null, "y": 150000}', 150000.0),
)


def plans(spark, sf_dir) -> DataFrame:
    """Two revisions of a block of the first quarter and one of the year 1996 for each customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in TARGETS]), (F.col("c_custkey") % len(TARGETS) + 1).cast("int"))
    day = lambda s: F.lit(s).cast("date")
    k = F.col("c_custkey")
    revisions = F.array(
        F.struct(F.lit("q1").alias("block_id"), F.lit(1).cast("bigint").alias("ingest_time"), day("1996-01-01").alias("start_date"), day("1996-03-31").alias("end_date"), F.lit(3).alias("planned_sessions_per_week")),
        F.struct(F.lit("q1").alias("block_id"), F.lit(2).cast("bigint").alias("ingest_time"), day("1996-01-01").alias("start_date"), day("1996-03-24").alias("end_date"), (k % 4).cast("int").alias("planned_sessions_per_week")),
        F.struct(F.lit("year").alias("block_id"), F.lit(1).cast("bigint").alias("ingest_time"), day("1996-01-01").alias("start_date"), day("1996-12-31").alias("end_date"), F.lit(1).alias("planned_sessions_per_week")),
    )
    rows = c.select(F.concat(F.lit("c"), k).alias("athlete_id"), text.alias("weekly_volume_targets"), F.explode(revisions).alias("r"))
    return rows.select("athlete_id", "r.block_id", "r.ingest_time", F.concat(F.lit("goal "), "r.block_id").alias("goal"), "r.start_date", "r.end_date", "r.planned_sessions_per_week", "weekly_volume_targets")


_TARGET_ROWS = ", ".join(f"({i}, '{t}', {'NULL' if v is None else v})" for i, (t, v) in enumerate(TARGETS))
PLANS_SQL = f"""
targets AS (SELECT i, txt, CAST(total AS DOUBLE) AS total FROM (VALUES {_TARGET_ROWS}) AS t(i, txt, total)),
revisions AS (SELECT 'c' || c_custkey AS athlete_id, c_custkey, block_id, CAST(ingest_time AS BIGINT) AS ingest_time, 'goal ' || block_id AS goal, start_date, end_date,
    CAST(CASE WHEN psw < 0 THEN c_custkey % 4 ELSE psw END AS INTEGER) AS planned_sessions_per_week, txt AS weekly_volume_targets, total
  FROM customer, (VALUES ('q1', 1, DATE '1996-01-01', DATE '1996-03-31', 3), ('q1', 2, DATE '1996-01-01', DATE '1996-03-24', -1), ('year', 1, DATE '1996-01-01', DATE '1996-12-31', 1)) AS r(block_id, ingest_time, start_date, end_date, psw), targets
  WHERE targets.i = c_custkey % {len(TARGETS)}),
latest_plans AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY athlete_id, block_id ORDER BY ingest_time DESC) = 1)"""


def wellness_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("athlete_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time"), i.alias("ingest_time"),
        F.when(i % 3 != 0, F.col("value") / 4).alias("hrv"), F.when(i % 5 != 0, (i % 13).cast("double")).alias("sleep_hours"), F.when(i % 7 > 2, (i % 12).cast("int")).alias("perceived_recovery"),
    )


WELLNESS_SQL = """
wellness AS (SELECT 'u' || user_id AS athlete_id, CAST(ts AS DATE) AS metric_date, event_id AS arrival, CASE WHEN event_id % 3 <> 0 THEN value / 4 END AS hrv,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 13 AS DOUBLE) END AS sleep, CASE WHEN event_id % 7 > 2 THEN CAST(event_id % 12 AS DOUBLE) END AS felt FROM events),
recoveries AS (SELECT athlete_id, metric_date, arrival, CASE
    WHEN hrv IS NOT NULL THEN least(greatest(least(greatest(hrv / 60.0 - 0.5, 0.0), 1.0) * 50.0 + least(greatest(coalesce(sleep, 0.0) / 8.0, 0.0), 1.0) * 30.0 + least(greatest(coalesce(felt, 0.0) / 10.0, 0.0), 1.0) * 20.0, 0.0), 100.0)
    WHEN sleep IS NOT NULL OR felt IS NOT NULL THEN least(greatest(least(greatest(coalesce(sleep, 0.0) / 8.0, 0.0), 1.0) * 60.0 + least(greatest(coalesce(felt, 0.0) / 10.0, 0.0), 1.0) * 40.0, 0.0), 100.0) END AS recovery_score FROM wellness),
recovery AS (SELECT athlete_id, metric_date, recovery_score FROM recoveries WHERE recovery_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY athlete_id, metric_date ORDER BY arrival DESC) = 1)"""

#: When the dead letters are looked at: 2024-01-31 UTC.
NOW_MS = 1_706_659_200_000


def letters(spark, sf_dir) -> DataFrame:
    """Dead letters made of events: (topic, offset, value), some of them corrupt, truncated, empty or of no topic."""
    e = table(spark, sf_dir, "events")
    i, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    kinds = F.array(*[F.lit(k) for k in ("VALIDATION_FAILURE", "TRANSFORM_ERROR", "LATE_DATA", "SCHEMA_INCOMPATIBILITY", "ODD")])
    topic = F.element_at(F.array(F.lit("dlq.canonical.training_event"), F.lit("dlq.canonical.wellness_event"), F.lit("dlq.canonical.planning_block")), (i % 3 + 1).cast("int"))
    origin = F.when(i % 19 == 0, F.lit("")).when(i % 23 == 0, F.lit("dlq.canonical.training_event")).when(i % 29 == 0, F.lit(None)).otherwise(F.element_at(F.array(F.lit("raw.strength"), F.lit("raw.wellness"), F.lit("raw.planning")), (i % 3 + 1).cast("int")))
    body = F.struct(
        origin.alias("original_topic"), F.when(i % 31 != 0, i.cast("string")).alias("original_key"), F.when(i % 37 == 0, F.lit("")).when(i % 41 == 0, F.lit(None)).otherwise(F.base64(F.encode("props", "UTF-8"))).alias("original_value"),
        (i % 43 == 0).alias("original_value_truncated"), F.when(i % 47 != 0, F.element_at(kinds, (i % 5 + 1).cast("int"))).alias("error_type"),
        F.when(i % 53 != 0, F.when(i % 59 == 0, F.lit(NOW_MS + 5)).otherwise(ms)).alias("timestamp"),
    )
    value = F.when(i % 61 == 0, F.lit("{broken")).when(i % 67 == 0, F.lit('{"original_value": "e30="}')).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))
    return e.select(topic.alias("topic"), i.alias("offset"), value.alias("value"))


LETTERS_SQL = f"""
letters AS (SELECT event_id AS "offset", ['dlq.canonical.training_event', 'dlq.canonical.wellness_event', 'dlq.canonical.planning_block'][event_id % 3 + 1] AS topic,
    CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'dlq.canonical.training_event' WHEN event_id % 29 = 0 THEN NULL ELSE ['raw.strength', 'raw.wellness', 'raw.planning'][event_id % 3 + 1] END AS original_topic,
    CASE WHEN event_id % 31 <> 0 THEN CAST(event_id AS VARCHAR) END AS original_key, CASE WHEN event_id % 37 = 0 THEN 0 ELSE octet_length(encode(props)) END AS payload_size,
    event_id % 43 = 0 AS truncated, CASE WHEN event_id % 47 <> 0 THEN ['VALIDATION_FAILURE', 'TRANSFORM_ERROR', 'LATE_DATA', 'SCHEMA_INCOMPATIBILITY', 'ODD'][event_id % 5 + 1] END AS error_type,
    CASE WHEN event_id % 53 <> 0 THEN CASE WHEN event_id % 59 = 0 THEN {NOW_MS + 5} ELSE (epoch_us(ts) // 1000) END END AS ts_ms,
    event_id % 61 = 0 OR event_id % 67 = 0 OR (event_id % 37 <> 0 AND event_id % 41 = 0) AS corrupt FROM events),
readable AS (SELECT * FROM letters WHERE NOT corrupt)"""

"""Record shapes and constants of the training-load domain."""

from __future__ import annotations

from pyspark.sql import types as T

#: Canonical records, in their column order.
TRAINING_DDL = (
    "event_id STRING, event_time BIGINT, ingest_time BIGINT, source STRING, schema_version INT, athlete_id STRING, event_type STRING, "
    "workout_id STRING, exercise_id STRING, set_number INT, reps INT, weight_kg DOUBLE, rpe DOUBLE, rir DOUBLE, activity_type STRING, "
    "distance_km DOUBLE, duration_sec INT, avg_hr INT, tss DOUBLE, session_load DOUBLE"
)
WELLNESS_DDL = (
    "event_id STRING, event_time BIGINT, ingest_time BIGINT, source STRING, schema_version INT, athlete_id STRING, event_type STRING, "
    "sleep_hours DOUBLE, resting_hr INT, hrv DOUBLE, steps INT, body_weight_kg DOUBLE, calories INT, protein_g DOUBLE, carbs_g DOUBLE, "
    "fat_g DOUBLE, nutrition_adherence DOUBLE, energy INT, soreness INT, mood INT, stress INT, perceived_recovery INT"
)
PLANNING_DDL = (
    "event_id STRING, event_time BIGINT, ingest_time BIGINT, source STRING, schema_version INT, athlete_id STRING, block_id STRING, "
    "goal STRING, start_date BIGINT, end_date BIGINT, planned_sessions_per_week INT, weekly_volume_targets STRING"
)
DLQ_DDL = (
    "original_topic STRING, original_key STRING, original_value STRING, original_value_truncated BOOLEAN, original_value_size_bytes INT, "
    "error_type STRING, error_message STRING, error_stack STRING, timestamp BIGINT"
)
METRICS_DDL = (
    "athlete_id STRING, metric_date DATE, acute_load DOUBLE, chronic_load_28d DOUBLE, chronic_load_42d DOUBLE, acute_chronic_ratio DOUBLE, "
    "deload_flag INT, fatigue_score DOUBLE, readiness_score DOUBLE, coaching_flags STRING, recovery_score DOUBLE, adherence_score DOUBLE"
)
ATHLETES_DDL = "athlete_id STRING, name STRING, sport STRING, created_at TIMESTAMP"
PLANS_DDL = (
    "athlete_id STRING, block_id STRING, ingest_time BIGINT, goal STRING, start_date DATE, end_date DATE, planned_sessions_per_week INT, weekly_volume_targets STRING"
)

#: Topics by kind.
RAW_TOPICS = tuple(f"raw.{d}" for d in ("strength", "cardio", "recovery", "nutrition", "wellness", "planning"))
CANONICAL_TOPICS = ("canonical.training_event", "canonical.wellness_event", "canonical.planning_block")
DLQ_TOPICS = ("dlq.canonical.training_event", "dlq.canonical.wellness_event", "dlq.canonical.planning_block")

#: Days that topics keep their records; the canonical ones are compacted as well.
RETENTION_DAYS = {t: 14 if t in ("raw.recovery", "raw.planning") else 7 for t in RAW_TOPICS + DLQ_TOPICS} | dict(zip(CANONICAL_TOPICS, (30, 30, 90), strict=True))

#: Event types.
STRENGTH_SET, CARDIO_ACTIVITY = "STRENGTH_SET", "CARDIO_ACTIVITY"
WELLNESS_DAILY, NUTRITION_DAILY, RECOVERY_SNAPSHOT = "WELLNESS_DAILY", "NUTRITION_DAILY", "RECOVERY_SNAPSHOT"
TRAINING_TYPES, WELLNESS_TYPES = (STRENGTH_SET, CARDIO_ACTIVITY), (WELLNESS_DAILY, NUTRITION_DAILY, RECOVERY_SNAPSHOT)

#: Windows in days, thresholds and weights of the formulas.
ACUTE_DAYS, CHRONIC_DAYS, LONG_DAYS = 7, 28, 42
RATIO_HIGH, RATIO_LOW, STREAK = 1.3, 0.8, 3
RATIO_DANGER = 1.5
HRV_BASELINE = 60.0
MAX_PAYLOAD_BYTES = 512 * 1024
MAX_REPLAY_BYTES = 1024 * 1024
DAY_MS = 86_400_000


def struct(ddl: str) -> T.StructType:
    """A STRUCT of nullable columns from DDL text, with no session needed."""
    kinds = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in (part.split() for part in ddl.split(","))])


def is_backward_compatible(old: T.StructType, new: T.StructType) -> bool:
    """Whether records written with `old` can be read with `new`: only optional columns may be added."""
    before = {f.name: f for f in old}
    after = {f.name: f for f in new}
    kept = all(name in after and after[name].dataType == f.dataType and (after[name].nullable or not f.nullable) for name, f in before.items())
    return kept and all(f.nullable for name, f in after.items() if name not in before)

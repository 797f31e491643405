"""Dead-letter envelopes: building, decoding, classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DAY_MS, MAX_PAYLOAD_BYTES

#: Fixed value: what it takes to mend an error.
FIXABILITY = {
    "VALIDATION_FAILURE": "DATA_FIX",
    "TRANSFORM_ERROR": "DATA_FIX",
    "SCHEMA_INCOMPATIBILITY": "INFRA_FIX",
    "DESERIALIZATION_ERROR": "INFRA_FIX",
    "LATE_DATA": "LATE_ARRIVAL",
}
#: Fixed value: retention of dead letters, in days.
RETENTION_DAYS = 7


def envelope(topic: Column, key: Column, value: Column, error_type: Column, message: Column, now_ms: Column | None = None, max_bytes: int = MAX_PAYLOAD_BYTES) -> list[Column]:
    """The nine columns of an envelope; a value over `max_bytes` is dropped and marked."""
    raw = F.encode(F.coalesce(value, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    return [
        topic.alias("original_topic"), key.alias("original_key"), F.when(size > max_bytes, F.lit("")).otherwise(F.replace(F.replace(F.base64(raw), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))).alias("original_value"),
        (size > max_bytes).alias("original_value_truncated"), size.cast("int").alias("original_value_size_bytes"), error_type.alias("error_type"),
        message.alias("error_message"), F.lit("").alias("error_stack"), now.cast("bigint").alias("timestamp"),
    ]


_SHAPE = "original_topic STRING, original_key STRING, original_value STRING, original_value_truncated BOOLEAN, error_type STRING, timestamp BIGINT"


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """`messages` with the envelope's columns, `payload` (binary) and `corrupt`.

    Corrupt: no JSON object, no original_topic or original_value key, a null value, or
    one that is no base64.
    """
    parsed = messages.withColumn("__v", F.try_parse_json(F.col(value))).withColumn("__e", F.from_json(F.col(value), _SHAPE))
    keys = F.coalesce(F.json_object_keys(F.when(F.col("__v").isNotNull(), F.col(value))), F.array().cast("array<string>"))
    clean = F.regexp_replace(F.col("__e.original_value"), r"[^A-Za-z0-9+/=]", "")
    payload = F.try_to_binary(clean, F.lit("base64"))
    corrupt = F.col("__v").isNull() | ~F.array_contains(keys, "original_topic") | F.col("__e.original_value").isNull() | payload.isNull()
    out = parsed.withColumn("corrupt", F.coalesce(corrupt, F.lit(True))).withColumn("payload", payload)
    names = ("original_topic", "original_key", "error_type", "timestamp")
    truncated = F.coalesce(F.col("__e.original_value_truncated"), F.lit(False)).alias("original_value_truncated")
    return out.select(*messages.columns, *[F.col(f"__e.{n}").alias(n) for n in names], truncated, "payload", "corrupt")


def age_bucket(timestamp: Column, now_ms: Column) -> Column:
    age = now_ms - timestamp
    buckets = F.when(timestamp.isNull(), "null_ts").when(age < 0, "clock_skew").when(age < DAY_MS, "<1d").when(age < 3 * DAY_MS, "1-3d")
    return buckets.when(age < 6 * DAY_MS, "3-6d").when(age < RETENTION_DAYS * DAY_MS, ">6d").otherwise("expired")


def fixability(error_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FIXABILITY.items() for x in pair])
    return F.coalesce(F.element_at(known, error_type), F.lit("UNKNOWN"))


def depth_status(depth: Column) -> Column:
    return F.when(depth <= 0, "ok").otherwise("warning")

"""Metrics rows as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.dlq import envelope
from ..functions.loads import finite

LOADS = ("acute_load", "chronic_load_28d", "chronic_load_42d")
SCORES = ("acute_chronic_ratio", "fatigue_score", "readiness_score")


def _ready() -> Column:
    ok = F.lit(True)
    for c in LOADS:
        ok = ok & finite(F.col(c))
    return F.coalesce(ok, F.lit(False))


def metrics_messages(metrics: DataFrame) -> DataFrame:
    """(key, value): a JSON object a row, dates as epoch milliseconds, flags as a list, NaN as null.

    Rows whose loads aren't finite have no message; `metrics_rejected` has them.
    """
    some = metrics.where(_ready())
    whole = F.struct(
        "athlete_id", (F.unix_date("metric_date").cast("bigint") * 86_400_000).alias("metric_date"), *LOADS, *[scores.known(F.col(c)).alias(c) for c in SCORES],
        "deload_flag", scores.flags_from_json(F.col("coaching_flags")).alias("coaching_flags"),
    )
    return some.select(F.col("athlete_id").alias("key"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def metrics_rejected(metrics: DataFrame, now_ms=None) -> DataFrame:
    bad = metrics.where(~_ready())
    whole = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in metrics.columns]))
    return bad.select(*envelope(F.lit("athlete.metrics.stream"), F.col("athlete_id"), whole, F.lit("VALIDATION_FAILURE"), F.lit("a load is not finite"), now_ms))

"""Recovery scores from wellness events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.times import ms_to_date


def recovery_scores(events: DataFrame, arrival: str = "ingest_time") -> DataFrame:
    """(athlete_id, metric_date, recovery_score): of a day's scorable events the one that arrived last."""
    score = scores.recovery(F.col("hrv"), F.col("sleep_hours"), F.col("perceived_recovery"))
    scored = events.withColumn("recovery_score", score).where("recovery_score is not null")
    return scored.groupBy("athlete_id", ms_to_date(F.col("event_time")).alias("metric_date")).agg(F.max_by("recovery_score", F.col(arrival)).alias("recovery_score"))

"""Plan adherence: how much of a planning block's sessions and volume was done.

Events meet blocks as days, summed before the join; the join is an equi-join on the
athlete with the dates as its condition, and blocks without events stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import loads
from .dedup import latest_by


def latest_plans(plans: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The last revision of each block, or the last one that was there at a time (`ingest_time` up to `as_of`)."""
    known = plans if as_of is None else plans.where(F.col("ingest_time") <= as_of)
    return latest_by(known, ["athlete_id", "block_id"], "ingest_time")


def adherence_scores(plans: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """(athlete_id, block_id, metric_date, actual_sessions, planned_sessions, actual_volume, adherence_score).

    `daily`: (athlete_id, day, daily_load). Blocks without planned sessions are left out.
    """
    blocks = latest_plans(plans).where("planned_sessions_per_week > 0").withColumn("weeks", loads.block_weeks(F.col("start_date"), F.col("end_date")))
    blocks = blocks.withColumns(
        {
            "planned_sessions": F.col("planned_sessions_per_week") * F.col("weeks"),
            "target": loads.volume_target(F.col("weekly_volume_targets")) * F.col("weeks"),
            "metric_date": F.least(F.col("end_date"), today),
        }
    )
    of = daily.select(F.col("athlete_id").alias("__athlete"), "day", "daily_load")
    met = blocks.join(of, (F.col("athlete_id") == F.col("__athlete")) & F.col("day").between(F.col("start_date"), F.col("metric_date")), "left")
    done = met.groupBy("athlete_id", "block_id", "metric_date", "planned_sessions", "target").agg(F.count("day").alias("actual_sessions"), F.coalesce(F.sum("daily_load"), F.lit(0.0)).alias("actual_volume"))
    score = loads.adherence(F.col("actual_sessions"), F.col("planned_sessions"), F.col("actual_volume"), F.col("target"))
    return done.withColumn("adherence_score", score).drop("target").where("adherence_score is not null")

"""The metrics table kept up under corrections, without recomputing an athlete's history.

A changed day touches the windows of the LONG_DAYS - 1 days after it. A flag depends on the signs
of the last STREAK rows, so beyond the touched days it can only differ on the STREAK - 1 rows that
follow them; behind a gap in the rows it can't, as streaks have no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LONG_DAYS, STREAK
from . import rolling

KEYS = ["athlete_id", "metric_date"]


#: A flag differs at most this many days after a changed day: with the last window that holds it, and the rows of a streak after that.
REACH = LONG_DAYS - 1 + STREAK - 1


def _by_athlete(days: DataFrame, column: str) -> DataFrame:
    """(athlete_id, __days): an athlete's days, a number each. A row an athlete, so that what is joined by
    athlete stays where it is and is not sorted; no more numbers than the calendar has days."""
    return days.groupBy("athlete_id").agg(F.sort_array(F.collect_set(F.unix_date(column))).alias("__days")).hint("shuffle_hash")


def _near(rows: DataFrame, changed: DataFrame, column: str, before: int, after: int) -> DataFrame:
    """The rows at most `before` days before or `after` days after a changed day of their athlete."""
    day = F.unix_date(column)
    near = F.exists("__days", lambda d: day.between(d - before, d + after))
    return rows.join(changed, "athlete_id").where(near).drop("__days")


def corrections(metrics: DataFrame, daily: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of the metrics table that change, with `gone`: whether the row goes.

    `metrics`: the table as it was; `daily`: daily loads as they are now; `changed`: the
    (athlete_id, day) whose load came, went or is another. Only rows that differ from the old ones,
    or are new, are given. No change, no rows; an athlete may be new, or lose the last day.
    """
    days = _by_athlete(changed, "day")
    # A row depends on the loads of the REACH days before it, so these days make the touched rows whole.
    fresh = _near(rolling.metrics_of_days(_near(daily, days, "day", REACH, REACH)), days, "metric_date", 0, REACH)
    old = _near(metrics, days, "metric_date", 0, REACH)
    shape = F.struct(*metrics.columns)
    was, now = old.select(*KEYS, shape.alias("old")), fresh.select(*KEYS, shape.alias("new"))
    # Hashed, not sorted, and never broadcast: sizes are guessed from the daily loads, of which each makes many rows.
    met = was.join(now.hint("shuffle_hash"), KEYS, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return met.select(F.col("new").isNull().alias("gone"), F.coalesce("new", "old").alias("row")).select("row.*", "gone")


def corrected(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    """The metrics table after `corrections`."""
    days = _by_athlete(changes, "metric_date")
    replaced = F.coalesce(F.array_contains("__days", F.unix_date("metric_date")), F.lit(False))
    return metrics.join(days, "athlete_id", "left").where(~replaced).select(*metrics.columns).unionByName(changes.where("not gone").select(*metrics.columns))

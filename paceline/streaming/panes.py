"""Rolling loads of a stream in two steps: days, then windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..schemas import ACUTE_DAYS, CHRONIC_DAYS, LONG_DAYS


def rolling_stream(events: DataFrame, ts: str = "event_ts", delay: str = "24 hours") -> DataFrame:
    """(athlete_id, metric_date, window_load, acute_load, chronic_load_28d, chronic_load_42d, acute_chronic_ratio) of (athlete_id, session_load, `ts`).

    Events are summed to days as they come; a closed day goes once into each of the LONG_DAYS
    windows over it. So an event changes one sum, and state is a row an athlete and open day or
    window, of fixed size. A window is given when `delay` has passed after its last day; gives what
    `rolling.rolling_load` gives over all events. Later events are dropped.
    """
    days = events.withWatermark(ts, delay).groupBy("athlete_id", F.window(ts, "1 day").alias("pane")).agg(F.sum("session_load").alias("load"))
    met = days.select("athlete_id", "load", F.window_time("pane").alias("at")).withColumn("span", F.window("at", f"{LONG_DAYS} days", "1 day"))
    age = F.datediff(F.date_sub(F.col("span.end").cast("date"), 1), F.col("at").cast("date"))
    within = lambda n: F.when(age < n, F.col("load"))
    sums = met.groupBy("athlete_id", "span").agg(
        F.sum("load").alias("window_load"), F.coalesce(F.sum(within(ACUTE_DAYS)), F.lit(0.0)).alias("acute_load"),
        F.coalesce(F.avg(within(CHRONIC_DAYS)), F.lit(0.0)).alias("chronic_load_28d"), F.coalesce(F.avg(within(LONG_DAYS)), F.lit(0.0)).alias("chronic_load_42d"),
    )
    return sums.select(
        "athlete_id", F.date_sub(F.col("span.end").cast("date"), 1).alias("metric_date"), "window_load", "acute_load", "chronic_load_28d", "chronic_load_42d",
        scores.load_ratio(F.col("acute_load"), F.col("chronic_load_28d")).alias("acute_chronic_ratio"),
    )

"""Daily loads, rolling loads, deload streaks and the metrics table.

Events are summed to days before anything else, so windows sort days, not events. The
three rolling windows and the streak share one partitioning by athlete. The metrics table
is made of steps (stretches of days over which no window changes), which become rows last:
a sparse series has a step for ten of its rows, and only steps are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.loads import finite
from ..functions.times import ms_to_date
from ..schemas import ACUTE_DAYS, CHRONIC_DAYS, LONG_DAYS, STREAK


def daily_load(events: DataFrame) -> DataFrame:
    """(athlete_id, day, daily_load) from (athlete_id, event_time ms, session_load); loads that aren't finite don't count."""
    return events.where(finite(F.col("session_load"))).groupBy("athlete_id", ms_to_date(F.col("event_time")).alias("day")).agg(F.sum("session_load").alias("daily_load"))


def largest_of_day(rows: DataFrame) -> DataFrame:
    """One row an athlete and day from several versions of it: the largest load, as a window that fires again only adds."""
    return rows.groupBy("athlete_id", "day").agg(F.max("daily_load").alias("daily_load"))


def recent_days(daily: DataFrame) -> DataFrame:
    """The daily loads that each athlete's latest metrics row depends on.

    That row stands LONG_DAYS - 1 days after the last training day; its windows and those of
    the rows that decide its streak reach back STREAK - 1 days before it at most.
    """
    last = F.max("day").over(Window.partitionBy("athlete_id"))
    return daily.withColumn("__last", last).where(F.datediff("__last", "day") < STREAK).drop("__last")


def days_between(daily: DataFrame, start: Column, end: Column) -> DataFrame:
    """The daily loads that metrics rows from start to end depend on.

    A row's windows reach back LONG_DAYS - 1 days, those of the rows that decide its streak STREAK - 1
    days more.
    """
    return daily.where(F.col("day").between(F.date_sub(start, LONG_DAYS + STREAK - 2), end))


def load_spine(daily: DataFrame, days: int = LONG_DAYS) -> DataFrame:
    """A row for each day whose window of `days` holds a training day, with that day's load or null.

    Each training day makes the days up to the next one, at most `days` of them, so every
    day is made once, however many windows hold it.
    """
    following = F.lead("day").over(Window.partitionBy("athlete_id").orderBy("day"))
    runs = daily.withColumn("__gap", F.least(F.coalesce(F.datediff(following, "day"), F.lit(days)), F.lit(days)))
    # From each training day to the day before the next one, at most `days` days.
    dates = F.transform(F.sequence(F.lit(0), F.col("__gap") - 1), lambda k: F.date_add(F.col("day"), k))
    out = runs.select("athlete_id", "daily_load", "day", F.posexplode(dates).alias("__k", "metric_date"))
    return out.select("athlete_id", "metric_date", F.when(F.col("__k") == 0, F.col("daily_load")).alias("daily_load"))


def rolling_load(spine: DataFrame, keep_number: bool = False) -> DataFrame:
    """Acute sum over 7 days; chronic means over 28 and 42 days, of the days present; their ratio."""
    by_date = Window.partitionBy("athlete_id").orderBy("__d")
    over = lambda days: by_date.rangeBetween(1 - days, 0)
    # The day's number is a column of its own, so that all windows, here and in
    # `deload_flag`, share one sort.
    out = _numbered(spine).withColumns(
        {
            "acute_load": F.coalesce(F.sum("daily_load").over(over(ACUTE_DAYS)), F.lit(0.0)),
            "chronic_load_28d": F.coalesce(F.avg("daily_load").over(over(CHRONIC_DAYS)), F.lit(0.0)),
            "chronic_load_42d": F.coalesce(F.avg("daily_load").over(over(LONG_DAYS)), F.lit(0.0)),
        }
    )
    return out.withColumn("acute_chronic_ratio", scores.load_ratio(F.col("acute_load"), F.col("chronic_load_28d"))).drop(*([] if keep_number else ["__d"]))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows if "__d" in rows.columns else rows.withColumn("__d", F.unix_date("metric_date"))


def deload_flag(rolled: DataFrame, streak: int = STREAK) -> DataFrame:
    """`rolled` with deload_flag: 1 or -1 from the third row on of a run of high or low ratios, else 0.

    Runs go over the rows there are, in order of date; a gap without rows doesn't end one.
    """
    by_date = Window.partitionBy("athlete_id").orderBy("__d")
    signed = _numbered(rolled).withColumn("__sign", scores.ratio_sign(F.col("acute_chronic_ratio")))
    turned = F.coalesce((F.col("__sign") != F.lag("__sign").over(by_date)).cast("int"), F.lit(1))
    marked = signed.withColumn("__turn", turned)
    # The number of the last row at which the sign turned gives a run's length, in the same sort.
    numbered = marked.withColumn("__n", F.row_number().over(by_date))
    start = F.max(F.when(F.col("__turn") == 1, F.col("__n"))).over(by_date.rowsBetween(Window.unboundedPreceding, 0))
    length = F.col("__n") - start + 1
    return numbered.withColumn("deload_flag", F.when(length >= streak, F.col("__sign")).otherwise(0).cast("int")).drop("__sign", "__turn", "__n", "__d")


def load_steps(daily: DataFrame) -> DataFrame:
    """The rolling loads as steps: (athlete_id, since, until, the loads and their ratio), days by their numbers, `until` not included.

    A load enters its windows on its day and leaves each after its last day; between such days
    no window changes. A leaving day that is a training day makes no step of its own, so a dense series
    has as many steps as days. There are steps only where the longest window holds a training day.
    """
    by_day = Window.partitionBy("athlete_id").orderBy("since")
    spans = (ACUTE_DAYS, CHRONIC_DAYS, LONG_DAYS)
    trained = daily.select("athlete_id", F.unix_date("day").alias("since"), "daily_load").withColumns({f"__at_{n}": F.count("*").over(by_day.rangeBetween(n, n)) for n in spans})
    step = lambda since, load, trains, kept: F.struct(since.alias("since"), load.alias("daily_load"), F.lit(trains).alias("trains"), kept.alias("kept"))
    entered = step(F.col("since"), F.col("daily_load"), True, F.lit(True))
    left = [step(F.col("since") + n, F.lit(None).cast(daily.schema["daily_load"].dataType), False, F.col(f"__at_{n}") == 0) for n in spans]
    steps = trained.select("athlete_id", F.inline(F.array(entered, *left))).where("kept")
    over = lambda days: by_day.rangeBetween(1 - days, 0)
    rolled = steps.withColumns(
        {
            "acute_load": F.coalesce(F.sum("daily_load").over(over(ACUTE_DAYS)), F.lit(0.0)),
            "chronic_load_28d": F.coalesce(F.avg("daily_load").over(over(CHRONIC_DAYS)), F.lit(0.0)),
            "chronic_load_42d": F.coalesce(F.avg("daily_load").over(over(LONG_DAYS)), F.lit(0.0)),
            "held": F.count(F.when(F.col("trains"), 1)).over(over(LONG_DAYS)),
            "until": F.lead("since").over(by_day),
        }
    )
    # Of leaving days that fall together the last one's step is the one with days in it.
    real = rolled.where("held > 0 and until > since")
    ratio = scores.load_ratio(F.col("acute_load"), F.col("chronic_load_28d")).alias("acute_chronic_ratio")
    return real.select("athlete_id", "since", "until", "acute_load", "chronic_load_28d", "chronic_load_42d", ratio)


def _days_of(steps: DataFrame, *columns) -> DataFrame:
    """A row for each day of each step: (athlete_id, metric_date, `columns`), which may use the day's number `__t`."""
    kept = [c for c in steps.columns if c != "until"]
    rows = steps.select(*kept, F.explode(F.sequence(F.col("since"), F.col("until") - 1)).alias("__t"))
    return rows.select("athlete_id", F.date_from_unix_date("__t").alias("metric_date"), *columns)


_LOADS = ("acute_load", "chronic_load_28d", "chronic_load_42d", "acute_chronic_ratio")


def rolling_load_of_days(daily: DataFrame) -> DataFrame:
    """`rolling_load` of `load_spine`, from daily loads."""
    return _days_of(load_steps(daily), *_LOADS)


def metrics_of_days(daily: DataFrame, streak: int = STREAK) -> DataFrame:
    """The metrics table's load columns, from daily loads.

    Flags are as `deload_flag` gives them. A run of high or low ratios has no gap in it: before and
    after days without rows the ratio is none or 1. So a run's length is a number of days.
    """
    by_day = Window.partitionBy("athlete_id").orderBy("since")
    steps = load_steps(daily).withColumn("__sign", scores.ratio_sign(F.col("acute_chronic_ratio")))
    steps = steps.withColumn("__turn", F.coalesce(F.col("__sign") != F.lag("__sign").over(by_day), F.lit(True)))
    steps = steps.withColumn("__start", F.max(F.when(F.col("__turn"), F.col("since"))).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    fatigue = scores.fatigue(F.col("acute_load"), F.col("chronic_load_42d"))
    flags = lambda flag: F.to_json(scores.coaching_flags(flag, F.col("fatigue_score")))
    scored = steps.withColumns({"fatigue_score": fatigue, "readiness_score": scores.readiness(F.col("acute_chronic_ratio"), F.col("chronic_load_28d"))})
    # Both texts a step, so that rows only choose.
    scored = scored.withColumns({"__flagged": flags(F.col("__sign")), "__unflagged": flags(F.lit(0))})
    long = F.col("__t") - F.col("__start") + 1 >= streak
    return _days_of(
        scored, *_LOADS, F.when(long, F.col("__sign")).otherwise(0).cast("int").alias("deload_flag"), "fatigue_score", "readiness_score",
        F.when(long, F.col("__flagged")).otherwise(F.col("__unflagged")).alias("coaching_flags"),
    )


def athlete_metrics(events: DataFrame) -> DataFrame:
    """The metrics table's load columns, from training events."""
    return metrics_of_days(daily_load(events))


def tumbling_day(events: DataFrame, ts: str = "event_ts") -> DataFrame:
    """One-day windows from UTC midnight; works on streams."""
    return events.groupBy("athlete_id", F.window(ts, "1 day")).agg(F.sum("session_load").alias("daily_load")).select("athlete_id", F.col("window.start").cast("date").alias("day"), "daily_load")


def sliding_windows(events: DataFrame, days: int = LONG_DAYS, ts: str = "event_ts") -> DataFrame:
    """(athlete_id, metric_date, window_load): windows of `days` that slide by a day. `rolling_load` gives the same without a copy of each row a window; this form also runs on streams."""
    of = events.groupBy("athlete_id", F.window(ts, f"{days} days", "1 day")).agg(F.sum("session_load").alias("window_load"))
    return of.select("athlete_id", F.date_sub(F.col("window.end").cast("date"), 1).alias("metric_date"), "window_load")

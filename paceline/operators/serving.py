"""The serving queries: what the dashboards and endpoints ask of the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..schemas import RATIO_DANGER, RATIO_HIGH
from .dedup import latest_by


def _with_athletes(rows: DataFrame, athletes: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joins on athlete_id; the optimizer broadcasts the dimension where its size allows."""
    return rows.join(athletes.select("athlete_id", *columns), "athlete_id", how)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    return latest_by(metrics, ["athlete_id"], "metric_date")


def by_sport(metrics: DataFrame, athletes: DataFrame) -> DataFrame:
    """Per sport over the athletes' latest rows: how many, and their mean loads and scores."""
    latest = latest_metrics(metrics.select("athlete_id", "metric_date", "acute_load", "chronic_load_28d", "acute_chronic_ratio", "fatigue_score", "readiness_score"))
    names = {"acute_load": "avg_acute_load", "chronic_load_28d": "avg_chronic_load", "acute_chronic_ratio": "avg_acr", "fatigue_score": "avg_fatigue", "readiness_score": "avg_readiness"}
    return _with_athletes(latest, athletes, ("sport",)).groupBy("sport").agg(F.count("*").alias("athlete_count"), *[F.avg(c).alias(n) for c, n in names.items()])


def risk_distribution(metrics: DataFrame, athletes: DataFrame) -> DataFrame:
    """Per sport the athletes whose latest ratio is safe, cautionary, dangerous or unknown."""
    latest, r = latest_metrics(metrics.select("athlete_id", "metric_date", "acute_chronic_ratio")), F.col("acute_chronic_ratio")
    zones = {"safe": r < RATIO_HIGH, "caution": r.between(RATIO_HIGH, RATIO_DANGER), "danger": r > RATIO_DANGER, "unknown": r.isNull()}
    return _with_athletes(latest, athletes, ("sport",)).groupBy("sport").agg(*[F.count_if(c).alias(n) for n, c in zones.items()])


def sport_daily_average(metrics: DataFrame, athletes: DataFrame, sport: str, start: Column, end: Column) -> DataFrame:
    some = metrics.where(F.col("metric_date").between(start, end)).select("athlete_id", "metric_date", "acute_load", "chronic_load_28d", "acute_chronic_ratio")
    of = _with_athletes(some, athletes.where(F.col("sport") == sport), ())
    means = [F.avg("acute_load").alias("avg_acute_load"), F.avg("chronic_load_28d").alias("avg_chronic_load"), F.avg("acute_chronic_ratio").alias("avg_acr")]
    return of.groupBy("metric_date").agg(*means, F.countDistinct("athlete_id").alias("athlete_count"))


def sport_exists(athletes: DataFrame, sport: str) -> bool:
    return not athletes.where(F.col("sport") == sport).limit(1).isEmpty()


def athlete_exists(metrics: DataFrame, athlete_id: str) -> bool:
    return not metrics.where(F.col("athlete_id") == athlete_id).limit(1).isEmpty()


def athlete_list(metrics: DataFrame) -> DataFrame:
    return metrics.select("athlete_id").distinct().orderBy("athlete_id")


def athlete_directory(metrics: DataFrame, athletes: DataFrame) -> DataFrame:
    """Every athlete with metrics, by sport and id; name and sport are null without a directory row, and come last."""
    some = _with_athletes(metrics.select("athlete_id").distinct(), athletes, ("name", "sport"), "left")
    return some.orderBy(F.asc_nulls_last("sport"), "athlete_id")


def sports(athletes: DataFrame) -> DataFrame:
    """Sports and their athletes, the largest first."""
    return athletes.groupBy("sport").agg(F.count("*").alias("athlete_count")).orderBy(F.desc("athlete_count"), "sport")


def sport_facets(directory: DataFrame) -> DataFrame:
    return directory.groupBy(F.coalesce("sport", F.lit("Other")).alias("sport")).agg(F.count("*").alias("athlete_count"))


def athlete_search(directory: DataFrame, text: str, sport: str = "all", limit: int = 200) -> DataFrame:
    """Ids or names that hold `text` in any case, of one sport or all; the first `limit` by id."""
    low = text.strip().lower()
    hit = F.lower("athlete_id").contains(low) | F.coalesce(F.lower("name").contains(low), F.lit(False))
    rows = directory.where(hit) if low else directory
    rows = rows if sport == "all" else rows.where(F.coalesce("sport", F.lit("Other")) == sport)
    return rows.orderBy("athlete_id").limit(limit)


def metrics_range(metrics: DataFrame, athlete_id: str, start: Column, end: Column) -> DataFrame:
    """One athlete's rows from start to end, both included; with the flags as a list. None where start is after end."""
    rows = metrics.where((F.col("athlete_id") == athlete_id) & F.col("metric_date").between(start, end))
    return rows.withColumn("coaching_flags", scores.flags_from_json(F.col("coaching_flags"))).orderBy("metric_date")


def densify(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A row a day from each athlete's first to last date; days without a row have nulls.

    Rows pass as they are; the days between them are made from bits of the days there are, a
    number an athlete and 60 days. So rows are neither sorted nor joined to days.
    """
    day, bits = F.unix_date("metric_date"), 60
    metrics = metrics.where("metric_date is not null")
    there = metrics.groupBy("athlete_id", F.floor(day / bits).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(bits)))).alias("days"), F.min(day).alias("a"), F.max(day).alias("z"))
    following = F.lead("a").over(Window.partitionBy("athlete_id").orderBy("block"))
    # From a block's first day to the one before the next block's.
    spans = there.select("athlete_id", "block", "days", "a", F.coalesce(following - 1, "z").alias("z"))
    span = spans.select("athlete_id", "block", "days", F.explode(F.sequence("a", "z")).alias("day"))
    held = (F.floor(F.col("day") / bits) == F.col("block")) & (F.call_function("getbit", F.col("days"), F.pmod(F.col("day"), F.lit(bits))) == 1)
    nothing = [F.lit(None).cast(metrics.schema[c].dataType).alias(c) for c in columns]
    missing = span.where(~held).select("athlete_id", F.date_from_unix_date("day").alias("metric_date"), *nothing)
    return metrics.select("athlete_id", "metric_date", *columns).unionByName(missing)


def peers(athletes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(athlete_id, sport) of all athletes of the sports of `chosen` (a table of ids)."""
    one = athletes.join(chosen.select("athlete_id"), "athlete_id", "left_semi")
    return athletes.join(one.select("sport").distinct(), "sport", "left_semi").select("athlete_id", "sport")


def athlete_vs_sport(metrics: DataFrame, athletes: DataFrame, chosen: str | DataFrame, start: Column, end: Column) -> DataFrame:
    """An athlete's days, or those of each of several (a table of ids), beside the mean of their sport."""
    one = athletes.where(F.col("athlete_id") == chosen) if isinstance(chosen, str) else athletes.join(chosen.select("athlete_id"), "athlete_id", "left_semi")
    days = metrics.where(F.col("metric_date").between(start, end)).select("athlete_id", "metric_date", "acute_load")
    peers = athletes.join(one.select("sport").distinct(), "sport", "left_semi").select("athlete_id", "sport")
    mean = days.join(peers, "athlete_id").groupBy("sport", "metric_date").agg(F.avg("acute_load").alias("sport_acute_load"))
    own = days.join(one.select("athlete_id", "sport"), "athlete_id") if not isinstance(chosen, str) else days.where(F.col("athlete_id") == chosen).join(one.select("athlete_id", "sport"), "athlete_id", "left")
    return own.join(mean, ["sport", "metric_date"], "left").select("athlete_id", "metric_date", "acute_load", "sport_acute_load")


def sport_ranking(summary: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """`summary` ordered by a column; null counts as the smallest. Ties go by sport."""
    return summary.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_first(by), "sport")


def danger_ranking(risks: DataFrame) -> DataFrame:
    """Sports by their athletes in danger, most first; ties go by sport."""
    return risks.orderBy(F.desc("danger"), "sport")


def metric_ranking(summary: DataFrame, by: str) -> DataFrame:
    """Sports by a metric, largest first, null counting as 0; ties go by sport."""
    return summary.orderBy(F.desc(F.coalesce(F.col(by), F.lit(0.0))), "sport")


def chart_domain(metrics: DataFrame, column: str = "acute_load", default: float = 200.0) -> DataFrame:
    """The chart's upper end: a tenth over the largest value, rounded up."""
    return metrics.agg(F.coalesce(F.ceil(F.max(column) * 1.1).cast("double"), F.lit(default)).alias("upper"))


def deload_days(metrics: DataFrame) -> DataFrame:
    return metrics.where("deload_flag = 1").select("athlete_id", "metric_date")


def drop_prefix(rows: DataFrame, prefix: str, column: str = "athlete_id") -> DataFrame:
    """Rows whose id doesn't start with `prefix`."""
    return rows.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))

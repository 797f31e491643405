"""Reports over dead letters, and the replay plan. `letters`: topic, and the columns of `functions.dlq.decode`."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dlq
from ..schemas import CANONICAL_TOPICS, MAX_REPLAY_BYTES, RAW_TOPICS


def error_types(letters: DataFrame) -> DataFrame:
    """Counts by topic and error type; topic 'ALL' has the sums over topics."""
    of = letters.where("not corrupt").select("topic", F.coalesce("error_type", F.lit("NULL")).alias("error_type"))
    rolled = of.groupingSets([[F.col("topic"), F.col("error_type")], [F.col("error_type")]], "topic", "error_type").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("topic", F.lit("ALL")).alias("topic"), "error_type", "n")


def label_keys(*reports: DataFrame, key: str) -> DataFrame:
    """The labels that any of several reports has, each once: the rows of a table that shows them side by side."""
    return functools.reduce(DataFrame.unionByName, [r.select(key) for r in reports]).distinct()


def ages(letters: DataFrame, now_ms: Column) -> DataFrame:
    of = letters.where("not corrupt")
    return of.groupBy("topic", dlq.age_bucket(F.col("timestamp"), now_ms).alias("bucket")).agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def age_extremes(letters: DataFrame) -> DataFrame:
    return letters.where("not corrupt").groupBy("topic").agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def triage(letters: DataFrame) -> DataFrame:
    """Counts by topic, fixability and origin."""
    origin = F.when(F.coalesce("original_topic", F.lit("")) == "", "UNKNOWN_ORIGIN").otherwise(F.col("original_topic"))
    return letters.where("not corrupt").groupBy("topic", dlq.fixability(F.col("error_type")).alias("fixability"), origin.alias("origin")).agg(F.count("*").alias("n"))


def samples(letters: DataFrame, *order: str, count: int = 3) -> DataFrame:
    """The first `count` letters of each topic, error type and origin, without their payloads."""
    origin = F.when(F.coalesce("original_topic", F.lit("")) == "", "UNKNOWN_ORIGIN").otherwise(F.col("original_topic"))
    of = letters.where("not corrupt").select("topic", F.coalesce("error_type", F.lit("NULL")).alias("error_type"), origin.alias("origin"), *[c for c in order if c != "topic"])
    rank = F.row_number().over(Window.partitionBy("topic", "error_type", "origin").orderBy(*order))
    return of.withColumn("n", rank).where(F.col("n") <= count)


def scan_counters(letters: DataFrame, max_count: int | None = None, order: Sequence[str] = ("topic", "partition", "offset")) -> DataFrame:
    """How many letters a scan saw and could not read; of the first `max_count` where one is given."""
    of = letters.orderBy(*order).limit(max_count) if max_count is not None else letters
    return of.agg(F.count("*").alias("scanned"), F.count_if("corrupt").alias("corrupt"))


def retention_warning(aged: DataFrame) -> DataFrame:
    """Topics with letters close to or past retention."""
    return aged.where(F.col("bucket").isin(">6d", "expired")).groupBy("topic").agg(F.sum("n").alias("n"))


def depth(offsets: DataFrame) -> DataFrame:
    """Per topic the sum over partitions of latest - earliest, 0 at least, and its status."""
    of = offsets.groupBy("topic").agg(F.sum(F.greatest(F.col("latest") - F.col("earliest"), F.lit(0))).alias("depth"))
    return of.withColumn("status", dlq.depth_status(F.col("depth")))


def replay_plan(letters: DataFrame, order: str | Sequence[str], error_type: str | None = None, max_count: int | None = None, max_bytes: int = MAX_REPLAY_BYTES) -> DataFrame:
    """`letters` with `outcome`: replayed, skipped_unrecoverable, skipped_oversized or filtered, the first rule that holds.

    With `max_count`, letters after that many processed ones (filtered ones don't count)
    are left out, also where several share a place in the `order` of columns.
    """
    valid = F.coalesce(F.col("original_topic").isin(*RAW_TOPICS, *CANONICAL_TOPICS), F.lit(False))
    size = F.octet_length("payload")
    outcome = F.when(F.col("corrupt"), "skipped_unrecoverable")
    if error_type is not None:
        outcome = outcome.when(~F.coalesce(F.col("error_type") == error_type, F.lit(False)), "filtered")
    outcome = outcome.when(F.col("original_value_truncated") | (size == 0), "skipped_unrecoverable").when(size > max_bytes, "skipped_oversized").when(~valid, "skipped_unrecoverable").otherwise("replayed")
    planned = letters.withColumn("outcome", outcome).withColumn("null_key", (F.col("outcome") == "replayed") & F.col("original_key").isNull())
    if max_count is None:
        return planned
    order = [order] if isinstance(order, str) else list(order)
    # Exactly the first letters that are processed, and the filtered ones before the last of them.
    first = planned.where("outcome != 'filtered'").orderBy(*order).limit(max_count)
    last = first.agg(F.max(F.struct(*order)).alias("last"), F.count("*").alias("n"))  # one row
    passed = planned.where("outcome = 'filtered'").crossJoin(F.broadcast(last)).where((F.col("n") < max_count) | (F.struct(*order) <= F.col("last")))
    return first.unionByName(passed.select(*planned.columns))


def replay_report(planned: DataFrame) -> DataFrame:
    outcomes = ("replayed", "skipped_oversized", "skipped_unrecoverable")
    return planned.where("outcome != 'filtered'").groupBy("topic").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])

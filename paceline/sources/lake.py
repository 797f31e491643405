"""The lake: Parquet by event day, sorted by athlete within files.

Partitioning by athlete as well would make a file for each athlete and day; sorting
gives the same skipping by row-group statistics.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ms_to_date
from ..schemas import TRAINING_DDL

TARGET_BYTES = 128 * 1024 * 1024


def append(events: DataFrame, path: str) -> None:
    """Appends canonical events; days are split over tasks by athlete, so a busy day isn't one task."""
    dated = events.withColumn("event_day", ms_to_date(F.col("event_time")))
    part = F.pmod(F.xxhash64("athlete_id"), F.lit(8))
    dated.repartition("event_day", part).sortWithinPartitions("event_day", "athlete_id").write.mode("append").option("compression", "snappy").partitionBy("event_day").parquet(path)


def replace_batch(events: DataFrame, path: str, number: int) -> None:
    """Appends a micro-batch under its own number, so that a batch that runs again replaces what it wrote."""
    dated = events.withColumn("event_day", ms_to_date(F.col("event_time"))).withColumn("batch", F.lit(number))
    dated.sortWithinPartitions("event_day", "athlete_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "event_day").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All events that `replace_batch` wrote."""
    return spark.read.schema(TRAINING_DDL + ", batch INT, event_day DATE").parquet(path).drop("batch")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events under `path`; filters on event_day prune folders, those on athlete_id row groups."""
    return spark.read.schema(TRAINING_DDL + ", event_day DATE").parquet(path)


def read_files(spark: SparkSession, manifest: str) -> DataFrame:
    """The files a manifest names (a JSON list of paths), and no others."""
    files = json.loads("".join(r["value"] for r in spark.read.text(manifest).collect()))  # a list of paths
    if not files:
        return spark.createDataFrame([], TRAINING_DDL)
    return spark.read.schema(TRAINING_DDL).parquet(*files)


def compact(spark: SparkSession, path: str, to: str, target_bytes: int = TARGET_BYTES, row_bytes: int = 120) -> None:
    """Rewrites the lake to `to` with files of about `target_bytes`: as many tasks a day as its rows need."""
    rows = read(spark, path)
    per_file = max(1, target_bytes // row_bytes)
    counts = rows.groupBy("event_day").agg(F.ceil(F.count("*") / per_file).cast("int").alias("files"))
    dealt = rows.join(counts, "event_day").withColumn("__part", F.pmod(F.xxhash64("athlete_id", "event_id"), F.col("files")))
    dealt.repartition("event_day", "__part").sortWithinPartitions("event_day", "athlete_id").drop("files", "__part").write.mode("overwrite").partitionBy("event_day").parquet(to)


def expire_before(spark: SparkSession, path: str, day: str, to: str) -> None:
    """Rewrites the lake to `to` without the days before `day`; only folders that stay are read."""
    read(spark, path).where(F.col("event_day") >= F.lit(day).cast("date")).write.mode("overwrite").partitionBy("event_day").parquet(to)

"""Do the serving store and the lake hold the same athlete days?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DAY_MS


def parity(serving: DataFrame, lake: DataFrame, serving_day: Column, lake_day: Column) -> DataFrame:
    """(athlete_id, day_epoch_ms, side): days that one side lacks. Days are epoch milliseconds of UTC midnights.

    One aggregate over the union of both key sets; neither side is read twice.
    """
    keys = lambda df, day, side: df.select(F.col("athlete_id").cast("string"), day.alias("day_epoch_ms"), F.lit(side).alias("side"))
    both = keys(serving, serving_day, 1).unionByName(keys(lake, lake_day, 2))
    held = both.groupBy("athlete_id", "day_epoch_ms").agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return held.select("athlete_id", "day_epoch_ms", F.when(F.col("sides") == 1, "iceberg_missing").otherwise("pg_missing").alias("side"))


#: Buckets that athletes are dealt into by hash. Digests are a row a bucket and month.
BUCKETS = 256
_KEYS = ["bucket", "athlete_id", "month"]


def month_masks(rows: DataFrame, day: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, athlete_id, month, days): the days an athlete has rows on, as bits of a number a month.

    Tasks put their rows' bits together before they are moved, so what moves is athletes' months,
    not events, and repeated rows change nothing. `day` is epoch milliseconds of UTC midnights.
    """
    athlete, date = F.col("athlete_id").cast("string"), F.date_from_unix_date(F.floor(day / F.lit(DAY_MS)).cast("int"))
    bits = rows.select(athlete.alias("athlete_id"), (F.year(date) * 12 + F.month(date) - 1).alias("month"), F.lit(1).cast("long").alias("one"), F.dayofmonth(date).alias("of"))
    masks = bits.groupBy("athlete_id", "month").agg(F.bit_or(F.call_function("shiftleft", "one", "of")).alias("days"))
    return masks.select(F.pmod(F.xxhash64("athlete_id"), F.lit(buckets)).cast("int").alias("bucket"), "athlete_id", "month", "days")


def digests(masks: DataFrame) -> DataFrame:
    """(bucket, month, n, total, mixed): order-free digests. Equal ones mean equal masks, but for a chance of 2**-100."""
    h = lambda salt: F.xxhash64(F.lit(salt), "athlete_id", "month", "days")
    return masks.groupBy("bucket", "month").agg(F.count("*").alias("n"), F.sum(F.pmod(h(1), F.lit(2**40))).alias("total"), F.bit_xor(h(2)).alias("mixed"))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(bucket, month) whose digests differ, or that one side lacks."""
    both = one.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(2)))
    same = (F.count("*") == 2) & (F.min("n") == F.max("n")) & (F.min("total") == F.max("total")) & (F.min("mixed") == F.max("mixed"))
    return both.groupBy("bucket", "month").agg(same.alias("same")).where("not same").select("bucket", "month")


def _unlike(serving: DataFrame, lake: DataFrame) -> DataFrame:
    """As `parity`, from masks: the days that one side's bits lack."""
    sides = serving.select(*_KEYS, F.col("days").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(lake.select(*_KEYS, F.lit(0).cast("long").alias("a"), F.col("days").alias("b")))
    held = sides.groupBy("athlete_id", "month").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b")).where("a != b")
    lone = lambda mine, other: F.filter(F.sequence(F.lit(1), F.lit(31)), lambda k: F.getbit(F.col(mine), k) > F.getbit(F.col(other), k))
    sided = lambda days, side: F.transform(days, lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))
    found = held.select("athlete_id", "month", F.explode(F.concat(sided(lone("a", "b"), "iceberg_missing"), sided(lone("b", "a"), "pg_missing"))).alias("x"))
    date = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.col("x.k"))
    return found.select("athlete_id", (F.unix_date(date).cast("bigint") * DAY_MS).alias("day_epoch_ms"), F.col("x.side").alias("side"))


def parity_by_digests(serving: DataFrame, lake: DataFrame, serving_day: Column, lake_day: Column, buckets: int = BUCKETS) -> DataFrame:
    """As `parity`: digests of both sides first, then the athletes of differing buckets only."""
    a, b = month_masks(serving, serving_day, buckets), month_masks(lake, lake_day, buckets)
    unlike = differing(digests(a), digests(b))
    pick = lambda masks: masks.join(unlike, ["bucket", "month"], "left_semi")
    return _unlike(pick(a), pick(b))


def write_coverage(rows: DataFrame, day: Column, path: str, buckets: int = BUCKETS) -> None:
    """Keeps a side's masks in a folder a bucket, and their digests beside them."""
    month_masks(rows, day, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/masks")
    digests(rows.sparkSession.read.parquet(f"{path}/masks")).write.mode("overwrite").parquet(f"{path}/digests")


def stored_parity(spark: SparkSession, serving: str, lake: str) -> DataFrame:
    """As `parity`, from two kept coverages of as many buckets: folders whose digests agree are not read."""
    unlike = differing(spark.read.parquet(f"{serving}/digests"), spark.read.parquet(f"{lake}/digests"))
    buckets = [r["bucket"] for r in unlike.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    return _unlike(*(spark.read.parquet(f"{p}/masks").where(F.col("bucket").isin(buckets)) for p in (serving, lake)))

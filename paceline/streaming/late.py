"""Late data, decided explicitly: Spark drops late rows in silence and one batch late.

An event of day D is late once the largest event time seen is `delay` + `lateness` past
the day's end. The largest time is kept in a small table of its own, one row a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..schemas import DAY_MS

DELAY_MS = LATENESS_MS = DAY_MS


def is_late(event_time: Column, largest: Column, delay_ms: int = DELAY_MS, lateness_ms: int = LATENESS_MS) -> Column:
    day_end = (F.floor(event_time / F.lit(DAY_MS)) + 1) * F.lit(DAY_MS)
    return F.coalesce(day_end + lateness_ms <= largest - delay_ms, F.lit(False))


def with_event_time(rows: DataFrame, event_time: Column, record_ms: Column, name: str = "event_ts", delay: str = "24 hours") -> DataFrame:
    """A stream with `name`, the event's time, and a watermark over it.

    A time that can't be read (missing, no time, out of range) never ends the job nor stands still:
    the row takes its record's time, so the watermark goes on and the row reaches the step that
    says what is wrong with it. A row without either time gets 1970-01-01 and counts as late.
    """
    ms = times.flexible_ms(event_time)
    sound = F.when(ms.between(-62_135_596_800_000, 253_402_300_799_999), ms)  # years 1 to 9999
    assigned = F.coalesce(sound, record_ms.cast("bigint"), F.lit(0))
    return rows.withColumn(name, F.timestamp_millis(assigned)).withWatermark(name, delay)


#: Arrivals a block has, and blocks a group of them.
BLOCK, GROUP = 100_000, 10_000


def late_by_arrival(events: DataFrame, order: str) -> DataFrame:
    """`events` with `late`, each judged against the largest event time that arrived before it.

    The running maximum over all rows is made in three steps, so that no task sees them all:
    within a block of BLOCK arrivals, over the blocks of a group, and over the groups, of
    which there is one for each BLOCK * GROUP arrivals.
    """
    before = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    blocked = events.withColumn("__block", F.floor(F.col(order) / F.lit(BLOCK)))
    blocks = blocked.groupBy("__block").agg(F.max("event_time").alias("__top")).withColumn("__group", F.floor(F.col("__block") / F.lit(GROUP)))
    groups = blocks.groupBy("__group").agg(F.max("__top").alias("__most"))
    groups = groups.select("__group", F.max("__most").over(before(Window.orderBy("__group"))).alias("__groups"))
    tops = blocks.join(groups, "__group").withColumn("__blocks", F.max("__top").over(before(Window.partitionBy("__group").orderBy("__block"))))
    own = F.max("event_time").over(before(Window.partitionBy("__block").orderBy(order)))
    met = blocked.withColumn("__own", own).join(tops.select("__block", F.greatest("__groups", "__blocks").alias("__before")), "__block")
    largest = F.greatest("__own", "__before")  # null only where both are
    return met.withColumn("late", is_late(F.col("event_time"), largest)).drop("__block", "__own", "__before")

"""Operators that keep state a key in Spark's state store: first copies, and streaks of high or low ratios.

State is a value or a map a key, with a time to live that counts from the last write, and
lives in RocksDB, so a key costs no heap. `started` starts a query with the session's options
these operators need, and gives the session its own back.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions import scores
from ..schemas import DAY_MS, STREAK

DEDUP_TTL_MS, DELOAD_TTL_MS = 7 * DAY_MS, 56 * DAY_MS
#: Parts that an athlete's ids are kept in, so that an athlete of most rows is several keys.
PARTS = 16

OPTIONS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Processing time never ends: with batches without data, a query over what is there now would not end either.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def _options(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in OPTIONS}
    for k, v in OPTIONS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query, which keeps the options that it is started with."""
    with _options(spark):
        return writer.start()


def _earliest(frames: Iterator[pd.DataFrame], by: list[str], order: list[str]) -> pd.DataFrame:
    """The first row in `order` of each value of `by`; of a batch no more is held than that."""
    held: pd.DataFrame | None = None
    for frame in frames:
        rows = frame if held is None else pd.concat([held, frame])
        held = rows.sort_values(order, kind="stable").drop_duplicates(by)
    return held


class FirstCopy(StatefulProcessor):
    """A value a key: whether it was seen. The first row in `order` of a key not seen is given on."""

    def __init__(self, order: list[str], ttl_ms: int):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:  # what isn't read would be taken for the next key's
                pass
            return
        first = _earliest((frame.assign(one_=0) for frame in rows), ["one_"], self.order)
        self.seen.update((True,))
        yield first.drop(columns="one_")

    def close(self) -> None:
        pass


class FirstCopyWithin(StatefulProcessor):
    """A map a key, from an id to whether it was seen."""

    def __init__(self, id_col: str, order: list[str], ttl_ms: int):
        self.id_col, self.order, self.ttl_ms = id_col, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "seen boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = _earliest(rows, [self.id_col], self.order)
        fresh = [not self.seen.containsKey((i,)) for i in first[self.id_col]]
        for i in first[self.id_col][fresh]:
            self.seen.updateValue((i,), (True,))
        if any(fresh):
            yield first[fresh]

    def close(self) -> None:
        pass


def _thinned(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Without the further copies within an Arrow batch, before rows move: a hot id leaves a task as few rows."""

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(order, kind="stable").drop_duplicates(by)

    return rows.mapInPandas(thin, rows.schema)


def first_copies(rows: DataFrame, order: list[str], id_col: str = "event_id", ttl_ms: int = DEDUP_TTL_MS) -> DataFrame:
    """Of the rows of an id, the first that comes within `ttl_ms`; in one batch, the first in `order`.

    Works on streams. Rows with a null or empty id are nobody's copies and all stay. An id comes
    again once it is forgotten. Rows that are found bad later still mark their id as seen.
    """
    named = F.coalesce(F.col(id_col), F.lit("")) != ""
    kept = _thinned(rows.where(named), [id_col], order).groupBy(id_col).transformWithStateInPandas(FirstCopy(order, ttl_ms), rows.schema, "append", "processingTime")
    return kept.unionByName(rows.where(~named))


def first_copies_within(rows: DataFrame, order: list[str], owner_col: str, id_col: str = "event_id", ttl_ms: int = DEDUP_TTL_MS) -> DataFrame:
    """As `first_copies`, but an id is one's own: two owners' rows of one id both stay. A null owner is an owner."""
    named = F.coalesce(F.col(id_col), F.lit("")) != ""
    thin = _thinned(rows.where(named), [owner_col, id_col], order).withColumn("part_", F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int"))
    kept = thin.groupBy(owner_col, "part_").transformWithStateInPandas(FirstCopyWithin(id_col, order, ttl_ms), thin.schema, "append", "processingTime")
    return kept.drop("part_").unionByName(rows.where(~named))


class Streak(StatefulProcessor):
    """A value a key: the last day, how long its sign has lasted, and the sign."""

    def __init__(self, columns: list[str], streak: int, ttl_ms: int):
        self.columns, self.streak, self.ttl_ms = columns, streak, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "day int, length int, sign int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, length, sign = self.state.get() if self.state.exists() else (None, 0, 0)
        days = pd.concat(list(rows)).sort_values("day_", kind="stable").drop_duplicates("day_")  # one athlete's days of one batch
        days = days if last is None else days[days["day_"] > last]
        if not len(days):
            return
        flags = []
        for now in days["sign_"].tolist():
            length = length + 1 if now == sign else 1
            sign = now
            flags.append(sign if length >= self.streak else 0)
        self.state.update((int(days["day_"].iloc[-1]), int(length), int(sign)))
        yield days.assign(deload_flag=pd.Series(flags, index=days.index, dtype="int32"))[self.columns]

    def close(self) -> None:
        pass


def deload_stream(rolled: DataFrame, streak: int = STREAK, ttl_ms: int = DELOAD_TTL_MS) -> DataFrame:
    """`rolled` (athlete_id, metric_date, acute_chronic_ratio, ...) with deload_flag, row by row as it comes.

    Works on streams: gives what `rolling.deload_flag` gives over all rows, if an athlete's days come
    in order of date over batches; within one they may come in any. A day that came before, or a
    later one of the same athlete, counts once: repeated and late days are left out and change
    nothing. A streak is forgotten after `ttl_ms` without a day. A null ratio ends a streak.
    """
    keyed = rolled.withColumns({"day_": F.unix_date("metric_date"), "sign_": scores.ratio_sign(F.col("acute_chronic_ratio")).cast("int")})
    schema = rolled.withColumn("deload_flag", F.lit(0).cast("int")).schema
    return keyed.groupBy("athlete_id").transformWithStateInPandas(Streak(schema.names, streak, ttl_ms), schema, "append", "processingTime")


def deload_job(rolled: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream of rolled rows with their flags, appended to the Parquet table at `path`, each row once."""
    writer = deload_stream(rolled).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return started(writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True), rolled.sparkSession)

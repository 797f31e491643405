"""Streaming jobs that run the batch operators on micro-batches.

Each job is a `foreachBatch` query: what a batch adds is written under its number, so a
batch that is run again after a failure replaces its own rows and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dlq import envelope
from ..functions.loads import finite
from ..functions.times import ms_to_date
from ..operators import adherence, canonical, dedup, merge, rolling, wellness
from ..schemas import DAY_MS, PLANNING_DDL, PLANS_DDL, TRAINING_DDL, struct
from ..sources import files, lake, topics
from . import state
from .late import is_late

DEDUP_DAYS = 7
COUNTERS = "batch BIGINT, processed BIGINT, duplicates BIGINT, late BIGINT, not_finite BIGINT"


class KeyedTable:
    """A table as a log of batches: of a key (the first column), the rows of the newest batch that has any count.

    A batch holds all rows of the keys it touches, so it costs what it touches, not the
    table. Each COMPACT batches the log is written as one base; what is older than the base
    before that goes, as a batch that is run again needs no more. `keep` says which rows are
    still wanted then.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, ddl: str, keep: Column | None = None):
        self.spark, self.path, self.ddl, self.kept = spark, path.rstrip("/"), ddl, keep
        self.key = ddl.split()[0]

    def _at(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> tuple[list[int], list[int]]:
        """Numbers of the bases and of the batches that were written whole."""
        fs, at = self._at()
        if not fs.exists(at):
            return [], []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if fs.exists(self._at(n, "_SUCCESS")[1])]
        return tuple(sorted(int(n[1:]) for n in done if n.startswith(kind)) for kind in "bv")

    def read(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows after the newest batch, or the newest one under `before`; of the keys in `only` where it is given."""
        bases, batches = ([n for n in some if before is None or n < before] for some in self._numbers())
        base = bases[-1:]
        paths = [f"{self.path}/b{n}" for n in base] + [f"{self.path}/v{n}" for n in batches if not base or n > base[0]]
        if not paths:
            return self.spark.createDataFrame([], self.ddl)
        rows = self.spark.read.schema(f"{self.ddl}, batch_number BIGINT").parquet(*paths)
        if only is not None:
            rows = rows.join(only.select(F.col(self.key).alias("only")), rows[self.key].eqNullSafe(F.col("only")), "left_semi")
        if len(paths) > 1:
            newest = rows.groupBy(F.col(self.key).alias("of")).agg(F.max("batch_number").alias("newest"))
            rows = rows.join(newest, rows[self.key].eqNullSafe(F.col("of")) & (F.col("batch_number") == F.col("newest"))).select(*rows.columns)
        return rows.drop("batch_number")

    def write(self, rows: DataFrame, number: int) -> None:
        """All rows of the keys that batch `number` touches."""
        rows.withColumn("batch_number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        bases, batches = self._numbers()
        if len([n for n in batches if not bases or n > bases[-1]]) < self.COMPACT:
            return
        whole = self.read(before=number + 1)
        whole = whole if self.kept is None else whole.where(self.kept)
        whole.withColumn("batch_number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/b{number}")
        for n in [n for n in bases if n != (bases[-1] if bases else None)]:
            self._remove(f"b{n}")
        for n in [n for n in batches if bases and n <= bases[-1]]:
            self._remove(f"v{n}")

    def _remove(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)


def _heads(spark: SparkSession, checkpoint: str, topic: str) -> KeyedTable:
    """Where a writer's partitions of a topic go on."""
    return KeyedTable(spark, f"{checkpoint}/heads/{topic}", "partition INT, next BIGINT")


def _publish(rows: DataFrame, root: str, topic: str, writer: str, number: int, checkpoint: str, order: list[str]) -> None:
    """Appends a batch's (key, value, timestamp) rows, numbered within the writer's partitions in `order`."""
    heads = _heads(rows.sparkSession, checkpoint, topic)
    made = topics.numbered(rows, topic, heads.read(before=number), order, writer)
    heads.write(topics.publish(made, root, topic, writer, str(number)), number)


def _seen(spark: SparkSession, path: str) -> KeyedTable:
    """Ids and when they came; those of DEDUP_DAYS ago count no more."""
    return KeyedTable(spark, path, "event_id STRING, seen_ms BIGINT", F.col("seen_ms") > F.unix_millis(F.current_timestamp()) - DEDUP_DAYS * DAY_MS)


def _recent(table: KeyedTable, number: int) -> DataFrame:
    return table.read(before=number).where(table.kept)


def _ids(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(event_id, '') != ''").select("event_id", F.unix_millis(F.current_timestamp()).alias("seen_ms"))


def ingest_job(spark: SparkSession, inbox: str, root: str, domain: str, checkpoint: str, every: str | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """A folder of files -> raw.<domain>: each file once. `every`: a polling interval; none: what is there now, then stop.

    Rows that break a rule are written to rejected.<domain>, with their file and why.
    """
    lines = files.stream_lines(spark, inbox, domain, files_per_trigger)

    def step(batch: DataFrame, number: int) -> None:
        rows = files.rows_of(batch, domain).persist()
        now = F.unix_millis(F.current_timestamp())
        _publish(files.envelopes(rows, domain, now).withColumn("timestamp", now), root, f"raw.{domain}", domain, number, checkpoint, ["value"])
        files.rejected(rows).write.mode("overwrite").parquet(f"{root.rstrip('/')}/rejected.{domain}/{topics.BATCH}={number}")
        rows.unpersist()

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_connectors(spark: SparkSession, inbox: str, root: str, checkpoint: str, every: str | None = "5 seconds", domains: tuple[str, ...] = canonical.DOMAINS) -> dict[str, StreamingQuery]:
    """One ingest query a domain over <inbox>/<domain>, all on this session."""
    return {d: ingest_job(spark, f"{inbox}/{d}", root, d, f"{checkpoint}/{d}", every) for d in domains}


def canonicalize_job(spark: SparkSession, root: str, domain: str, out_topic: str, dlq_topic: str, checkpoint: str, files_per_trigger: int | None = None, key: str = "$.event_id") -> StreamingQuery:
    """raw.<domain> -> canonical records and dead letters; of an id's copies the first in the log's order wins within DEDUP_DAYS.

    Ids that were seen are state in Spark's store, forgotten DEDUP_DAYS after they came. A plan's id is its athlete's own.
    """
    order = ["timestamp", "partition", "offset"]
    raw = topics.read_stream(spark, root, f"raw.{domain}", files_per_trigger).withColumn("event_id", F.get_json_object("value", "$.event_id"))
    if domain == "planning":
        fresh = state.first_copies_within(raw.withColumn("athlete_id", F.get_json_object("value", "$.athlete_id")), order, "athlete_id").drop("athlete_id")
    else:
        fresh = state.first_copies(raw, order)

    def step(batch: DataFrame, number: int) -> None:
        made = canonical.canonicalize(batch, domain).persist()
        good = made.where("error is null").select(F.col("record.athlete_id").alias("key"), F.to_json("record").alias("value"), F.col("record.ingest_time").alias("timestamp"), "partition", "offset")
        _publish(good.withColumnsRenamed({"partition": "came", "offset": "at"}), root, out_topic, domain, number, checkpoint, ["came", "at"])
        bad = canonical.rejected(made, f"raw.{domain}", key=key)
        _publish(bad.select(F.col("original_key").alias("key"), F.to_json(F.struct("*")).alias("value"), "timestamp"), root, dlq_topic, domain, number, checkpoint, ["value"])
        made.unpersist()

    return state.started(fresh.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True), spark)


def metrics_job(spark: SparkSession, root: str, checkpoint: str, files_per_trigger: int | None = None, lake_path: str | None = None) -> StreamingQuery:
    """Canonical training events -> daily loads and metrics; late and non-finite events -> dead letters.

    A batch adds its sums to the days it touches and recomputes the metrics of their
    athletes with the batch operators, so corrections within the allowed lateness reach
    the days after them. Only these athletes' rows are read and written.
    """
    stream = topics.read_stream(spark, f"{root}", "canonical.training_event", files_per_trigger)
    daily = KeyedTable(spark, f"{checkpoint}/daily", "athlete_id STRING, day DATE, daily_load DOUBLE")
    seen = _seen(spark, f"{checkpoint}/seen")
    clock = KeyedTable(spark, f"{checkpoint}/clock", "largest BIGINT")
    table = KeyedTable(spark, f"{checkpoint}/metrics", METRICS_ROWS)
    counters = KeyedTable(spark, f"{checkpoint}/counters", COUNTERS)
    dlq = "dlq.canonical.training_event"

    def step(batch: DataFrame, number: int) -> None:
        largest = clock.read(before=number).agg(F.max("largest")).first()[0]
        events = batch.select(F.from_json("value", TRAINING_DDL).alias("e"), "partition", "offset").select("e.*", "partition", "offset")
        first = dedup.first_by_id(events, F.struct("ingest_time", "partition", "offset")).drop("partition", "offset")
        fresh = dedup.unseen(first, _recent(seen, number)).withColumn("late", is_late(F.col("event_time"), F.lit(largest).cast("bigint")))
        fresh = fresh.withColumn("error_type", F.when(~finite(F.col("session_load")), "VALIDATION_FAILURE").when(F.col("late"), "LATE_DATA")).persist()
        bad = fresh.where("error_type is not null")
        whole = F.to_json(F.struct(*[c for c in fresh.columns if c not in ("late", "error_type")]))
        letters = bad.select(*envelope(F.lit("canonical.training_event"), F.col("event_id"), whole, F.col("error_type"), F.lit("late or not finite")))
        _publish(letters.select(F.col("original_key").alias("key"), F.to_json(F.struct("*")).alias("value"), "timestamp"), root, dlq, "metrics", number, checkpoint, ["value"])
        good = fresh.where("error_type is null")
        added = good.groupBy("athlete_id", ms_to_date(F.col("event_time")).alias("day")).agg(F.sum("session_load").alias("daily_load"))
        touched = added.select("athlete_id").distinct()
        days = daily.read(before=number, only=touched).unionByName(added).groupBy("athlete_id", "day").agg(F.sum("daily_load").alias("daily_load"))
        daily.write(days, number)
        current = daily.read(before=number + 1, only=touched)
        table.write(rolling.metrics_of_days(current).select(*[f.name for f in struct(METRICS_ROWS)]), number)
        seen.write(_ids(fresh), number)
        counts = fresh.agg(F.count("*").alias("processed"), F.count_if(F.col("error_type") == "LATE_DATA").alias("late"), F.count_if(F.col("error_type") == "VALIDATION_FAILURE").alias("not_finite"))
        counted = counts.crossJoin(events.agg(F.count("*").alias("all_events")))  # one row each
        counters.write(counted.select(F.lit(number).cast("bigint").alias("batch"), "processed", (F.col("all_events") - F.col("processed")).alias("duplicates"), "late", "not_finite"), number)
        if lake_path:
            lake.replace_batch(good.drop("late", "error_type"), lake_path, number)
        clock.write(events.agg(F.greatest(F.max("event_time"), F.lit(largest).cast("bigint")).alias("largest")), number)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def plans_job(spark: SparkSession, root: str, checkpoint: str) -> StreamingQuery:
    """Canonical planning blocks -> the table of plans: each revision (athlete, block, ingest time) once, as it came first."""
    stream = topics.read_stream(spark, root, "canonical.planning_block")
    table = KeyedTable(spark, f"{checkpoint}/plans", PLANS_DDL)
    keys = ["athlete_id", "block_id", "ingest_time"]

    def step(batch: DataFrame, number: int) -> None:
        blocks = batch.select(F.from_json("value", PLANNING_DDL).alias("b"), "partition", "offset").select("b.*", F.struct("partition", "offset").alias("came"))
        as_date = {c: ms_to_date(F.col(c)) for c in ("start_date", "end_date")}
        names = [f.name for f in struct(PLANS_DDL)]
        first = blocks.withColumns(as_date).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in names if c not in keys]), "came").alias("row")).select(*keys, "row.*").persist()
        known = table.read(before=number, only=first.select("athlete_id").distinct())
        table.write(merge.insert_absent(known, first, keys), number)
        first.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def adherence_batch(table: DataFrame, plans: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """`table` (the metrics table) with the adherence scores of all blocks: a partial upsert of one column.

    Of several blocks with one metric date, the last by its id counts.
    """
    scored = adherence.adherence_scores(plans, rolling.daily_load(events), today)
    return merge.upsert_columns(table, scored, ["athlete_id", "metric_date"], ["adherence_score"], arrival="block_id")


METRICS_ROWS = (
    "athlete_id STRING, metric_date DATE, acute_load DOUBLE, chronic_load_28d DOUBLE, chronic_load_42d DOUBLE, acute_chronic_ratio DOUBLE, "
    "deload_flag INT, fatigue_score DOUBLE, readiness_score DOUBLE, coaching_flags STRING"
)


def wellness_job(spark: SparkSession, root: str, checkpoint: str, ddl: str) -> StreamingQuery:
    """Canonical wellness events -> recovery scores, last arrival of a day wins over batches too."""
    stream = topics.read_stream(spark, root, "canonical.wellness_event")
    table = KeyedTable(spark, f"{checkpoint}/recovery", "athlete_id STRING, metric_date DATE, recovery_score DOUBLE")

    def step(batch: DataFrame, number: int) -> None:
        events = batch.select(F.from_json("value", ddl).alias("e")).select("e.*")
        fresh = wellness.recovery_scores(events).persist()
        old = table.read(before=number, only=fresh.select("athlete_id").distinct())
        table.write(old.join(fresh, ["athlete_id", "metric_date"], "left_anti").unionByName(fresh), number)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def dedup_stream(events: DataFrame, id_col: str = "event_id", ts: str = "event_ts", days: int = DEDUP_DAYS) -> DataFrame:
    """First copy of an id within `days` of event time, on Spark's own state store."""
    return events.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([id_col])


def daily_stream(events: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Daily loads of a stream: a day closes two days of event time after its end (delay and lateness)."""
    return rolling.tumbling_day(events.withWatermark(ts, "48 hours"), ts)


def daily_updates_job(events: DataFrame, path: str, checkpoint: str, ts: str = "event_ts") -> StreamingQuery:
    """Daily loads as they grow: each trigger writes the days that changed, before their window closes.

    `events`: a stream of (athlete_id, session_load, `ts`). The table is a KeyedTable at `path`.
    """
    table = KeyedTable(events.sparkSession, path, "athlete_id STRING, day DATE, daily_load DOUBLE")

    def step(batch: DataFrame, number: int) -> None:
        changed = batch.select("athlete_id", "day", "daily_load").persist()
        old = table.read(before=number, only=changed.select("athlete_id").distinct())
        table.write(old.join(changed, ["athlete_id", "day"], "left_anti").unionByName(changed), number)
        changed.unpersist()

    return daily_stream(events, ts).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

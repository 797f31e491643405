"""Topics as folders: append-only logs of (key, value, topic, offset, timestamp, partition) in Parquet.

The folder stands where a message broker would: `publish`, `read_batch` and `read_stream`
are the only places that know, so another log can take its place. A topic has PARTITIONS
partitions for each writer, by the key's hash; offsets are dense within a partition, so
that each writer numbers its messages alone and in as many tasks as it has partitions.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import latest_by
from ..schemas import CANONICAL_TOPICS, DAY_MS, DLQ_TOPICS, RAW_TOPICS, RETENTION_DAYS

TOPICS = RAW_TOPICS + CANONICAL_TOPICS + DLQ_TOPICS
SHAPE = "key STRING, value STRING, topic STRING, offset BIGINT, timestamp BIGINT"
LOG = SHAPE + ", partition INT"
#: The order of a log's messages.
ORDER = ("topic", "partition", "offset")
#: Fixed value: partitions of a topic. Each writer has as many of its own.
PARTITIONS = 8
WRITERS = ("append", "strength", "cardio", "recovery", "nutrition", "wellness", "planning", "metrics")
#: Folders of a topic that hold one batch of one writer each; a batch that runs again replaces its own.
BATCH = "batch"


def path_of(root: str, topic: str) -> str:
    if topic not in TOPICS:
        raise ValueError(f"no such topic: {topic}")
    return f"{root.rstrip('/')}/{topic}"


def create_topics(spark: SparkSession, root: str, names: tuple[str, ...] = TOPICS) -> list[str]:
    """Makes each topic's folder with an empty batch, where it isn't there; the names of the new ones."""
    made = []
    for topic in names:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path_of(root, topic))
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], LOG).write.parquet(f"{path_of(root, topic)}/{BATCH}=none")
            made.append(topic)
    return made


def numbered(messages: DataFrame, topic: str, heads: DataFrame, order: list[str], writer: str = "append", least: int = 0) -> DataFrame:
    """(key, value) and `timestamp` as LOG rows; `heads` (partition, next) says where partitions go on."""
    first = WRITERS.index(writer) * PARTITIONS
    dealt = messages.withColumn("partition", (F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(PARTITIONS)) + first).cast("int"))
    place = F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1
    met = dealt.withColumn("place", place).join(heads.select(F.col("partition").alias("of"), "next"), F.col("partition") == F.col("of"), "left")
    return met.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit(topic).alias("topic"),
        (F.greatest(F.coalesce("next", F.lit(0)), F.lit(least)) + F.col("place")).cast("bigint").alias("offset"), F.col("timestamp").cast("bigint").alias("timestamp"), "partition",
    )


def publish(rows: DataFrame, root: str, topic: str, writer: str, number: str) -> DataFrame:
    """Writes LOG rows as one batch of a writer, in place of what it wrote under that number; (partition, next) of what is there then."""
    at = f"{path_of(root, topic)}/{BATCH}={writer}-{number}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(LOG).parquet(at).groupBy("partition").agg((F.max("offset") + 1).alias("next"))


def write_batch(messages: DataFrame, root: str, topic: str, first_offset: int = 0) -> None:
    """Appends (key, value) rows after what the topic's partitions hold, from `first_offset` on at least."""
    spark = messages.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path_of(root, topic))
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    log = read_batch(spark, root, topic) if there else spark.createDataFrame([], LOG)
    heads = log.groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    now = messages.select("key", "value", F.unix_millis(F.current_timestamp()).alias("timestamp"), F.monotonically_increasing_id().alias("arrival"))
    publish(numbered(now, topic, heads, ["arrival"], least=first_offset), root, topic, "append", uuid.uuid4().hex)


def expired(rows: DataFrame, now_ms: int) -> DataFrame:
    """Rows of a log that are past their topic's retention."""
    days = F.create_map(*[F.lit(x) for pair in RETENTION_DAYS.items() for x in pair])
    return rows.where(F.col("timestamp") < F.lit(now_ms) - F.element_at(days, F.col("topic")).cast("bigint") * DAY_MS)


def compacted(rows: DataFrame) -> DataFrame:
    """The last record of each key of a compacted topic."""
    return latest_by(rows.withColumn("__at", F.struct("timestamp", "offset")), ["topic", "key"], "__at").drop("__at")


def _log(rows: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in LOG.split(", ")]
    return rows.select(*[F.coalesce("partition", F.lit(0)).alias("partition") if n == "partition" else F.col(n) for n in names])


def read_batch(spark: SparkSession, root: str, topic: str, start_offset: int | None = None, start_timestamp: int | None = None, end_offset: int | None = None) -> DataFrame:
    """The log as it is now: from its start, or in each partition from an offset or from the first
    message of a time on, up to `end_offset`, which is exclusive. Offsets reach the scan."""
    rows = _log(spark.read.schema(LOG).parquet(path_of(root, topic)))
    if start_offset is not None:
        rows = rows.where(F.col("offset") >= start_offset)
    if end_offset is not None:
        rows = rows.where(F.col("offset") < end_offset)
    if start_timestamp is not None:
        starts = rows.where(F.col("timestamp") >= start_timestamp).groupBy("partition").agg(F.min("offset").alias("start"))
        rows = rows.join(starts, "partition").where(F.col("offset") >= F.col("start")).select(*rows.columns)
    return rows


def read_stream(spark: SparkSession, root: str, topic: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _log(reader.parquet(path_of(root, topic)))


def avro_as_json(value: Column, schema: str) -> Column:
    """JSON text of binary records in a schema registry's wire format: five bytes before the Avro record.

    Needs Spark's Avro module on the class path.
    """
    from pyspark.sql.avro.functions import from_avro

    return F.to_json(from_avro(F.substring(value, 6, 2**31 - 1), schema))


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, avro_schema: str | None = None, **options: str) -> DataFrame:
    """The same columns from a Kafka topic, from its start on; needs Spark's Kafka connector on the class path.

    With `avro_schema`, values are Avro records, and are given as JSON. `stream=False` reads what is there now, between `startingOffsets` and `endingOffsets`
    (or the ...ByTimestamp forms) among `options`.
    """
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = reader.option("startingOffsets", "earliest").options(**options).load()
    value = F.col("value").cast("string") if avro_schema is None else avro_as_json(F.col("value"), avro_schema)
    return rows.select(F.col("key").cast("string"), value.alias("value"), "topic", "offset", F.unix_millis("timestamp").alias("timestamp"), "partition")


def offsets(spark: SparkSession, root: str, topics: tuple[str, ...] = DLQ_TOPICS) -> DataFrame:
    """(topic, partition, earliest, latest) of partitions that hold anything; `latest` is the next offset."""
    every = functools.reduce(DataFrame.unionByName, [read_batch(spark, root, t).select(*ORDER) for t in topics])
    return every.groupBy("topic", "partition").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))


def replay(planned: DataFrame, root: str, dry_run: bool = False) -> dict[str, int]:
    """Writes the letters to be replayed back to the topics they came from; counts by topic."""
    ready = planned.where("outcome = 'replayed'").select("original_topic", F.col("original_key").alias("key"), F.decode("payload", "UTF-8").alias("value"))
    counts = {r["original_topic"]: r["count"] for r in ready.groupBy("original_topic").count().collect()}  # a row a topic
    for topic in [] if dry_run else sorted(counts):
        write_batch(ready.where(F.col("original_topic") == topic), root, topic)
    return counts

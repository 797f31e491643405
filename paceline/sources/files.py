"""Readers of the domains' delimited files and of planning documents, in batch and as streams.

Every cell is read as text, found by its file's own header, and typed by column expressions;
a row that breaks a rule keeps its cells and says why in `error`, so nothing is lost and no
file fails as a whole. Batches and streams share all of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..functions import coerce as C
from ..functions import times

#: Columns of each domain's files: kind and whether it must be there.
COLUMNS: dict[str, dict[str, tuple[str, bool]]] = {
    "strength": {
        "athlete_id": ("string", True), "workout_id": ("string", True), "exercise_id": ("string", True), "set_number": ("int", True), "reps": ("int", True),
        "weight_kg": ("double", True), "rpe": ("double", False), "rir": ("double", False), "timestamp": ("timestamp", True),
    },
    "cardio": {
        "athlete_id": ("string", True), "activity_type": ("string", True), "duration_sec": ("int", True), "timestamp": ("string", True),
        "distance_km": ("double", False), "avg_hr": ("int", False), "tss": ("double", False),
    },
    "nutrition": {
        "athlete_id": ("string", True), "date": ("date", True), "calories": ("int", False), "protein_g": ("double", False), "carbs_g": ("double", False),
        "fat_g": ("double", False), "adherence_score": ("double", False),
    },
    "recovery": {
        "athlete_id": ("string", True), "date": ("date", True), "sleep_hours": ("double", False), "resting_hr": ("int", False), "hrv": ("double", False),
        "steps": ("int", False), "body_weight_kg": ("double", False),
    },
    "wellness": {
        "athlete_id": ("string", True), "date": ("date", True), "hrv": ("double", False), "sleep_hours": ("double", False), "resting_hr": ("int", False),
        "steps": ("int", False), "body_weight_kg": ("double", False), "energy": ("int", False), "soreness": ("int", False), "mood": ("int", False),
        "stress": ("int", False), "perceived_recovery": ("int", False),
    },
    "planning": {
        "athlete_id": ("string", True), "block_id": ("string", True), "goal": ("string", True), "start_date": ("string", True), "end_date": ("string", True),
        "planned_sessions_per_week": ("int", True), "weekly_volume_targets": ("string", True),
    },
}
#: The `source` of each domain's envelopes.
SOURCES = {"strength": "strong_csv", "cardio": "synthetic_cardio", "nutrition": "nutrition_csv", "recovery": "apple_health", "wellness": "synthetic_wellness", "planning": "synthetic_planning"}


#: Cells of a line that the reader parts; a line of more is parted from its text, whatever their number.
WIDTH = 64
#: Files whose headers may be broadcast (some hundred bytes each).
BROADCAST_HEADS = 50_000
#: Domains whose plans may also come as documents, and the suffixes of these.
DOCUMENTS = ("planning",)
_JSON, _YAML = "*.json", "*.{yaml,yml}"


def _lines(reader: DataFrameReader | DataStreamReader, path: str, domain: str) -> DataFrame:
    """(file, start, cells, doc): the lines of *.csv, header lines too, cells by place; `start` is where the file's part begins.

    Plans may hold line breaks in quoted cells, so their files aren't split.
    """
    names = [f"c{i}" for i in range(WIDTH)]
    schema = ", ".join(f"{c} STRING" for c in [*names, "line"])
    read = reader.option("columnNameOfCorruptRecord", "line").option("header", False).option("encoding", "UTF-8").option("escape", '"').option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("multiLine", domain in DOCUMENTS)
    rows = read.schema(schema).csv(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.when(F.col(names[-1]).isNotNull() & F.col("line").isNotNull(), _parted(F.col("line"))).otherwise(F.array(*names)).alias("cells"), F.lit(None).cast("string").alias("doc"))


def _parted(line: Column) -> Column:
    """The cells of a line, quoted or not, as the reader gives them: an empty one is null, a quoted empty one isn't."""
    cells = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).when(x != "", x))


def _documents(reader: DataFrameReader | DataStreamReader, path: str, glob: str) -> DataFrame:
    rows = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.lit(None).cast("array<string>").alias("cells"), F.col("value").alias("doc"))


def _names(domain: str) -> list[str]:
    return list(COLUMNS[domain]) + (["start_date"] if domain == "cardio" else [])


def cells_by_header(lines: DataFrame, domain: str) -> DataFrame:
    """The domain's cells, and `file`, of the lines of any files: each file's first line names its columns, in any order.

    Columns that a file lacks are null, further ones are left out.
    """
    counted = lines.where("cells is not null").withColumn("n", F.monotonically_increasing_id())
    heads = counted.where("start = 0").groupBy(F.col("file").alias("of")).agg(F.min("n").alias("head"), F.min_by("cells", "n").alias("names")).persist()
    if heads.count() <= BROADCAST_HEADS:  # then lines stay where they are, in their order
        heads = F.broadcast(heads)
    names = F.transform("names", lambda x: F.regexp_replace(x, "^\ufeff", ""))
    body = counted.join(heads, F.col("file") == F.col("of")).where("n != head").withColumn("names", names)
    return body.select(*[F.get(F.col("cells"), (F.array_position("names", n) - 1).cast("int")).alias(n) for n in _names(domain)], "file")


def read_cells(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """All *.csv files under a folder, or one file, by each file's own header, each cell as text; with `file`."""
    return cells_by_header(_lines(spark.read, path, domain), domain)


def typed_rows(cells: DataFrame, domain: str) -> DataFrame:
    """`cells` typed by the domain's rules, with `error` (null for good rows). The first failing column is named."""
    columns = COLUMNS[domain]
    if domain == "cardio" and "start_date" in cells.columns:
        cells = cells.withColumn("timestamp", F.coalesce(C.blank_to_null(F.col("timestamp")), F.col("start_date")))
    errors = [C.cell_error(n, kind, required) for n, (kind, required) in columns.items()]
    if domain == "planning":
        errors += [
            F.when(F.col("end_date") < F.col("start_date"), F.lit("end_date must not be before start_date")),
            F.when(C.cell_int(F.col("planned_sessions_per_week")) <= 0, F.lit("planned_sessions_per_week must be > 0")),
            F.when(F.try_parse_json("weekly_volume_targets").isNull(), F.lit("weekly_volume_targets is not valid JSON")),
        ]
    kept = [C.cell_value(n, kind).alias(n) for n, (kind, _) in columns.items()] + ["file"] * ("file" in cells.columns)
    return cells.select(*kept, F.coalesce(*errors).alias("error"))


def read_rows(spark: SparkSession, path: str, domain: str) -> DataFrame:
    return typed_rows(read_cells(spark, path, domain), domain)


def stream_lines(spark: SparkSession, path: str, domain: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder as a stream, each file once and whole: what `rows_of` reads."""

    def reader() -> DataStreamReader:
        made = spark.readStream
        return made.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else made

    lines = _lines(reader(), path, domain)
    if domain in DOCUMENTS:
        for glob in (_JSON, _YAML):
            lines = lines.unionByName(_documents(reader(), path, glob))
    return lines


def rows_of(lines: DataFrame, domain: str) -> DataFrame:
    """Typed rows, with `file` and `error`, of lines and documents of whole files."""
    rows = typed_rows(cells_by_header(lines, domain), domain)
    if domain in DOCUMENTS:
        docs = lines.where("doc is not null").select("file", "doc")
        yaml = F.col("file").rlike(r"\.ya?ml$")
        read = docs.where(~yaml).unionByName(docs.where(yaml).mapInPandas(_yaml_to_json, "file string, doc string"))
        rows = rows.unionByName(typed_rows(plan_cells(read, "doc"), domain))
    return rows


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Planning documents by suffix: .yaml and .yml, .json (one object a file) and .csv.

    YAML is read by a vectorized function, file by file, as nothing built in reads it.
    """
    lines = _lines(spark.read, path, "planning").unionByName(_documents(spark.read, path, _JSON)).unionByName(_documents(spark.read, path, _YAML))
    return rows_of(lines, "planning")


def rejected(rows: DataFrame) -> DataFrame:
    """(file, error, cells): the rows that broke a rule, their typed cells as JSON."""
    names = [c for c in rows.columns if c not in ("file", "error")]
    return rows.where("error is not null").select("file", "error", F.to_json(F.struct(*names)).alias("cells"))


def summaries(rows: DataFrame) -> DataFrame:
    """(file, published, skipped): good rows and others of each file that has any."""
    return rows.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("published"), F.count_if(F.col("error").isNotNull()).alias("skipped"))


def plan_cells(docs: DataFrame, value: str = "value") -> DataFrame:
    """Cells of JSON documents, one object a row; a document that is none has only nulls."""
    j = C.Json()
    cells = {n: j.text(n) for n in COLUMNS["planning"]}
    return j.read(docs, value).select(*[F.when(F.col("is_object"), c).alias(n) for n, c in cells.items()], *["file"] * ("file" in docs.columns))


def _yaml_to_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def read(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except yaml.YAMLError:
            return None

    for frame in frames:
        yield frame.assign(doc=[read(t) for t in frame["doc"]])


def envelopes(rows: DataFrame, domain: str, ingest_ms: Column) -> DataFrame:
    """(key, value): a JSON envelope for each good row, keyed by athlete.

    The id is a digest of the row, so that a file that is read again gives the same ids.
    """
    names = list(COLUMNS[domain])
    good = rows.where("error is null") if "error" in rows.columns else rows
    event_id = F.sha2(F.to_json(F.struct(F.lit(domain).alias("domain"), *names)), 256)
    if domain == "strength":
        as_time = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
        event_time, ingest_time = as_time(times.iso_to_ms(F.col("timestamp"))), as_time(ingest_ms)
    else:
        when = {"cardio": "timestamp", "planning": "start_date"}.get(domain, "date")
        event_time, ingest_time = times.iso_to_ms(F.col(when)), ingest_ms
    payload = F.struct(*[n for n in names if domain == "planning" or n != "athlete_id"])
    whole = F.struct(event_id.alias("event_id"), event_time.alias("event_time"), ingest_time.alias("ingest_time"), F.lit(SOURCES[domain]).alias("source"), F.col("athlete_id"), payload.alias("payload"))
    return good.select(F.col("athlete_id").alias("key"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))

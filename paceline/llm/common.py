"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the operators' contracts: space, tab, LF, VT, FF, CR.
WHITE = r"[\x20\x09-\x0D]+"


#: The temporary folder of a plain local run, made once.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    That folder is the session's ``spark.checkpoint.dir``. Where it is unset, a
    temporary folder serves, but only in plain local mode, in which driver and
    executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.get("base") or tempfile.mkdtemp(prefix="paceline-")
        _OWN["base"] = base
    return f"{base.rstrip('/')}/paceline/{label}-{uuid.uuid4().hex}"


#: Paths that `stored` has made, a list for each `passing` block that is open here.
_MADE: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("made", default=())


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    if _MADE.get():
        _MADE.get()[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block at whose end the tables that `stored` made in it go, but for those given to the function it yields."""
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    token = _MADE.set((*_MADE.get(), made))
    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            if path not in kept:
                removed(spark, path)
            elif _MADE.get():
                _MADE.get()[-1].append(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Ids that may be broadcast (about 50 bytes each in a hash table): 50 MB.
BROADCAST_IDS = 1_000_000
#: Bytes of such ids as text.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch that a Python worker is given at a time.
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on hands Python workers batches of BATCH_BYTES: rows of any length, bounded memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def worker_cache() -> dict:
    """What this Python process keeps from one task to the next. Worker functions are shipped
    by value, so a variable of their own module would be new in each task."""
    return sys.modules.setdefault("paceline_worker_cache", types.ModuleType("paceline_worker_cache")).__dict__.setdefault("kept", {})


def release_memory() -> None:
    """At a task's end: gives what the worker has freed back to the system, as it stays for other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of `docs` whose id isn't in `gone` (one column, `gone_id`); null is an id like others.

    Up to BROADCAST_IDS ids of BROADCAST_BYTES in all (both counted) no row of `docs` is
    moved; beyond that both sides are dealt by id.
    """
    n, size = gone.agg(F.count("*"), F.sum(F.octet_length(F.col("gone_id").cast("string")))).first()
    some = F.broadcast(gone) if n <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES else gone
    return docs.join(some, docs[id_col].eqNullSafe(some["gone_id"]), "left_anti")


def one_of_each(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Of rows equal in id and text, one, with its columns. A large group leaves each task as one row."""
    mark = unused(rows, "text_mark")
    return rows.withColumn(mark, F.sha2(text, 256)).dropDuplicates([id_col, mark]).drop(mark)


def ids_repeat(rows: DataFrame, id_col: str) -> bool:
    """Whether any id, null included, has more than one row."""
    return not rows.groupBy(id_col).count().where("count > 1").isEmpty()

"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: an offset and
a step, both from a digest of the shard's name, give a permutation of the slots. The
shards take turns, each claiming the first slot of its order that is still free, until
the table is full; so any two shards' numbers of slots differ by one at most, and when a
shard is added or removed few other slots change hands. The table has a fixed size and
is broadcast; a row's place is one array lookup, with no shuffle.

Rows are dealt by document id, not by a column that can be hot, and `write_shards`
splits each shard's rows over several tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: Prime; over 100 slots a shard for up to 600 shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, step): slot k of the shard's order is (offset + k * step) mod size."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the table's size must be prime and no less than the number of shards, whose names must differ")
    orders = [preference(s, size) for s in shards]
    table, tried, claimed = [-1] * size, [0] * len(shards), 0
    while True:
        for i, (offset, step) in enumerate(orders):
            at = (offset + tried[i] * step) % size
            while table[at] >= 0:
                tried[i] += 1
                at = (offset + tried[i] * step) % size
            table[at], tried[i], claimed = i, tried[i] + 1, claimed + 1
            if claimed == size:
                return table


def slot_of(id_column, size: int):
    """The leading 60 bits of the id text's MD5, modulo the table's size; a null id is the empty text."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, shards=SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id") -> DataFrame:
    """`docs` with `slot` (int) and `shard` (name); existing columns of these names are replaced.

    Rows that share an id share a shard, null ids too. An empty table stays empty.
    """
    spark = docs.sparkSession
    rows = [(slot, shards[owner]) for slot, owner in enumerate(fill_table(list(shards), size))]
    at, of, named = (unused(docs, name) for name in ("slot_at", "slot_of", "shard_of"))
    lookup = F.broadcast(spark.createDataFrame(rows, T.StructType([T.StructField(of, T.IntegerType()), T.StructField(named, T.StringType())])))  # `size` rows, whatever the input
    placed = docs.withColumn(at, slot_of(docs[id_col], size))
    placed = placed.join(lookup, placed[at] == lookup[of])
    kept = [placed[f"`{c}`"] for c in docs.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, placed[at].alias("slot"), placed[named].alias("shard"))


def write_shards(docs: DataFrame, path: str, shards=SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id", files_per_shard: int = 4) -> None:
    """Writes a folder a shard (shard=NAME) of `files_per_shard` files at most, each from a task of its own."""
    part = F.pmod(F.xxhash64(F.col("slot")), F.lit(files_per_shard))
    placed = assign_shards(docs, shards, size, id_col)
    placed.repartition(len(shards) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs.select("doc_id", "n_chars")).select("doc_id", "slot", "shard", "n_chars")


def oracle(shards=SHARDS, size: int = TABLE_SIZE) -> str:
    """The placement in SQL, its table filled by DuckDB's rule: shard names over the same slots."""
    names = ", ".join(f"'{s}'" for s in shards)
    owners = ", ".join(map(str, fill_table(list(shards), size)))
    return f"""
WITH t AS (SELECT [{names}] AS names, [{owners}] AS owners),
placed AS (SELECT doc_id, n_chars, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, names[owners[slot + 1] + 1] AS shard, n_chars FROM placed, t
"""

"""Exact dedup over an extendible-hash index kept in shared files.

DataFrame operations only. The steps:

1. One scan writes an entry a row (id, 64-bit key of the normalised text, SHA-256).
2. The directory starts as one bucket. While a bucket holds more distinct keys than
   `capacity`, it splits by one more leading bit of the key; where its depth reaches
   the directory's, the directory doubles. Equal keys can't be split and don't count
   twice, so a hot text never makes the directory grow.
3. Keys of more than one row get their bytes compared: a second scan keeps the texts
   of those keys only and sums up equal ones before the shuffle, so that a text with a
   million copies leaves each map task once.
4. The directory routes these sums, and the entries of keys that occur once, to owner
   tasks, each of which takes a range of buckets. An owner compares the bytes of a key's
   texts, chains those that differ, and writes its part of the index: one row a chained
   text, with the smallest id and the number of rows.
5. Each entry looks itself up: the directory gives its bucket, the index the row of its key
   and SHA-256 there. A hot text has one index row; its entries are split by the skew-join rule.

Shuffled: about 100 bytes a row, and each repeated text once a map task. No text that
occurs once is moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ids_repeat, one_of_each, passing, stored, without_ids

#: Distinct keys a bucket holds before it splits.
CAPACITY = 100_000
#: The directory has at most 2**MAX_DEPTH slots, which bounds what the driver sees of it.
MAX_DEPTH = 16
#: Repeated keys that may be broadcast (8 bytes each); beyond that every text takes part in step 3.
BROADCAST_KEYS = 1_000_000
#: Sums of one text that an owner gets at most.
PARTS = 8


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def split_buckets(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """The directory for distinct keys counted by their `depth` leading bits.

    Returns (slot, bucket, local depth) for each of the 2**g slots, g being the global
    depth reached by doubling. A bucket is named by its first slot at full `depth`.
    """
    directory, g = [(0, 0)], 0  # a slot's (prefix, local depth)
    held = lambda prefix, local: sum(counts.get(i, 0) for i in range(prefix << (depth - local), (prefix + 1) << (depth - local)))
    queue = [(0, 0)]
    while queue:
        prefix, local = queue.pop()
        if local == depth or held(prefix, local) <= capacity:
            continue
        if local == g:  # doubling: each slot becomes two that point to the same bucket
            directory, g = [slot for slot in directory for _ in range(2)], g + 1
        children = [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
        width = 1 << (g - local - 1)
        for child, _ in children:
            directory[child * width : (child + 1) * width] = [(child, local + 1)] * width
        queue += children
    return [(slot, prefix << (depth - local), local) for slot, (prefix, local) in enumerate(directory)]


def slot(key, bits: int):
    """The leading `bits` of a 64-bit key, as a number from 0."""
    return F.lit(0) if bits == 0 else F.shiftrightunsigned(key, 64 - bits).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after each run of white space became one space; null
    counts as empty. The row with the smallest id stays; a null id loses to any other.
    Rows that repeat both id and text: exactly one has kept = true. `bucket` and `chain`
    say where the index holds the text (chain over 1: another text has the same key).
    An empty table gives an empty result. Further columns of `docs` are not read.
    """
    return _deduped(docs, id_col, text_col, capacity)[0]


def _deduped(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> tuple[DataFrame, bool]:
    """The verdicts, and whether any id repeats."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm")).withColumn("key", F.xxhash64("norm"))
    entries = stored(source.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "dedup-entries")

    keys = entries.groupBy("key").agg(F.count("*").alias("n_rows"))
    total, repeated = keys.agg(F.count("*"), F.count_if(F.col("n_rows") > 1)).first()
    depth = min(MAX_DEPTH, max(1, (4 * total // capacity).bit_length()))
    counted = entries.select("key").distinct().groupBy(slot(F.col("key"), depth).alias("slot")).count()
    directory = split_buckets({r["slot"]: r["count"] for r in counted.collect()}, depth, capacity)
    bits = len(directory).bit_length() - 1
    slots = F.broadcast(spark.createDataFrame([(s, b) for s, b, _ in directory], "slot int, bucket int"))  # 2**MAX_DEPTH rows at most
    route = lambda rows: rows.withColumn("slot", slot(F.col("key"), bits)).join(slots, "slot").drop("slot")

    many = keys.where("n_rows > 1").select("key")
    suspects = source.join(F.broadcast(many), "key", "left_semi") if repeated <= BROADCAST_KEYS else source
    sums = suspects.groupBy("key", "norm", (F.spark_partition_id() % PARTS).alias("part")).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    sums = sums.select("key", F.sha2("norm", 256).alias("text_sha256"), "norm", "least_id", "n")
    if repeated <= BROADCAST_KEYS:
        single = entries.join(F.broadcast(many), "key", "left_anti")
        sums = sums.unionByName(single.select("key", "text_sha256", F.lit(None).cast("string").alias("norm"), F.col("doc_id").alias("least_id"), F.lit(1).cast("long").alias("n")))
    # Owner tasks: a range of buckets each; equal bytes get the same place in the key's chain.
    owned = route(sums).repartitionByRange("bucket", "key")
    chain = F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("norm"))
    index = owned.withColumn("chain", chain).groupBy("bucket", "key", "chain").agg(F.any_value("text_sha256").alias("sha"), F.min("least_id").alias("keep_id"), F.sum("n").alias("group_size"))
    index = stored(index, "dedup-index").withColumnsRenamed({"bucket": "in_bucket", "key": "in_key"})

    found = route(entries).join(index, (F.col("bucket") == F.col("in_bucket")) & (F.col("key") == F.col("in_key")) & (F.col("text_sha256") == F.col("sha")))
    kept, repeats = F.col("doc_id").eqNullSafe(F.col("keep_id")), ids_repeat(entries, "doc_id")
    if repeats:  # of rows that repeat id and text, the first stays
        firsts = found.where(kept).groupBy("key", "chain").agg(F.min("row").alias("first_row")).withColumnsRenamed({"key": "k", "chain": "c"})
        found = found.join(stored(firsts, "dedup-firsts"), (F.col("key") == F.col("k")) & (F.col("chain") == F.col("c")))
        kept = F.col("row") == F.col("first_row")
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain"), repeats


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with its columns, whatever their names; of rows equal in id and text, one."""
    with passing(docs.sparkSession) as keep:
        verdicts, repeats = _deduped(docs, id_col, text_col)
        verdicts = keep(stored(verdicts, "dedup-verdicts"))
    if not repeats:
        return without_ids(docs, verdicts.where("not kept").select(F.col("doc_id").alias("gone_id")), id_col)
    stay = verdicts.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    norm = normalised(docs[text_col])
    met = docs.join(stay, docs[id_col].eqNullSafe(stay["kept_id"]) & (F.sha2(norm, 256) == stay["kept_sha"]), "left_semi")
    return one_of_each(met, id_col, norm)


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

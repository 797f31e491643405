"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets.

1. One scan hashes each text's word shingles and keeps, a row: the set's size and
   128-bit digest, BANDS band keys from full minima, and a packed signature with the low
   BITS bits of each of BANDS * ROWS minima. Texts aren't kept.
2. Rows of equal sets are one node. A third of all rows may be one node; one of its rows,
   found again by a hash of id and text, stands for it in the second scan.
3. Nodes that share a band key are a bucket. Four of its nodes lead; each member is
   compared with its leaders, once a pair. Pairs whose signatures' bit counts, corrected
   for chance collisions, say that a similarity of `percent` is over five standard
   deviations away are passed over; the others are decided on the full sets, which a
   second scan makes for these nodes only.
4. Buckets whose members still are in different components are compared in whole: members
   are dealt into blocks, and each pair of blocks is one cell. A cell joins up what it
   links as it goes and compares only members that aren't joined yet, so no pair list is
   made and a large group costs a cell at most one link a member. Where a bucket would have
   more than CELLS cells a block, its members first part by rare shingles: ordered from rare
   to frequent in the bucket, linked sets of sizes a >= b share one of the first
   a - ceil(t a) + 1 of the larger and the first b - ceil(2 t b / (1 + t)) + 1 of the smaller,
   so members that have only frequent shingles in common don't meet.
5. Components of all links; each has its smallest doc_id as its name.

A pair of similarity 0.85 shares no band with a chance of (1 - 0.85**4)**24 = 2e-8; more
alike pairs, less; by its signature it is passed over with one of 1.5e-6 (the binomial's
lower tail). Sets are held as 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_repeat, one_of_each, passing, release_memory, small_batches, stored, without_ids
from .graph import components
from .shingles import mix, shingle_sets

BANDS, ROWS, BITS = 24, 4, 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Standard deviations by which an estimate may miss before a pair is passed over.
SIGMAS = 5
#: Nodes that may be broadcast to pick texts in the second scan (a hash, a number and a digest each: 32 bytes).
BROADCAST_NODES = 1_000_000
#: Members of a block, and shingles of theirs (16 MB), on average at most.
BLOCK, BLOCK_SHINGLES = 1_000, 2_000_000
#: Cells a block beyond which a bucket's members part by rare shingles.
CELLS = 8
#: Owners of blocks that small labels share; numbers from 0 on are labels with blocks of their own.
SHARED, SHARED_LATER = -1, -2

_COUNT = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(85))
_MUL = _rng.integers(0, 2**63, _COUNT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, _COUNT, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the _COUNT hash functions over a set."""
    least = np.full(_COUNT, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    return least


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits): BANDS and _COUNT * BITS / 64 signed 64-bit numbers."""
    least = minima(hashes)
    bands = least.reshape(BANDS, ROWS).copy()
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, r])
    low = mix(least) & np.uint64(2**BITS - 1)
    packed = (low.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def estimate(same: float, count: int = _COUNT, bits: int = BITS) -> float:
    """The similarity for `same` equal fields: unequal minima agree by chance once in 2**bits."""
    chance = 0.5**bits
    return (same / count - chance) / (1 - chance)


def least_same(percent: int = PERCENT) -> int:
    """Equal fields under which a pair of similarity percent/100 is SIGMAS deviations away."""
    chance = 0.5**BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return max(0, int(np.floor(_COUNT * p - SIGMAS * (_COUNT * p * (1 - p)) ** 0.5)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands, packed = [], [], [], []
        for hashes in shingle_sets(batch.column(2)):
            sizes.append(len(hashes))
            if len(hashes):
                digests.append(_digest(hashes))
                b, s = signature(hashes)
                bands.append(b)
                packed.append(s)
            else:
                digests.append(None)
                bands.append(None)
                packed.append(None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(packed, longs)],
            ["doc_id", "at", "n_shingles", "digest", "bands", "packed"],
        )
    release_memory()


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) of (node, digest, text) where the text's set has that digest: another row can have the same hash."""
    for batch in batches:
        for i, hashes in enumerate(shingle_sets(batch.column(2))):
            if _digest(hashes) == batch.column(1)[i].as_py():
                one = pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), one], ["node", "hashes"])
    release_memory()


def same_fields(a, b):
    """Equal BITS-bit fields of two signatures, by bit counts."""
    n = 64 // BITS
    low = int("01" * n, 2) if BITS == 2 else sum(1 << (BITS * i) for i in range(n))
    total = F.lit(0)
    for i in range(_COUNT * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + n - F.bit_count(any_bit.bitwiseAND(F.lit(low if low < 2**63 else low - 2**64)))
    return total


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of them empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat(one[at] == flat, starts, dtype=np.int64)


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def link_cell(nodes, sides, labels, bands, band: int, packed, sets: list[np.ndarray], percent: int, chunk: int = 64) -> list[tuple[int, int]]:
    """Links that join what a cell's members link; members of one label count as joined.

    `sides`: 0 for members of the first block, 1 of the second, 2 of the one block that is
    compared with itself. A pair is left to the first band in which it shares a bucket.
    """
    roots, found, least = labels.copy(), [], least_same(percent)
    low = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    sizes = np.array([len(x) for x in sets])
    for i in np.flatnonzero(sides != 1):
        others = (roots != roots[i]) & ((np.arange(len(nodes)) > i) if sides[i] == 2 else sides == 1)
        others &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        at = np.flatnonzero(others)
        if len(at):
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
        if not len(at):
            continue
        x = packed[at] ^ packed[i]
        differ = x.copy()
        for k in range(1, BITS):
            differ |= x >> np.uint64(k)
        same = _COUNT - _POP[(differ & low).view(np.uint8).reshape(len(at), -1)].sum(axis=1, dtype=np.int64)
        at = at[same >= least]
        for k in range(0, len(at), chunk):
            some = at[k : k + chunk]
            some = some[roots[some] != roots[i]]
            if not len(some):
                continue
            shared = shared_counts(sets[i], [sets[j] for j in some])
            for j in some[100 * shared >= percent * (sizes[some] + sizes[i] - shared)]:
                if roots[j] != roots[i]:
                    found.append((int(nodes[i]), int(nodes[j])))
                    roots[roots == roots[j]] = roots[i]
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, kept, n_class.

    A document's set: its distinct 5-word shingles after lower-casing A-Z; with fewer
    words, all of them as one. Null, empty and blank texts have an empty set and are
    linked with nothing. Ids may be of any type that can be ordered. component_id is the
    smallest doc_id reachable over links, kept says whether the row's id is that; n_class
    counts the rows of the same set. Rows that repeat an id are separate members. A null id
    is smaller than none: a component of null ids only has a null component_id, and its
    rows are kept. An empty table gives an empty result. Further columns of `docs` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("at"), docs[text_col].alias("text"))
    rows = stored(small_batches(texts).mapInArrow(_signatures, f"doc_id {kind}, at long, n_shingles long, digest binary, bands array<long>, packed array<long>"), "signatures")

    # Equal sets have equal sizes, bands and signatures.
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "bands", "packed")]
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("at").alias("at"), F.count("*").alias("n_class"), *same)
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("node", "at", "digest", "n_shingles", "bands", "packed")

    with passing(docs.sparkSession) as keep:
        labels = keep(_labels(nodes, texts, percent))

    named = classes.select("digest", "node", "first_id", "n_class").join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = named.select("digest", "label", "n_class").join(names, "label").select(F.col("digest").alias("d"), "component_id", "n_class")
    out = rows.select("doc_id", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "n_class")


def _labels(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have links: the smallest node that each reaches."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # Four leaders a bucket: the smallest and largest node, by number and by hash.
    mixed = F.xxhash64("node")
    leaders = [F.min("node"), F.max("node"), F.min_by("node", mixed), F.max_by("node", mixed)]
    leads = buckets.groupBy("band", "key").agg(F.count("*").alias("members"), *[x.alias(f"lead{i}") for i, x in enumerate(leaders)]).where("members > 1")
    # Written first: a join with an aggregate on its own key is none that the skew rule can split.
    members = stored(buckets.join(stored(leads, "leads"), ["band", "key"]), "members")
    led = members.select("node", F.explode(F.array_distinct(F.array(*[f"lead{i}" for i in range(len(leaders))]))).alias("lead"))
    pairs = led.where("node != lead").select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")).distinct()

    # The second scan: sets of the nodes that are in any bucket.
    wanted = stored(members.select("node").distinct().join(nodes, "node"), "wanted")
    marks, n_wanted = wanted.select("node", F.col("at").alias("mark"), "digest"), wanted.count()
    picked = texts.join(F.broadcast(marks) if n_wanted <= BROADCAST_NODES else marks, F.col("at") == F.col("mark"))
    sets = stored(picked.select("node", "digest", "text").mapInArrow(_sets, "node long, hashes array<long>"), "sets")
    if sets.count() > n_wanted:  # rows that repeat id and text
        sets = stored(sets.groupBy("node").agg(F.any_value("hashes").alias("hashes")), "sets")

    hers = wanted.select(F.col("node").alias("l"), F.col("packed").alias("l_packed"))
    his = wanted.select(F.col("node").alias("m"), F.col("packed").alias("m_packed"))
    close = pairs.join(his, F.col("node") == F.col("m")).join(hers, F.col("lead") == F.col("l"))
    close = close.where(same_fields(F.col("m_packed"), F.col("l_packed")) >= least_same(percent)).select("lead", "node")
    with_one = close.join(sets.select(F.col("node").alias("m"), F.col("hashes").alias("m_set")), F.col("node") == F.col("m"))
    with_both = with_one.join(sets.select(F.col("node").alias("l"), F.col("hashes").alias("l_set")), F.col("lead") == F.col("l"))
    shared = F.size(F.array_intersect("m_set", "l_set"))
    links = with_both.where(100 * shared >= percent * (F.size("m_set") + F.size("l_set") - shared)).select(F.col("lead").alias("u"), F.col("node").alias("v"))
    links = stored(links, "links")
    labels = stored(components(links), "labels")

    more = stored(_link_rest(members, wanted, sets, labels, percent), "links")
    return labels if more.isEmpty() else stored(components(links.unionByName(more)), "labels")


def _link_rest(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Further links (u, v) within buckets whose members aren't in one component yet."""
    labelled = members.select("band", "key", "node").join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    labelled = labelled.select("band", "key", "node", F.coalesce("label", "node").alias("label"))
    # A bucket of two has been compared. Of buckets with the same members, one is compared.
    who = F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")
    buckets = labelled.groupBy("band", "key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), who)
    buckets = buckets.where("n > 2 and least < most")
    chosen = buckets.groupBy("who", "n").agg(F.min("band").alias("band")).join(buckets.select("who", "n", "band", "key"), ["who", "n", "band"]).select("band", "key")
    of = stored(labelled.join(chosen, ["band", "key"]).join(nodes.select("node", "n_shingles"), "node").withColumn("first", F.lit(True)), "open")
    owners, _ = _owners(of)
    # Cells: pairs of blocks of different owners, and of shared blocks. Linear in the blocks where one label owns most.
    shared, every = F.sum(F.when(F.col("owner") < 0, F.col("blocks")).otherwise(0)), F.sum("blocks")
    cells = (every * every - F.sum(F.when(F.col("owner") >= 0, F.col("blocks") * F.col("blocks")).otherwise(0)) + shared) / 2
    wide = owners.groupBy("band", "key").agg(cells.alias("cells"), every.alias("every")).where(F.col("cells") > CELLS * F.col("every")).select("band", "key")
    wide = stored(wide, "wide")
    if not wide.isEmpty():
        parted = _part(of.join(wide, ["band", "key"], "left_semi"), sets, percent)
        of = stored(of.join(wide, ["band", "key"], "left_anti").unionByName(parted), "open")

    # Members are dealt into blocks. A label of more than a block has blocks of its own
    # (owner = label), which aren't compared with each other; the others share blocks.
    owners, sizes = _owners(of)
    owners = stored(owners, "owners")
    # Written first, so that the join with a hot bucket's members is one that can be split.
    dealing = stored(sizes.select("band", "key", "label", "first", "owner").join(owners, ["band", "key", "owner"]), "dealing")
    dealt = of.join(dealing, ["band", "key", "label", "first"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    block = owners.select("band", "key", "owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = block.select("band", "key", F.struct("owner", "block").alias("x"))
    cells = block.join(block.select("band", "key", F.col("x").alias("y")), ["band", "key"])  # pairs of blocks, not of members
    cells = cells.where((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("x.owner") == SHARED)))
    cells = cells.where((F.col("x.owner") != F.col("y.owner")) | (F.col("x.owner") == SHARED))
    # Small cells share a task, so that no Python call is made for a few members. The blocks of
    # a bucket that has several are full, and have tasks of their own.
    n_of, n_hashes = of.agg(F.count("*"), F.sum("n_shingles")).first()
    tasks = max(1, n_of // BLOCK, (n_hashes or 0) // BLOCK_SHINGLES)
    alone = owners.groupBy("band", "key").agg(((F.max("blocks") == 1) & (F.max("owner") < 0)).alias("small"))
    cells = cells.join(alone, ["band", "key"])
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("at"), F.lit(2).alias("side"))))
    sides = sides.otherwise(F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("side")), F.struct(F.col("y").alias("at"), F.lit(1).alias("side"))))
    cells = cells.withColumn("cell", F.xxhash64("band", "key", "x", "y")).withColumn("side", sides)
    cells = cells.withColumn("task", F.when(F.col("small"), F.pmod(F.xxhash64("band", "key"), F.lit(tasks))).otherwise(F.col("cell")))
    spread = cells.select("band", "key", "cell", "task", F.explode("side").alias("s")).select("band", "key", "cell", "task", "s.side", "s.at.owner", "s.at.block")
    rows = dealt.join(stored(spread, "cells"), ["band", "key", "owner", "block"]).select("task", "cell", "band", "side", "node", "label")
    rows = rows.join(nodes.select(F.col("node").alias("k"), "bands", "packed"), F.col("node") == F.col("k")).join(sets.select(F.col("node").alias("l"), "hashes"), F.col("node") == F.col("l"))

    def link(pdf):
        import pandas as pd

        out = []
        for _, g in pdf.groupby("cell", sort=False):
            sets = [np.sort(np.asarray(x, np.int64)) for x in g["hashes"]]
            bands, packed = (np.array([np.asarray(x, np.int64) for x in g[c]]) for c in ("bands", "packed"))
            out += link_cell(g["node"].to_numpy(), g["side"].to_numpy(), g["label"].to_numpy(), bands, int(g["band"].iloc[0]), packed.view(np.uint64), sets, percent)
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return rows.select("task", "cell", "band", "side", "node", "label", "bands", "packed", "hashes").groupBy("task").applyInPandas(link, "u long, v long")


def _owners(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, key, owner, blocks), and the owner of each (band, key, label, first)."""
    fill = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = of.groupBy("band", "key", "label", "first").agg(fill.alias("fill"))
    sizes = sizes.withColumn("owner", F.when(F.col("fill") > 1, F.col("label")).when(F.col("first"), SHARED).otherwise(SHARED_LATER))
    return sizes.groupBy("band", "key", "owner").agg(F.ceil(F.sum("fill")).cast("int").alias("blocks")), sizes


def _part(of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of wide buckets in smaller ones, a bucket a rare shingle; `first`: it is early enough for a partner of the same size or more.

    Two members that are linked meet in one of these, where the smaller has `first`.
    """
    tokens = of.join(sets.select(F.col("node").alias("n"), "hashes"), F.col("node") == F.col("n")).select("band", "key", "node", "label", "n_shingles", F.explode("hashes").alias("token"))
    often = tokens.groupBy("band", "key", "token").agg(F.count("*").alias("often"))
    ranked = tokens.join(stored(often, "often"), ["band", "key", "token"])
    ordered = ranked.groupBy("band", "key", "node", "label", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    n = F.col("n_shingles")
    head = lambda over, under: (n - F.ceil(n * over / under) + 1).cast("int")
    heads = ordered.select("band", "key", "node", "label", "n_shingles", F.posexplode(F.slice("tokens", 1, head(percent, 100))).alias("at", "head"))
    parts = heads.select("band", F.xxhash64("key", "head.token").alias("key"), "node", "label", "n_shingles", (F.col("at") < head(2 * percent, 100 + percent)).alias("first"))
    met = parts.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.max("first").alias("any")).where("a < z and any").select("band", "key")
    return parts.join(stored(met, "met"), ["band", "key"]).select(*of.columns)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of `docs`.

    Of rows equal in id and text, one stays. Where an id repeats with different texts, all
    of these stay if any of them names its component.
    """
    with passing(docs.sparkSession) as keep:
        verdicts = keep(stored(near_classes(docs, id_col, text_col), "near-verdicts"))
    if not ids_repeat(verdicts, "doc_id"):
        return without_ids(docs, verdicts.where("not kept").select(F.col("doc_id").alias("gone_id")), id_col)
    stay = verdicts.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return one_of_each(docs.join(stay, docs[id_col].eqNullSafe(stay["kept_id"]), "left_semi"), id_col, docs[text_col])


def op8_near_dedup(spark, sf_dir):
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")

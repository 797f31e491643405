"""SimHash near-dedup through covering locality-sensitive hashing.

1. One scan gives each text a 64-bit fingerprint: a bit is set where it is set in over half of
   the hashes of the text's shingles. From here on, work is on distinct fingerprints, so a
   group of copies is one.
2. The cover. Each bit gets a nonzero vector of radius + 1 bits; for each nonzero vector v,
   a mask keeps the bits whose vectors have an odd product with v. The vectors of up to
   `radius` differing bits can't span the whole space, so some v is orthogonal to all of them:
   the mask of that v hides every difference. So each pair within the radius is in one bucket
   (equal masked fingerprints) of some table at least; that's certain, not likely. Radius 3
   has 15 tables, each of about 34 of the 64 bits.
3. A bucket's members are compared with four of its own, its leaders. What that links is joined
   up to components; buckets that are within one component need no more.
4. The others are compared in whole, where a task holds them as one short list; it reports
   links that join what isn't joined yet, so never more than members. Buckets of more than
   SMALL members first part again: their hidden bits get a cover of their own, which again
   separates no pair within the radius. Hidden bits go from 64 to at most 34, 18 and 8, and eight
   bits tell 256 members apart, so every bucket ends up short without a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, release_memory, small_batches, stored, table
from .graph import components

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Members of a bucket that one task compares as a list.
SMALL = 256
#: Bytes of a text that are split into words in one go, and shingles hashed in one go.
PIECE, SHINGLES = 1 << 20, 1 << 16


def cover(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over `bits`: any `radius` of them are all left out by one mask at least."""
    size = radius + 1
    vector = {b: i % (2**size - 1) + 1 for i, b in enumerate(bits)}
    masks = [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, 2**size)]
    return sorted(set(masks))


def covers(mask: int, radius: int = RADIUS) -> list[int]:
    """The masks that part a bucket of `mask`: what it keeps, and a cover of what it hides."""
    return [mask | more for more in cover([b for b in range(BITS) if not mask >> b & 1], radius)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with A-Z in lower case, in pieces cut at white space; each begins with the last ones of the piece before."""
    at, kept = 0, []
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and not (text[to] == 32 or 9 <= text[to] <= 13):
            to += 1
        words = kept + text[at:to].lower().split()
        yield words
        kept, at = words[-(WORDS - 1) :], to


def fingerprint(text: bytes | None) -> int:
    """Null and blank texts have fingerprint zero; a text of fewer words than a shingle is one shingle."""
    from xxhash import xxh64_intdigest

    counts, n, short = np.zeros(BITS, np.int64), 0, []
    for words in _words(text or b""):
        short = words if len(words) < WORDS else []
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist() if len(words) else []
        ends = ends.tolist()
        for i in range(0, len(words) - WORDS + 1, SHINGLES):
            last = min(i + SHINGLES, len(words) - WORDS + 1)
            hashes = np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts[i:last], ends[i + WORDS - 1 : last + WORDS - 1], strict=True)], "<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if n == 0 and short:
        return xxh64_intdigest(b" ".join(short), SEED)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        made = pa.array([signed(fingerprint(t.as_py())) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])
    release_memory()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text, as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return small_batches(texts).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _compared(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of buckets (fps, labels): links that join members of different labels, a spanning forest of them."""
        for batch in batches:
            us, vs = [], []
            for fps, labels in zip(batch.column(0), batch.column(1), strict=True):
                fp, roots = fps.values.to_numpy(), labels.values.to_numpy().copy()
                near = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= radius
                near &= roots[:, None] != roots[None, :]
                for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
                    if roots[i] != roots[j]:
                        us.append(int(fp[i]))
                        vs.append(int(fp[j]))
                        roots[roots == roots[j]] = roots[i]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return link


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bucketed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Of (mask, fp): the members of buckets that aren't within one component, with label, n and four leaders."""
    rows = members.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    if labels is None:
        rows = rows.withColumn("label", F.col("fp"))
    else:
        rows = rows.join(labels.select("node", F.col("label").alias("named")), F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("named", "fp")).drop("node", "named")
    mixed = F.xxhash64("fp")
    leaders = [x.alias(f"lead{i}") for i, x in enumerate((F.min("fp"), F.max("fp"), F.min_by("fp", mixed), F.max_by("fp", mixed)))]
    of = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("z"), *leaders)
    # Written first, so that the join with a hot bucket's members is one that can be split.
    of = stored(of.where("n > 1 and a < z").drop("a", "z"), "cover-buckets")
    return stored(rows.join(of, ["mask", "key"]), "cover-members")


def _labels(nodes: DataFrame, radius: int) -> DataFrame | None:
    """(node, label) of the fingerprints (fp) that have links; None without any."""
    spark = nodes.sparkSession
    masks, hot, links, labels = {0: covers(0, radius)}, nodes.select(F.lit(0).cast("long").alias("mask"), "fp"), [], None
    while True:
        # Masks of a level: at most (2**(radius + 1) - 1) ** level rows, whatever the input.
        parts = F.broadcast(spark.createDataFrame([(signed(m), signed(more)) for m, some in masks.items() for more in some], "mask long, part long"))
        members = _bucketed(hot.join(parts, "mask").select(F.col("part").alias("mask"), "fp").distinct() if labels is not None else hot.join(parts, "mask").select(F.col("part").alias("mask"), "fp"), labels)
        led = members.select("fp", F.explode(F.array_distinct(F.array(*[f"lead{i}" for i in range(4)]))).alias("lead")).where("fp != lead")
        led = led.where(_distance("fp", "lead") <= radius).select(F.greatest("fp", "lead").alias("u"), F.least("fp", "lead").alias("v")).distinct()
        links.append(stored(led, "cover-links"))
        if not links[-1].isEmpty():
            labels = _joined(links)
        open_ = _still_open(members.where("n > 3"), labels)  # of three, each is a leader's pair
        short = open_.where(F.col("n") <= SMALL).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("label").alias("labels"))
        links.append(stored(short.select("fps", "labels").mapInArrow(_compared(radius), "u long, v long"), "cover-links"))
        if not links[-1].isEmpty():
            labels = _joined(links)
        hot = open_.where(F.col("n") > SMALL).select("mask", "fp")
        found = [r["mask"] for r in hot.select("mask").distinct().collect()]  # as many as there are masks, at most
        if not found:
            return labels
        masks = {m % 2**64: covers(m % 2**64, radius) for m in found}


def _joined(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return stored(components(every), "cover-labels")


def _still_open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(mask, key, fp, n, label) of the buckets that hold several labels now."""
    rows = members.select("mask", "key", "fp", "n", "label")
    if labels is None:
        return rows
    rows = rows.drop("label").join(labels, F.col("fp") == F.col("node"), "left").select("mask", "key", "fp", "n", F.coalesce("label", "fp").alias("label"))
    rows = stored(rows, "cover-open")
    several = stored(rows.groupBy("mask", "key").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("mask", "key"), "cover-several")
    return stored(rows.join(several, ["mask", "key"]), "cover-open")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row for each row of `docs`: doc_id, fingerprint, component_id, kept, n_same.

    Words are stretches without white space (space, 9-13) after lower-casing A-Z; shingles of
    three, repeats included, are joined by spaces and hashed by XXH64. Fewer words are one
    shingle; a null, empty or blank text has fingerprint zero and is linked like any other.
    Rows link at `radius` or fewer differing bits. component_id is the smallest doc_id
    reachable; kept says whether the row's id is that; n_same counts rows of the same
    fingerprint. Ids may be of any type that can be ordered; rows that repeat an id are members
    each. A null id names a component only where there is no other. An empty table gives an
    empty result. Further columns of `docs` are not read.
    """
    if not 0 <= radius < 8:
        raise ValueError("a radius is 0 to 7: a cover has 2 ** (radius + 1) - 1 tables")
    with passing(docs.sparkSession) as keep:
        rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
        classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")), "simhash-classes")
        labels = _labels(classes.select("fp"), radius)
        named = classes.withColumn("label", F.col("fp"))
        if labels is not None:
            named = classes.join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp")).drop("node")
        named = stored(named, "simhash-named")
        names = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "simhash-names")
        of = stored(named.join(names, "label").select("fp", "component_id", "n_same"), "simhash-of")
        out = rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_same")
        return keep(stored(out, "simhash-result"))


def op13_simhash(spark, sf_dir):
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")

"""A trie of conversations' first turns, by partition refinement.

1. Turns are put in order by one range-partitioned sort that may cut a conversation anywhere,
   and numbered by what each partition holds and what those before it counted; a conversation
   of a third of all turns is several tasks' work.
2. Conversations are rebuilt: the first turns of every group's base conversation, then their own.
   Equal ones become one sequence with a weight, so copies are refined once.
3. Refinement starts with one class of all sequences. A round splits the active classes by the
   digests of their next turns, several turns a round and twice as many in each further one. A
   sequence whose class holds no other retires; its remaining turns are a unary chain, a row
   each, whose figures need no other row.
4. What the classes add up to is folded back without a step a level: a node's sums are sums over
   the sequences that pass through it. A class's smallest sequence owns the words of its node,
   from the first turn on at which it is the smallest; so each node's words are counted once.

SHA-256 over an unbounded list of ids has no parallel form. Ids are sorted and joined up to
pieces by many tasks; then one task a node streams the pieces through the digest, never holding
more than one batch of them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, stored, table

#: Conversations of one base, and the number of different head lengths.
GROUP, HEADS = 20, 4
#: Turns that the first round splits by, and the most that one does.
FIRST_ROUND, LAST_ROUND = 4, 64
#: Ids joined up to one piece.
PIECE = 8_192
WORD = r"[^\x20\x09-\x0D]+"

_RANKED = "conv_id long, part int, rank long, words long, upto long, t string"
_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _carried(values: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """Running sums that begin anew at `starts`; the first stretch goes on from `first`."""
    sums = np.cumsum(values)
    base = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], 0)
    base[0] -= first
    return sums - np.repeat(base, np.diff(np.append(starts, len(values))))


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (conv_id, words, t): place and words so far within this partition's part of the conversation."""
    from pyspark import TaskContext

    part, last, rank, upto = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        goes_on = last is not None and ids[0] == last
        ranks = _carried(np.ones(len(ids), np.int64), starts, rank if goes_on else 0)
        sums = _carried(words, starts, upto if goes_on else 0)
        last, rank, upto = ids[-1], int(ranks[-1]), int(sums[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(ranks), batch.column(1), pa.array(sums), batch.column(2)], ["conv_id", "part", "rank", "words", "upto", "t"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (rep, conv_id): the decimal ids of a rep, joined by commas, PIECE at most a row."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 32
    for batch in batches:
        reps, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts = np.flatnonzero(np.append(True, reps[1:] != reps[:-1])) if len(reps) else []
        out: tuple[list, list, list] = ([], [], [])
        for a, z in zip(starts, [*starts[1:], len(reps)], strict=True):
            for i in range(a, z, PIECE):
                for column, value in zip(out, (int(reps[a]), place, ",".join(map(str, ids[i : min(i + PIECE, z)].tolist()))), strict=True):
                    column.append(value)
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["rep", "place", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: each rep's SHA-256 over all its ids."""
    made = lambda rep, digest: pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "ends_sha256"])
    now, digest = None, None
    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rep == now:
                digest.update(b",")
            else:
                if now is not None:
                    yield made(now, digest)
                now, digest = rep, hashlib.sha256()
            digest.update(ids.encode())
    if now is not None:
        yield made(now, digest)


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t, words, before) of every turn: its place from 1, a digest of role and text, its words and those before it."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", "turn", "t"]
    parts = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "words", "t").mapInArrow(_rank, _RANKED), "trie-ranked")
    pieces = parts.groupBy("conv_id", "part").agg(F.max("rank").alias("n"), F.max("upto").alias("w"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a piece a partition at most
    carried = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.sum(x).over(earlier).alias(f"earlier_{x}") for x in ("n", "w")])
    carried = F.broadcast(carried.where("earlier_n is not null"))  # conversations that the sort cut: less than one a partition
    met = parts.join(carried, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    or_0 = lambda c: F.coalesce(c, F.lit(0))
    return met.select("conv_id", (F.col("rank") + or_0("earlier_n")).alias("pos"), "t", "words", (F.col("upto") - F.col("words") + or_0("earlier_w")).alias("before"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns, total) of every rebuilt conversation, and (conv_id, pos, t, words, before) of its turns."""
    firsts = F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "t", "words"))))
    convs = stored(own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("words").alias("w"), firsts.alias("firsts")), "trie-convs")
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("b"), F.col("firsts").alias("base_firsts"))
    h = head_length(F.col("conv_id")).cast("int")
    met = convs.withColumn("h", h).join(bases, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("b"), "left")
    heads = F.coalesce(F.slice("base_firsts", 1, F.col("h")), F.expr("array()").cast("array<struct<pos:bigint,t:string,words:bigint>>"))
    words = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x["words"])
    met = met.withColumn("heads", heads).withColumn("head_w", words("heads")).withColumn("skip_w", words(F.slice("firsts", 1, F.col("h"))))
    n_turns = F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    met = stored(met.select("conv_id", "h", "heads", "head_w", "skip_w", n_turns.cast("long").alias("n_turns"), (F.col("head_w") + F.col("w") - F.col("skip_w")).alias("total")), "trie-members")
    rest = own.where(F.col("pos") > h).join(met.select(F.col("conv_id").alias("c"), "h", F.size("heads").alias("n_heads"), "head_w", "skip_w"), F.col("conv_id") == F.col("c"))
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_heads")).alias("pos"), "t", "words", (F.col("before") - F.col("skip_w") + F.col("head_w")).alias("before"))
    first = met.select("conv_id", F.col("heads").alias("all"), F.explode("heads").alias("x"))
    first = first.select("conv_id", "x.pos", "x.t", "x.words", words(F.filter("all", lambda y: y["pos"] < F.col("x.pos"))).alias("before"))
    return met.select("conv_id", "n_turns", "total"), rest.unionByName(first)


def sequences(members: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, rep, m, n_turns, total): rep is the smallest conversation of the same turns, m how many there are.

    Equal means: as many turns, and equal sums of two independent 64-bit hashes of (place, SHA-256).
    """
    low, sums = F.lit(0xFFFFFFFF), []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), "pos", "t")
        sums += [F.sum(h.bitwiseAND(low)).alias(f"s{salt}l"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"s{salt}h")]
    names = ["s1l", "s1h", "s2l", "s2h"]
    signed = members.join(turns.groupBy(F.col("conv_id").alias("c")).agg(*sums), F.col("conv_id") == F.col("c"), "left")
    signed = stored(signed.select("conv_id", "n_turns", "total", *[F.coalesce(s, F.lit(0)).alias(s) for s in names]), "trie-signed")
    equal = stored(signed.groupBy("n_turns", *names).agg(F.min("conv_id").alias("rep"), F.count("*").alias("m")), "trie-equal")
    return stored(signed.join(equal, ["n_turns", *names]).select("conv_id", "rep", "m", "n_turns", "total"), "trie-sequences")


def refined(turns: DataFrame, root: int) -> DataFrame:
    """(rep, pos, name, before, words): where sequences share a class, with its smallest one's name."""
    active, done, step, found = None, 0, FIRST_ROUND, []
    while True:
        block = turns.where(F.col("pos").between(done + 1, done + step)).select("rep", "pos", "t", "before", "words")
        block = block.withColumn("class", F.lit(root)) if active is None else block.join(active, "rep")
        run = block.groupBy("rep", "class").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "before", "words"))).alias("run"))  # `step` turns at most
        chain = lambda x: F.sha2(F.array_join(F.transform(F.slice("run", F.lit(1), x["pos"].cast("int") - done), lambda y: y["t"]), ""), 256)
        keys = run.select("rep", "class", F.explode(F.transform("run", lambda x: F.struct(x["pos"].alias("pos"), x["before"].alias("before"), x["words"].alias("words"), chain(x).alias("prefix")))).alias("x"))
        keys = stored(keys.select("rep", "class", "x.*"), "trie-keys")
        shared = stored(keys.groupBy("class", "pos", "prefix").agg(F.min("rep").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n"), "trie-classes")
        found.append(stored(keys.join(shared, ["class", "pos", "prefix"]).select("rep", "pos", "name", "before", "words"), "trie-shared"))
        done += step
        active = found[-1].where(F.col("pos") == done).select("rep", F.col("name").alias("class"))
        if active.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        step = min(2 * step, LAST_ROUND)


def ends(seqs: DataFrame) -> DataFrame:
    """(rep, ends_sha256) over the ascending ids of each rep's conversations."""
    alone = seqs.where("m = 1").select("rep", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    order = ["rep", "conv_id"]
    many = seqs.where("m > 1").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(many.mapInArrow(_pieces, "rep long, place long, ids string"), "trie-ends")
    streamed = pieces.repartition("rep").sortWithinPartitions("rep", "place").select("rep", "ids")
    return alone.unionByName(streamed.mapInArrow(_digests, "rep long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` has conv_id, turn, role and text; further columns are not read. Turns go by
    `turn`, null first, equal ones by the digest of role and text; each row is a turn, repeated
    ones too. A null role or text is empty. A row without a conv_id belongs to no conversation and
    is left out. A conversation that has no turns once it is rebuilt ends at the root. Empty texts
    are turns of no words. An empty table has no members, so no nodes: an empty result.
    """
    with passing(conversations.sparkSession) as keep:
        members, turns = rebuilt(ranked(conversations))
        turns = stored(turns, "trie-turns")
        seqs = sequences(members, turns)
        root = seqs.agg(F.min("rep")).first()[0]
        return keep(stored(_nodes(seqs, turns, -1 if root is None else root), "trie-nodes"))


def _nodes(seqs: DataFrame, turns: DataFrame, root: int) -> DataFrame:
    reps = seqs.where("conv_id = rep").drop("conv_id")
    turns = stored(turns.join(reps.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep"), "trie-turns")
    shared = refined(turns, root)

    # A sequence's last shared place s, and the words before the first place at which it names its class.
    own = F.min(F.when(F.col("name") == F.col("rep"), F.struct("pos", "before")))["before"]
    past = F.max(F.struct("pos", "name", (F.col("before") + F.col("words")).alias("past")))
    spans = shared.groupBy(F.col("rep").alias("r")).agg(own.alias("own"), past.alias("z"))
    per = reps.join(spans, F.col("rep") == F.col("r"), "left").select(
        "rep", "m", "n_turns", "total", F.coalesce("z.pos", F.lit(0)).alias("s"), F.coalesce("z.name", F.lit(root)).alias("last"),
        F.when(F.col("rep") == root, 0).otherwise(F.coalesce("own", "z.past", F.lit(0))).alias("owned_from"),
    )
    per = stored(per, "trie-sequence-spans")

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        """Sums over the sequences through a node; `before`: words before it."""
        saved = F.sum(F.col("m") * (F.col("total") - F.col("before"))) - F.sum(F.col("total") - F.when(F.col("rep") == F.col("name"), F.col("before")).otherwise(F.col("owned_from")))
        leaves = F.greatest(F.count_if(F.col("n_turns") > F.col("s")), F.lit(1))
        return rows.groupBy(*keys).agg(F.sum("m").alias("n_convs"), leaves.alias("n_leaves"), saved.alias("saved_tokens"))

    through = shared.join(per.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"))
    inner = summed(through, "pos", "name")
    up = shared.select(F.col("rep").alias("r"), (F.col("pos") + 1).alias("p"), F.col("name").alias("above"))
    inner = inner.join(up, (F.col("name") == F.col("r")) & (F.col("pos") == F.col("p")), "left").select("pos", "name", F.coalesce("above", F.lit(root)).alias("parent"), "n_convs", "n_leaves", "saved_tokens")
    top = summed(per.withColumns({"name": F.lit(root), "before": F.lit(0)}), F.lit(0).cast("long").alias("pos"), "name").withColumn("parent", F.lit(None).cast("long"))
    inner = stored(inner.unionByName(top.select(*inner.columns)), "trie-inner")

    below = inner.where("pos > 0").select((F.col("pos") - 1).alias("p"), F.col("parent").alias("n")).unionByName(per.where("n_turns > s").select(F.col("s").alias("p"), F.col("last").alias("n")))
    children = below.groupBy("p", "n").agg(F.count("*").alias("n_children"))
    inner = inner.join(children, (F.col("pos") == F.col("p")) & (F.col("name") == F.col("n")), "left")
    inner = inner.select(F.col("name").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens")

    # Tails: unary chains, a row a turn.
    tails = turns.join(per.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).where(F.col("pos") > F.col("s"))
    tails = tails.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("s") + 1, F.col("last")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
    )
    at = per.select(F.col("rep").alias("r"), F.when(F.col("n_turns") > F.col("s"), F.col("rep")).otherwise(F.col("last")).alias("c"), F.col("n_turns").alias("d"))
    ended = ends(seqs).join(at, F.col("rep") == F.col("r")).select("c", "d", "ends_sha256")
    every = inner.unionByName(tails).join(ended, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left")
    none = hashlib.sha256().hexdigest()
    return every.select(*_NODES, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH bits AS (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS crc FROM bits),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda a, b: xor(a // 256, crc[xor(a, b) % 256 + 1])), 4294967295) % {HEADS} AS h FROM ids, tab),
own AS (SELECT conv_id, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT hs.conv_id, 0 AS part, pos, t, words FROM hs JOIN own ON own.conv_id = hs.conv_id - hs.conv_id % {GROUP} AND pos <= h
  UNION ALL SELECT own.conv_id, 1, pos, t, words FROM own JOIN hs USING (conv_id) WHERE pos > h),
turns AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(t, '') OVER w AS key, words FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
paths AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM ids UNION ALL SELECT conv_id, depth, key, words FROM turns),
linked AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM linked GROUP BY depth, key),
fanned AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.up = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.up),
folded AS (SELECT a.depth, a.key, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
  FROM fanned d JOIN paths a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.depth, a.key)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM fanned JOIN folded USING (depth, key)
"""

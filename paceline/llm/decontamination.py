"""Benchmark decontamination: a broadcast hash set of the test items' word windows.

DataFrame operations only. One scan turns each document into its words and then into a
row a window position, whose 64-bit hash meets the windows' hashes in a broadcast hash
join. Split, explode, hash and probe are one codegen stage, so positions that hit
nothing never leave the task. Hits are verified word by word in the same stage; only
they, and one row a document, are shuffled.

The windows are broadcast only up to BROADCAST_WINDOWS rows (counted first). Beyond that
(hash of the text, place, size, hash of the window) is dealt by the window's hash, without
words; what meets a window comes back to the texts of that hash, once a different text, and
is verified there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, passing, stored, unused, without_ids

#: A word after lower-casing A-Z: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose letters are as they were.
WORD_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Consecutive words a window has.
WINDOW = 10
#: Windows that may be broadcast, and bytes of their words on average: 100 MB.
BROADCAST_WINDOWS, WINDOW_BYTES = 500_000, 200


def words(text):
    """The words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _window_hash(column: str, at: str, size: int):
    return F.xxhash64(F.lit(size), *[F.get(F.col(column), F.col(at) + k) for k in range(size)])


def _positions(size: int, column: str = "words"):
    """0 .. n - size, empty for fewer words."""
    n = F.size(column)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, size, gram, item_id): each window of each item, once an item.

    An item of fewer words than `window`, but not none, is one window of that size.
    """
    items = benchmark.select(benchmark[id_col].alias("item_id"), words(benchmark[text_col]).alias("words"))
    full = items.select("item_id", "words", F.explode(_positions(window)).alias("at"))
    full = full.select("item_id", F.lit(window).alias("size"), _window_hash("words", "at", window).alias("hash"), F.slice("words", F.col("at") + 1, window).alias("gram"))
    whole = items.where((F.size("words") > 0) & (F.size("words") < window))
    parts = [full]
    for size in range(1, window):
        short = whole.where(F.size("words") == size).withColumn("at", F.lit(0))
        parts.append(short.select("item_id", F.lit(size).alias("size"), _window_hash("words", "at", size).alias("hash"), F.col("words").alias("gram")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select("hash", "size", F.array_join("gram", " ").alias("gram"), "item_id").distinct()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, n_hit, items (sorted strings), spans, text_key (a hash of the text).

    `spans` are the disjoint stretches of hit words, as (first, last) word numbers in
    order. Null and empty texts have no words and no hits; rows that repeat an id are
    judged each for itself; items without words can't be hit; an empty table on either
    side gives no hits or no rows. An item with a null id hits words but isn't listed.
    """
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    grams = windows.select("hash", "size", "gram").distinct()
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect()) or [window]  # at most `window` numbers
    n_windows, n_bytes = windows.agg(F.count("*"), F.sum(F.octet_length("gram"))).first()
    near = n_windows <= broadcast_windows and (n_bytes or 0) <= WINDOW_BYTES * broadcast_windows
    meant = F.broadcast if near else lambda df: df
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), words(docs[text_col]).alias("words"))
    held = stored((_held if near else _held_far)(rows, grams, sizes), "hits")
    last = "element_at(acc, -1)"
    joined_up = F.expr(
        f"""aggregate(found, cast(array() as array<struct<at:int,end:int>>), (acc, x) ->
          if(size(acc) = 0 or {last}.end < x.at, concat(acc, array(named_struct('at', x.at, 'end', x.end))),
             concat(slice(acc, 1, size(acc) - 1), array(named_struct('at', {last}.at, 'end', greatest({last}.end, x.end))))))"""
    )
    spans = held.select("row", "doc_id", "text_key", "n_words", joined_up.alias("spans"), "grams")
    listed = spans.where(F.size("grams") > 0).select("row", F.explode("grams").alias("g")).select("row", "g.hash", "g.gram")
    by_gram = windows.where("item_id is not null").select(F.col("hash").alias("w_hash"), F.col("gram").alias("w_gram"), F.col("item_id").cast("string").alias("item"))
    items = listed.join(meant(by_gram), (F.col("hash") == F.col("w_hash")) & (F.col("gram") == F.col("w_gram"))).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = spans.join(items, "row", "left")
    return out.select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0, (n, s) -> n + s.end - s.at)").cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", "text_key",
    )


def _held(rows: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """`rows` with `found` (hit windows by place) and `grams`: a broadcast hash set, probed and verified in one stage."""
    # A document's position -1 stands for itself and meets the one row of size 0.
    marked = grams.unionByName(rows.sparkSession.createDataFrame([(0, 0, "")], "hash long, size int, gram string"))
    marked = F.broadcast(marked.withColumnsRenamed({"hash": "w_hash", "size": "w_size"}))
    n = F.size("words")
    spread = rows.select("row", "doc_id", "text_key", n.alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.greatest(n - sizes[0], F.lit(-1)))).alias("at"))
    key = lambda size: F.when(F.col("at") < 0, F.lit(0).cast("long")).when(F.col("at") + size <= F.col("n_words"), _window_hash("words", "at", size))
    if len(sizes) == 1:
        spread = spread.withColumns({"size": F.when(F.col("at") < 0, 0).otherwise(sizes[0]), "hash": key(sizes[0])})
    else:
        kinds = [F.struct(F.when(F.col("at") < 0, F.lit(0) if i == 0 else F.lit(-1)).otherwise(size).alias("size"), key(size).alias("hash")) for i, size in enumerate(sizes)]
        spread = spread.withColumn("kind", F.explode(F.array(*kinds))).withColumns({"size": F.col("kind.size"), "hash": F.col("kind.hash")})
    same_words = F.array_join(F.expr("slice(words, greatest(at, 0) + 1, size)"), " ") == F.col("gram")
    # The sizes are compared by subtraction, so that the join's key is the one 64-bit hash.
    met = spread.join(marked, (F.col("hash") == F.col("w_hash")) & (F.col("size") - F.col("w_size") == 0) & ((F.col("size") == 0) | same_words))
    real = F.col("size") > 0
    hits = met.select("row", "doc_id", "text_key", "n_words", "at", "size", "hash", "gram")

    # One row a document: its hits are bounded by its words.
    return hits.groupBy("row", "doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(real, F.struct("at", (F.col("at") + F.col("size")).alias("end"))))).alias("found"),
        F.collect_set(F.when(real, F.struct("hash", "gram"))).alias("grams"),
    )


def _held_far(rows: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """The same where the windows are too many to broadcast: places go by hash, without words, and hits come back to their text."""
    n = F.size("words")
    spread = rows.select("text_key", "words", n.alias("n_words"), F.explode(F.when(n >= sizes[0], F.sequence(F.lit(0), n - sizes[0]))).alias("at"))
    kinds = [F.struct(F.lit(size).alias("size"), F.when(F.col("at") + size <= F.col("n_words"), _window_hash("words", "at", size)).alias("hash")) for size in sizes]
    places = spread.select("text_key", "at", F.explode(F.array(*kinds)).alias("k")).select("text_key", "at", "k.size", "k.hash").where("hash is not null")
    marked = grams.withColumnsRenamed({"hash": "w_hash", "size": "w_size"})
    met = places.join(marked, (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size"))).select("text_key", "at", "size", "hash", "gram").distinct()
    of_text = met.groupBy(F.col("text_key").alias("of_key")).agg(F.collect_list(F.struct("at", "size", "hash", "gram")).alias("met"))
    # Another text may have the same hash: what met is verified against each text's own words.
    real = F.expr("filter(coalesce(met, array()), m -> array_join(slice(words, m.at + 1, m.size), ' ') = m.gram)")
    held = rows.join(of_text, F.col("text_key") == F.col("of_key"), "left").select("row", "doc_id", "text_key", n.alias("n_words"), real.alias("met"))
    found = F.expr("array_sort(array_distinct(transform(met, m -> named_struct('at', m.at, 'end', m.at + m.size))))")
    return held.select("row", "doc_id", "text_key", "n_words", found.alias("found"), F.expr("array_distinct(transform(met, m -> named_struct('hash', m.hash, 'gram', m.gram)))").alias("grams"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, with its columns; an id goes if any of its rows is hit."""
    with passing(docs.sparkSession) as keep:
        found = find_contamination(docs, benchmark, id_col, text_col).where("n_hit > 0")
        gone = keep(stored(found.select(F.col("doc_id").alias("gone_id")).distinct(), "contaminated"))
    return without_ids(docs, gone, id_col)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the hit words: each goes with the signs after it; rows without hits are as they were.

    A text that is all hits becomes what stands before its first word.
    """
    w, g, p = (unused(docs, name) for name in ("words_", "signs_", "spans_"))
    with passing(docs.sparkSession) as keep:
        found = find_contamination(docs, benchmark, id_col, text_col).where("n_hit > 0")
        hit = keep(stored(found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.col("spans").alias(p)), "spans"))
    hit = hit.dropDuplicates(["hit_id", "hit_key"])
    met = docs.join(hit, docs[id_col].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs[text_col]) == hit["hit_key"]), "left")
    met = met.withColumns({w: F.regexp_extract_all(docs[text_col], F.lit(WORD_AS_WRITTEN), F.lit(0)), g: F.split(docs[text_col], WORD_AS_WRITTEN, -1)})
    kept = F.expr(f"transform(`{w}`, (w, i) -> if(exists(`{p}`, s -> i >= s.at and i < s.end), '', concat(w, `{g}`[i + 1])))")
    cut = F.when(F.col(p).isNull(), docs[text_col]).otherwise(F.concat(F.get(F.col(g), F.lit(0)), F.array_join(kept, "")))
    return met.select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op3_decontamination(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM lower_items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lower_docs, sizes WHERE len(w) >= size)),
hits AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

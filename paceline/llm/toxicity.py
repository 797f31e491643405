"""Toxicity by compression distance: does a text's window compress better with a
zstandard dictionary of toxic text or with one of ordinary text?

1. The labelled sample is split by a hash of the id: TRAIN of PARTS parts train, the rest calibrate.
2. zstandard trains dictionaries on both sides. Ordinary ones: on stretches of ordinary rows.
   Toxic ones: on what toxic rows say and ordinary ones don't, the words of toxic rows that begin
   with a telling stem. A stem is the beginning of a word, or the word, that significantly more
   toxic than ordinary rows hold; of stems that go on from each other, the most telling. A sample
   holds windows of one stem, and stems have as many windows each where there are as many, so the
   trainer doesn't spend a dictionary on the most frequent language. Trained on whole toxic rows
   instead, it fills up with ordinary syllables.
3. Both dictionaries of a pair begin with the same shared part, so ordinary windows compress alike
   with both, and the difference in bytes marks toxic ones.
4. A pair is a candidate for each significance and form of training. They are judged on the
   calibration rows as the very dictionaries that would be used; BEST ones are kept, each the one
   that helps most beside those before it.
5. A text's score is a logistic function of how many windows differ by 1, 2, ... bytes at least,
   as numbers and as shares, for each kept pair. Weights and the cut are calibrated on the
   calibration rows.

A window is a word between two spaces, followed by a carrier that all dictionaries end with:
zstandard looks for no match in the last bytes of its input, and stores tiny inputs as they
are, so without the carrier short words would not compress at all.

Rows are read on executors. To the driver go numbers, telling stems and selected windows, never
texts: what a row gives is bounded by ROW_WINDOWS and ROW_STRETCHES.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, passing, release_memory, small_batches, stored

#: Labelled toxic rows that are learned from at most; ordinary ones, twice as many.
LEARN_ROWS = 1_500
#: Parts of the labelled sample by a hash of the id, and how many of them train dictionaries.
PARTS, TRAIN = 8, 5
#: Toxic windows that a toxic row trains on at most, and stretches of STRETCH words that an ordinary row does, evenly spaced.
ROW_WINDOWS, ROW_STRETCHES, STRETCH = 400, 24, 8
#: Bytes of the shared part of all dictionaries.
SHARED_BYTES = 24_000
#: Bytes of a dictionary's own part, and of the segments that zstandard's trainer takes.
FORMS = ((1_024, 32), (2_048, 24))
#: Deviations by which a stem's share of toxic rows must exceed its share of ordinary rows. A stem
#: in n toxic and no ordinary rows has the square root of 2 n. Fewer than LEAST_ROWS toxic rows never decide.
SIGNIFICANT, LEAST_ROWS = (2.4, 4.0, 5.0, 6.0), 3
#: Windows of a stem that are trained on at most, and windows in a sample.
STEM_WINDOWS, SAMPLE = 40, 4
#: Telling stems that the driver sees at most, the most telling first.
STEMS = 20_000
#: Pairs of dictionaries that are kept.
BEST = 2
#: How zstandard looks for matches.
MATCHING = {"window_log": 15, "chain_log": 15, "hash_log": 15, "search_log": 5, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_DFAST}
#: What calling an ordinary text toxic costs, in misses.
FALSE_ALARM = 4
#: Differences in bytes that are counted.
THRESHOLDS = (1, 2, 3, 4, 5, 6)
#: Letters of a word's beginning that may be a stem; a whole word of up to LONGEST letters may be one.
STEM, LONGEST = range(4, 13), 40
#: Words whose differences a worker remembers.
REMEMBER = 150_000
CARRIER = b" " + bytes(range(1, 17))
_WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[str]:
    """The words of a text, in order; each stands for one window."""
    return _WORD.findall((text or "").lower())


def _bytes(words: Iterable[str]) -> bytes:
    return (" " + " ".join(words) + " ").encode("utf-8", "replace")


def _window(word: str) -> bytes:
    # A word of any length is compared in whole.
    return b" " + word.encode("utf-8", "replace") + CARRIER


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in STEM if k < len(word)] + [word] * (len(word) <= LONGEST)


def stems_of(words: Iterable[str]) -> set[str]:
    return {p for w in set(words) for p in beginnings(w)}


def stretches(words: list[str]) -> list[bytes]:
    """ROW_STRETCHES stretches of a row at most, evenly spaced."""
    starts = range(0, len(words), STRETCH)
    chosen = starts if len(starts) <= ROW_STRETCHES else [starts[i * len(starts) // ROW_STRETCHES] for i in range(ROW_STRETCHES)]
    return [_bytes(words[i : i + STRETCH]) for i in chosen]


def selected(words: list[str], stems: set[str]) -> list[str]:
    """The toxic windows of a row: the first ROW_WINDOWS words of which a stem is the beginning or the whole."""
    return [w for w in words if not stems.isdisjoint(beginnings(w))][:ROW_WINDOWS]


def samples(rows: list[list[str]], stems: set[str], cut: bool) -> list[bytes]:
    """What a toxic dictionary is trained on: toxic windows by stem, STEM_WINDOWS a stem at most, SAMPLE in one sample.

    `cut`: windows end where their stem does.
    """
    by: dict[str, list[str]] = {s: [] for s in stems}
    for words in rows:
        for w in words:
            stem = max(stems.intersection(beginnings(w)), key=len)
            by[stem].append(stem if cut else w)
    mixed = {s: sorted(some, key=lambda w: (hash_of(w.encode("utf-8", "replace")), w)) for s, some in by.items()}
    evenly = {s: [some[i * len(some) // STEM_WINDOWS] for i in range(STEM_WINDOWS)] if len(some) > STEM_WINDOWS else some for s, some in mixed.items()}
    # Stems in turn: the trainer takes segments from each stretch of its samples, and each is to hold all stems.
    return [_bytes(evenly[s][i : i + SAMPLE]) for i in range(0, STEM_WINDOWS, SAMPLE) for s in sorted(evenly) if i < len(evenly[s])]


def deviations(toxic, ordinary, n_toxic, n_ordinary):
    """By how many standard deviations a stem's share of toxic rows exceeds its share of ordinary rows."""
    p = (toxic + ordinary) / (n_toxic + n_ordinary)
    return (toxic / n_toxic - ordinary / n_ordinary) / (p * (1 - p) * (1 / n_toxic + 1 / n_ordinary) + 1e-12) ** 0.5


def telling(z: dict[str, float], significant: float) -> list[str]:
    """Of the significant stems those that are the most telling among the ones they begin or go on from."""
    good = {s: v for s, v in z.items() if v >= significant}
    longer: dict[str, float] = {}  # how telling the best longer stem is
    for stem, v in good.items():
        for k in range(1, len(stem)):
            longer[stem[:k]] = max(longer.get(stem[:k], 0.0), v)
    return sorted(s for s, v in good.items() if v > longer.get(s, 0.0) and v >= max((good.get(s[:k], 0.0) for k in range(1, len(s))), default=0.0))


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes | None:
    """A dictionary trained by zstandard; None where it refuses, as it does where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return None


def coder(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor with `content` as its dictionary, which also matches short stretches."""
    how = zstandard.ZstdCompressionParameters(**MATCHING, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Dictionaries:
    """Differences of compressed lengths, ordinary less toxic in bytes, for each of some pairs (toxic, ordinary)."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = pairs
        self.contents = list(dict.fromkeys(x for pair in pairs for x in pair))
        self.of = [[self.contents.index(x) for x in pair] for pair in pairs]
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(pairs)), np.int16)
        self.coders = None

    def __getstate__(self):
        return self.pairs

    def __setstate__(self, pairs):
        self.__init__(pairs)

    def differences(self, words: list[str]) -> np.ndarray:
        """A row a word, a column a pair; every different word is compressed once with each dictionary."""
        if self.coders is None:
            self.coders = [coder(x) for x in self.contents]
        fresh = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(fresh) > REMEMBER:
            self.place, self.known, fresh = {}, self.known[:0], list(dict.fromkeys(words))
        for i in range(0, len(fresh), 20_000):
            some = fresh[i : i + 20_000]
            inputs = [_window(w) for w in some]
            sizes = np.array([[len(x) for x in c.multi_compress_to_buffer(inputs, threads=0)] for c in self.coders])
            self.place.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            self.known = np.concatenate([self.known, np.stack([sizes[b] - sizes[a] for a, b in self.of], axis=1).astype(np.int16)])
        return self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def counts(differences: np.ndarray) -> np.ndarray:
    """A text's features: for each pair and threshold the logarithm of its windows and of their share, and whether there is any."""
    n = max(1, len(differences))
    hits = np.array([(differences >= t).sum(axis=0) for t in THRESHOLDS], float)
    return np.concatenate([np.log1p(hits), np.log1p(200 * hits / n), hits > 0]).T.ravel()


WIDTH = 3 * len(THRESHOLDS)


def pairs_of(toxic: list[list[bytes]], plain: list[bytes]) -> list[tuple[bytes, bytes]]:
    """A pair for each significance, of which `toxic` has the samples, and form; where training is refused, there is none.

    Where all are (a handful of rows), the samples themselves are one pair of raw dictionaries, with a warning.
    """
    plain = [x for _, x in sorted((hash_of(x), x) for x in plain)]
    half = (len(plain) + 1) // 2
    shared = _trained(SHARED_BYTES, plain[:half], 48, 8) or b"".join(plain[:half])[-SHARED_BYTES:]
    ordinary = {size: _trained(size, plain[half:], 48, 8) for size, _ in FORMS}
    out = []
    for some in toxic:
        for size, k in FORMS:
            own = _trained(size, some, k, 6)
            if own and ordinary[size]:
                out.append((shared + own + CARRIER, shared + ordinary[size][-len(own) :] + CARRIER))
    if not out:
        warnings.warn("too few toxic windows for zstandard's trainer: they are taken as a raw dictionary", stacklevel=2)
        size = FORMS[0][0]
        own = b"".join(toxic[0])[-size:]
        out = [(shared + own + CARRIER, shared + b"".join(plain[half:])[-len(own) :] * bool(own) + CARRIER)]
    return list(dict.fromkeys(out))


def hash_of(x: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x, 2)


class Model:
    """Pairs of dictionaries and the logistic function of a text's counts."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], x: np.ndarray, y: np.ndarray):
        """`x`: features of the calibration rows, WIDTH a pair; `y`: their labels."""
        parts = [x[:, i * WIDTH : (i + 1) * WIDTH] for i in range(len(pairs))]
        order: list[int] = []
        for _ in range(min(BEST, len(pairs))):  # the one that helps most beside those chosen
            left = [i for i in range(len(pairs)) if i not in order]
            order.append(min(left, key=lambda i: self._fit(np.hstack([parts[j] for j in [*order, i]]), y)))
        self.cost = self._fit(np.hstack([parts[i] for i in order]), y)
        self.dictionaries = Dictionaries([pairs[i] for i in order])

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> float:
        """Newton steps for a logistic regression, each label weighing as it occurs; then the offset
        is set so that 0.5 parts the calibration rows at the least cost, labels weighing alike and a
        false alarm FALSE_ALARM times a miss. Returns that cost."""
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([(x - self.mean) / self.sd, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * w)
        self.w = w
        margin = np.sort(np.unique(z @ w))
        cuts = np.concatenate([[margin[0] - 1], (margin[1:] + margin[:-1]) / 2, [margin[-1] + 1]])
        got = z @ w
        pos, neg = np.sort(got[y == 1]), np.sort(got[y == 0])
        wrong = np.searchsorted(pos, cuts) / max(1, len(pos)) + FALSE_ALARM * (1 - np.searchsorted(neg, cuts) / max(1, len(neg)))
        self.w[-1] -= cuts[int(wrong.argmin())]
        return float(wrong.min())

    def score(self, texts: list[str | None]) -> np.ndarray:
        words = [windows(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        every = self.dictionaries.differences([w for one in words for w in one])
        x = np.array([counts(d) for d in np.split(every, ends[:-1])]) if texts else np.zeros((0, len(self.mean)))
        z = (x - self.mean) / self.sd @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(rows: list[tuple[list[str], int, bool]]) -> Model:
    """The model of rows (words, toxic, whether it trains) that are at hand; what `learn` does on executors."""
    n = [max(1, sum(1 for _, t, train in rows if train and t == side)) for side in (0, 1)]
    by = [Counter(s for words, t, train in rows if train and t == side for s in stems_of(words)) for side in (0, 1)]
    z = {s: deviations(a, by[0][s], n[1], n[0]) for s, a in by[1].items() if a >= LEAST_ROWS}
    stems = {sig: set(telling(z, sig)) for sig in SIGNIFICANT}
    toxic = [samples([selected(words, some) for words, t, train in rows if train and t], some, cut) for some in stems.values() for cut in (False, True)]
    pairs = pairs_of(toxic, [x for words, t, train in rows if train and not t for x in stretches(words)])
    every = Dictionaries(pairs)
    left = [(words, t) for words, t, train in rows if not train] if len({t for _, t, train in rows if not train}) == 2 else [(words, t) for words, t, _ in rows]
    return Model(pairs, np.array([counts(every.differences(words)) for words, _ in left]), np.array([t for _, t in left], float))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """From at most `rows` toxic and 2 * `rows` ordinary labelled rows, none held out, in the order of a hash.

    An id labelled more than once is toxic if any of its labels is. Of an id's repeated rows the
    one of the smallest hash counts. None where either label is missing. Where the rows that
    calibrate lack a label, all rows calibrate. The order of rows has no part in anything.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    sides = [known.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(rows if t else 2 * rows) for t in (0, 1)]
    ids = F.broadcast(sides[0].unionByName(sides[1]).withColumnRenamed("doc_id", "id"))  # 3 * rows at most
    some = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(ids, F.col("doc_id") == F.col("id"))
    train = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(PARTS)) < TRAIN
    some = some.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("train", train)
    with passing(docs.sparkSession):
        return _learnt(small_batches(stored(some, "toxicity-sample")))


def _learnt(some: DataFrame) -> Model | None:
    """From (id, toxic, text, train)."""
    n = {(r["train"], r["toxic"]): r["count"] for r in some.groupBy("train", "toxic").count().collect()}
    if len({t for _, t in n}) < 2:
        return None

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                found = pa.array(sorted(stems_of(windows(text.as_py()))), pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(found), toxic.as_py(), np.int32))], ["stem", "toxic"])

    trains, n0, n1 = some.where("train"), max(1, n.get((True, 0), 0)), max(1, n.get((True, 1), 0))
    by = trains.select("toxic", "text").mapInArrow(stems, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    z = deviations(F.col("a").cast("double"), F.col("b").cast("double"), n1, n0)
    by = by.where(F.col("a") >= LEAST_ROWS).withColumn("z", z).where(F.col("z") >= min(SIGNIFICANT)).orderBy(F.desc("z"), "stem").limit(STEMS)
    z = {r["stem"]: deviations(float(r["a"]), float(r["b"]), n1, n0) for r in by.collect()}
    of = {sig: set(telling(z, sig)) for sig in SIGNIFICANT}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place among the significances, a row's toxic windows) of toxic rows, (-1, stretches) of ordinary ones."""
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                words = windows(text.as_py())
                made = [(i, [w.encode("utf-8", "replace") for w in selected(words, stems)]) for i, stems in enumerate(of.values())] if toxic.as_py() else [(-1, stretches(words))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array([x for _, x in made], pa.list_(pa.binary()))], ["side", "given"])

    given = trains.select("toxic", "text").mapInArrow(give, "side int, given array<binary>").collect()  # bounded by ROW_WINDOWS and ROW_STRETCHES a row
    toxic = [samples([[bytes(x).decode() for x in r["given"]] for r in given if r["side"] == i], stems, cut) for i, stems in enumerate(of.values()) for cut in (False, True)]
    pairs = pairs_of(toxic, [bytes(x) for r in given if r["side"] < 0 for x in r["given"]])
    every = Dictionaries(pairs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [counts(every.differences(windows(t))).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    left = some.where("not train") if {t for train, t in n if not train} == {0, 1} else some
    got = sorted((tuple(r["x"]), r["toxic"]) for r in left.select("toxic", "text").mapInArrow(judge, "toxic int, x array<double>").collect())  # numbers, WIDTH a pair
    return Model(pairs, np.array([x for x, _ in got]), np.array([t for _, t in got], float))


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts are texts without windows and get the score of such; where there
    was nothing to learn from, every score is 0. Repeated rows get the same score. An
    empty table gives an empty result. Labels, language, source and id take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                scores = np.zeros(len(texts)) if model is None else model.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op2_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    found = score_toxicity(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

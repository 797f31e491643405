"""Language identification in two levels: the family first, then the language in it.

Both levels are linear support vector machines over hashed byte n-grams. Families of
several languages are settled among them one against one, by votes and then margins.

Learning takes rows with a language whose id isn't held out, LEARN_ROWS different texts a
language at most: those whose hash falls under a threshold that the language's count of
different texts gives. A language with a third of all rows costs no more than another, and a
text with many copies counts once. Features are taken on the executors, so the driver gets
24 KB a row at most, however long the texts. Everything else reads every text in whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, release_memory, small_batches

#: Rows a language is learned from, at most, and all of them; languages, the most frequent ones.
LEARN_ROWS, LEARN_ALL, LANGUAGES = 600, 12_000, 200
#: Buckets of hashed n-grams.
DIM = 4_096
#: Families of languages (ISO 639-1). Another code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
    "semitic": "am ar he mt".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "uralic": "et fi hu".split(),
}
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")
_rng = np.random.Generator(np.random.PCG64(7))
_MIX = [_rng.integers(0, 2**31, 256, dtype=np.uint32) | np.uint32(1) for _ in range(3)]


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in langs), f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """A row a text: square roots of the shares of its hashed byte bigrams and trigrams.

    A-Z are lower-cased; ASCII digits, signs and white space all count as one space. Each
    row has length 1, or 0 for texts under two bytes.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(texts), DIM), np.float32)
    for i in range(len(texts)):
        counts = np.zeros(DIM, np.int64)
        # A long text is counted in pieces that overlap by the two bytes a trigram needs.
        for a in range(offsets[i], offsets[i + 1], 1 << 20):
            piece = data[a : min(a + (1 << 20) + 2, offsets[i + 1])]
            low = np.where((piece >= 65) & (piece <= 90), piece + 32, piece)
            low = np.where((low < 97) | ((low > 122) & (low < 128)), 32, low).astype(np.uint8)
            if len(low) >= 2:
                two = _MIX[0][low[:-1]] ^ (_MIX[1][low[1:]] << np.uint32(1))
                counts += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
                if len(low) >= 3:
                    three = two[:-1] * np.uint32(31) ^ _MIX[2][low[2:]]
                    counts += np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        total = counts.sum()
        if total:
            out[i] = np.sqrt(counts / total)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, y being -1 or 1, or 0 for rows that don't count.

    The classes weigh alike. Accelerated gradient steps from zero, so runs repeat. The rows
    aren't copied, as the driver holds them.
    """
    n = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    pw, pb, rate = w, b, 1 / (1 / c + 4)
    for t in range(steps):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        short = np.maximum(0, 1 - y * (x @ vw + vb)) * y * n
        pw, pb = w, b
        w, b = vw + rate * (2 * (short @ x) - vw / c), vb + rate * 2 * short.sum()
    return w, float(b)


class Model:
    """families: names; langs: family -> languages; pairs: (family, i, j) -> column of the weights."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families = sorted({family(k) for k in langs})
        self.langs = {f: sorted({k for k in langs if family(k) == f}) for f in self.families}
        own, fam = np.array(langs), np.array([family(k) for k in langs])
        self.columns, weights, offsets = [], [], []
        jobs = [("", a, b, fam == a, fam == b) for i, a in enumerate(self.families) for b in self.families[i + 1 :]]
        jobs += [(f, a, b, own == a, own == b) for f in self.families for i, a in enumerate(self.langs[f]) for b in self.langs[f][i + 1 :]]
        for f, a, b, is_a, is_b in jobs:
            w, off = train_svm(x, is_a.astype(np.float32) - is_b.astype(np.float32))
            self.columns.append((f, a, b))
            weights.append(w)
            offsets.append(off)
        self.weights = np.array(weights, np.float32).reshape(len(weights), DIM).T
        self.offsets = np.array(offsets, np.float32)

    def _pick(self, group: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By votes, then summed margins: the winner's number and its least margin over another."""
        votes, sums = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        least = np.full((len(margins), len(names)), np.inf)
        for k, (g, a, b) in enumerate(self.columns):
            if g == group and a in names:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                for at, v in ((i, m), (j, -m)):
                    votes[:, at] += v > 0
                    sums[:, at] += np.clip(v, -1, 1)
                    least[:, at] = np.minimum(least[:, at], v)
        won = (votes + sums / (2 * len(names) + 1)).argmax(axis=1)
        return won, least[np.arange(len(margins)), won]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the logistic of the least margin at either level."""
        margins = x @ self.weights + self.offsets
        which, sure = self._pick("", self.families, margins)
        names = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            at = np.flatnonzero(which == i)
            if len(at):
                won, m = self._pick(f, self.langs[f], margins[at])
                names[at] = np.array(self.langs[f], object)[won]
                sure[at] = np.minimum(sure[at], m)
        return list(names), 1 / (1 + np.exp(-3 * np.clip(sure, -10, 10)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, places, values) of (lang, h, text): the features that aren't zero."""
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            x = features(batch.column(2))
            rows = [np.flatnonzero(r) for r in x]
            places = pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary())
            values = pa.array([v[r].tobytes() for v, r in zip(x, rows, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, values], ["lang", "h", "places", "values"])


def learn(docs: DataFrame, rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """None where no row has a language. Held-out rows, null texts and null languages aren't read.

    Of each language at most `rows` texts are drawn, and of all at most LEARN_ALL; beyond
    LANGUAGES different values of `lang` the rarest ones aren't learnt.
    """
    known = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), docs[id_col].alias("doc_id"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h"))
    counted = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counted:
        return None
    rows = min(rows, LEARN_ALL // len(counted))
    share = F.create_map(*[F.lit(v) for r in counted for v in (r["lang"], min(1.0, 1.2 * rows / max(1, r["n"])))])
    drawn = known.where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    # Copies of a text become one before they are moved; what is left of a language is about 1.2 * rows.
    once = drawn.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = once.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "text")
    some = small_batches(few).mapInArrow(_sparse, "lang string, h long, places binary, values binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    x = np.zeros((some.num_rows, DIM), np.float32)
    for i, (places, values) in enumerate(zip(some["places"], some["values"], strict=True)):
        x[i, np.frombuffer(places.as_buffer(), np.uint16)] = np.frombuffer(values.as_buffer(), np.float32)
    langs = some["lang"].to_pylist()
    del some
    model = Model(x, langs)
    del x
    release_memory()
    return model


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace") if c > "\x7f")


def predict_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, lang_pred, score.

    `und` with score 0 for null texts, texts without a letter, and all texts where there
    was nothing to learn from. Repeated rows get the same answer. An empty table gives an
    empty result. Language, source and id take no part in a prediction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1)
                if model is None:
                    names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
                else:
                    names, scores = model.predict(features(texts))
                    raw = texts.cast(pa.large_binary())
                    for i in range(len(batch)):
                        text = raw[i].as_py()
                        if text is None or not has_letter(text):
                            names[i], scores[i] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.asarray(scores, np.float64))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def drop_unknown(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a language, with its columns, in one pass over them.

    Null texts and texts without a letter go. Where there was nothing to learn from, the
    others stay.
    """
    if model is None:
        model = learn(docs, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keep = batch.column(at).cast(pa.large_binary()), []
            for k in range(0, len(batch), 512):
                some = raw.slice(k, 512)
                names = model.predict(features(some))[0] if model else [""] * len(some)
                keep += [t is not None and has_letter(t) and name != UNKNOWN for t, name in zip(some.to_pylist(), names, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        release_memory()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_languages(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

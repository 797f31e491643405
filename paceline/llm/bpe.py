"""Byte-pair encoding over a trie of distinct words, and decoding.

A batch's distinct words are sorted, which is the depth-first order of their trie. Along
each path the state of a prefix is its encoding's last token and the place of the state
before it: the encoding of a prefix ends in the one vocabulary token that is a suffix of
it and that may follow the last token of what remains. So each shared prefix is encoded
once, words cost a step a byte whatever their length, and a word's ids are read off by
walking its states back.

Two tokens may follow each other when the merges, run over the bytes of both, give back
these two. Adjacent pairs decide for whole sequences, and the answers are remembered.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, worker_cache

#: Repeated words whose ids a worker remembers, and token pairs; new words, a third of it.
REMEMBER = 100_000
#: Characters of a text that are cut into words in one go.
PIECE = 1 << 22

#: Fixed value: how byte-level BPE cuts a text into words.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizers file of the byte-level kind holds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normalizer is asked for")
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        spell = lambda token: self.ids[bytes(letters[c] for c in token)]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((spell(a), spell(b)), (r, spell(a + b)))


class Encoder:
    """Encodes and decodes texts; remembers the words that it meets again."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.often: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.special = {t: i.to_bytes(4, "little") for t, i in vocabulary.special.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        marks = sorted(self.v.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        automaton = ahocorasick.Automaton()
        for spelled, i in vocabulary.ids.items():
            automaton.add_word(spelled.decode("latin-1"), (i, len(spelled)))
        automaton.make_automaton()
        self.suffixes = automaton.iter
        size = max(self.v.bytes) + 1
        self.table = [self.v.bytes.get(i, b"") for i in range(size)]

    def merge(self, text: bytes) -> tuple[list[int], list[tuple[int, int, int, int]]]:
        """The merges as they are defined, lowest rank and then leftmost first: the tokens, and (rank, left, right, made) of each merge."""
        rank = self.v.rank
        parts, trace = [self.v.ids[text[i : i + 1]] for i in range(len(text))], []
        while len(parts) > 1:
            found = [(rank[p][0], i) for i, p in enumerate(itertools.pairwise(parts)) if p in rank]
            if not found:
                break
            r, i = min(found)
            made = rank[parts[i], parts[i + 1]][1]
            trace.append((r, parts[i], parts[i + 1], made))
            parts[i : i + 2] = [made]
        return parts, trace

    def spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """The token's outermost parts on a side (0 left, 1 right), as (part, rank it is made at, rank it is used up at)."""
        known = self.spines.get((token, side))
        if known is None:
            _, trace = self.merge(self.table[token])
            split = {made: (r, left, right) for r, left, right, made in trace}
            known, part, until = [], token, float("inf")
            while part is not None:
                r, *halves = split.get(part, (-1, None, None))
                known.append((part, r, until))
                part, until = halves[side], r
            self.spines[token, side] = known
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges over the bytes of both give back both.

        They don't if somewhere a part at a's end and one at b's start merge before either
        is used up within its token; of equal ranks, the leftmost comes first.
        """
        known = self.follows.get((a, b))
        if known is None:
            known, rank = True, self.v.rank
            for u, made_u, until_u in self.spine(a, 1):
                for v, made_v, until_v in self.spine(b, 0):
                    if made_u < until_v and made_v < until_u and (u, v) in rank:
                        r = rank[u, v][0]
                        if r < until_u and r <= until_v:
                            known = False
            self.follows[a, b] = known
        return known

    def may_begin(self, a: int) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merge(self.table[a])[0] == [a]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian 32-bit numbers.

        An automaton over the vocabulary lists, for each end in a word, the tokens that end
        there, the longest first.
        """
        follows, may_follow, may_begin, suffixes = self.follows, self.may_follow, self.may_begin, self.suffixes
        made: dict[str, bytes] = {}
        last, back, before = [0], [0], b""  # states of the current path: last token, length before it
        for word in sorted(words):  # by code point, which is the order of their bytes too
            spelled = word.encode("utf-8", "replace")
            shared, most = 0, min(len(before), len(spelled))
            while shared < most and before[shared] == spelled[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            done = shared - 1  # the last place whose state is known
            for end, (token, size) in suffixes(spelled.decode("latin-1")):
                if end > done:
                    start = end + 1 - size
                    if start:
                        pair = last[start], token
                        fits = follows[pair] if pair in follows else may_follow(*pair)
                    else:
                        fits = may_begin(token)
                    if fits:
                        last.append(token)
                        back.append(start)
                        done = end
            before, out, at = spelled, [], len(spelled)
            while at:
                out.append(last[at])
                at = back[at]
            out.reverse()
            made[word] = array("I", out).tobytes()
        return made

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """A text's words, in lists; special tokens are cut out first."""
        for part in self.split.split(text) if self.split and "<" in text else [text]:
            if part in self.v.special:
                yield [part]
            elif len(part) <= PIECE:
                yield _CUT.findall(part)
            else:
                found = (m[0] for m in _CUT.finditer(part))
                while some := list(itertools.islice(found, 1 << 18)):
                    yield some

    def _look_up(self, words: set[str]) -> dict[str, bytes]:
        """The ids of these words. A word that is met again is remembered for long, a new one for a while."""
        now, fresh, often, once = {}, [], self.often, self.once
        for w in words:
            ids = often.get(w)
            if ids is None:
                ids = once.pop(w, None)
                if ids is None:
                    fresh.append(w)
                    continue
                often[w] = ids
            now[w] = ids
        made = self.encode_words(fresh)
        now.update(made)
        if len(once) + len(made) > REMEMBER // 3:
            once.clear()
        once.update(made)
        if len(often) > REMEMBER:
            often.clear()
        if len(self.follows) > REMEMBER:
            self.follows.clear()
        return now

    def _join(self, piece: list[str], known: dict[str, bytes]) -> bytes:
        return self.special[piece[0]] if len(piece) == 1 and piece[0] in self.special else b"".join([known[w] for w in piece])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        out = [b""] * len(texts)
        short = [(i, list(self._pieces(t))) for i, t in enumerate(texts) if len(t) <= PIECE]
        known = self._look_up({w for _, pieces in short for p in pieces for w in p} - self.special.keys())
        for i, pieces in short:
            out[i] = b"".join([self._join(p, known) for p in pieces])
        for i, text in enumerate(texts):
            if len(text) > PIECE:  # in pieces, so that no list holds all of its words
                out[i] = b"".join([self._join(p, self._look_up(set(p) - self.special.keys())) for p in self._pieces(text)])
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        table = self.table
        return b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python process: what one task remembers serves the next."""
    kept = worker_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(Vocabulary(path))
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `keep_ids`, ids.

    Null counts as the empty text, which has no tokens. A special token's string in a
    text becomes its id and decodes to itself. Repeated rows are encoded alike; an empty
    table gives an empty result; further columns are not read. `path` is a tokenizers
    file that every executor can read, by default the public byte-level one.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                of_ids = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                of_text = pa.array([hashlib.sha256(encoder.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids], pa.string())
                columns = [batch.column(0), sizes, of_ids, of_text]
                if keep_ids:
                    columns.append(pa.array([memoryview(x).cast("i") for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids count as none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            texts = [encoder.decode(b"".join(i.to_bytes(4, "little") for i in ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return small_batches(encoded.select(encoded[id_col].alias("doc_id"), F.col(ids_col).alias("ids"))).mapInArrow(run, f"doc_id {kind}, text string")


def op4_bpe(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)

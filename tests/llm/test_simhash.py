"""Fingerprints against a plain count of bits, components against all pairs."""

import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paceline.llm import simhash as S

from . import conftest


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    """Components over all pairs of distinct fingerprints."""
    fps = np.array(sorted(set(prints)), np.uint64)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
    at = {int(f): int(r) for f, r in zip(fps, root, strict=True)}
    least = {}
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            least[at[f]] = min(i, least.get(at[f], i))
    return [least.get(at[f]) for f in prints]


@pytest.mark.parametrize("radius", range(5))
def test_a_cover_separates_no_pair_within_the_radius(radius):
    for bits in (list(range(12)), [1, 5, 9, 20, 33, 63, 7], [3]):
        masks = S.cover(bits, radius)
        for gone in itertools.combinations(bits, min(radius, len(bits))):
            assert any(not any(m >> b & 1 for b in gone) for m in masks)


def test_all_triples_of_64_bits_are_covered_and_parts_get_short():
    masks = S.covers(0)
    assert len(masks) == 15 and all(30 <= m.bit_count() <= 36 for m in masks)
    for gone in itertools.combinations(range(64), 3):
        assert any(not m & sum(1 << b for b in gone) for m in masks)
    third = {c for m in masks for b in S.covers(m) for c in S.covers(b)}
    assert max(64 - m.bit_count() for m in third) <= 8 and 2**8 <= S.SMALL


def test_fingerprints(spark):
    texts = conftest.awkward_texts() + ["a b", "A B", "x\u00a0y z\u2028w v", "one\x0btwo\x0cthree four", "a a a a a a"]
    for t in texts:
        assert S.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t), t
    one = S.simhash_classes(spark.createDataFrame([(1, "Some words HERE")], "doc_id long, text string")).first()
    spark_hash = spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit("some words here")))).alias("h")).first().h
    assert one.fingerprint == spark_hash.zfill(16)


def test_a_text_in_pieces(monkeypatch):
    text = conftest.prose(random.Random(1), 5000)
    want = S.fingerprint(text.encode())
    for piece, shingles in ((1, 7), (100, 3), (4096, 1 << 16)):
        monkeypatch.setattr(S, "PIECE", piece)
        monkeypatch.setattr(S, "SHINGLES", shingles)
        assert S.fingerprint(text.encode()) == want == plain_fingerprint(text)


def test_awkward_documents(spark, awkward, empty):
    got = S.simhash_classes(awkward).collect()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(ids, prints, plain_components(ids, prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert S.simhash_classes(empty).count() == 0


def test_clashing_names_null_and_repeated_ids(spark, clashing):
    got = sorted(((r.doc_id, r.component_id, r.n_same) for r in S.simhash_classes(clashing).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (2, 2, 1), (None, None, 1)], key=str)


def clouds(seed, many):
    """Fingerprints in clouds round a few centres, far more of them than a short bucket holds, and lone ones."""
    rng, out = random.Random(seed), set()
    for k, n in enumerate(many):
        centre = rng.getrandbits(64)
        for _ in range(n):
            f = centre
            for b in rng.sample(range(64), rng.randrange(0, 3 + 3 * (k % 3))):
                f ^= 1 << b
            out.add(f)
    out |= {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63, 1}
    return sorted(out)


def apart(n, seed=4):
    """Fingerprints in one bucket of the first table, no two of them within 3 bits: words of a code of distance 4."""
    hidden = [b for b in range(64) if not S.covers(0)[0] >> b & 1][:30]
    odd = sorted((c for c in range(64) if c.bit_count() % 2), key=lambda c: (c.bit_count() > 1, c))[: len(hidden)]
    rng, out = random.Random(seed), set()
    while len(out) < n:
        chosen = [i for i in range(6, len(hidden)) if rng.random() < 0.5]
        check = 0
        for i in chosen:
            check ^= odd[i]
        chosen += [i for i in range(6) if check & odd[i]]
        out.add(sum(1 << hidden[i] for i in chosen))
    return sorted(out)


@pytest.mark.parametrize("case", ["clouds", "small clouds", "apart", "apart but for some"])
def test_components_against_all_pairs(spark, case):
    fps = {"clouds": lambda: clouds(1, [500, 1500, 1200]), "small clouds": lambda: clouds(3, [30, 40])}.get(case, lambda: apart(2000))()
    if case == "apart but for some":
        fps = sorted({*fps, *(f ^ 7 << i % 60 for i, f in enumerate(fps[:50])), *(f ^ 1 << 63 for f in fps[100:120])})
    if case == "apart":
        assert len(set(plain_components(fps, fps))) == len(fps)
    nodes = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long").repartition(6)
    made = S._labels(nodes, 3)
    labels = {r.node % 2**64: r.label % 2**64 for r in made.collect()} if made else {}
    got = {}
    for f in fps:
        got.setdefault(labels.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(fps, plain_components(fps, fps), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_query_against_all_pairs(spark):
    from paceline.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids, prints = [r.doc_id for r in docs], [plain_fingerprint(r.text) for r in docs]
    want = dict(zip(ids, zip([f"{f:016x}" for f in prints], plain_components(ids, prints), strict=True), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want

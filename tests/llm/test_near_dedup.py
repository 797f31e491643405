import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paceline.llm import near_dedup as N
from paceline.llm.graph import components
from paceline.llm.shingles import shingle_sets


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(sets):
        least[root(n)].append(i)
    return {i: (len(s), min(least[root(n)]), i == min(least[root(n)])) for n, (i, s) in enumerate(sets)}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(N.near_classes(awkward)) == brute(rows)


@pytest.mark.parametrize("block", [4, 1000])
def test_chains_within_a_hot_bucket(spark, monkeypatch, block):
    """Members that link to few others, in blocks of any size."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(90)], []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(90)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert found(N.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edge_cases(empty, clashing):
    assert N.near_classes(empty).count() == 0
    got = [(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in N.near_classes(clashing).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True, 1), (1, 1, True, 1), (None, 1, False, 1), (2, 2, True, 1), (None, None, True, 0)], key=str)
    kept = N.drop_near_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == 4  # the null id stays with both of its texts


def test_shingle_sets_count_what_texts_hold():
    texts = ["A b  c\td e f a b c d e f", None, "", " \n", "one", "One", "one two", "two one", "é É", "x " * 400_000 + "y"]
    got = list(shingle_sets(pa.array(texts)))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert got[4].tolist() == got[5].tolist() and got[6].tolist() != got[7].tolist()


def test_estimates_correct_for_chance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)
    b[:500] = a[:500]
    fields = lambda s: np.array([(int(w) & (2**64 - 1)) >> (2 * k) & 3 for w in s for k in range(32)])
    same = (fields(N.signature(np.unique(a))[1]) == fields(N.signature(np.unique(b))[1])).sum()
    assert abs(N.estimate(same) - 1 / 3) < 0.2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_blocks_of_a_hot_bucket_have_tasks_of_their_own(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(N, "stored", lambda df, name: kept.setdefault(name, df))
    n = 9 * N.BLOCK // 2
    members = spark.range(n).selectExpr("0 as band", "7L as key", "id as node")
    nodes = spark.range(n).selectExpr("id as node", "10 as n_shingles", "array(0L) as bands", "array(0L) as packed")
    sets, labels = spark.range(n).selectExpr("id as node", "array(id) as hashes"), spark.createDataFrame([], "node long, label long")
    N._link_rest(members, nodes, sets, labels, 85)
    cells = kept["cells"].select("task", "cell").distinct().collect()
    assert len(cells) == 15 and len({r.task for r in cells}) == 15


def test_long_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    hashes = [next(shingle_sets(pa.array([w]))).tolist() for w in (one, two)]
    assert hashes[0] != hashes[1]
    rows = [(1, one), (2, two), (3, f"{one} b c d e"), (4, f"{two} b c d e")]
    assert found(N.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_ids_of_other_types(spark):
    rows = [("x1", "a b c d e f g"), ("x10", "A b c d e f g"), ("b", "other words are in here now"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_classes(docs).collect()}
    assert got == {"x1": ("x1", True), "x10": ("x1", False), "b": ("b", True), None: ("x1", False)}
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == ["b", "x1"]


def test_a_hot_bucket_of_unlinked_members_is_not_compared_in_whole(spark):
    """Members share four fifths of their shingles, so bands meet; by rare shingles only the linked ones do."""
    n, core = 200, list(range(1, 81))
    sets = {i: core + [1000 + 20 * i + k for k in range(20)] for i in range(n)}
    for i in range(0, n, 50):  # linked with the next one
        sets[i + 1] = sets[i][:-2] + [900_000 + 2 * i, 900_001 + 2 * i]
    of = spark.createDataFrame([(0, 7, i, i, 100, True) for i in range(n)], "band int, key long, node long, label long, n_shingles long, first boolean")
    parted = N._part(of, spark.createDataFrame([(i, s) for i, s in sets.items()], "node long, hashes array<long>"), 85).collect()
    by_bucket = defaultdict(set)
    for r in parted:
        by_bucket[r.key].add(r.node)
    assert {frozenset(b) for b in by_bucket.values()} == {frozenset((i, i + 1)) for i in range(0, n, 50)}


def test_members_of_any_size_meet_if_they_are_linked(spark):
    rng = random.Random(8)
    base = list(range(100))
    sets = [sorted(set(base[: rng.randrange(85, 101)]) - {rng.randrange(100) for _ in range(rng.randrange(6))} | {500 + rng.randrange(200) for _ in range(rng.randrange(8))}) for _ in range(80)]
    of = spark.createDataFrame([(0, 7, i, i, len(s), True) for i, s in enumerate(sets)], "band int, key long, node long, label long, n_shingles long, first boolean")
    parted = N._part(of, spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>"), 85).collect()
    buckets = defaultdict(dict)
    for r in parted:
        buckets[r.key][r.node] = r.first
    met = {(a, b) for m in buckets.values() for a in m for b in m if a < b and (m[a] or m[b])}
    linked = {(a, b) for b in range(80) for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    assert linked and linked <= met

import hashlib
import re
from collections import defaultdict

from paceline.llm import exact_dedup as E


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_against_brute_force(awkward):
    rows = awkward.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    got = {r.doc_id: r for r in E.exact_dedup(awkward, capacity=8).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_collisions_are_compared_by_bytes(spark, monkeypatch):
    """With keys that all collide, texts still only equal themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.chain) for r in E.exact_dedup(docs).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}
    assert sorted({v[2] for v in got.values()}) == [1, 2, 3]


def test_without_broadcast(awkward, monkeypatch):
    want = sorted(map(tuple, E.exact_dedup(awkward).drop("bucket").collect()))
    monkeypatch.setattr(E, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, E.exact_dedup(awkward).drop("bucket").collect())) == want


def test_edge_cases(empty, clashing):
    assert E.exact_dedup(empty).count() == 0
    got = E.exact_dedup(clashing).collect()
    assert sum(r.kept for r in got) == 3  # one of the copies, the other text, the null text
    assert {r.keep_id for r in got if r.group_size == 3} == {1}
    kept = E.drop_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == 3


def test_directory_doubles_only_where_needed():
    counts = {i: (50 if i < 2 else 1) for i in range(16)}
    directory = E.split_buckets(counts, 4, 60)
    assert len(directory) == 16  # the full prefix splits to its end
    names = {b for _, b, _ in directory}
    assert len(names) < 16 and directory[15][1] == directory[8][1]
    assert E.split_buckets({0: 3}, 4, 10) == [(0, 0, 0)]

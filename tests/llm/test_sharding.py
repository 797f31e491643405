from collections import Counter

import pytest

from paceline.llm import sharding as S


def test_table_is_filled_by_turns():
    shards = [f"s{i}" for i in range(7)]
    table = S.fill_table(shards, 101)
    sizes = Counter(table)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for i, s in enumerate(shards):
        offset, step = S.preference(s, 101)
        assert sorted((offset + k * step) % 101 for k in range(101)) == list(range(101))
    # The first shard's first choice is always its own.
    assert table[S.preference(shards[0], 101)[0]] == 0


def test_few_slots_move_when_a_shard_goes():
    shards = list(S.SHARDS)
    before, after = S.fill_table(shards), S.fill_table(shards[:-1])
    lost = sum(b == len(shards) - 1 for b in before)
    moved = sum(b != a for b, a in zip(before, after, strict=True))
    assert lost <= moved < 3 * lost


def test_bad_tables():
    for args in (([], 7), (["a"], 8), (["a", "a"], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            S.fill_table(*args)


def test_placement(spark, tmp_path, empty):
    rows = [(i, "t") for i in range(2000)] + [(5, "again"), (None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as shard")
    placed = S.assign_shards(docs)
    got = placed.collect()
    assert len(got) == 2003 and placed.columns == ["doc_id", "text", "slot", "shard"]
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    table = S.fill_table(list(S.SHARDS))
    assert all(r.shard == S.SHARDS[table[r.slot]] for r in got)
    S.write_shards(docs, str(tmp_path / "out"), S.SHARDS[:3], 101)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3
    assert S.assign_shards(empty).count() == 0


def test_clashing_names(spark):
    names = ["__slot", "__shard", "__at", "slot_at", "slot_of", "shard_of", "SLOT", "a.b"]
    docs = spark.createDataFrame([(i, *[f"{n}{i}" for n in names]) for i in range(50)], ["doc_id", *names])
    placed = S.assign_shards(docs)
    assert placed.columns == ["doc_id", *[n for n in names if n != "SLOT"], "slot", "shard"]
    for r in placed.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n != "SLOT")

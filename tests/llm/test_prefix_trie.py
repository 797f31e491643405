"""The trie against a plain one, built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from paceline.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = {}
    for c, k, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((k is not None, k or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: (x[0], x[1], digest(x[2])))] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], ([], []))[0].append(c)
        nodes[seq][1].append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = sum(saved[k] for k in below) + (len(nodes[n][0]) - 1) * words
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]][0]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for n, (m, e) in nodes.items()
    )


def check(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.prefix_trie(df.repartition(partitions) if partitions else df)
    assert got.columns == COLUMNS
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_random_conversations(spark):
    rng, rows = random.Random(5), []
    for c in rng.sample(range(400), 150):
        for k in range(rng.randrange(1, 8)):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["hi there", "yes", "", "a b  c\u00a0d", "\t"])))
    check(spark, rows)


def test_long_shared_beginnings_take_few_rounds(spark, monkeypatch):
    same = [("user", f"turn {i}") for i in range(150)]
    rows = [(20 * c, k, *t) for c in range(4) for k, t in enumerate(same[: 150 - 20 * c] + [("user", f"end {c}")] * (c % 3))]
    rounds = []
    monkeypatch.setattr(P, "stored", lambda df, label, f=P.stored: (rounds.append(label), f(df, label))[1])
    check(spark, rows)
    assert rounds.count("trie-classes") <= 6  # 4 + 8 + 16 + 32 + 64 + 64


def test_one_conversation_with_most_turns_and_many_copies(spark):
    rows = [(7, k, "user", f"w{k % 11} x") for k in range(3000)] + [(20 * c, k, "user", f"copy {k}") for c in range(300) for k in range(5)]
    check(spark, rows, 9)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, 5, None, "x"), (None, 1, "user", "nobody"), (40, 1, "u", "only"), (41, 1, "u", "only"),
        (20, 3, "", "1:ab"), (21, 3, "1:a", "b"), (23, 1, "user", "y " * 100_000), (60, 0, "u", "a"),
    ]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 1, "user", "x")], [(3, 1, "u", "x"), (6, 1, "u", "x")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_clashing_columns(spark):
    rows = [(c, k, "user", f"t{k}", 1, "p", 2) for c in (0, 20, 40) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA + ", rep int, t string, pos int")
    assert sorted(map(tuple, P.prefix_trie(df).collect())) == sorted(plain([r[:4] for r in rows]))


def test_pieces_of_many_ids(spark, monkeypatch):
    ids = list(range(0, 20 * 30_000, 20))
    df = spark.createDataFrame([(i, i, 0, len(ids), 1, 0) for i in ids], "conv_id long, row long, rep long, m long, n_turns long, total long").select("conv_id", "rep", "m", "n_turns", "total")
    (got,) = P.ends(df.repartition(8)).collect()
    assert got.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

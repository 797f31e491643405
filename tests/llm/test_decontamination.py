import re

from paceline.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for gram, ids in grams.items():
            for k in range(len(w) - len(gram) + 1):
                if tuple(w[k : k + len(gram)]) == gram:
                    hit |= set(range(k, k + len(gram)))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def fixture(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    items = [(1, passage), (2, "Short one"), (3, None), (4, ""), (5, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"), (10, "solo"), (6, "!!")]
    docs = [
        (1, "x " + passage.upper().replace(" ", ", ") + " y"), (2, "p0 p1 p2 p3 p4"), (3, "a short ONE; short one. solo"), (4, None), (5, ""), (6, passage + " " + passage), (7, "soloist"),
        (8, "é" + " " + " ".join(f"p{i}" for i in range(2, 14))), (9, "w " * 5000 + passage), (9, "w"), (None, "solo"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_against_brute_force(spark):
    docs, bench, d, i = fixture(spark)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.find_contamination(docs, bench).collect()], key=str)
    assert got == brute(d, i)
    # The same beyond the bound of the broadcast.
    far = D.find_contamination(docs, bench, broadcast_windows=0)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in far.collect()], key=str) == got


def test_full_windows_only(spark):
    docs, bench, d, i = fixture(spark)
    bench, i = bench.where("item_id in (1, 5)"), [x for x in i if x[0] in (1, 5)]
    got = sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.find_contamination(docs, bench).collect()], key=str)
    assert got == brute(d, i)


def test_edge_cases(spark, empty, clashing):
    _, bench, _, _ = fixture(spark)
    assert D.find_contamination(empty, bench).count() == 0
    none = D.find_contamination(clashing, bench.limit(0)).collect()
    assert len(none) == 5 and all(r.n_hit == 0 for r in none)
    hit = spark.createDataFrame([(9, "other words in this text")], "item_id long, text string")
    kept = D.drop_contaminated(clashing, hit)
    assert kept.columns == clashing.columns and kept.count() == 4
    spans = D.find_contamination(clashing, hit).where("n_hit > 0").first().spans
    assert [(s["at"], s["end"]) for s in spans] == [(0, 5)]


def test_cutting_spans(spark):
    docs, bench, d, i = fixture(spark)
    cut = D.cut_contaminated(docs, bench)
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    passage = " ".join(f"p{i}" for i in range(15))
    want = {1: "x y", 2: "p0 p1 p2 p3 p4", 3: "a ", 4: None, 5: "", 6: "", 7: "soloist", 8: "é ", None: ""}
    assert [g for g in got if g[0] != 9] == sorted(want.items(), key=str) and passage not in str(got)
    assert sorted(len(t) for k, t in got if k == 9) == [1, 10000] and cut.columns == docs.columns
    assert all(r.n_hit == 0 for r in D.find_contamination(cut, bench).collect())

"""Cases that several operators share: empty tables, names that clash, hot texts, what is left behind."""

import os
import random

import corpus_pipeline
import pytest

from paceline.llm import common, decontamination, exact_dedup, html_text, language_id, licenses, near_dedup, toxicity

from . import conftest


def test_pipeline_over_an_empty_table(spark, tmp_path, empty):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "p1 p2 p3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_without_languages(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "123", None), (3, "hello there", None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.drop_unknown(docs).collect()) == [3, 4]


def test_a_hot_text_pushes_no_language_out(spark):
    rng = random.Random(2)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(n))
    rows = [(i, make(["sch", "ung", "der"], 20), "de") for i in range(60)] + [(100 + i, make(["eau", "oi", "ê"], 20), "fr") for i in range(60)]
    rows += [(1000 + i, "the same text", "en") for i in range(2000)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    assert {k for langs in model.langs.values() for k in langs} == {"de", "en", "fr"}


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that are named like the operators' own, and ids that repeat."""
    text = "one two three four five six seven eight nine ten eleven"
    names = "gone_id long, kept_id long, kept_sha string, text_mark string, words_ string, signs_ string, spans_ string, hit_id long, row long, at long"
    rest = (7, 7, "s", "m", "w", "g", "p", 7, 1, 2)
    rows = [(1, text, *rest), (1, text, *rest), (2, text + " ", *rest), (3, "other words", *rest), (None, None, *rest), (None, None, *rest)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}")


def test_names_that_clash(spark, odd):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    ids = lambda df: sorted((str(r.doc_id) for r in df.collect()))
    made = {
        "exact": (exact_dedup.drop_copies(odd), ["1", "2", "3", "None"]),
        "near": (near_dedup.drop_near_copies(odd), ["1", "3", "None"]),
        "drop": (decontamination.drop_contaminated(odd, bench), ["3", "None", "None"]),
        "cut": (decontamination.cut_contaminated(odd, bench), ["1", "1", "2", "3", "None", "None"]),
    }
    for name, (df, want) in made.items():
        assert df.columns == odd.columns and ids(df) == want, name
    assert {r.text for r in made["cut"][0].collect()} == {"one ", "other words", None}


def test_toxicity_beside_other_columns(spark, odd):
    rows = [(["good", "plain", "text", "here"], 0, True)] * 8 + [(["vile", "nasty", "text", "here"], 1, True)] * 8
    got = toxicity.score_toxicity(odd, toxicity.fitted(rows)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)


def test_licenses_in_a_very_long_text(spark):
    notice = next(t for name, t in licenses.TEMPLATES if name == "MIT")
    text = "word " * 200_000 + notice + " word" * 200_000 + " " + notice
    names = [m.license for m in licenses.Scanner().scan(text)[1]]
    assert names.count("MIT") == 2


def test_what_passing_blocks_leave(spark, tmp_path, awkward):
    folder = lambda: {f for f in os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/paceline") if "near" in f or "sets" in f or "members" in f}
    before = folder()
    near_dedup.drop_near_copies(awkward.limit(30)).count()
    assert {f.split("-")[0] for f in folder() - before} == {"near"}
    with common.passing(spark) as keep:
        one, two = common.stored(awkward, "a"), keep(common.stored(awkward, "b"))
    assert not os.path.exists(one.stored_at) and os.path.exists(two.stored_at)


#: Pages written by hand, with the article's blocks.
PAGES = {
    "news": (
        """<!DOCTYPE html><html><head><title>Bridge reopens - The Courier</title><script>var a = "<p>no</p>";</script></head><body>
        <div id="cookie-banner" class="consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
        <header class="site-header"><a href="/">The Courier</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
        <main><article><h1>Old bridge reopens after two years</h1>
        <p>The stone bridge over the river opened to traffic again on Monday, two years after a flood damaged its central arch.</p>
        <div class="ad">Save 20 % on tyres this week only!</div>
        <p>Engineers replaced 140 blocks &amp; rebuilt the eastern parapet, the council said. <a href="/x">An earlier report</a> had put the cost at twice as much.</p>
        <h2>What comes next</h2><p>A second inspection is planned for the spring.</p></article></main>
        <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm warning</a></li><li><a href="/2">Fair returns</a></li></ul></aside>
        <section id="comments"><h3>2 comments</h3><div class="comment"><p>About time, I have been driving round for ages.</p></div></section>
        <footer><p>&copy; 2024 The Courier. All rights reserved.</p></footer></body></html>""",
        ["Old bridge reopens after two years", "The stone bridge over the river opened to traffic again on Monday, two years after a flood damaged its central arch.", "Engineers replaced 140 blocks & rebuilt the eastern parapet, the council said. An earlier report had put the cost at twice as much.", "What comes next", "A second inspection is planned for the spring."],
    ),
    "blog": (
        """<html><body><div class="navbar"><a href="/">Home</a> <a href="/about">About</a></div>
        <div class="post"><h1>Baking with rye</h1><div class="byline">By Ada <a href="#">Follow</a></div>
        <p>Rye flour holds more water than wheat, so the dough feels wet for a long time.</p><ul><li>500 g of rye flour</li><li>450 g of water, warm</li></ul>
        <p>Let it rest overnight. In the morning it should have doubled.</p><blockquote>Patience is the main ingredient.</blockquote></div>
        <div class="related"><h3>You may also like</h3><ul><li><a href="/b">Sourdough for beginners</a></li></ul></div>
        <div class="newsletter-signup"><form action="/s"><label>Your mail</label><input name="m"><button>Subscribe</button></form></div>
        <div id="footer">&copy; Ada, all rights reserved</div></body></html>""",
        ["Baking with rye", "Rye flour holds more water than wheat, so the dough feels wet for a long time.", "500 g of rye flour", "450 g of water, warm", "Let it rest overnight. In the morning it should have doubled.", "Patience is the main ingredient."],
    ),
    "docs": (
        """<html><body><nav class="menu"><ul><li><a href="/i">Install</a><li><a href="/u">Use</a><li><a href="/f">FAQ</a></ul></nav>
        <div class="content"><h1>Reading a table</h1><p>Open the file with the reader, then ask for its columns.<pre>rows = read("a.tab")</pre>
        <p>Each row is a tuple; missing cells are empty.<table><tr><td>name</td><td>the column's name</td></tr></table></div>
        <footer>&copy; the project's authors</footer></body></html>""",
        ["Reading a table", "Open the file with the reader, then ask for its columns.", 'rows = read("a.tab")', "Each row is a tuple; missing cells are empty.", "name", "the column's name"],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(name):
    page, want = PAGES[name]
    got = html_text.main_text(page, html_text.trained_field()).split("\n")
    wrong = set(got) ^ set(want)
    assert len(wrong) <= 1 and [g for g in got if g in want] == [w for w in want if w in got], wrong


def test_awkward_texts_are_what_they_are_called():
    texts = conftest.awkward_texts()
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 100_000

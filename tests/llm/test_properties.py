"""Properties that hold for any text."""

import re

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import bpe, html_text, licenses, pii
from paceline.llm.shingles import shingle_sets, word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(PATH))
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)
FEW = settings(max_examples=120, deadline=None)


@FEW
@given(TEXT)
def test_tokens_and_round_trip(text):
    (ids,) = ENCODER.encode([text])
    assert list(memoryview(ids).cast("I")) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.decode(ids) == text


@FEW
@given(st.text("ab.@-+_% é9", max_size=40))
def test_emails(text):
    assert pii.emails(text) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]


@FEW
@given(st.lists(st.text("aA b\t\n\x0b\x0c\ré ", max_size=30), max_size=6))
def test_shingles_of_texts_side_by_side(texts):
    together = [s.tolist() for s in shingle_sets(pa.array(texts, pa.string()))]
    assert together == [next(shingle_sets(pa.array([t], pa.string()))).tolist() for t in texts]


@FEW
@given(st.text("ab \n", max_size=60))
def test_long_texts_are_cut_at_white_space(text):
    import numpy as np

    from paceline.llm import shingles

    data = np.frombuffer(text.encode(), np.uint8)
    want = word_hashes(data, np.array([0, len(data)]))[0].tolist()
    before, shingles.PIECE = shingles.PIECE, 7
    try:
        assert shingles.long_word_hashes(data).tolist() == want
    finally:
        shingles.PIECE = before


@FEW
@given(st.text("<>/!-='\" pdivascript&#x;ul\n", max_size=80))
def test_any_markup_gives_blocks(page):
    for block in html_text.leaf_blocks(page):
        assert block.text == " ".join(block.text.split()) != ""


@FEW
@given(TEXT, TEXT, st.sampled_from(licenses.TEMPLATES))
def test_notices_in_any_text(before, after, template):
    scan = licenses.Scanner().scan(f"{before}\n{template[1]}\n{after}")
    assert template[0] in [m.license for m in scan[1]]

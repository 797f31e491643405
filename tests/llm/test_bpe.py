import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paceline.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(B.Vocabulary(PATH))


def test_like_the_library(encoder):
    library, rng = Tokenizer.from_file(PATH), random.Random(1)
    letters = "abc  \t\n\r\x0b\x0c\x1c\x85\xa0 ​'sdtréÉ漢字🙂½²Ⅷ٣́-!?.,<|endoftext|>0129"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x" * 5000, " " * 700 + "a", "ab" * 3000, "\x00\x01"]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = encoder.encode(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == [w.ids for w in want]
    assert [encoder.decode(g) for g in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_pairs_that_may_follow(encoder):
    rng = random.Random(2)
    ids = [i for i in encoder.v.ids.values() if encoder.may_begin(i)]
    short = [i for i in ids if len(encoder.table[i]) < 4]
    for _ in range(4000):
        a, b = rng.choice(short), rng.choice(short)
        assert encoder.may_follow(a, b) == (encoder.merge(encoder.table[a] + encoder.table[b])[0] == [a, b])
    for a in short:
        assert encoder.may_follow(a, a) == (encoder.merge(encoder.table[a] * 2)[0] == [a, a])


def test_memory_limits_change_nothing(monkeypatch):
    texts = ["some words here", "and more words there", "some other words"] * 5
    want = B.Encoder(B.Vocabulary(PATH)).encode(texts)
    monkeypatch.setattr(B, "REMEMBER", 2)
    monkeypatch.setattr(B, "PIECE", 6)
    small = B.Encoder(B.Vocabulary(PATH))
    assert [x for t in texts for x in small.encode([t])] == want
    assert small.encode(texts) == want


def test_round_trip_in_spark(awkward, empty, clashing):
    encoded = B.encode_documents(awkward, PATH)
    texts = {r.doc_id: r.text for r in B.decode_documents(encoded, PATH).collect()}
    assert texts == {r.doc_id: r.text or "" for r in awkward.collect()}
    assert B.encode_documents(empty, PATH).count() == 0
    assert B.encode_documents(clashing, PATH).where("n_tokens = 0").count() == 1

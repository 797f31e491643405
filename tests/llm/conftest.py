import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_texts(seed=3):
    """Texts with copies, near copies, ties, nulls, blanks, a very long one and odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(6, 80)) for _ in range(30)]
    out = list(base)
    out += [base[0]] * 25 + [base[1].replace(" ", "\n\t ")] * 3 + [base[2].upper()]
    for _ in range(40):  # near copies of one text and of each other
        words = base[3].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    out += [None, None, "", "   ", " ", "one", "one two", "one two", "a b c d e", prose(rng, 20_000), "é\U0001f642 漢字 x", "<|endoftext|> x", "\x00\x01"]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    texts = awkward_texts()
    rows = [(i * 7 % 1009, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Names that the operators use inside, null ids, and rows that repeat."""
    rows = [(1, "same text here now ok", 5, 1, "x"), (1, "same text here now ok", 5, 1, "x"), (None, "same text here now ok", 6, 2, "y"), (2, "other words in this text", 7, 3, "z"), (None, None, 8, 4, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, row long, digest string")

import random

import pytest

#: Rows with every odd case: nulls, empty and blank texts, repeats, ties, a very long text, non-ASCII letters.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the forest"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the forest"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the forest"),
    (None, "The quick brown fox jumps over the lazy dog and runs away from the hunter in the forest"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "Ünïcödé ñandú 漢字 \U0001f600 привет мир"),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (None, None),
    (-3, "a b"),
]


@pytest.fixture
def odd(spark):
    """The odd rows, with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", 0, "clash", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, score double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def near_copies():
    """(doc_id, text): random texts, exact copies, near copies of different distance, shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], draw(60)
    for g in range(12):
        base = draw(rng.randrange(20, 160))
        for c in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, 4) if c else 0):
                text[rng.randrange(len(text))] = rng.choice(words)
            if g % 3 == 0:
                at = rng.randrange(len(text))
                text[at:at] = passage[rng.randrange(0, 20) : rng.randrange(25, 60)]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ba co du fe gi lo mu ne pi ra".split() for b in "lan ter vos min dra kel sun".split()]


@pytest.fixture(scope="session")
def prose():
    """A maker of random prose of n words."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """documents rows from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows, lang="en", source="s"):
        full = [(k, t, lang, source, None if t is None else len(t), 1, 2, "x") for k, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int, shard int, key string")

    return make


ODD = [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two three"), (7, "Ünïcödé – ß"), (8, "w " * 5000)]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows, a null key, a long text."""
    return list(ODD)

import random

import pytest

#: Letters for invented words, with some beyond ASCII.
SYLLABLES = "ba co di fu ge ha ñi ßo lé mu na or pi qu ré st tu vo wa xé".split()


@pytest.fixture(scope="session")
def prose():
    """A function that gives n invented words of a seed."""

    def make(n: int, seed: int) -> list[str]:
        rng = random.Random(seed)
        return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """A function that makes documents of (doc_id, text) with extra columns of clashing names."""

    def make(rows):
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kinds string, item_id string, copy bigint, hash bigint"
        return spark.createDataFrame([(d, t, "en" if d is None or d % 2 else "fr", f"s{(d or 0) % 3}", len(t or ""), 9.0, "k", "i", 5, 1) for d, t in rows], kinds)

    return make

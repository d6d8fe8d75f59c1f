import random

import pytest
from pyspark.sql import functions as F

from loxodrome.llm import near_dedup
from tests.llm.plain import near_groups


def varied(words, rng, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = rng.choice(["xx", "yy", "zz", "ww", "vv"])
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(frame, prose, size, percent):
    rng = random.Random(size)
    docs = [(i, " ".join(prose(rng.randint(1, 60), i))) for i in range(40)]
    for g in range(6):  # groups of variants of a text, from loose to close
        base = prose(rng.choice([12, 40, 150, 400]), 1000 + g)
        docs += [(1000 * (g + 1) + i, " ".join(varied(base, rng, rng.choice([0.0, 0.01, 0.02, 0.05, 0.1])))) for i in range(30)]
    common = " ".join(prose(20, 77))
    docs += [(9000 + i, common + " " + " ".join(prose(rng.choice([0, 2, 30]), 9000 + i))) for i in range(40)]
    docs += [(9500, ""), (9501, None), (9502, "  \t\n"), (9503, "One two"), (9504, "one  TWO"), (9505, "one")]
    want = near_groups(docs, size, percent)
    got = near_dedup.near_duplicates(frame(docs), size, percent).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hot_lists(frame, prose, monkeypatch):
    """The paths for lists of many members, at a small size."""
    monkeypatch.setattr(near_dedup, "HOT_LIST", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    base = prose(120, 3)
    docs = [(i, " ".join(varied(base, rng, rng.choice([0.0, 0.005, 0.02, 0.04, 0.08])))) for i in range(90)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(docs), 3, 85).collect()} == near_groups(docs, 3, 85)


def test_repeated_rows_nulls_and_empty_tables(frame, spark):
    text = "a b c d e f g h"
    got = near_dedup.near_duplicates(frame([(3, text), (3, text), (None, text), (5, "other words entirely here now ok yes")])).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {3, 5}
    assert near_dedup.near_duplicates(frame([])).count() == 0
    kept = near_dedup.deduplicated(frame([(3, text), (3, text), (4, text), (None, "x y"), (None, "x y")]))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3] and "score" in kept.columns


def test_bounds():
    assert near_dedup.least_shared(85) >= 8 and near_dedup.least_shared(100) == near_dedup.LISTED


def test_kept_documents_of_the_stage(frame, prose):
    docs = [(i, " ".join(prose(30, i % 7))) for i in range(21)]
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(frame(docs)).select(F.col("doc_id")).collect()) == list(range(7))


def test_null_ids_are_linked(frame, prose):
    """Near copies with a null id join the component of an id; of those alone one is kept."""
    a, b = prose(60, 1), prose(60, 2)
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    docs = [(3, " ".join(a)), (None, near(a, 59)), (None, " ".join(b)), (None, near(b, 0)), (8, "other words entirely")]
    got = near_dedup.near_duplicates(frame(docs)).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["3", "3", "8", "None", "None"]
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicated(frame(docs)).collect()]
    assert (3, " ".join(a)) in kept and (8, "other words entirely") in kept and len(kept) == 3 and sum(d is None for d, _ in kept) == 1


def test_one_id_with_two_texts(frame):
    """A duplicate of another document goes even where its id has a text of its own that stays; of texts that differ in blanks one stays."""
    one, two = "a b c d e f g h", "quite another text with words of its own"
    kept = near_dedup.deduplicated(frame([(1, one), (2, one), (2, two), (3, "z  y x w v u"), (3, "z y x w v u")])).collect()
    assert sorted((r["doc_id"], r["text"].split()[0]) for r in kept) == [(1, "a"), (2, "quite"), (3, "z")]


def test_very_long_text(frame, prose):
    long = prose(150_000, 9)
    docs = [(1, " ".join(long)), (2, " ".join([*long[:-1], "end"])), (3, "x " * 100_000), (4, "x")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(docs), 3, 85).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == (1, 3) and got[4] == (1, 4)


def test_loose_group_makes_few_pairs(frame, prose, monkeypatch):
    """Hundreds of loose variants of one text: the pairs that are compared stay near the number of documents."""
    compared = []
    plain = near_dedup.Linker.likely

    def counted(self, pairs):
        pairs = self.scratch.table(pairs)
        compared.append(pairs.count())
        return plain(self, pairs)

    monkeypatch.setattr(near_dedup.Linker, "likely", counted)
    rng, base = random.Random(2), prose(100, 4)
    docs = [(i, " ".join(varied(base, rng, 0.04))) for i in range(400)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(docs), 5, 80).collect()} == near_groups(docs, 5, 80)
    assert sum(compared) < 20 * len(docs)

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loxodrome.llm import decontaminate
from tests.llm.plain import contamination


def check(frame, spark, docs, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = decontaminate.decontaminate(frame(docs), bench).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in got} == contamination(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


def cases(prose):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng.choice([1, 3, 9, 10, 11, 30]), 500 + i))) for i in range(25)]
    items += [(90, "Ab ab ab ab ab ab ab ab ab ab ab ab"), (91, None), (92, "--"), (93, items[5][1]), (94, "Zwölf, Äpfel!")]
    docs = []
    for d in range(60):
        w = prose(rng.choice([0, 5, 40, 200]), d)
        for _ in range(rng.randint(0, 2)):
            src = rng.choice(items)[1]
            part = (src or "").split()
            if part:
                a = rng.randint(0, max(0, len(part) - 10))
                at = rng.randint(0, len(w))
                w[at:at] = part[a : a + rng.choice([9, 10, 14, 40])]
        docs.append((d, " ".join(w)))
    docs += [(100, "ab " * 40), (101, None), (102, ""), (103, "AB, ab! ab ab ab ab ab ab ab ab."), (104, "zwölf äpfel zwölf Äpfel")]
    return docs, items


def test_against_all_windows(frame, spark, prose):
    check(frame, spark, *cases(prose))


def test_without_broadcast(frame, spark, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    check(frame, spark, *cases(prose))


def by_row(docs, items):
    return Counter((d, n, hit, tuple(found)) for d, t in docs for n, hit, found in [contamination([(0, t)], items)[0]])


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, -1])
def test_null_and_repeated_ids(frame, spark, monkeypatch, rows):
    """Each row has its own result, whatever its id."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")]
    docs = [(5, "x " + items[0][1]), (5, "clean words"), (5, "clean words"), (None, items[0][1]), (None, items[0][1]), (None, "a short item"), (None, "fine"), (None, None), (7, None)]
    got = decontaminate.decontaminate(frame(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == by_row(docs, items)
    stay = decontaminate.clean(frame(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in stay.collect()) == Counter([(5, "clean words"), (5, "clean words"), (None, "fine"), (None, None), (7, None)]) and "score" in stay.columns


def test_long_text_and_ties(frame, spark, prose):
    """A text of 60,000 words with a passage at either end, one of one word throughout, and an item of one word."""
    passage, other = prose(25, 1), prose(60_000, 2)
    docs = [(1, " ".join(passage + other + passage)), (2, "la " * 5_000), (3, "la")]
    for items in ([(1, " ".join(passage))], [(1, " ".join(passage)), (2, "la " * 12)]):
        check(frame, spark, docs, items)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.decontaminate(frame(docs), spark.createDataFrame([(9, "la"), (8, "la la")], "item_id bigint, text string")).collect()}
    assert got[2] == (5_000, ["8", "9"]) and got[3] == (1, ["9"])


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.decontaminate(frame([(1, "a b c")]), none).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (3, 0, False)
    assert decontaminate.decontaminate(frame([]), none).count() == 0
    assert decontaminate.clean(frame([(1, "a b"), (1, "a b")]), none).count() == 2

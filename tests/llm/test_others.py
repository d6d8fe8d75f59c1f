"""Mixing, fixity audit, license scans and the pipeline."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loxodrome.llm import licenses, mixing, warc
from loxodrome.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import differing
from tests.llm.plain import words


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert not differing(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_poisson_inverse(spark):
    def plain(u, rate):
        p = cdf = math.exp(-rate)
        k = 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        return k

    for rate in (0.0, 0.3, 1.0, 7.5, 64.0):
        us = [i / 997 for i in range(997)]
        df = spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.poisson(F.col("u"), F.lit(rate)).alias("k"))
        assert all(r["k"] == plain(r["u"], rate) for r in df.collect())


def test_mixture_meets_weights(spark, frame):
    docs = frame([(i, "x") for i in range(6000)])
    got = mixing.mixed(docs, {"s0": 3.0, "s1": 1.0}, 9000).select("doc_id", "source", "copy", "shuffle_key").collect()
    n = Counter(r["source"] for r in got)
    assert set(n) == {"s0", "s1"} and abs(n["s0"] - 6750) < 300 and abs(n["s1"] - 2250) < 200
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    big = mixing.mixed(frame([(3, "x"), (6, None)]), {"s0": 1.0}, 400)
    assert 330 < big.count() < 470 and big.select("doc_id", "copy").distinct().count() == big.count()


def test_mixture_edges(frame):
    assert mixing.mixed(frame([])).count() == 0
    assert mixing.mixed(frame([(1, "x")]), {"nobody": 1.0}).count() == 0
    nulls = frame([(None, "x")] * 3 + [(1, None)]).withColumn("source", F.lit(None).cast("string"))
    assert "copy" in mixing.mixed(nulls).columns and mixing.mixed(nulls, {None: 1.0}, 400).count() > 0


def test_null_ids_draw_by_their_texts(frame):
    """1,000 texts without an id aimed at 1,500 copies; equal ones draw alike."""
    docs = frame([(None, f"text {i}") for i in range(1000)] + [(None, "same")] * 2)
    got = Counter(r["text"] for r in mixing.mixed(docs, {"s0": 1.0}, 1500).select("text").collect())
    assert abs(sum(got.values()) - 1500) < 120 and got["same"] % 2 == 0
    assert got == Counter(r["text"] for r in mixing.mixed(docs.repartition(7), {"s0": 1.0}, 1500).select("text").collect())


def test_shuffle_is_in_the_order_of_its_key(frame):
    """Partition by partition, with the copies of one document far from each other."""
    df = mixing.mixed(frame([(i, "é" * 50_000 if i == 1 else "x") for i in range(300)]), wanted=900)
    rows = df.select("shuffle_key", F.spark_partition_id().alias("p")).collect()
    assert rows == sorted(rows, key=lambda r: (r["p"], r["shuffle_key"])) and [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)


def test_audit_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'é' * (i % 9)}{i}</p>") for i in range(2500)] + [(7, "http://h/7", "<p>" + "é" * 7 + "7</p>"), (None, None, None)], "page_id bigint, url string, html string")
    other = pages.filter("page_id is null or page_id <> 2400").withColumn("html", F.when(F.col("page_id").isin(3, 1500), "gone").otherwise(F.col("html")))
    got = warc.audit(pages, other).collect()
    by = Counter(r["status"] for r in got)
    assert {r["page_id"] for r in got if r["status"] == "corrupt"} >= {3, 1500} and len(got) == 2501 and by["missing"] == 1
    assert all(r["page_id"] >= 2000 or r["page_id"] in (3, 1500) for r in got if r["status"] != "ok")
    assert sum(r["copies"] for r in got) == 2502
    assert {r["status"] for r in warc.audit(pages, pages).collect()} == {"ok"}
    assert warc.audit(pages.limit(0), pages.limit(0)).count() == 0
    extra = warc.audit(pages.filter("page_id < 10"), pages.filter("page_id < 12"))
    assert extra.filter("status = 'extra'").count() == 2


def test_hot_file_is_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_RECORDS", 50)
    pages = spark.range(400).select(F.lit(5).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    got = warc.audit(pages, pages.withColumn("html", F.when(F.col("html") == "9", "x").otherwise(F.col("html")))).collect()
    assert len({r["file"] for r in got}) > 5 and any(r["status"] != "ok" for r in got)


def found(spark, own, other):
    """(page_id, status) -> copies, of what an audit doesn't call ok."""
    kinds = "page_id bigint, url string, html string"
    got = warc.audit(spark.createDataFrame(own, kinds), spark.createDataFrame(other, kinds)).collect()
    assert sum(r["copies"] for r in got if r["status"] != "extra") == len(own)
    return {(r["page_id"], s): sum(x["copies"] for x in got if (x["page_id"], x["status"]) == (r["page_id"], s)) for r in got if (s := r["status"]) != "ok"}


def test_audit_counts_copies_and_realigns(spark, monkeypatch):
    own = [(i, f"u{i}", f"<p>{i}</p>") for i in range(40)] + [(7, "u7", "<p>7</p>")] * 3
    assert found(spark, own, own[:-2]) == {(7, "missing"): 2}
    assert found(spark, own[:-2], own) == {(7, "extra"): 2}
    assert found(spark, own, [r for r in own if r[0] != 20]) == {(20, "missing"): 1}
    assert found(spark, own, [*own[:10], (10, "u10", "<p>"), *own[11:], (3, "u3", "<p>3</p>"), (41, "u", "new")]) == {(10, "corrupt"): 1, (3, "extra"): 1, (41, "extra"): 1}
    assert found(spark, own, [*own[:-2], (7, "u7", "bad")]) == {(7, "corrupt"): 1, (7, "missing"): 1}
    assert found(spark, [*own, (None, None, "x")], own) == {(None, "missing"): 1}
    monkeypatch.setattr(warc, "MOST_RECORDS", 50)
    hot = [(5, "u", str(i)) for i in range(200)]
    assert found(spark, hot, [*hot[:9], (5, "u", "bad"), *hot[10:]]) == {(5, "corrupt"): 1}
    assert found(spark, hot, hot[:90]) == {(5, "missing"): 110}


def test_one_record_lost_of_a_split_range(spark, monkeypatch):
    """The number of a range's files doesn't depend on the replica."""
    monkeypatch.setattr(warc, "MOST_RECORDS", 50)
    own = [(i, f"u{i}", f"<p>{i}</p>") for i in range(101)]
    assert found(spark, own, own[:70] + own[71:]) == {(70, "missing"): 1}
    nulls = [(None, f"u{i}", "x") for i in range(101)]
    assert found(spark, nulls, nulls[1:]) == {(None, "missing"): 1}


def plain_audit(own, other):
    """(page_id, status) -> copies, by counting records of each page and URL on either side."""
    a, b, out = Counter(own), Counter(other), Counter()
    for key in {r[:2] for r in own + other}:
        left = [sum((x - y).values()) for x, y in ((Counter({r: c for r, c in s.items() if r[:2] == key}), Counter({r: c for r, c in t.items() if r[:2] == key})) for s, t in ((a, b), (b, a)))]
        for status, n in (("corrupt", min(left)), ("missing", left[0] - min(left)), ("extra", left[1] - min(left))):
            if n:
                out[key[0], status] += n
    return dict(out)


@pytest.mark.parametrize("most", [10_000, 20])
def test_audit_against_counts(spark, monkeypatch, most):
    """Random losses, insertions, changes and repeats, with and without split ranges."""
    monkeypatch.setattr(warc, "MOST_RECORDS", most)
    rng = random.Random(most)
    own = [(rng.choice([None, *range(60)]), f"u{rng.randint(0, 2)}", rng.choice("abcd")) for _ in range(250)] + [(1500, "u", "é" * 300_000)]
    other = []
    for r in own:
        x = rng.random()
        other += [] if x < 0.05 else [r, r] if x < 0.1 else [(*r[:2], r[2] + "!")] if x < 0.2 else [r]
    other += [(3000, "new", "n")]
    assert found(spark, own, other) == plain_audit(own, other)


def test_audit_ignores_other_columns(spark):
    kinds = "page_id bigint, url string, html string, file string, digest string, copies int, range int"
    pages = spark.createDataFrame([(i, "u", "x", "f", "d", 9, 7) for i in range(5)], kinds)
    got = warc.audit(pages, pages.filter("page_id <> 2")).collect()
    assert Counter(r["status"] for r in got) == {"ok": 4, "missing": 1} and got[0].asDict().keys() == {"file", "page_id", "offset", "length", "copies", "digest", "status"}


def plain_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_against_plain(frame):
    texts = [
        None, "", "CC-BY, cc by cc by!", "GNU General Public License v3; all RIGHTS reserved.", "ccc by", "Général public license général", "licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Creative Commons Attribution-ShareAlike 4.0 International", "mit allen Rechten", "all rights\n\nreserved " * 3,
    ]
    got = {r["row"]["doc_id"]: r for r in licenses.scanned(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {i: got[i]["labels"] for i in got}
    assert labels[3] == "gpl,gpl-3.0,reserved" and labels[6] == "cc-by,cc-by-nc-4.0" and labels[7] == "apache-2.0" and labels[8] == "mit" and labels[9] == "mit" and labels[10] == "cc-by-sa-4.0" and labels[11] == ""
    assert licenses.scanned(frame([])).count() == 0


def test_rules_compile_and_match_their_own_forms():
    assert len(licenses.RULES) > 300
    scanner = licenses.Scanner()
    for r in licenses.RULES:
        re.compile(r.pattern)
        assert r.keywords
    assert [d.label for d in scanner.detections(b" the mozilla public license version 2 0 applies ")] == ["mpl-2.0"]


def strings(pattern, rng):
    """A string that the pattern matches, by random choices at each alternative, class and repeat."""

    def of(tokens):
        out = ""
        for op, arg in tokens:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "ANY":
                out += "x"
            elif op == "IN":
                chosen = rng.choice(arg)
                out += {"LITERAL": lambda: chr(chosen[1]), "CATEGORY": lambda: rng.choice("123"), "RANGE": lambda: chr(rng.randint(*chosen[1]))}[str(chosen[0])]()
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(of(inner) for _ in range(rng.randint(low, min(int(high), low + 2))))
            elif op == "SUBPATTERN":
                out += of(arg[3])
            elif op == "BRANCH":
                out += of(rng.choice(arg[1]))
            else:
                assert op in ("ASSERT", "ASSERT_NOT"), op
        return out

    return of(re._parser.parse(pattern))


def test_keywords_are_in_whatever_their_rules_match():
    """Generated examples of each rule, with and without the prefilter."""
    rng, scanner = random.Random(5), licenses.Scanner()
    lost = set()
    for r in licenses.RULES:
        compiled, seen = re.compile(r.pattern), set()
        for _ in range(60):
            text = f" {strings(r.pattern, rng)} "
            assert compiled.search(text), (r, text)
            if text not in seen and not any(f" {k}" in text for k in r.keywords):
                lost.add((r.label, text))
            seen.add(text)
    assert not lost
    everything = licenses.Scanner([licenses.Rule(r.rank, r.label, r.pattern, ("",), r.weight) for r in licenses.RULES])
    for text in ("0BSD", "FreeBSD license", "SPDX-License-Identifier: Elastic-2.0", "Elastic 2.0", "SPDX-License-Identifier: Vim", "Parity 7.0", "Open Licence 2.0", "PHP v3.01"):
        got = scanner.scan(text.encode())
        assert got == everything.scan(text.encode()) and got[5] and got[6]


def plain_labels(text):
    """Labels and score by trying every rule at every place, without the prefilter, and suppressing spans one by one."""
    joined = f" {' '.join(words(text))} "
    spans = {(*m.span(), r.rank) for r in licenses.RULES for m in re.finditer(r.pattern, joined)}
    kept = [(a, b, k) for a, b, k in spans if not any((c <= a and b <= d and d - c > b - a) or ((c, d) == (a, b) and m < k) for c, d, m in spans)]
    base = [label for phrase, label in licenses.BASE if f" {phrase} " in joined]
    rules = {r.rank: r for r in licenses.RULES}
    return ",".join(sorted({*base, *(rules[k].label for *_, k in kept)})), max([float(bool(base)), *(rules[k].weight for *_, k in kept)])


def test_labels_against_plain(spark, frame):
    """Whole notices, those of sf0.01, and generated forms of rules, among other words."""
    rng = random.Random(8)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lower(text) rlike 'licen|rights|copyright|creative|public'").select("text").limit(40).collect()]
    for _ in range(60):
        parts = [strings(rng.choice(licenses.RULES).pattern, rng) for _ in range(rng.randint(1, 4))]
        docs.append(" and then, ".join(parts) + rng.choice(["", ". All rights reserved.", " cc by"]))
    got = {r["row"]["doc_id"]: (r["labels"], r["score"]) for r in licenses.scanned(frame(list(enumerate(docs)))).collect()}
    for i, t in enumerate(docs):
        assert got[i] == plain_labels(t), t


def test_licenses_edges(frame):
    """Long texts of one phrase in time that grows with their length, repeated rows, ties and clashing columns."""
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        assert licenses.Scanner().scan(b"all rights reserved " * n)[:4] == (3 * n, n, 0, 3 * n - 3)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1
    rows = licenses.scanned(frame([(1, "CC BY"), (1, "CC BY"), (None, "x")]).withColumn("labels", F.lit("mine"))).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["labels"], r["row"]["labels"]) for r in rows) == [(0, "", "mine"), (1, "cc-by", "mine"), (1, "cc-by", "mine")]


def test_contained_spans_are_suppressed():
    d = lambda a, b, rank: licenses.Detection(a, b, rank, str(rank), 1.0)
    assert licenses.resolved([d(0, 10, 5), d(2, 8, 0), d(0, 10, 3), d(8, 14, 1)]) == [d(0, 10, 3), d(8, 14, 1)]

import hashlib

import xxhash
from pyspark.sql import functions as F

from loxodrome.llm import fingerprint
from loxodrome.llm.queries import op1_fingerprint
from tests.llm.plain import SPACED, UPPER


def shingle_hashes(text: str) -> set[int]:
    w = SPACED.findall(text.translate(UPPER))
    k = min(5, len(w))
    hashes = set()
    for i in range(len(w) - k + 1 if w else 0):
        h = 42
        for x in w[i : i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    return hashes


def plain_likeness(a: set, b: set) -> float:
    if max(len(a), len(b)) > fingerprint.FEW:
        a, b = ({h for h in s if h < fingerprint.THRESHOLD} for s in (a, b))
        return len(a & b) / len(a | b) if a | b else 0.0
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_text(hashes: set) -> str:
    hexes = lambda hs: "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(hs))
    low = {h for h in hashes if h < fingerprint.THRESHOLD}
    return hexes(low) + ("." + hexes(hashes - low) if len(hashes) <= fingerprint.FEW else "")


def plain(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = (shingle_hashes(x) for x in (t, edited, nxt))
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_text(a), plain_likeness(a, b), plain_likeness(a, c))
    return out


def test_against_plain(spark, frame, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    docs = [(i * 3, " ".join(prose(i % 90, i))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "é" * 10), (1003, "x " * 3000), (1004, " ".join(prose(700, 4))), (1005, " ".join(prose(300, 5)))]
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in op1_fingerprint(spark, str(tmp_path)).collect()}
    assert got == plain(docs)


def test_small_tables(spark, frame, tmp_path):
    for name, docs, n in (("none", [], 0), ("one", [(5, "abcdef")], 1), ("nulls", [(None, "a"), (None, None), (2, "b"), (2, "b")], 4)):
        frame(docs).write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = op1_fingerprint(spark, str(tmp_path / name)).collect()
        assert len(rows) == n
        if n == 1:
            assert rows[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and rows[0]["near_next"] == 1.0


def test_merge_and_containment(spark, frame, prose):
    a, b = " ".join(prose(400, 1)), " ".join(prose(5000, 2))
    row = frame([(1, a)]).select(fingerprint.sketch(F.lit(a)).alias("a"), fingerprint.sketch(F.lit(f"{a} {b}")).alias("ab"), fingerprint.sketch(F.lit(b)).alias("b"))
    a, ab, b = F.col("a"), F.col("ab"), F.col("b")
    both = fingerprint.merge(a, b)
    got = row.select(fingerprint.containment(a, ab), fingerprint.likeness(a, b), F.size(F.array_except(both["low"], "ab.low")), both["rest"]).first()
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0 and got[3] is None


def test_merge_of_short_texts(frame, prose):
    """Two texts with all their hashes give one with all of them, until there are too many."""
    for n, whole in ((60, True), (200, False)):
        a, b = " ".join(prose(n, 1)), " ".join(prose(n, 2))
        made = frame([(1, a)]).select(fingerprint.merge(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(b))).alias("m")).first()["m"]
        want = shingle_hashes(a) | shingle_hashes(b)
        low = sorted(h for h in want if h < fingerprint.THRESHOLD)
        assert made["low"] == low and made["rest"] == (sorted(want - set(low)) if whole else None)


def test_containment_of_passages(spark, prose):
    """Passages of 6 to 60 words in a text of 3,000 words, whole or half replaced: never wrong where something is retained, and close on the mean."""
    words = prose(3000, 9)
    cases = []
    for n in (6, 8, 12, 20, 40, 60):
        for k in range(40):
            own = words[40 * k : 40 * k + n]
            cases += [(n, " ".join(own), 1), (n, " ".join(own[: n // 2] + prose(n - n // 2, 5000 + k)), 0)]
    df = spark.createDataFrame(cases, "n int, text string, whole int").select("n", "whole", "text", fingerprint.containment(fingerprint.sketch(F.col("text")), fingerprint.sketch(F.lit(" ".join(words)))).alias("c"))
    long, errors = shingle_hashes(" ".join(words)), []
    for r in df.collect():
        own = shingle_hashes(r["text"])
        if r["c"] is None:
            assert not [h for h in own if h < fingerprint.THRESHOLD]
            continue
        truth = len(own & long) / len(own)
        assert not r["whole"] or r["c"] == truth == 1.0
        errors.append(abs(r["c"] - truth))
    assert len(errors) > 0.7 * len(cases) and sum(errors) / len(errors) < 0.15


def test_containment_of_short_texts_is_exact(spark, prose):
    words = prose(200, 3)
    for n in (1, 3, 6, 8, 30):
        a, b = " ".join(words[:n] + ["zz"]), " ".join(words)
        got = spark.range(1).select(fingerprint.containment(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(b)))).first()[0]
        x, y = shingle_hashes(a), shingle_hashes(b)
        assert got == len(x & y) / len(x)

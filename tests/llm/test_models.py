"""Language, toxicity and quality: held-out accuracy, and the edge cases of their definitions."""

import random

import numpy as np
import pytest

from loxodrome.llm import hashed, langid, quality, toxicity
from loxodrome.llm.common import held_out
from loxodrome.llm.queries import op2_language, op3_toxicity


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op2_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(frame):
    docs = [(i, "un deux trois quatre été" if i % 2 == 0 else "one two three four") for i in range(1, 40)] + [(100, None), (101, ""), (102, "123 !?"), (103, "x"), (103, "x")]
    net = langid.learnt(frame(docs))
    rows = {r["row"]["doc_id"]: r for r in langid.identified(frame(docs), net).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (100, 101, 102)) and rows[103]["lang_pred"] in ("en", "fr") and rows[1]["row"]["score"] == 9.0 and "text" not in rows[1]["row"]
    assert langid.learnt(frame([])) is None and langid.identified(frame([(1, "a")]), None).first()["lang_pred"] == "und"


def test_windows_cover_the_text():
    text = bytes(random.Random(1).randrange(1, 256) for _ in range(1000))
    windows, owner, used = langid.packed([text, b"", b"ab"])
    assert windows[owner == 0].tobytes()[:1000] == text and used.tolist() == [256, 256, 256, 232, 1, 2]


def test_two_bytes_at_once_equal_single_tables():
    rng = np.random.default_rng(0)
    f = langid.FILTERS * len(langid.WIDTHS)
    net = langid.ByteConvNet(["a", "b"], {w: rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS}, np.zeros(f), np.zeros((f, 2)), np.zeros(2))
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    padded = np.zeros((5, langid.WINDOW + 3), np.uint8)
    padded[:, : langid.WINDOW] = x
    want = np.concatenate([sum(net.tables[w][j][padded[:, j : j + langid.WINDOW]] for j in range(w)).max(1) for w in langid.WIDTHS], 1)
    assert np.allclose(langid.pooled(x, *net.pairs()), want, atol=1e-5)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in op3_toxicity(spark, sf).filter("held_out").collect() if r["doc_id"] in truth]
    hit = sum(p and t for p, t in got)
    assert hit / sum(t for _, t in got) > 0.8 and hit / sum(p for p, _ in got) > 0.95


def test_toxicity_edges(spark, frame):
    docs = [(i, (f"you stupid clown w{i} " if i % 3 == 0 else f"a fine day v{i} ") * 3) for i in range(1, 90)] + [(100, None), (101, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 90)] + [(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learnt(frame(docs), labels)
    rows = {r["row"]["doc_id"]: r for r in toxicity.scored(frame(docs), model).collect()}
    assert rows[3]["predicted"] == 1 and rows[4]["predicted"] == 0 and rows[100]["score"] == rows[101]["score"]
    none = toxicity.learnt(frame(docs), labels.filter("false"))
    assert toxicity.scored(frame(docs), none).agg({"score": "max"}).first()[0] < 1e-6


def test_toxicity_keeps_the_prior_of_all_labels(spark):
    """Samples of 300 toxic and 500 other texts, where about one label in nine is toxic."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    some = docs.filter(held_out(docs["doc_id"])).join(labels.select("doc_id").distinct(), "doc_id")
    got = [(r["predicted"], truth[r["row"]["doc_id"]]) for r in toxicity.scored(some, toxicity.learnt(docs, labels, 300, 500)).collect()]
    clean, toxic = [p for p, t in got if not t], [p for p, t in got if t]
    assert np.mean(clean) < 0.03 and np.mean(toxic) > 0.7


def test_hashed_scores_do_not_depend_on_batches():
    model = hashed.fitted([hashed.present(b"good text here"), hashed.present(b"bad stuff there")], np.array([1.0, 0.0]), np.ones(1 << hashed.BITS))
    score = model.scorer()
    assert score([b"good text"])[0] > score([b"bad stuff"])[0] and np.allclose(score([b"a", b"good text"])[1], score([b"good text"])[0])


def test_quality_finds_defects(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["good"], truth[r["row"]["doc_id"]]) for r in quality.scored(docs.select("doc_id", "text"), *quality.learnt(docs)).collect() if r["row"]["doc_id"] in truth]
    assert np.mean([bool(g) == bool(t) for g, t in got]) > 0.95


def test_em_recovers_classes():
    """Labellers that vote for one class or abstain, right more often than not, and overlap."""
    rng = np.random.default_rng(3)
    n, k = 20_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.7
    votes = np.zeros((n, k), int)
    for j, (_, for_good) in enumerate(quality.LABELLERS):
        votes[:, j] = rng.random(n) < np.where(good == for_good, 0.6, 0.05)
    bits = votes @ (1 << np.arange(k)[::-1])
    patterns, counts = np.unique(bits, return_counts=True)
    model = quality.estimated(patterns, counts.astype(float))
    assert ((model.good(bits) > 0.5) == good).mean() > 0.85
    assert (model.accuracy() > 0.7).all()


@pytest.mark.parametrize("text", [b"", b"   ", b"One.", "é".encode() * 5000])
def test_quality_edges(text):
    assert 0 <= quality.votes(text) < 1 << len(quality.LABELLERS)


def plain_language(net, text):
    """The whole prediction for one text, filter by filter and byte by byte."""
    data = text.encode()
    total, weight = np.zeros(len(net.langs)), 0.0
    for at in range(0, max(1, len(data)), langid.WINDOW):
        part = data[at : at + langid.WINDOW]
        padded = part + bytes(langid.WINDOW + 3 - len(part))
        peaks = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                peaks.append(max(sum(net.tables[w][j][padded[i + j]][f] for j in range(w)) for i in range(langid.WINDOW)))
        h = np.maximum(np.array(peaks) + net.bias, 0)
        z = h @ net.out + net.out_bias
        e = np.exp(z - z.max())
        total += e / e.sum() * max(1, len(part))
        weight += max(1, len(part))
    return total / weight


def test_language_against_plain(frame, prose):
    """Short and long texts, on both sides of a window's end, with ties and repeated rows."""
    docs = [(i, " ".join(prose(40, i)) + (" été" if i % 2 else " one")) for i in range(1, 30)]
    net = langid.learnt(frame(docs))
    texts = ["a", "é" * 128, "x" * 256, "x" * 257, " ".join(prose(300, 99)), "Ω", "a", "b" * 100_000]
    got = {}
    for r in langid.identified(frame(list(enumerate(texts))), net).collect():
        got[r["row"]["doc_id"]] = (r["lang_pred"], r["score"])
    for i, t in enumerate(texts[:-1]):
        share = plain_language(net, t)
        assert got[i][0] == net.langs[int(share.argmax())] and got[i][1] == pytest.approx(share.max(), abs=1e-5)
    assert got[0] == got[6] and 0 <= got[7][1] <= 1
    even = langid.ByteConvNet(["a", "b"], {w: np.zeros((w, 256, langid.FILTERS), np.float32) for w in langid.WIDTHS}, np.zeros(24, np.float32), np.zeros((24, 2), np.float32), np.zeros(2, np.float32))
    assert langid.identified(frame([(1, "tie")]), even).first()["lang_pred"] == "a"


def test_learnt_windows_reach_the_end_of_texts(spark):
    """The second language only shows beyond the first thousands of characters."""
    rows = [(i, "zz " * 1500 + ("один два три " if i % 2 else "eins zwei drei ") * 400, "ru" if i % 2 else "de") for i in range(1, 40)]
    net = langid.learnt(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 600)
    score = langid.predictor(net)()
    assert score([b"eins zwei drei " * 20, "один два три ".encode() * 20])[0] == ["de", "ru"]


def plain_grams(text, orders):
    """The distinct hashed n-grams of characters, one by one."""
    b, out = [ord(c) for c in text.lower()], set()
    for n in orders:
        for i in range(len(b) - n + 1):
            h = b[i]
            for c in b[i + 1 : i + n]:
                h = (h * 0x01000195 + c) % (1 << 32)
            k = ((h ^ (h >> 15)) * 0x9E3779B1 + n * 7919) % (1 << 32)
            out.add(k * 0x9E3779B1 % (1 << 32) >> (32 - hashed.BITS))
    return out


@pytest.mark.parametrize("orders", [toxicity.ORDERS, hashed.ORDERS])
def test_scores_against_plain(frame, orders):
    """N-grams are of characters: letters beyond ASCII count as one, capitals of any script as small ones."""
    texts = ["", "abc", "Ещё ОДИН раз", "ещё один раз", "straße " * 30, "x" * 50_000, "ab" * 3]
    for t in texts:
        assert set(hashed.present(t.encode(), orders).tolist()) == plain_grams(t, orders)
    index = np.array(sorted(set().union(*[plain_grams(t, orders) for t in texts]))[::2], np.uint32)
    weight = np.random.default_rng(1).normal(0, 0.5, len(index)).astype(np.float32)
    model = hashed.HashedLinear(index, weight, -0.3, orders)
    table = dict(zip(index.tolist(), weight.tolist(), strict=True))
    want = [1 / (1 + np.exp(0.3 - sum(table.get(g, 0.0) for g in plain_grams(t, orders)))) for t in texts]
    got = {r["row"]["doc_id"]: r for r in toxicity.scored(frame(list(enumerate(texts)) + [(99, None)]), model).collect()}
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want) and got[99]["score"] == got[0]["score"] and got[2]["score"] == got[3]["score"]
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_log_count_ratios_against_plain():
    texts, y = [b"good day", b"good night", b"bad day", b"bad bad", b"bad luck", b"bad day", b"bad eggs"], np.array([0, 0, 1, 1, 1, 1, 1.0])
    r = toxicity.log_count_ratios(texts, y)
    for g in plain_grams("bad ", (4,)):
        assert r[g] == pytest.approx(np.log((5 + 1) / (5 + 2)) - np.log((0 + 1) / (2 + 2))) if abs(np.log(6 / 7) - np.log(1 / 4)) >= toxicity.LEAST_RATIO else r[g] == 0


def test_training_texts_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, (f"bad{i} " if i % 2 else f"good{i} ") * 2_000) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    seen = []
    plain = toxicity.train
    toxicity.train = lambda texts, y, weights: seen.append((sum(map(len, texts)), weights)) or plain(texts, y, weights)
    try:
        model = toxicity.learnt(docs, labels, most=200_000)
    finally:
        toxicity.train = plain
    # about 200,000 bytes of either class; each drawn row stands for its share of all labels
    assert 200_000 < seen[0][0] < 650_000 and min(seen[0][1]) > 2
    assert [p["predicted"] for p in toxicity.scored(docs.limit(2), model).collect()] in ([0, 1], [1, 0])


def plain_measures(text):
    """The definitions of MEASURES, character by character."""
    raw = text.encode()
    w = raw.split()
    if not w:
        return [None] * 6 + [0.0]
    blanks = sum(raw.count(c) for c in (b" ", b"\n", b"\r", b"\x0b", b"\x0c"))
    solid = max(1, len(raw) - blanks)
    odd = sum(chr(c) in "!\"#$%&*+/<=>@[\\]^_`{}~|\t" for c in raw)
    large, small = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            again += len(line) if line in seen else 0
            seen.add(line)
    parts = [w[i : i + 1000] for i in range(0, len(w), 1000)]
    return [odd / solid, large / (large + small) if large + small else None, again / len(raw), sum(map(len, w)) / len(w), sum(chr(c) in "|\t" for c in raw) / solid, sum(len(set(p)) / len(p) for p in parts) / len(parts) if len(w) >= 50 else None, float(len(w))]


def test_quality_against_plain(frame, prose):
    """Measures, votes and posteriors of whole texts, one by one."""
    rng = random.Random(6)
    texts = ["", "  ", "One. Two!", "ABC DEF", "a|b|c\td", "same line\nsame line\nsame line", " ".join(prose(1500, 3)), "".join(rng.choice("aB|# \n.é") for _ in range(3000)), "word " * 80]
    model, scorer = quality.learnt(frame([(i, t) for i, t in enumerate(texts * 20)]))
    got = {r["row"]["doc_id"]: r for r in quality.scored(frame(list(enumerate(texts))), model, scorer).collect()}
    for i, t in enumerate(texts):
        m = plain_measures(t)
        assert quality.measures(t.encode()) == [pytest.approx(v) if v is not None else None for v in m]
        bits, doubts = [], 0
        for v, (_, bad, good, larger) in zip(m, quality.MEASURES, strict=True):
            bits.append(v is not None and (v > bad if larger else v < bad))
            doubts += v is not None and (v > good if larger else v < good)
        ends = sum(t.count(c) for c in (". ", ".\n", "! ", "? ")) + (t.rstrip()[-1:] in (".", "!", "?") and bool(t.rstrip()))
        bits += [doubts > 0, doubts == 0, not any(bits) and ends > 0 and m[-1] / max(1, ends) < 60]
        odds = model.prior / (1 - model.prior)
        for j, v in enumerate(bits):
            odds *= model.rate[1, j] / model.rate[0, j] if v else (1 - model.rate[1, j]) / (1 - model.rate[0, j])
        assert got[i]["weak"] == pytest.approx(odds / (1 + odds)) and got[i]["good"] == (got[i]["score"] >= 0.5)


def test_empty_tables_and_clashing_columns(spark, frame):
    none = frame([])
    assert langid.identified(none, None).count() == 0 and toxicity.scored(none, toxicity.train([], [])).count() == 0
    model, scorer = quality.learnt(none)
    assert quality.scored(none, model, scorer).count() == 0
    odd = frame([(1, "good words here."), (1, "good words here.")]).selectExpr("doc_id", "text", "'x' as score", "true as good", "5 as weak", "'y' as lang_pred", "2 as predicted", "struct(1 as a) as row")
    rows = quality.scored(odd, model, scorer).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["row"]["score"] == "x"
    assert toxicity.scored(odd, toxicity.train([b"a", b"b"], [0, 1])).first()["row"]["predicted"] == 2 and langid.identified(odd, None).first()["lang_pred"] == "und"

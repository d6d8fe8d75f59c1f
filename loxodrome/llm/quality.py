"""Quality by weak labels: heuristic labellers, EM for their accuracies, a linear scorer of hashed n-grams.

Each labeller votes for its one class (bad for those that look for a defect, good for those that
look for ordinary prose) or abstains. Over the counts of all documents' vote patterns (at most
2 ** 10 of them reach the driver, whatever the corpus) expectation-maximisation estimates how often
each labeller votes on documents of either class, and so how often its votes are right, and with
that the chance that a document of a pattern is good.
Those chances are the labels of about TRAIN_DOCS documents (those with the smallest hashes), on which a linear scorer of hashed character n-grams is trained. The patterns are counted
over all documents; only the scorer's fit is on the bounded sample.

Defined results: null and empty texts, and those without words, are voted bad for their length; an
empty table gives an empty result; repeated rows each get
their row; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.arrow_rows import added
from loxodrome.llm.common import sampled
from loxodrome.llm.hashed import BITS, HashedLinear, fitted, present

TRAIN_DOCS, LEAST_TEXTS, STEPS = 4_000, 5, 100
#: Measures of a text, the values beyond which one is a defect and within which it is ordinary, and whether larger is worse.
MEASURES = [
    ("symbols", 0.12, 0.06, True),  # share of ASCII symbols other than letters, digits, blanks and common punctuation
    ("capitals", 0.5, 0.2, True),  # share of capitals among ASCII letters
    ("repeated", 0.45, 0.1, True),  # share of bytes in lines that came before in the text
    ("long words", 12.0, 9.5, True),  # mean bytes in a word
    ("tables", 0.05, 0.01, True),  # share of bars and tabs
    ("variety", 0.25, 0.4, False),  # mean share of distinct words in each thousand words, of texts of 50 words or more
    ("length", 1.0, 1.0, False),  # words
]
#: A labeller for each defect; then one for any doubtful measure, one for ordinary measures, one for sentences.
LABELLERS = [*[(m[0], False) for m in MEASURES], ("doubtful", False), ("ordinary", True), ("sentences", True)]
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 small letter, 3 symbol, 4 bar or tab, 5 blank
_KIND[65:91], _KIND[97:123] = 1, 2
for _c in b"!\"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 3
for _c in b"|\t":
    _KIND[_c] = 4
for _c in b" \n\r\x0b\x0c":
    _KIND[_c] = 5


def measures(text: bytes) -> list[float | None]:
    """The values of MEASURES; None where there is nothing to measure."""
    words = text.split()
    if not words:
        return [None] * (len(MEASURES) - 1) + [0.0]
    n = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    letters, solid = int(n[1] + n[2]), len(text) - int(n[5])
    seen: Counter = Counter(line for line in text.split(b"\n") if line.strip())
    again = sum(len(k) * (c - 1) for k, c in seen.items())
    parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
    variety = float(np.mean([len(set(p)) / len(p) for p in parts])) if len(words) >= 50 else None
    return [int(n[3] + n[4]) / max(1, solid), int(n[1]) / letters if letters else None, again / len(text), sum(map(len, words)) / len(words), int(n[4]) / max(1, solid), variety, float(len(words))]


def votes(text: bytes) -> int:
    """One bit for each labeller, set where it votes."""
    values = measures(text)
    bits = doubts = 0
    for value, (_, bad, good, larger) in zip(values, MEASURES, strict=True):
        defect = value is not None and (value > bad if larger else value < bad)
        bits = bits << 1 | defect
        doubts += value is not None and (value > good if larger else value < good)
    sound = bits == 0
    ends = sum(text.count(c) for c in (b". ", b".\n", b"! ", b"? ")) + text.rstrip()[-1:].endswith((b".", b"!", b"?"))
    return bits << 3 | (doubts > 0) << 2 | (doubts == 0) << 1 | (sound and 0 < ends and values[-1] / ends < 60)


@dataclass
class LabelModel:
    """prior: the share of good documents; rate[c, j]: how often labeller j votes on documents of class c (1 good)."""

    prior: float
    rate: np.ndarray

    def good(self, patterns: np.ndarray) -> np.ndarray:
        v = digits(patterns)
        z = np.log(self.prior / (1 - self.prior)) + v @ np.log(self.rate[1] / self.rate[0]) + (1 - v) @ np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """The chance of each labeller, where it votes, to be right."""
        votes = np.array([1 - self.prior, self.prior])[:, None] * self.rate
        return votes[[int(g) for _, g in LABELLERS], range(len(LABELLERS))] / votes.sum(0)


def digits(patterns: np.ndarray) -> np.ndarray:
    """(patterns, labellers): 1 where a labeller votes."""
    return np.stack([patterns >> (len(LABELLERS) - 1 - j) & 1 for j in range(len(LABELLERS))], 1)


def estimated(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """The label model of these vote patterns by EM, begun with votes for bad outweighing those for good."""
    v, for_good = digits(patterns), np.array([g for _, g in LABELLERS])
    against, favour = (v * ~for_good).sum(1), (v * for_good).sum(1)
    good = np.where(against > 0, np.where(against > favour, 0.02, 0.2), 0.95)
    model = LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5))
    for _ in range(STEPS if len(patterns) else 0):
        share = np.stack([counts * (1 - good), counts * good])
        model = LabelModel(float(np.clip(share[1].sum() / counts.sum(), 0.001, 0.999)), (share @ v + 0.5) / (share.sum(1, keepdims=True) + 1))
        new = model.good(patterns)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return model


def voted(docs: DataFrame) -> DataFrame:
    """row, pattern."""
    return added(docs, "text", [("pattern", "int", pa.int32())], lambda: lambda texts: [[votes(t or b"") for t in texts]])


def learnt(docs: DataFrame, limit: int = TRAIN_DOCS) -> tuple[LabelModel, HashedLinear]:
    """The label model of all docs (doc_id, text), and the scorer trained on about ``limit`` of them."""
    counted = voted(docs.select("doc_id", "text")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns, counts = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float)
    model = estimated(patterns, counts)
    some = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = sorted(r["text"].encode() for r in sampled(some, limit, "doc_id", "text").select("text").collect())
    y = model.good(np.array([votes(t) for t in texts], np.int64)) if texts else np.empty(0)
    seen, weight = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS)
    for t, v in zip(texts, y, strict=True):  # one text's n-grams are held at a time
        f = present(t)
        seen[f] += 1
        weight[f] += v
    # n-grams in enough texts whose share of good texts is off the mean
    odd = np.abs(weight / np.maximum(seen, 1) - (y.mean() if len(y) else 0.5)) > 0.1
    scale = ((seen >= LEAST_TEXTS) & odd).astype(float)
    return model, fitted([f[scale[f] != 0] for f in (present(t) for t in texts)], y, scale)


def scored(docs: DataFrame, model: LabelModel, scorer: HashedLinear) -> DataFrame:
    """row (the columns of docs but text), weak (chance of good by the votes), score (by the scorer), good (score >= 0.5)."""

    def make():
        score = scorer.scorer()

        def all_(texts):
            p = score(texts)
            return model.good(np.array([votes(t or b"") for t in texts], np.int64)), p, p >= 0.5

        return all_

    return added(docs, "text", [("weak", "double", pa.float64()), ("score", "double", pa.float64()), ("good", "boolean", pa.bool_())], make)

"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The presence of each hashed n-gram (of 4, 6 or 8 characters of the text in lower case) counts as the
logarithm of the ratio of its smoothed shares among toxic and other texts. N-grams in fewer than
LEAST_TEXTS texts, or with a logarithm within LEAST_RATIO of 0, are no features: they tell the classes
apart too little to be worth a weight. Logistic regression then weighs the scaled presences.

It is trained in numpy on the driver, on about TRAIN_TOXIC toxic and TRAIN_CLEAN other labelled
documents outside the held-out fold, of TRAIN_BYTES of text in all: of either class those whose hashed
ids fall in a share of the range that meets both bounds (texts longer than LONGEST bytes are scored, but
not learnt from). Both classes are counted over all labels outside the fold, and each row of a sample
stands for as many labels as its class has for each row drawn, so that 0.5 means even odds in the corpus
at every size.

Defined results: null and empty texts get the score of a text without any n-gram; of repeated
labels the largest counts; null labels are left out; without labels, or with one class only, every
score is the share of toxic labels (0 without labels); repeated rows each get their row; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.arrow_rows import added
from loxodrome.llm.common import held_out
from loxodrome.llm.hashed import BITS, HashedLinear, fitted, present

ORDERS, TRAIN_TOXIC, TRAIN_CLEAN, LEAST_TEXTS, LEAST_RATIO = (4, 6, 8), 3_000, 5_000, 5, 2.0
#: Bytes of text that reach the driver for each class, and of one text.
TRAIN_BYTES, LONGEST = 32_000_000, 1_000_000


def log_count_ratios(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """For each feature the log of the ratio of its smoothed shares in the two classes; 0 where it is rare or tells little. One text's features are held at a time."""
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for t, v in zip(texts, y, strict=True):
        (pos if v else neg)[present(t, ORDERS)] += 1
    r = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    return np.where((pos + neg >= LEAST_TEXTS) & (np.abs(r) >= LEAST_RATIO), r, 0.0)


def train(texts: list[bytes], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> HashedLinear:
    """weights: how many labels a text of the class 0 and of the class 1 stands for."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.0
        return HashedLinear(np.empty(0, np.uint32), np.empty(0, np.float32), 30.0 if share else -30.0)
    scale = log_count_ratios(texts, y)
    features = [f[scale[f] != 0] for f in (present(t, ORDERS) for t in texts)]
    return fitted(features, y, scale, ORDERS, rows=np.where(y > 0, weights[1], weights[0]))


def learnt(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, most: int = TRAIN_BYTES) -> HashedLinear:
    """The classifier trained on about so many of docs (doc_id, text) of either class, of about ``most`` bytes each, by labels (doc_id, toxic)."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("hit"))
    all_ = {r["hit"]: r["count"] for r in known.groupBy("hit").count().collect()}  # two rows
    few = F.broadcast(_sample(known, False, all_, clean).union(_sample(known, True, all_, toxic)))  # about toxic + clean rows
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id").filter(size <= LONGEST)
    sizes = {r["hit"]: r["bytes"] for r in some.groupBy("hit").agg(F.sum(size).alias("bytes")).collect()}
    share = {h: min(1.0, most / max(1, sizes.get(h, 0))) for h in (False, True)}
    unit = (F.xxhash64("doc_id", F.lit("bytes")) / F.lit(float(1 << 64))) + 0.5
    pairs = sorted(((r["text"] or "").encode(), int(r["hit"])) for r in some.filter(unit <= F.when(F.col("hit"), share[True]).otherwise(share[False])).select("text", "hit").dropDuplicates().collect())
    drawn = {h: sum(y == h for _, y in pairs) for h in (False, True)}
    weights = [max(1.0, all_.get(h, 0) / max(1, drawn[h])) if all_.get(h, 0) > limit or share[h] < 1 else 1.0 for h, limit in ((False, clean), (True, toxic))]
    return train([t for t, _ in pairs], [y for _, y in pairs], tuple(weights))


def _sample(known: DataFrame, hit: bool, all_: dict[bool, int], limit: int) -> DataFrame:
    """doc_id, hit: of the labels of one class about so many, those whose hashes fall in that share of the range."""
    own = known.filter(F.col("hit") == hit)
    return own if all_.get(hit, 0) <= limit else own.filter(F.xxhash64("doc_id") < -(1 << 63) + (1 << 64) * limit // all_[hit])


def scored(docs: DataFrame, model: HashedLinear) -> DataFrame:
    """row (the columns of docs but text), score (0 to 1), predicted (1 if score >= 0.5)."""

    def make():
        score = model.scorer()

        def both(texts):
            p = score(texts)
            return p, (p >= 0.5).astype(np.int32)

        return both

    return added(docs, "text", [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], make)

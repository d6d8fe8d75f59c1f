"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes (the last one filled up with zeros). Filters of several
widths slide over each window, the maximum of each filter over the window is taken, and a softmax
layer over the maxima gives the languages' shares; a document's shares are the means of those of
all its windows, weighted by their bytes. A filter is a table of 256 values for each of its
places, so a convolution is a sum of table rows; two places are looked up at once.

The network is trained in numpy on the driver, on about TRAIN_WINDOWS windows of labelled documents
outside the held-out fold: of all windows of their whole texts those whose hashes fall in that share of
the range, so that every place of every labelled text has the same chance.

Defined results: null text, or one without any letter, is ``und`` with score 0; without labelled
rows every document is ``und``; repeated rows each get their row; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.arrow_rows import added
from loxodrome.llm.common import held_out

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Windows that are trained on, of WINDOW code points each before they are cut to WINDOW bytes.
TRAIN_WINDOWS = 12_000
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 4, 300, 128, 0.01, 7
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """tables[w]: (w, 256, FILTERS) for each width; bias (F,), out (F, L), out_bias (L,)."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of table rows for two bytes at once: of the places 0 and 1, and of the places 2 and 3."""
        first, second = [], []
        for w in WIDTHS:
            t = self.tables[w]
            first.append((t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1))
            if w > 2:
                rest = t[3][None, :, :] if w > 3 else np.zeros((1, 256, FILTERS), np.float32)
                second.append((t[2][:, None, :] + rest).reshape(65536, -1))
        return np.ascontiguousarray(np.concatenate(first, 1)), np.ascontiguousarray(np.concatenate(second, 1))


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, WINDOW), the number of the text each belongs to, and its bytes in use."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    used = np.full(int(counts.sum()), WINDOW, np.float32)
    k = 0
    for t, c in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        k += int(c)
        used[k - 1] = max(1, len(t) - (int(c) - 1) * WINDOW)
        at += int(c) * WINDOW
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts), used


def pooled(windows: np.ndarray, first: np.ndarray, second: np.ndarray, chunk: int = 32) -> np.ndarray:
    """The maximum of each filter over each window."""
    n = len(windows)
    out = np.empty((n, first.shape[1]), np.float32)
    padded = np.zeros((n, WINDOW + 3), np.uint16)
    padded[:, :WINDOW] = windows
    pair = (padded[:, :-1] << 8) | padded[:, 1:]
    for at in range(0, n, chunk):
        p = pair[at : at + chunk]
        a = np.take(first, p[:, :WINDOW], axis=0, mode="clip")
        a[:, :, FILTERS:] += np.take(second, p[:, 2 : WINDOW + 2], axis=0, mode="clip")
        a.max(axis=1, out=out[at : at + chunk])
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str]) -> ByteConvNet | None:
    """The network of these windows (each at most WINDOW bytes) and their languages, by Adam on the cross entropy."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    x, _, _ = packed([t[:WINDOW] for t in texts])
    padded = np.zeros((len(x), WINDOW + 3), np.uint8)
    padded[:, :WINDOW] = x
    y = np.searchsorted(langs, labels)
    f = FILTERS * len(WIDTHS)
    net = ByteConvNet(langs, {w: rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*[net.tables[w] for w in WIDTHS], net.bias, net.out, net.out_bias]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    # few windows are gone over more often
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(x))))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            b = padded[rows]
            peak, where = [], []
            for w in WIDTHS:
                z = sum(net.tables[w][j][b[:, j : j + WINDOW]] for j in range(w))
                where.append(z.argmax(axis=1))
                peak.append(np.take_along_axis(z, where[-1][:, None, :], axis=1)[:, 0, :])
            z = np.concatenate(peak, 1) + net.bias
            h = np.maximum(z, 0)
            g = softmax(h @ net.out + net.out_bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = (g @ net.out.T) * (z > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                gt = np.zeros_like(net.tables[w])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at_byte = np.take_along_axis(b, where[k] + j, axis=1)
                    np.add.at(gt[j], (at_byte, np.broadcast_to(np.arange(FILTERS), at_byte.shape)), part)
                grads.append(gt)
            grads += [back.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for p, gr, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (gr - m)
                s += 0.001 * (gr * gr - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def learnt(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> ByteConvNet | None:
    """The network trained on about ``limit`` windows of the labelled rows of docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.char_length("text") > 0) & ~held_out(F.col("doc_id")))
    last = F.floor((F.char_length("text") - 1) / WINDOW).cast("int")
    n = rows.agg(F.coalesce(F.sum(last.cast("bigint") + 1), F.lit(0))).first()[0]
    below = -(1 << 63) + (1 << 64) * limit // n if n > limit else (1 << 63) - 1
    own = rows.withColumn("own", F.xxhash64("doc_id", "text", "lang"))
    places = F.filter(F.sequence(F.lit(0), last), lambda k: F.xxhash64("own", k) <= below)
    cuts = own.select("lang", F.col("text"), F.explode(places).alias("k")).select("lang", F.expr(f"substring(text, k * {WINDOW} + 1, {WINDOW})").alias("cut"))
    some = sorted((r["lang"], r["cut"]) for r in cuts.distinct().collect())  # about limit rows of WINDOW code points
    return train([cut.encode() for _, cut in some], [lang for lang, _ in some])


def predictor(net: ByteConvNet | None):
    """What makes, in a worker, the function from texts to languages and scores."""

    def make():
        import regex

        letter = regex.compile(r"\p{L}")
        if net is None:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
        first, second = net.pairs()

        def score(texts: list[bytes | None]) -> tuple[list, list]:
            plain = [t or b"" for t in texts]
            windows, owner, used = packed(plain)
            share = softmax(np.maximum(pooled(windows, first, second) + net.bias, 0) @ net.out + net.out_bias)
            total = np.stack([np.bincount(owner, share[:, k] * used, len(texts)) for k in range(len(net.langs))], 1)
            total /= np.bincount(owner, used, len(texts))[:, None]
            best = total.argmax(1)
            known = [bool(letter.search(t.decode("utf-8", "replace"))) for t in plain]
            return [net.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(min(1.0, total[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]

        return score

    return make


def identified(docs: DataFrame, net: ByteConvNet | None, keep_text: bool = False) -> DataFrame:
    """row (the columns of docs but text), with keep_text the text, lang_pred, score."""
    return added(docs, "text", [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())], predictor(net), keep_text)

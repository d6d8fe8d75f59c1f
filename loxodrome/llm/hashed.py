"""Hashed character n-grams and linear scorers over them, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS, ORDERS = 20, (3, 4, 5)
_STEP, _SPREAD = np.uint32(0x01000195), np.uint32(0x9E3779B1)


def grams(text: bytes, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> list[np.ndarray]:
    """For each order the hashes, in text order, of the n-grams of the characters (code points) of UTF-8 text in lower case."""
    b = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    h, out = b, []
    for n in range(2, max(orders) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _STEP
        h += b[n - 1 :]
        if n in orders:
            k = h ^ (h >> np.uint32(15))
            k *= _SPREAD
            k += np.uint32(n * 7919)
            k *= _SPREAD
            k >>= np.uint32(32 - bits)
            out.append(k)
    return out


def present(text: bytes, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """The distinct hashes of a text's n-grams."""
    found = grams(text, orders, bits)
    if not found:
        return np.empty(0, np.uint32)
    seen = np.zeros(1 << bits, bool)
    for k in found:
        seen[k] = True
    return np.flatnonzero(seen).astype(np.uint32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class HashedLinear:
    """Weights of the presence of hashed n-grams; those not named are 0."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS

    def scorer(self):
        """A function from texts (UTF-8 bytes, None for null) to the probabilities of the class."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.index] = self.weight
        used = table != 0

        def score(texts: list[bytes | None]) -> np.ndarray:
            z = np.full(len(texts), self.bias)
            for i, t in enumerate(texts):
                hits = [k[used[k]] for k in grams(t or b"", self.orders)]
                if hits:
                    z[i] += table[np.unique(np.concatenate(hits))].sum(dtype=np.float64)
            return sigmoid(z)

        return score


def fitted(features: list[np.ndarray], y: np.ndarray, scale: np.ndarray, orders: tuple[int, ...] = ORDERS, ridge: float = 1e-3, epochs: int = 60, rate: float = 0.05, rows: np.ndarray | None = None) -> HashedLinear:
    """Logistic regression on scale * presence, by Adam on all rows at once; y may hold probabilities, rows the rows' weights. Features of scale 0 are left out."""
    share_of = np.full(len(y), 1 / max(1, len(y))) if rows is None else rows / rows.sum()
    kept = np.flatnonzero(scale).astype(np.int64)
    place = np.full(len(scale), -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    cols = [c[c >= 0] for c in (place[f] for f in features)]
    row = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])
    flat = np.concatenate(cols) if cols else np.empty(0, np.int32)
    value = scale[kept].astype(np.float32)[flat]
    w, m, s = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
    share = float(np.clip(share_of @ y if len(y) else 0.5, 1e-4, 1 - 1e-4))
    b, mb, sb = float(np.log(share / (1 - share))), 0.0, 0.0
    for e in range(1, epochs + 1 if len(y) and len(kept) else 1):
        g = (sigmoid(np.bincount(row, w[flat] * value, len(cols)) + b) - y) * share_of
        gw, gb = np.bincount(flat, g[row] * value, len(kept)) + ridge * w, float(g.sum())
        m += 0.1 * (gw - m)
        s += 0.01 * (gw * gw - s)
        w -= rate * (m / (1 - 0.9**e)) / (np.sqrt(s / (1 - 0.99**e)) + 1e-7)
        mb, sb = mb + 0.1 * (gb - mb), sb + 0.01 * (gb * gb - sb)
        b -= rate * (mb / (1 - 0.9**e)) / (np.sqrt(sb / (1 - 0.99**e)) + 1e-7)
    return HashedLinear(kept.astype(np.uint32), (w * scale[kept]).astype(np.float32), b, orders)

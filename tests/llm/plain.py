"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import re

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingles(text: str | None, size: int) -> set:
    w = SPACED.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(docs: list[tuple], size: int, percent: int) -> dict:
    """doc_id -> (n_shingles, smallest reachable doc_id)."""
    sets = {d: shingles(t, size) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, item ids)."""
    cut = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        cut.setdefault(str(i), set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, wins in cut.items():
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out

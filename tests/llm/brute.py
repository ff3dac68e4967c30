"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows, threshold=0.8):
    """doc_id -> (class_id, copies_id, n_links), of (doc_id, text)."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= threshold * len(x | y) - 1e-9 and x | y:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[a] = (min(seen), min([a, *(b for b in links[a] if sets[b] == sets[a])]), len(links[a]))
    return out


def window_removal(rows, window=13):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first = {}
    split = {d: words(t) for d, t in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def byte_removal(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        x = data[d]
        for i in range(len(x) - length + 1):
            first.setdefault(x[i : i + length], d)
    out = {}
    for d, x in data.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

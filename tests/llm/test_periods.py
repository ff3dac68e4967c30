import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from spikeline.llm import periods

from .tables import documents, frame


def brute(words, least=24, powers=3):
    out = []
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            stretch = words[a : i + q]
            if len(stretch) >= max(least, powers * q) and not any(stretch[:-d] == stretch[d:] for d in range(1, q)):
                out.append((a, len(stretch), q))
            i += a == i
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *told, hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_runs_equal_brute_force():
    """Few different words, planted repetitions, nested and neighbouring runs, at several thresholds."""
    r = random.Random(1)
    found = 0
    for _ in range(1500):
        words = [r.randrange(r.choice([1, 2, 3, 8])) for _ in range(r.randint(0, 120))]
        if len(words) > 10:
            a, p = r.randrange(len(words)), r.randint(1, 12)
            for i in range(a + p, min(len(words), a + r.randint(20, 100))):
                words[i] = words[i - p]
        least, powers = r.choice([(24, 3), (6, 3), (4, 2), (24, 2), (9, 4)])
        want = brute(words, least, powers)
        assert periods.periodic_runs(np.array(words, np.int64), least, powers) == want
        found += len(want)
    assert found > 1000


def test_long_texts_take_little_more_than_linear_time():
    assert periods.periodic_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 4000:
        a, b = b, b + a
    assert periods.periodic_runs(np.array(b)) == brute(b)


def test_places_keep_order_across_chunks(monkeypatch):
    monkeypatch.setattr(periods.Places, "CHUNK", 4)
    r = random.Random(2)
    numbers = r.sample(range(1000), 200)
    places, held = periods.Places(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        low, high = places.add(x)
        assert low == max((y for y in held if y < x), default=None) and high == min((y for y in held if y > x), default=None)
        held.append(x)
    assert list(places) == sorted(held)


def test_documents_equal_brute_force(spark):
    rows = [r for r in documents() if len((r[1] or "").split()) < 3000]
    line = "the same line again "
    rows += [(1000 + i, t, None, None) for i, t in enumerate([line * 9, "x " * 30, f"intro {line * 7} middle words {'a b ' * 20} end", "a b c " * 12, "once " * 23])]
    rows += [(None, line * 9, None, None), (None, None, None, None), (1000, line * 9, None, None)]
    got = periods.run_digests(frame(spark, rows).withColumn("runs", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row(r[0], r[1]) for r in rows), key=str)
    assert periods.run_digests(frame(spark, [])).collect() == []


def test_with_runs_keeps_every_column(spark):
    out = periods.with_runs(frame(spark, [(1, "a b c " * 10, "en", "s"), (2, None, None, None)]).withColumn("runs", F.lit(5))).orderBy("doc_id").collect()
    assert [tuple(x) for x in out[0]["_runs"]] == [(0, 30, 3)] and bytes(out[0]["collapsed"]) == b"a b c" and out[0]["runs"] == 5
    assert out[1]["_runs"] == [] and bytes(out[1]["collapsed"]) == b""

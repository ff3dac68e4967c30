import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeline.llm import clustering, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, size=64, seed=4):
    """(vec_id, embedding, label): clusters, copies of one vector, repeated ids, and rows that don't count."""
    r = np.random.default_rng(seed)
    middles = r.normal(0, 0.2, (5, size))
    rows = [(i, (middles[i % 5] + r.normal(0, 0.05, size)).astype(np.float32).tolist(), i % 5) for i in range(n)]
    rows += [(n + i, rows[7][1], None) for i in range(n // 3)]
    rows += [(100, rows[3][1], 1), (100, rows[100][1], 1), (None, rows[5][1], 2), (None, None, None), (-100, rows[9][1], 3)]
    odd = list(rows[0][1])
    rows += [(9000 + i, [*odd[:-1], x], 0) for i, x in enumerate((None, math.nan, math.inf, -math.inf))]
    return rows


def scaled(x):
    return [math.floor(1024 * v) for v in x]


def usable(rows, size=None):
    return [(i, scaled(v)) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and (size is None or len(v) == size)]


def brute_lloyd(rows, k=8, rounds=10, size=64):
    kept = usable(rows, size)
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            members = [v for (_, v), (_, o) in zip(kept, own) if o == j]
            if members:
                c[j] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    each = [sum(d for d, o in own if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, o, d, each[o], sum(each), sha[o]) for (i, _), (d, o) in zip(kept, own)), key=str)


def test_clusters_equal_plain_lloyd(spark):
    rows = vectors()
    rows += [(7000, [0.5] * 63, 0), (7001, [], 0)]
    got = clustering.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("cluster", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lloyd(rows)


def test_clusters_of_few_and_no_vectors(spark):
    rows = vectors()[:3]
    got = clustering.clusters(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lloyd(rows)
    assert clustering.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.clusters(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)).collect()


def test_reassignment_compares_only_what_changed(monkeypatch):
    """Equal to a full comparison, ties included, for any set of changed centroids; unmoved owners meet changed centroids only."""
    r = np.random.default_rng(0)
    x = r.integers(-4, 5, (400, 3)).astype(np.int32)
    old = r.integers(-4, 5, (6, 3))
    full = clustering.squared_distances(x, old)
    owner, distance = full.argmin(axis=1), full.min(axis=1)
    seen = []
    plain = clustering.squared_distances
    monkeypatch.setattr(clustering, "squared_distances", lambda a, b: seen.append(a.shape[0] * b.shape[0]) or plain(a, b))
    for changed in ([0], [2, 5], [], range(6)):
        flags = np.zeros(6, bool)
        flags[list(changed)] = True
        new = old.copy()
        new[flags] += 1
        seen.clear()
        got = clustering.reassigned(x, owner, distance, new, flags)
        want = plain(x, new)
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
        moved = flags[owner].sum()
        assert sum(seen) == moved * 6 + (400 - moved) * flags.sum()


def brute_top(rows, k=10, every=100):
    kept = usable(rows)
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(kept) if b != a)[:k]
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(scores)]
    return sorted(out, key=str)


def top(frame, **settings):
    return sorted(map(tuple, search.top_k(frame, **settings).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    """Small blocks, so that pairs of blocks, parts and early stops all take part; other lengths, repeated ids and nulls."""
    rows = vectors()
    r = np.random.default_rng(1)
    rows += [(200, r.normal(0, 3, 70).tolist(), 0), (300, r.normal(0, 1, 5).tolist(), 0), (400, [], 0), (7001, [], 0)]
    for name, value in (("BLOCK", 16), ("QUERIES_A_BLOCK", 2), ("GROUP", 3), ("CHUNK", 4), ("SAMPLE", 40)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search.index, "__defaults__", (1024, False, 16))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("rank", F.lit(1))
    assert top(frame) == brute_top(rows)
    assert top(frame, every=7, k=3, n_pivots=2) == brute_top(rows, 3, 7)


def test_search_of_few_and_no_vectors(spark):
    rows = vectors()[:1] + vectors()[1:4]
    assert top(spark.createDataFrame(rows, SCHEMA)) == brute_top(rows) and len(brute_top(rows)) == 3
    assert top(spark.createDataFrame(rows[:1], SCHEMA)) == []
    assert top(spark.createDataFrame([], SCHEMA)) == []
    assert top(spark.createDataFrame([(0, [0.0] * 4, 0), (1, [0.0] * 4, 0)], SCHEMA)) == [(0, 1, 1, 0)]


def test_bounds_hold_and_eliminate():
    """No score passes the cap its pivots give, and in separate clusters most candidates fall below the k-th best."""
    r = np.random.default_rng(2)
    middles = r.normal(0, 300, (12, 16))
    x = np.floor(middles[r.integers(0, 12, 2000)] + r.normal(0, 8, (2000, 16))).astype(np.int32)
    pivots = search.choose_pivots(list(x[:200]), 16, float(search.norms(x).max()))
    d, dq = pivots.of_candidates(x), pivots.of_queries(x[:50])
    scores = search.inner(x[:50], x)
    for q in range(50):
        cap = pivots.cap(search.norms(x[q : q + 1])[0], np.abs(d - dq[q]).max(axis=1).astype(float))
        assert (scores[q] <= cap).all()
        assert (cap >= np.sort(scores[q])[-11]).mean() < 0.5

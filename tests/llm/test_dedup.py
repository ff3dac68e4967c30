import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeline.llm import groups, near, sketch, substring, suffixes

from . import brute
from .tables import documents, frame


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_near_classes_match_brute_force(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["copies_id"], r["n_links"]) for r in near.near_classes(frame(spark, rows)).collect()}
    assert got == brute.near([r[:2] for r in rows])


def test_near_blocks_of_a_large_bucket(spark, monkeypatch):
    """Near copies in more than one block: each link is counted once."""
    monkeypatch.setattr(near, "BLOCK", 4)
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        w = list(base)
        w[r.randrange(90)] = f"x{i}"
        rows.append((i, " ".join(w), None, None))
    got = {x["doc_id"]: (x["class_id"], x["copies_id"], x["n_links"]) for x in near.near_classes(frame(spark, rows), recall=0.9999999).collect()}
    want = brute.near([x[:2] for x in rows])
    assert got == want


def test_near_null_ids_repeats_and_extra_columns(spark):
    text = "one two three four five six seven"
    rows = [(None, text, None, None), (4, text, None, None), (4, text, None, None), (2, text + " eight", None, None)]
    got = sorted((x["doc_id"] or -1, x["class_id"], x["n_links"]) for x in near.near_classes(frame(spark, rows).withColumn("key", F.lit(1))).collect())
    assert got == [(-1, None, 0), (2, 2, 0), (4, 4, 1), (4, 4, 1)]  # 3 of 4 shingles: below 0.8
    assert near.keep_one(frame(spark, rows)).count() == 3


def test_choose_bands_reaches_recall():
    bands, rows = near.choose_bands(0.8, 0.999, 144)
    assert bands * rows <= 144 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_intersections_agree_with_sets():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, size=r.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len({*a} & {*b}) for b in sets] for a in sets])
    got = near.intersections(sets)
    off = ~np.eye(12, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = dict(near.components(edges).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_windows_match_brute_force(spark, rows):
    for width in (1 << 24, 1 << 8):  # a sketch that is all but full loses nothing
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.word_digests(frame(spark, rows), width=width).collect()}
        assert got == brute.window_removal([r[:2] for r in rows])


def test_cut_documents_keeps_columns(spark, rows):
    docs = frame(spark, rows).withColumn("n_chars", F.length("text"))
    out = substring.cut_documents(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    want = brute.window_removal([r[:2] for r in rows])
    texts = {r[0]: r[1] for r in rows}
    for d, (n, removed, _) in want.items():
        if removed == 0:
            assert kept[d]["text"] == texts[d]
        elif removed == n:
            assert d not in kept
        else:
            assert len(brute.words(kept[d]["text"])) == n - removed and kept[d]["n_chars"] == len(kept[d]["text"])


def test_bytes_match_brute_force(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.byte_removal([r[:2] for r in rows])


def test_bytes_of_repetitive_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    r = random.Random(9)
    noise = "".join(r.choice("ab") for _ in range(4000))
    rows = [(0, "a" * 500, None, None), (1, noise, None, None), (2, "a" * 200 + noise[1000:2000], None, None), (3, "é" * 60 + "a" * 49, None, None), (4, "b" + "é" * 70, None, None), (5, noise[:49], None, None)]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute.byte_removal([x[:2] for x in rows])


def _bounded(solve, most):
    """solve, but no key may bring more than `most` contexts to one task."""

    def checked(keys, payloads, first):
        assert np.unique(keys, return_counts=True)[1].max() <= most, "one key in one task"
        return solve(keys, payloads, first)

    return checked


@pytest.mark.parametrize("heavy, broadcast", [(20, groups.BROADCAST), (2, 0)])
def test_keys_with_many_contexts_are_split(spark, monkeypatch, heavy, broadcast):
    """A passage with other text around it in each document: one key, a context a document. Also where nearly all
    keys are heavy and too many to broadcast."""
    monkeypatch.setattr(groups, "HEAVY", heavy)
    monkeypatch.setattr(groups, "BROADCAST", broadcast)
    solve, solved = substring._solve, suffixes._solved
    monkeypatch.setattr(substring, "_solve", _bounded(solve, heavy))
    monkeypatch.setattr(suffixes, "_solved", lambda length: _bounded(solved(length), heavy))
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (5, 8, 14)]
    rows = [(i, f"{prose(20)} {passages[i % 3]} {r.choice(['left', 'right', word()])} {prose(20)}", None, None) for i in range(240)]
    rows += [(500 + i, rows[i * 7][1][r.randrange(60) :], None, None) for i in range(30)] + [(600 + i, passages[2], None, None) for i in range(40)]
    r.shuffle(rows)
    docs = frame(spark, rows)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.remove_repeats(docs).collect()}
    assert got == brute.byte_removal([x[:2] for x in rows])
    got = {x["doc_id"]: tuple(x)[1:] for x in substring.word_digests(docs).collect()}
    assert got == brute.window_removal([x[:2] for x in rows])


def test_deep_shallow_orders_suffixes():
    r = np.random.default_rng(4)
    base = r.integers(97, 99, 400).astype(np.uint8)
    text = np.concatenate([base, base[50:300], base[:100], np.zeros(50, np.uint8)])
    starts = np.arange(text.size - 50)
    order, begins = suffixes.deep_shallow(text, starts)
    strings = [text[i : i + 50].tobytes() for i in order]
    assert strings == sorted(strings)
    assert begins.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_multikey_quicksort_parts_large_groups_by_pivots():
    """Runs are sorted by themselves; one of them is far beyond SMALL, so that pivots part it."""
    r = np.random.default_rng(4)
    text = np.concatenate([r.integers(97, 100, 20_000).astype(np.uint8), np.zeros(50, np.uint8)])
    starts = np.array([0, 7, 60, 61, 9000])
    edges = [*starts, 20_000]
    order, begins = suffixes.multikey_quicksort(text, np.arange(20_000), 32, starts)
    for a, b in zip(edges, edges[1:]):
        strings = [text[i : i + 32].tobytes() for i in order[a:b]]
        assert sorted(order[a:b]) == list(range(a, b)) and strings == sorted(strings)
        assert begins[a:b].tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_blind_trie_orders_strings():
    r = random.Random(6)
    strings = ["".join(r.choice("ab") for _ in range(12)).encode() for _ in range(500)]
    trie = suffixes.BlindTrie()
    for i, x in enumerate(strings):
        trie.insert(x, i)
    got = trie.groups()
    assert [strings[g[0]] for g in got] == sorted({*strings})
    assert all(len({strings[i] for i in g}) == 1 for g in got) and sum(map(len, got)) == 500


REPEATS = [(None, "x" * 80), (5, "x" * 80), (5, "x" * 80), (5, "y" * 90), (9, "x" * 80), (2, "z" * 49), (3, "z" * 49), (9, "y" * 60 + "q" * 30), (None, None), (11, None), (12, "")]
WORDS = " ".join(f"w{i}" for i in range(20))
REPEATED_WORDS = [(None, WORDS), (5, WORDS), (5, WORDS), (5, WORDS + " and more"), (9, WORDS), (2, "a b c"), (3, "a b c"), (7, "before " + WORDS), (None, None), (11, None), (12, "")]


def named(removal, rows):
    """Brute force over rows with repeated and null ids: none is smaller than itself or than null."""
    out = []
    for i, (d, t) in enumerate(rows):
        alone = [(0, t)] if d is None else [*[(-j - 1, x) for j, (e, x) in enumerate(rows) if e is not None and e < d], (0, t)]
        out.append((d, *removal(alone)[0]))
    return sorted(out, key=repr)


def test_bytes_with_null_and_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame(REPEATS, "doc_id long, text string")
    for name in ("found", "_id", "row", "h1", "key", "n_bytes"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted((tuple(x) for x in suffixes.remove_repeats(docs).collect()), key=repr) == named(brute.byte_removal, REPEATS)


def test_words_with_null_and_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame(REPEATED_WORDS, "doc_id long, text string")
    assert sorted((tuple(x) for x in substring.word_digests(docs).collect()), key=repr) == named(brute.window_removal, REPEATED_WORDS)
    for name in ("_found", "_copy", "_row", "_id", "_h1", "_mine1", "row"):
        docs = docs.withColumn(name, F.lit("x"))
    out = substring.cut_documents(docs)
    assert out.columns == docs.columns and {r["_row"] for r in out.collect()} == {"x"}
    want = [(d, n - k) for d, n, k, _ in named(brute.window_removal, REPEATED_WORDS) if n == 0 or n > k]
    assert sorted(((r["doc_id"], len(brute.words(r["text"]))) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_sketch_parts_merge_alike(spark, monkeypatch):
    """Merged in one step or two, with lists or dense counts, the bits are the same."""
    docs = spark.range(4000).repartition(6)

    def keys_of(batches):
        for batch in batches:
            k = batch.column(0).to_numpy().astype(np.uint64)
            yield k, k % np.uint64(2500)

    one = sketch.unpacked(sketch.repeated(docs, keys_of, 4000, 1 << 14))
    monkeypatch.setattr(sketch, "MERGE_BYTES", 1000)
    two = sketch.unpacked(sketch.repeated(docs, keys_of, 4000, 1 << 14))
    assert (one == two).all() and sketch.estimated_repeated(one, np.arange(1500, dtype=np.uint64)).all()
    assert [sketch.width_for(x) for x in (0, 1e6, 1e12)] == [1 << 20, 1 << 22, 1 << 29]


def test_sketch_never_underestimates(spark):
    keys = np.arange(1000, dtype=np.uint64)
    docs = spark.createDataFrame([(0,), (1,), (2,)], "k long").repartition(3)

    def keys_of(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                mine = keys[k * 300 : k * 300 + 400]
                yield np.zeros(mine.size, np.uint64), mine

    bits = sketch.unpacked(sketch.repeated(docs, keys_of, 1200, 1 << 16))
    found = sketch.estimated_repeated(bits, keys)
    assert found[300:400].all() and found[600:700].all()
    assert found[:300].mean() < 0.1


@pytest.mark.parametrize("query", [lambda d: near.near_classes(d), lambda d: substring.cut_documents(d), lambda d: suffixes.remove_repeats(d)])
def test_no_rows(spark, query):
    assert query(frame(spark, [])).count() == 0

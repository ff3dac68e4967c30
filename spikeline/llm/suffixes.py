"""Suffix-array dedup: bytes in 50-byte strings that an earlier document holds.

Exact copies come first: only one text of each kind, under its least doc_id, goes
through what follows; the other documents that have it lose all of it.

Which suffixes are worth sorting: a string of LENGTH bytes is known by its key,
the least hash of the GRAM-byte runs inside. Equal strings have equal keys,
so a string can only repeat across documents if its key does. The count-min
sketch of sketch.py passes over keys seen in one document; the others bring
their contexts, the bytes of neighbouring strings with that key, and contexts meet
under it. Equal contexts are one row with their first document.

Contexts are then sorted as suffixes by deep-shallow sorting: multikey quicksort
over eight-byte characters down to SHALLOW bytes, and blind tries for the groups
that agree there and differ further on. The quicksort parts the suffixes of all open groups
at once, by three ways around a pivot of each group. Neighbours with a common prefix of LENGTH bytes are equal
strings; the least document of each such group is its first. Every context
returns to its occurrences with the first documents of its strings.

Texts are told apart by 128 hash bits and their least doc_id; strings by their bytes.
Nulls: a null text has no bytes; rows without doc_id neither lose bytes nor cause
others to. Texts of fewer than 50 bytes keep everything. Rows that repeat a doc_id aren't
smaller than each other. Extra columns don't matter; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_texts, materialize, mixed, read, sliding, text_hashes, utf8
from .groups import MOST, covered, found_in, losses, without_text
from .sketch import estimated_repeated, repeated, unpacked

LENGTH = 50
GRAM = 24  # a multiple of 8
SHALLOW = 32
PIECE = 1 << 20  # bytes that a task hashes at once


# -- sorting ------------------------------------------------------------------


def _characters(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that orders as they do."""
    return text[at[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)


SMALL = 24  # suffixes; groups of no more are put in order at once


def multikey_quicksort(text: np.ndarray, suffixes: np.ndarray, shallow: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `shallow` bytes, and where groups that agree in them begin.
    If `starts` is given, runs of suffixes start there and each is put in order by itself.

    Characters have eight bytes. A round parts every open group three ways around a pivot,
    the median of three of its members' characters: those below it, those equal to it, which go on with
    the next character, and those above. Groups up to SMALL are ordered by the character itself. text
    must go on for `shallow` bytes after each suffix.
    """
    order = suffixes.copy()
    depth = np.zeros(order.size, np.int64)  # how far a place's group agrees
    begins = np.zeros(order.size, bool)
    begins[:1] = True
    if starts is not None:
        begins[starts] = True
    while True:
        lone = begins & np.append(begins[1:], True)[: order.size]
        open_ = np.flatnonzero(~lone & (depth < shallow))
        if not open_.size:
            return order, begins
        first = np.flatnonzero(begins[open_])
        size = np.diff(np.append(first, open_.size))
        group = np.repeat(np.arange(first.size), size)
        c = _characters(text, order[open_] + depth[open_])
        a, b, z = c[first], c[first + size // 2], c[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), z))[group]
        side = np.where((size <= SMALL)[group], c, (c > pivot).astype(np.uint64) + (c >= pivot).astype(np.uint64))
        sorted_ = np.lexsort((side, group))
        order[open_] = order[open_[sorted_]]
        side, same = side[sorted_], (c == pivot)[sorted_]
        depth[open_] += np.where((size <= SMALL)[group], 8, 8 * same)
        begins[open_] = np.append(True, (np.diff(group) != 0) | (side[1:] != side[:-1]))


class BlindTrie:
    """Strings in order, told apart by the first byte in which they differ.

    A node knows how far its leaves agree, not what they agree in. An insertion
    walks down by single bytes, compares the string with the leaf it meets once,
    and branches where the two differ.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [-1, [members], string]; node: [depth, {byte: child}]

    def insert(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, [member], string]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[2]
        if string == other:
            node[1].append(member)
            return
        lo, hi = 0, len(string)  # the first difference, by halves
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if string[lo : mid + 1] == other[lo : mid + 1] else (lo, mid)
        up, node = None, self.root
        while node[0] >= 0 and node[0] < lo:
            up, node = node, node[1][string[node[0]]]
        leaf = [-1, [member], string]
        if node[0] == lo:
            node[1][string[lo]] = leaf
            return
        branch = [lo, {string[lo]: leaf, other[lo]: node}]
        if up is None:
            self.root = branch
        else:
            up[1][string[up[0]]] = branch

    def groups(self) -> list[list[int]]:
        """Members in order, those of equal strings together."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                out.append(node[1])
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(text: np.ndarray, suffixes: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (each of the runs that begin at `starts`) in the order of their first `length` bytes, and for
    each whether it begins a group of equal ones. text: uint8, with `length` bytes after each suffix."""
    shallow = min(shallow, length // 8 * 8)
    order, begins = multikey_quicksort(text, suffixes, shallow, starts)
    edges = np.append(np.flatnonzero(begins), order.size)
    sizes = np.diff(edges)
    many = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not many.size:
        return order, begins
    # groups that agree to the end would be tries of one leaf
    head = np.repeat(order[edges[:-1]], sizes)
    rest = np.arange(shallow, length)
    differs = np.zeros(order.size, bool)
    for part in np.array_split(many, many.size // 20_000 + 1):
        differs[part] = (text[order[part, None] + rest] != text[head[part, None] + rest]).any(axis=1)
    data = text.tobytes()
    for g in np.flatnonzero(np.logical_or.reduceat(differs, edges[:-1])):
        a, b = edges[g], edges[g + 1]
        group = order[a:b].copy()
        trie = BlindTrie()
        for i, s in enumerate(group.tolist()):
            trie.insert(data[s + shallow : s + length], i)
        at = a
        for same in trie.groups():
            order[at : at + len(same)] = group[same]
            begins[at : at + len(same)] = False
            begins[at] = True
            at += len(same)
    return order, begins


# -- keys ---------------------------------------------------------------------


def gram_values(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on where there are as many."""
    size = data.size - GRAM + 1
    words = np.empty(data.size - 7, np.uint64)
    raw = data.tobytes()
    for k in range(8):
        n = (data.size - k) // 8
        words[k::8] = np.frombuffer(raw, "<u8", n, k)[: words[k::8].size]
    out = mixed(words[:size])
    for k in range(8, GRAM, 8):
        out = mixed(out + words[k : size + k])
    return out


def string_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, strings, key) of the runs of neighbouring strings with one key, MOST strings
    at most, in data, which holds texts of `length` bytes or more that end at `ends`."""
    if data.size < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(gram_values(data), length - GRAM + 1)
    there = np.ones(data.size, bool)  # strings that reach beyond their text aren't
    for e in ends.tolist():
        there[e - length + 1 : e] = False
    there = there[: least.size]
    begin = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (there[1:] != there[:-1])))
    size = np.diff(np.append(begin, least.size))
    begin, size = begin[there[begin]], size[there[begin]]
    parts = -(-size // MOST)
    step = MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    at = np.repeat(begin, parts) + step
    return at, np.minimum(np.repeat(size, parts) - step, MOST), least[at]


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int]], np.ndarray]]:
    """Batches' texts (column 0) in pieces of about PIECE bytes: (batch, [(row, start, end) of
    the bytes], the bytes). A long text comes in parts that overlap by length - 1 bytes."""
    for batch in batches:
        column = batch.column(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        values = column.buffers()[2]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        spans: list[tuple[int, int, int]] = []
        size = 0
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for start in range(a, max(a + 1, b - length + 1), PIECE):
                end = min(b, start + PIECE + length - 1)
                if end - start < length:
                    continue
                spans.append((row, start - a, end - a))
                size += end - start
                if size >= PIECE:
                    yield batch, spans, np.concatenate([data[offsets[r] + s : offsets[r] + e] for r, s, e in spans])
                    spans, size = [], 0
        if spans:
            yield batch, spans, np.concatenate([data[offsets[r] + s : offsets[r] + e] for r, s, e in spans])


def _string_keys(length: int):
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, spans, data in _pieces(batches, length):
            ends = np.cumsum([e - s for _, s, e in spans])
            at, _, keys = string_runs(data, ends, length)
            yield np.array([r for r, _, _ in spans])[np.searchsorted(ends, at, "right")], keys

    return keys_of


def contexts(texts: DataFrame, length: int = LENGTH, width: int | None = None) -> DataFrame:
    """key, context, doc_id, row and at, where the context starts, of all keys estimated to be in more
    than one text. texts: of distinct_texts()."""
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    bits = repeated(texts.select("text"), _string_keys(length), size / ((length - GRAM) / 2 + 1), width)
    names = ["key", "context", "doc_id", "row", "at"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = unpacked(bits)
        for batch, spans, data in _pieces(batches, length):
            ends = np.cumsum([e - s for _, s, e in spans])
            at, n, keys = string_runs(data, ends, length)
            some = estimated_repeated(sketch, keys)
            at, n, keys = at[some], n[some], keys[some]
            if not at.size:
                continue
            which = np.searchsorted(ends, at, "right")
            begin = np.append(0, ends[:-1])[which]
            last = at + n + length - 1
            raw = data.tobytes()
            rows = np.array([r for r, _, _ in spans])[which]
            place = at - begin + np.array([s for _, s, _ in spans])[which]
            payload = pa.array([raw[a:b] for a, b in zip(at.tolist(), last.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), payload, batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(place)], names=names)

    return texts.select("text", "doc_id", "row").mapInArrow(found, "key long, context binary, doc_id long, row long, at long")


# -- groups -------------------------------------------------------------------


def _solved(length: int):
    def solve(keys: np.ndarray, texts: list[bytes], first: np.ndarray) -> list[list[int]]:
        """The first document of each string of each context."""
        sizes = np.array([len(x) for x in texts])
        n = sizes - length + 1
        text = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(sizes.size), n)
        suffixes = np.repeat(begin, n) + np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
        place = np.full(text.size, -1, np.int64)
        place[suffixes] = np.arange(suffixes.size)
        # equal strings have equal keys, so that each key's strings are sorted by themselves
        new = np.append(True, np.diff(keys) != 0)
        order, begins = deep_shallow(text, suffixes, length, starts=(np.cumsum(n) - n)[new])
        which, begins = place[order], np.flatnonzero(begins)
        result = np.empty(suffixes.size, np.int64)
        result[which] = np.repeat(np.minimum.reduceat(first[of[which]], begins), np.diff(np.append(begins, order.size)))
        return [x.tolist() for x in np.split(result, np.cumsum(n)[:-1])]

    return solve


def repeats(docs: DataFrame, length: int = LENGTH, width: int | None = None) -> DataFrame:
    """doc_id, h1, h2 and found of every text of `length` bytes or more, under its least doc_id:
    found holds the runs of strings that a smaller doc_id has too. docs: doc_id, text."""
    texts = distinct_texts(docs, length)
    found = materialize(contexts(texts, length, width), "contexts")
    ids = without_text(texts)
    strings = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (length - 1)), lambda i: F.substring(x, i, F.lit(length)))
    lost = losses(found, "context", F.length("context") - (length - 1), strings, _solved(length))
    return ids.join(lost, "row", "left").drop("row")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(length: int):
    """Fills in what texts with `found` lose; the other rows pass."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sha = (batch.column(x).to_pylist() for x in ("n_removed", "n_spans", "kept_sha256"))
            texts = batch.column("text")
            for i, found in enumerate(found_in(batch.column("found"))):
                if found is None:
                    continue
                data = texts[i].as_py()
                gone = covered(len(data), found, length)
                sha[i] = hashlib.sha256(np.frombuffer(data, np.uint8)[~gone]).hexdigest()
                removed[i], spans[i] = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return digests


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""
    found = repeats(docs, length, width).withColumnsRenamed({"doc_id": "_id", "h1": "_h1", "h2": "_h2"})
    h1, h2 = text_hashes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), h1.alias("h1"), h2.alias("h2"))
    joined = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    size, none = F.length("text").cast("long"), F.lit(0).cast("long")
    copy = F.col("_id").isNull() & F.col("doc_id").isNotNull() & (size >= length)  # of a text that a smaller doc_id has
    some = F.col("found").isNotNull()
    sha = F.when(copy, F.lit(hashlib.sha256().hexdigest())).when(~some, F.sha2("text", 256))
    told = joined.select("doc_id", size.alias("n_bytes"), F.when(copy, size).otherwise(none).alias("n_removed"), F.when(copy, none + 1).otherwise(none).alias("n_spans"), sha.alias("kept_sha256"), F.when(some, F.col("text")).alias("text"), "found")
    return told.mapInArrow(_digests(length), RESULT)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 50-byte strings of earlier documents cover."""
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_suffixes": op2_suffixes}
ORACLE = {
    # every string of 50 bytes as 100 hexadecimal digits
    "op2_suffixes": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, TRUE) AS begins FROM w JOIN f USING (s) WHERE first < doc_id),
e AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, b FROM e UNION ALL SELECT doc_id, n, n FROM t),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY a) AS kept FROM
    (SELECT doc_id, a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM cuts) JOIN t USING (doc_id) WHERE a >= begin GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM e GROUP BY doc_id) USING (doc_id)"""
}

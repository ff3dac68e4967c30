"""Substring dedup: 13-word windows that an earlier document holds are removed.

A count-min prefilter estimates in how many documents a window occurs. Windows
are counted under their key, the least hash of the runs of GRAM words inside:
equal windows have equal keys, so an estimate by key is never below the truth,
and neighbouring windows share keys, which makes the sketch a fifth as full. The
second pass hashes only windows estimated repeated, to 128 bits with their key, and
groups them exactly, in runs of neighbours; the first document of each group keeps
its words, the others lose them.

Exact copies come first: only one text of each kind, under its least doc_id, goes
through the two passes; the other documents that have it lose all of its words.

Texts are told apart by 128 hash bits and their least doc_id. "Exactly" above is by 128
hash bits of a window, not by its words. Nulls: a null text has no words; rows without doc_id neither lose words nor
cause others to. Texts of fewer than 13 words have no windows. Rows that repeat a
doc_id aren't smaller than each other. Extra columns don't matter; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, Vocabulary, distinct_texts, free_name, gram_hashes, materialize, mixed, read, sliding, text_hashes, utf8, words_of
from .groups import MOST, Found, covered, found_in, losses, without_text
from .sketch import estimated_repeated, repeated, unpacked

WINDOW = 13
GRAM = 6
WORDS = 100_000  # that a task hashes at once
WORD_BYTES = 6.5  # about, with the space: for the size of the sketch


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    """(batch, rows, ends, words): about WORDS words of whole texts (column 0) at a time, where each text ends."""
    for batch in batches:
        rows, ends, words = [], [], []
        for row, text in enumerate(batch.column(0)):
            own = words_of(text.as_py())
            if len(own) >= window:
                words += own
                rows.append(row)
                ends.append(len(words))
                if len(words) >= WORDS:
                    yield batch, np.array(rows), np.array(ends), words
                    rows, ends, words = [], [], []
        if rows:
            yield batch, np.array(rows), np.array(ends), words


def _windows(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start that stay within a text, and the number of that text."""
    sizes = np.diff(ends, prepend=0) - window + 1
    of = np.repeat(np.arange(ends.size), sizes)
    return np.arange(of.size) + of * (window - 1), of


def _keyed(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every run of `window` words the least hash of its runs of `gram` words."""
    return sliding(gram_hashes(words, gram), window - gram + 1)


def _window_keys(window: int, gram: int):
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vocabulary = Vocabulary()
        for _, _, ends, words in _texts(batches, window):
            at, of = _windows(ends, window)
            keys = _keyed(vocabulary.hashes(words)[0], window, gram)[at]
            new = np.append(True, (np.diff(keys) != 0) | (np.diff(of) != 0))  # neighbours mostly share their key
            yield of[new], keys[new]

    return keys_of


def _solve(keys: np.ndarray, hashes: list[list[int]], first: np.ndarray) -> list[list[int]]:
    """The first document of every window: windows are equal if key and hash are."""
    sizes = [len(x) for x in hashes]
    h = np.concatenate([np.array(x, np.int64) for x in hashes])
    k = np.repeat(keys, sizes)
    order = np.lexsort((h, k))
    begin = np.flatnonzero(np.append(True, (np.diff(k[order]) != 0) | (np.diff(h[order]) != 0)))
    out = np.empty(h.size, np.int64)
    out[order] = np.repeat(np.minimum.reduceat(np.repeat(first, sizes)[order], begin), np.diff(np.append(begin, h.size)))
    return [x.tolist() for x in np.split(out, np.cumsum(sizes)[:-1])]


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> DataFrame:
    """doc_id, h1, h2 and found of every text that may have a window, under its least doc_id:
    found holds the runs of windows that a smaller doc_id has too. docs: doc_id, text."""
    gram = min(gram, window)
    texts = distinct_texts(docs, _least_bytes(window))
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    bits = repeated(texts.select("text"), _window_keys(window, gram), size / WORD_BYTES / ((window - gram) / 2 + 1), width)
    kinds = pa.schema([("key", pa.int64()), ("hashes", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        sketch = unpacked(bits)
        for batch, rows_in, ends, words in _texts(batches, window):
            a, b = vocabulary.hashes(words)
            at, of = _windows(ends, window)
            keys = _keyed(a, window, gram)[at]
            some = np.flatnonzero(estimated_repeated(sketch, keys))
            if not some.size:
                continue
            at, of, keys = at[some], of[some], keys[some]
            hashes = b[at].copy()
            for k in range(1, window):
                hashes = hashes * ODD + b[at + k]
            # runs of neighbours with one key, MOST at most
            new = np.append(True, (np.diff(at) != 1) | (np.diff(keys) != 0) | (np.diff(of) != 0))
            start = np.flatnonzero(new)
            place = np.arange(at.size) - np.repeat(start, np.diff(np.append(start, at.size)))
            start = np.flatnonzero(new | (place % MOST == 0))
            runs_of = pa.ListArray.from_arrays(pa.array(np.append(start, at.size), pa.int32()), pa.array(mixed(hashes).view(np.int64)))
            source = rows_in[of[start]]
            own = at[start] - np.append(0, ends)[of[start]]
            which = pa.array(source)
            yield pa.RecordBatch.from_arrays([pa.array(keys[start].view(np.int64)), runs_of, batch.column(1).take(which), batch.column(2).take(which), pa.array(own)], schema=kinds)

    found = texts.select("text", "doc_id", "row").mapInArrow(estimated, "key long, hashes array<long>, doc_id long, row long, at long")
    found = materialize(found, "windows")
    ids = without_text(texts)
    lost = losses(found, "hashes", F.size("hashes"), lambda hashes: hashes, _solve)
    return ids.join(lost, "row", "left").drop("row")


def _least_bytes(window: int) -> int:
    """A text with a window has as many bytes."""
    return 2 * window - 1


def with_windows(docs: DataFrame, names: tuple[str, str], window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> DataFrame:
    """docs with two more columns: `found` of repeated_windows(), and whether a smaller doc_id has the
    whole text (which has a window or not)."""
    found, copy = names
    h1, h2 = text_hashes()
    taken = {x: free_name(docs, x) for x in ("_id", "_h1", "_h2", "_mine1", "_mine2")}
    known = repeated_windows(docs, window, gram, width).withColumnsRenamed({"doc_id": taken["_id"], "h1": taken["_h1"], "h2": taken["_h2"], "found": found})
    keyed = docs.withColumn(taken["_mine1"], h1).withColumn(taken["_mine2"], h2)
    same = (keyed["doc_id"].cast("long") == known[taken["_id"]]) & (keyed[taken["_mine1"]] == known[taken["_h1"]]) & (keyed[taken["_mine2"]] == known[taken["_h2"]])
    joined = keyed.join(known, same, "left")
    whole = known[taken["_id"]].isNull() & keyed["doc_id"].isNotNull() & (F.length(utf8(keyed["text"])) >= _least_bytes(window))
    return joined.withColumn(copy, whole).drop(*taken.values())


def _kept(words: list[bytes], found: Found | None, copy: bool, window: int) -> list[bytes]:
    if copy and len(words) >= window:
        return []
    if found is None:
        return words
    gone = covered(len(words), found, window)
    return [w for w, g in zip(words, gone) if not g]


def cut_documents(docs: DataFrame, window: int = WINDOW, width: int | None = None) -> DataFrame:
    """docs without the repeated words: such a text becomes its kept words, joined by
    spaces, n_chars its length; documents that lose every word go."""
    names = free_name(docs, "_found"), free_name(docs, "_copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = [], []
            for text, found, copy in zip(batch.column("text"), found_in(batch.column(names[0])), batch.column(names[1])):
                text, copy = text.as_py(), copy.as_py()
                if found is not None or copy:
                    words = words_of(text)
                    left = _kept(words, found, copy, window)
                    if len(left) < len(words):
                        text = b" ".join(left).decode()
                    kept.append(bool(left) or not words)
                else:
                    kept.append(True)
                texts.append(text)
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
            yield batch.drop_columns(list(names)).filter(pa.array(kept, pa.bool_()))

    out = with_windows(docs, names, window, width=width).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text)."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            found_here = found_in(batch.column("found"))
            for doc_id, text, found, copy in zip(batch.column("doc_id"), batch.column("text"), found_here, batch.column("copy")):
                words = words_of(text.as_py())
                kept = _kept(words, found, copy.as_py(), window)
                out.append((doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                ids, n, removed, sha = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = with_windows(rows, ("found", "copy"), window, gram, width)
    return marked.select("doc_id", utf8().alias("text"), "found", "copy").mapInArrow(digests, SCHEMA)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: words, words removed, and the SHA-256 of what is kept."""
    return word_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_substring": op8_substring}
ORACLE = {
    "op8_substring": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN firsts USING (g) WHERE f < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
}

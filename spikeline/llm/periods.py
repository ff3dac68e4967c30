"""Periodic runs of words, found with a suffix automaton.

A state of the automaton stands for strings that end at the same places. From the longest
states to the shortest, each hands its ordered end positions to the state of its next
shorter suffixes, the smaller set going into the larger. A position that finds a new
neighbour at a distance q no longer than the state's strings has found a square: a string
and the same string q words later overlap or touch. It is extended to both sides while
words q apart agree. Squares inside a run that is known already are not extended again.

A run of least length `least` and exponent `powers` holds neighbours at its period in a state of
length max(least - period, (powers - 1) * period) or more, so shorter states hand on nothing; and each
of its words occurs `powers` times in the text, so words that occur less often cut the
text into stretches, which go through one automaton, parted by separators of their own.

Time is about n log n, memory linear in the longest text. A text is handled whole by one
task, all else is a projection: no shuffle. Null and empty texts have no words and no runs.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read, words_of

LEAST, POWERS = 24, 3


class Places:
    """Ordered numbers in chunks: adding one tells its neighbours."""

    CHUNK = 1024

    def __init__(self, first: int):
        self.chunks, self.lasts, self.n = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """The next smaller and the next larger number; x isn't among the numbers yet."""
        k = min(bisect_left(self.lasts, x), len(self.lasts) - 1)
        chunk = self.chunks[k]
        insort(chunk, x)
        self.n += 1
        i = bisect_left(chunk, x)
        low = chunk[i - 1] if i else self.lasts[k - 1] if k else None
        high = chunk[i + 1] if i + 1 < len(chunk) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else None
        self.lasts[k] = chunk[-1]
        if len(chunk) > self.CHUNK:
            half = len(chunk) // 2
            self.chunks[k : k + 1] = [chunk[:half], chunk[half:]]
            self.lasts[k : k + 1] = [chunk[half - 1], chunk[-1]]
        return low, high

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of every state the length of its longest string, the state of its next shorter suffixes, and the place
    where it was made (-1 for copies, which own no place)."""
    lengths, links, ends, steps, last = [0], [-1], [-1], [{}], 0
    for at, c in enumerate(text):
        new = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        ends.append(at)
        steps.append({})
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = links[p]
        if p >= 0:
            q = steps[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(lengths)
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                ends.append(-1)
                steps.append(dict(steps[q]))
                links[q] = links[new] = copy
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = links[p]
        last = new
    return lengths, links, ends


def stretches(codes: np.ndarray, least: int, powers: int) -> list[int]:
    """Places where runs can lie: of stretches of `least` words or more that all occur `powers` times or more, each place,
    with a -1 after every stretch."""
    kinds, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[which] >= powers, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    out: list[int] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= least:
            out += [*range(a, b), -1]
    return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def periodic_runs(codes: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period: stretches with that smallest period, of length
    max(least, powers * period) at least, which no neighbour extends. codes: a number a word. powers: 2 or more."""
    places = stretches(codes, least, powers)
    if not places:
        return []
    cuts = iter(range(-1, -len(places) - 2, -1))
    text = [int(codes[p]) if p >= 0 else next(cuts) for p in places]  # every separator occurs once
    lengths, links, ends = automaton(text)
    words = codes.tolist()
    n = len(words)
    shortest = -(-least * (powers - 1) // powers)
    sets: dict[int, Places] = {}
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts of runs, and where these end

    def seed(first: int, q: int, length: int) -> None:
        """Strings of this length that end at text places first and first + q are equal: the run that holds them."""
        a, b = places[first] - length + 1, places[first] + q + 1
        starts, stops = known.setdefault(q, ([], []))
        k = bisect_right(starts, a) - 1
        if k >= 0 and stops[k] >= b:
            return
        while a > 0 and words[a - 1] == words[a - 1 + q]:
            a -= 1
        while b < n and words[b] == words[b - q]:
            b += 1
        k = bisect_left(starts, a)
        starts.insert(k, a)
        stops.insert(k, b)

    order = sorted((v for v in range(1, len(lengths)) if lengths[v] >= shortest), key=lengths.__getitem__, reverse=True)
    for v in order:
        own = sets.pop(v, None)
        if ends[v] >= 0:
            own = Places(ends[v]) if own is None else own  # a state that was made with a place has it from the start
        parent = links[v]
        if lengths[parent] < shortest:
            continue
        length = lengths[parent]
        large = sets.get(parent)
        if large is None and ends[parent] >= 0:
            large = Places(ends[parent])
        if large is None:
            sets[parent] = own
            continue
        if own.n > large.n:
            own, large = large, own
        sets[parent] = large
        for x in own:
            low, high = large.add(x)
            for first, second in ((low, x), (x, high)):
                if first is not None and second is not None and (powers - 1) * (q := second - first) <= length and length + q >= least:
                    seed(first, q, length)
    out = []
    for q, (starts, stops) in known.items():
        for a, b in zip(starts, stops):
            if b - a < max(least, powers * q):
                continue
            x = codes[a:b]
            if not any(np.array_equal(x[: -(q // p)], x[q // p :]) for p in _primes(q)):  # a shorter period divides this one
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def replanted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repetition planted into one document of ten, as a hash of its id says; none without an id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    gone = np.cumsum(step)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g] if runs else words


def coded(words: list[bytes]) -> np.ndarray:
    """A number for each different word."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


SPANS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """The operator for any table: adds `runs`, all periodic runs of the text, and `collapsed`, its words without
    repetitions (under names with underscores before them where docs has such columns)."""

    @F.pandas_udf(SPANS)
    def found(texts):
        import pandas as pd

        rows = []
        for x in texts:
            words = words_of(x)
            runs = periodic_runs(coded(words), least, powers)
            rows.append(([dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs))))
        return pd.DataFrame(rows, columns=["runs", "collapsed"])

    held, runs, rest = free_name(docs, "_found"), free_name(docs, "runs"), free_name(docs, "collapsed")
    out = docs.withColumn(held, found(F.col(text).cast("string")))
    return out.select(*docs.columns, F.col(held)["runs"].alias(runs), F.col(held)["collapsed"].alias(rest))


KINDS = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(doc_id: int | None, text: str | None) -> tuple:
    """The row of one document: its repetition planted, its strongest run, and hashes of all runs and of the words that stay."""
    words = replanted(words_of(text), doc_id)
    runs = periodic_runs(coded(words))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return doc_id, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def run_digests(docs: DataFrame) -> DataFrame:
    """A row a document. docs: doc_id, text."""
    schema = pa.schema(KINDS.items())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [digest(d.as_py(), t.as_py()) for d, t in zip(*batch.columns)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    return run_digests(read(spark, sf_dir, "documents"))


QUERIES = {"op12_periods": op12_periods}
ORACLE: dict[str, str] = {}

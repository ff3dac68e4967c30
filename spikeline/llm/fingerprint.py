"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0..n) give prefix arrays P[i] = sum of (c[j] + 1) * B^j for
j < i, modulo two primes. The hash of any span is (P[j] - P[i]) / B^i, so equality
of spans takes constant time and the longest common extension of two places a
binary search. A fingerprint holds, for each of SLOTS classes of spans of SPAN code
points, eight bits of the least span hash ("--" where the class is empty); the
likeness of two fingerprints is the share of slots that agree among those that
either fills, an estimate of the Jaccard likeness of the span sets. The longest common
extension from the start says how many code points a text shares with its edited text and
with the next document before they first differ.

Nulls: a null text is an empty one. Texts shorter than SPAN are one span; two
empty texts are alike (1), an empty and another one aren't (0). Documents are
ordered by doc_id (null first), ties by a hash of the text; the only document is its own next
one. Ranges hold about as many bytes each; many rows of one doc_id, or of none, are
parted by that hash, but rows that repeat both meet in one task. Extra columns don't matter; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, mixed, partitions, read

PRIMES = (2147483647, 2147483629)  # the two largest below 2^31
BASES = (1000003, 1048583)
SPAN = 12
SLOTS = 128


class Powers:
    """B^j and B^-j modulo a prime, for as many j as have been asked for."""

    def __init__(self, base: int, prime: int):
        self.prime, self.pairs = prime, [(base, np.ones(1, np.int64)), (pow(base, -1, prime), np.ones(1, np.int64))]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, (base, have) in enumerate(self.pairs):
            while have.size < n:
                have = np.concatenate([have, have * pow(base, have.size, self.prime) % self.prime])
            self.pairs[k] = (base, have)
        return self.pairs[0][1][:n], self.pairs[1][1][:n]


POWERS = tuple(Powers(b, p) for b, p in zip(BASES, PRIMES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class PrefixHash:
    """The prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.size = codes.size
        self.arrays = []
        for powers in POWERS:
            power, inverse = powers.upto(self.size + 1)
            total = np.zeros(self.size + 1, np.int64)
            np.cumsum((codes + 1) * power[: self.size] % powers.prime, out=total[1:])
            self.arrays.append((total % powers.prime, inverse, powers.prime))

    def spans(self, starts: np.ndarray | int, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length."""
        (a, i, p), (b, k, q) = self.arrays
        high = (a[starts + length] - a[starts]) % p * i[starts] % p
        low = (b[starts + length] - b[starts]) % q * k[starts] % q
        return high << 31 | low

    def all_spans(self, length: int) -> np.ndarray:
        n = self.size - length + 1
        (a, i, p), (b, k, q) = self.arrays
        high = (a[length:] - a[:n]) % p * i[:n] % p
        low = (b[length:] - b[:n]) % q * k[:n] % q
        return high << 31 | low

    def equal(self, at: int, other: PrefixHash, there: int, length: int) -> bool:
        return bool(self.spans(at, length) == other.spans(there, length))

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """How many code points from `at` on equal the other's from `there` on."""
        lo, hi = 0, min(self.size - at, other.size - there)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(at, other, there, mid) else (lo, mid - 1)
        return lo


def sketch(text: PrefixHash, span: int = SPAN, slots: int = SLOTS) -> np.ndarray:
    """A byte for each slot, -1 where it is empty. slots: a power of two."""
    out = np.full(slots, -1, np.int64)
    if text.size:
        h = np.sort(mixed(text.all_spans(min(span, text.size)).astype(np.uint64)))
        shift = 64 - slots.bit_length() + 1
        at = np.searchsorted(h, np.arange(slots, dtype=np.uint64) << np.uint64(shift))
        filled = np.diff(np.append(at, h.size)) > 0
        out[filled] = (mixed(h[at[filled]]) & np.uint64(255)).astype(np.int64)
    return out


def as_text(slots: np.ndarray) -> str:
    return "".join(["--" if x < 0 else f"{x:02x}" for x in slots.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a >= 0) | (b >= 0)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) in ranges of doc_id, each in its own task and in order; a range ends
    with the first row of the next (of the first, after the last), marked by `tail`."""
    tie = F.xxhash64("text")
    ranges = Ranges(docs, "doc_id", tie, partitions(docs), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)
    keyed = docs.select("doc_id", "text", tie.alias("tie"), ranges.number().alias("part"))
    firsts = keyed.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("x")).orderBy("part").collect()  # a row for each range
    rows = [(r["part"], r["x"]["doc_id"], r["x"]["tie"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    edges = docs.sparkSession.createDataFrame(rows, "part int, _first long, _tie long, _before int")
    joined = keyed.join(F.broadcast(edges), "part")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    before = F.struct(F.col("_before").alias("part"), F.lit(1).alias("tail"))
    first = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("tie") == F.col("_tie"))
    sent = joined.select("doc_id", "text", "tie", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("t"))
    dealt = sent.select("t.part", "t.tail", "doc_id", "text", "tie").repartitionById(ranges.count, "part")
    return dealt.sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "tie", F.col("text").asc_nulls_first()).drop("tie")


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter replaced by as many code points of the following text, or all it has."""
    n = codes.size // 4
    return np.concatenate([codes[: codes.size - n], following[:n]])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long"
ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    closed = None  # the range whose tail has come; further tails tie with it

    def row(a: tuple, b: tuple) -> tuple:
        x = edited(a[1], b[1])
        other = PrefixHash(x)
        mine = sketch(other)
        digest = hashlib.sha256(x.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return a[0], a[1].size, digest, as_text(a[3]), as_text(mine), likeness(a[3], mine), likeness(a[3], b[3]), a[2].extension(0, other, 0), a[2].extension(0, b[2], 0)

    for batch in batches:
        out = []
        for part, tail, doc_id, text in zip(*batch.columns):
            part = part.as_py()
            if part == closed:
                continue
            codes = code_points(text.as_py() or "")
            hashes = PrefixHash(codes)
            now = (doc_id.as_py(), codes, hashes, sketch(hashes))
            if held is not None:
                out.append(row(held, now))
            held = now
            if tail.as_py():
                held, closed = None, part
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, their likeness to each other and the next document's, and shared starts."""
    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_compared, SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprint": op4_fingerprint}
ORACLE: dict[str, str] = {}

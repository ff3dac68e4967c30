"""A count-min sketch of keys by document, merged from the sketches of partitions.

Every task counts its documents' keys in DEPTH rows of `width` cells, each
document once a cell, and hands on the cells it has touched, as sorted distances.
Cells are merged by ranges of CHUNK, counts ending at 2: only "more than one
document?" is asked. Where a range gets more than MERGE_BYTES, parts of the tasks are merged
first. A merging task holds one range's counts and one list at a time. What the driver
gathers and broadcasts is one bit a cell, compressed: DEPTH * width / 8 bytes.

The width follows the number of keys up to MOST cells (128 MiB of bits in all), so that is
the bound of the broadcast. Estimates are never below the truth; beyond some 180 million
keys they overestimate more, so that the exact pass has more to do but loses nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, shuffles_removed

LEAST, MOST = 1 << 20, 1 << 29
DEPTH = 2
CHUNK = 1 << 22
HELD = 1 << 21  # cells that a task collects before it hands them on
MERGE_BYTES = 256 << 20
SPARSE_16, SPARSE_32, DENSE = b"\0", b"\1", b"\2"  # what cells are given as


def width_for(keys: float) -> int:
    """Cells for about `keys` keys: three each at least, a power of two."""
    return min(MOST, max(LEAST, 1 << math.ceil(math.log2(max(1.0, 3 * keys)))))


def cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch; width: a power of two."""
    mask = np.uint64(width - 1)
    return [mixed(keys + np.uint64(d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask for d in range(1, DEPTH + 1)]


def _packed(values: np.ndarray) -> bytes:
    """Sorted offsets with repeats, as distances: of two bytes where all of them fit."""
    gaps = np.diff(values, prepend=0)
    wide = gaps.size and gaps.max() > 65535
    return (SPARSE_32 if wide else SPARSE_16) + gaps.astype(np.uint32 if wide else np.uint16).tobytes()


def _add(seen: np.ndarray, data: bytes) -> None:
    """Adds what _packed() or _merged() made to counts that end at 2."""
    if data[:1] == DENSE:
        seen += np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8)
    else:
        at = np.cumsum(np.frombuffer(data, np.uint32 if data[:1] == SPARSE_32 else np.uint16, offset=1).astype(np.int64))
        twice = at[1:][at[1:] == at[:-1]]
        seen[at] += 1  # numpy adds once a distinct cell
        seen[twice] = 2
    np.minimum(seen, 2, out=seen)


MERGED = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
MERGED_DDL = "chunk int, part int, cells binary"


def _merged(size: int, last: bool):
    """Counts by chunk and part (rows come sorted by them): as cells to add again, at last as bits."""

    def finished(key: tuple[int, int], seen: np.ndarray) -> pa.RecordBatch:
        data = zlib.compress(np.packbits(seen > 1).tobytes(), 1) if last else DENSE + zlib.compress(seen.tobytes(), 1)
        return pa.RecordBatch.from_pydict({"chunk": [key[0]], "part": [key[1]], "cells": [data]}, schema=MERGED)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, np.zeros(size, np.uint8)
        for batch in batches:
            for chunk, part, data in zip(*batch.columns):
                now = chunk.as_py(), part.as_py()
                if now != key:
                    if key is not None:
                        yield finished(key, seen)
                    key, seen = now, np.zeros(size, np.uint8)
                _add(seen, data.as_py())
        if key is not None:
            yield finished(key, seen)

    return merged


def repeated(docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], keys: float, width: int | None = None) -> Broadcast:
    """The sketch's bits. keys_of: from batches of docs, pairs of document numbers (any that differ
    within an array) and keys (uint64), each document in one array. keys: about how many there are."""
    width = width or width_for(keys)
    chunks = DEPTH * max(1, width // CHUNK)
    parts = max(1, math.ceil(2.5 * DEPTH * keys / chunks / MERGE_BYTES))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        part = TaskContext.get().partitionId() % parts

        def flushed() -> Iterator[pa.RecordBatch]:
            for d in range(DEPTH):
                if not held[d]:
                    continue
                x = np.sort(np.concatenate(held[d]).astype(np.int64))
                held[d].clear()
                keep = np.ones(x.size, bool)
                keep[2:] = x[2:] != x[:-2]  # two of a cell are enough
                x = x[keep]
                chunk = x // CHUNK
                edges = np.flatnonzero(np.diff(chunk, prepend=-1))
                for a, b in zip(edges, [*edges[1:], x.size]):
                    yield pa.RecordBatch.from_pydict({"chunk": [int(d * (width // CHUNK + 1) + chunk[a])], "part": [part], "cells": [_packed(x[a:b] - chunk[a] * CHUNK)]}, schema=MERGED)

        count = 0
        for number, some in keys_of(batches):
            for d, cell in enumerate(cells(some, width)):
                pair = np.unique((number.astype(np.uint64) << np.uint64(40)) | cell)
                held[d].append((pair & np.uint64((1 << 40) - 1)).astype(np.uint32))
            count += some.size
            if count > HELD:
                yield from flushed()
                count = 0
        yield from flushed()

    spark, size = docs.sparkSession, min(width, CHUNK)
    touched = docs.mapInArrow(partial, MERGED_DDL)
    if parts > 1:
        touched = touched.repartition(min(chunks * parts, 200_000), "chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(_merged(size, False), MERGED_DDL).withColumn("part", F.lit(0))
    bits = touched.repartition(max(chunks, partitions(docs)), "chunk").sortWithinPartitions("chunk").mapInArrow(_merged(size, True), MERGED_DDL)
    with shuffles_removed(spark):
        found = [(row.chunk, bytes(row.cells)) for row in bits.select("chunk", "cells").collect()]
    return spark.sparkContext.broadcast((width, found))


_READ: dict[int, tuple[list, np.ndarray]] = {}  # with the chunks, so that their id stays theirs


def unpacked(sketch: Broadcast) -> np.ndarray:
    """The bits by row, unpacked once in a process."""
    width, chunks = sketch.value
    known = _READ.get(id(chunks))
    if known is not None:
        return known[1]
    bits = np.zeros((DEPTH, max(1, width // 8)), np.uint8)
    for number, packed in chunks:
        d, chunk = divmod(number, width // CHUNK + 1)
        part = np.frombuffer(zlib.decompress(packed), np.uint8)
        bits[d, chunk * (CHUNK // 8) : chunk * (CHUNK // 8) + part.size] = part
    _READ.clear()
    _READ[id(chunks)] = chunks, bits
    return bits


def estimated_repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each key, whether the sketch counts it in more than one document."""
    out = np.ones(keys.size, bool)
    for row, cell in zip(bits, cells(keys, bits.shape[1] * 8)):
        out &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out

"""What the corpus operators share: inputs, written intermediates, ranges of a key."""

from __future__ import annotations

import itertools
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, everywhere in this subpackage: maximal runs without these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when these end: nothing reads them again."""
    before = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: what follows
    starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote, once all that was made of it is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


TASK_BYTES = 64 << 20  # of input files, that a task after an exchange gets at most about


def partitions(df: DataFrame) -> int:
    """Tasks for an exchange of df: spark.sql.shuffle.partitions, more where the files it comes from are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # more stands for "unknown"
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(size // TASK_BYTES, 200_000))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(col: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


def word_count(col: str | Column = "text") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def text_hashes(col: str | Column = "text") -> tuple[Column, Column]:
    """128 bits of a text, as two numbers."""
    data = utf8(col)
    return F.xxhash64(F.lit(1), data), F.xxhash64(F.lit(2), data)


def distinct_texts(docs: DataFrame, least: int) -> DataFrame:
    """text (binary), doc_id (the least that has it), h1, h2, n_bytes and row (a number of its own) of
    every text of `least` bytes or more with a doc_id. docs: doc_id, text. Copies are collapsed before the shuffle."""
    h1, h2 = text_hashes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), h1.alias("h1"), h2.alias("h2")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    one = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return materialize(one.select("text", "doc_id", "h1", "h2", F.length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "texts")


CELLS = 1024  # counts of the first look at a range of keys, at least


def numbers(values: list[int]) -> Column:
    """A constant array: one literal, however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def place(value: Column, starts: list[int]) -> Column:
    """Number of the last of the ascending starts that is at most value, -1 where there is none: two looks at about
    the root of their number each, in an expression that doesn't grow with them."""
    step = max(1, math.isqrt(len(starts)))
    group = F.size(F.filter(numbers(starts[::step]), lambda t: t <= value)) - 1
    inside = F.slice(numbers(starts), F.greatest(group, F.lit(0)) * step + 1, F.lit(step))
    return F.when(group < 0, F.lit(-1)).otherwise(group * step + F.size(F.filter(inside, lambda t: t <= value)) - 1)


class Ranges:
    """Ranges of (key, tie) with about as much weight each, in the same places however rows are dealt out.

    key: an integer column, tie: a 64-bit number that parts rows of one key (null keys, or one that
    many rows have). Weights are summed in cells; all cells of over two shares are looked at again, finer, in one
    job a round. The driver sees some four sums for every range that is wanted.
    """

    def __init__(self, df: DataFrame, key: str, tie: Column, n: int, weight: Column):
        some = F.col(key).isNotNull()
        lo, hi, total, null = df.agg(F.min(key), F.max(key), F.sum(weight), F.sum(F.when(~some, weight))).first()
        self.key, self.tie = key, tie
        share = max(1.0, (total or 0) / max(1, n))
        pieces = lambda w: max(1, min(n, round(w / share)))
        done, todo, least = [], [] if lo is None else [(int(lo), int(hi), total)], CELLS
        while todo:
            looked = [(a, b, (b - a) // max(least, 4 * pieces(w)) + 1) for a, b, w in sorted(todo)]
            todo, least = [], 16
            for i, c, w in self._sums(df, weight, looked):
                a, b, width = looked[i]
                first, last = a + c * width, min(b, a + (c + 1) * width - 1)
                if w > 2 * share and width > 1:
                    todo.append((first, last, w))
                else:
                    done.append((first, w, width == 1))
        #: where ranges start, and how many parts by tie the keys from there on have
        self.starts: list[int] = []
        self.parts: list[int] = []
        held = share  # the first cell opens a range
        for first, w, single in sorted(done):
            hot = single and w > 2 * share
            if held >= share or hot:
                self.starts.append(first)
                self.parts.append(pieces(w) if hot else 1)
                held = 0.0
            held += share if hot else w
        self.nulls = pieces(null) if null else 1
        self.before = [self.nulls + x for x in itertools.accumulate(self.parts, initial=0)][:-1]
        self.count = self.nulls + sum(self.parts)

    def _sums(self, df: DataFrame, weight: Column, looked: list[tuple[int, int, int]]) -> list:
        """(number, cell, weight) of the cells of the ranges looked at: first key, last key, a cell's width."""
        at = lambda i: F.element_at(numbers([x[i] for x in looked]), F.col("_i") + 1)
        rows = df.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("_k"), weight.alias("_w"))
        rows = rows.withColumn("_i", place(F.col("_k"), [x[0] for x in looked])).where("_i >= 0").withColumns({"_a": at(0), "_b": at(1), "_width": at(2)}).where("_k <= _b")
        cell = F.expr("cast((cast(_k as decimal(20)) - cast(_a as decimal(20))) div cast(_width as decimal(20)) as bigint)")
        return rows.groupBy("_i", cell.alias("_c")).agg(F.sum("_w")).collect()

    def _part(self, n: Column) -> Column:
        """A number below n, in the order of tie."""
        return F.least(F.floor((self.tie / 2.0**64 + 0.5) * n), n - 1).cast("int")

    def number(self) -> Column:
        """The range a row is in. Null keys come first."""
        null = self._part(F.lit(self.nulls))
        if not self.starts:
            return null
        at = F.greatest(place(F.col(self.key), self.starts), F.lit(0)) + 1
        found = F.element_at(numbers(self.before), at) + self._part(F.element_at(numbers(self.parts), at))
        return F.when(F.col(self.key).isNull(), null).otherwise(found).cast("int")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in `keys`, from batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))  # fixed values of a 64-bit finalizer


def mixed(x: np.ndarray) -> np.ndarray:
    """uint64 values, spread evenly; one-to-one."""
    x = (x ^ (x >> MIX[2])) * MIX[0]
    x = (x ^ (x >> MIX[3])) * MIX[1]
    return x ^ (x >> MIX[4])


class Vocabulary(dict):
    """Words to numbers, with two 64-bit hashes for each; forgets all beyond `most` words."""

    def __init__(self, most: int = 500_000):
        self.most, self.a, self.b = most, np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.a):
            self.a, self.b = np.concatenate([self.a, self.a]), np.concatenate([self.b, self.b])
        h = xxhash.xxh3_128_intdigest(word)
        self.a[n], self.b[n] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        self[word] = n
        return n

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.a[at], self.b[at]


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() cuts at exactly the six characters that WORD leaves out."""
    return (text.encode() if isinstance(text, str) else bytes(text or b"")).split()


ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, of the whole text where it has fewer (but some)."""
    if not words.size:
        return words
    n = min(n, words.size)
    out = words[: words.size - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = out * ODD + words[k : words.size - n + 1 + k]
    return mixed(out)


def sliding(x: np.ndarray, n: int, f=np.minimum) -> np.ndarray:
    """f (minimum or maximum) over every n consecutive values, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[:-step], x[step:])
        done += step
    return x

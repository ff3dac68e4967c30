"""Exact top-k search by inner product, with a table of distances to pivots.

Inner products order vectors as distances do once every candidate x gets one more component,
sqrt(M - |x|^2) with M the largest |x|^2, and queries a 0 there: the squared distance of query and
candidate is |q|^2 + M - 2 q.x. So the triangle inequality holds: the distance of q and x is at
least |d(q, p) - d(x, p)| for every pivot p, and the largest of these bounds caps q.x.

1. The pivot table: every vector with its distances to PIVOTS pivots, packed into blocks of
   vectors that are near the same pivot, each with the range of its distances to every pivot. Rows
   are not shuffled. Pivots are picked far from each other among SAMPLE vectors with the
   least hash of their id; which they are changes the work, never the result.
2. Queries are packed into blocks too, and start from a threshold: the k-th best score among the sample.
3. A small table pairs blocks of queries with blocks of candidates, except where the ranges of
   distances show that no score can reach any threshold.
4. The blocks that are left meet by joins, GROUP blocks of candidates a task for one block of queries, the
   most promising first. Within a block a query takes candidates in the order of their bound and stops
   at the first bound below its k-th score. The best k of each task are merged by a window.

Scores are exact integers; bounds carry more slack than rounding takes. Ties go to the smaller
vec_id (null last), then repeated rows in any order: each is a candidate of its own, and a query excludes only its own row.
Vectors that are null or hold a null or non-finite component take no part. A query meets candidates of
other lengths by the components both have. No vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clustering import integers
from .common import discard, materialize, partitions, read

K, EVERY, SCALE = 10, 100, 1024
PIVOTS, SAMPLE = 32, 4096
BLOCK, QUERIES_A_BLOCK, GROUP = 4096, 256, 64
HELD = 32 << 20  # bytes of vectors that a task sorts at once
CHUNK = 256  # candidates of one query scored at once
NO_ID = np.iinfo(np.int64).max  # stands for a null id while rows are ordered

RANGES = "lo array<double>, hi array<double>"
BLOCKS = f"n int, width int, ids array<bigint>, vectors binary, distances binary, {RANGES}"
ARROW = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("distances", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
FOUND = "query_block long, query_row int, score long, vec_id long, query_id long, own long"
FOUND_ARROW = pa.schema([("query_block", pa.int64()), ("query_row", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64())])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and of b, over the columns both have."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * max(1, w)
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def norms(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) ** 2).sum(axis=1)


class Pivots:
    """Pivots, and distances to them in the space with one more component. most: the largest squared norm of a candidate."""

    def __init__(self, rows: list[np.ndarray], most: float):
        width = max((len(r) for r in rows), default=0)
        self.rows = np.array([np.pad(r, (0, width - len(r))) for r in rows], np.int32).reshape(len(rows), width)
        self.most = most
        self.extra = np.sqrt(np.maximum(most - norms(self.rows), 0))
        self.slack = 4e-6 * np.sqrt(most) + 1e-6  # over what float32 distances and roots of small differences lose

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        both = inner(x, self.rows) + np.sqrt(np.maximum(self.most - norms(x), 0))[:, None] * self.extra[None]
        return np.sqrt(np.maximum(2 * self.most - 2 * both, 0)).astype(np.float32)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms(q)[:, None] + self.most - 2 * inner(q, self.rows), 0)).astype(np.float32)

    def cap(self, norm: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest score of candidates at least `bound` away from a query of this squared norm."""
        return (norm + self.most - np.maximum(bound - self.slack, 0) ** 2) / 2 * (1 + 1e-12) + 1


def choose_pivots(sample: list[np.ndarray], n: int, most: float) -> Pivots:
    """Of the sample, one after the other the vector farthest from those chosen; fewer than n where the rest are copies of them."""
    if not sample:
        return Pivots([], most)
    first = max(range(len(sample)), key=lambda i: int((sample[i].astype(np.int64) ** 2).sum()))
    chosen, every = [first], Pivots(sample, most)
    near = Pivots([sample[first]], most).of_candidates(every.rows)[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, Pivots([sample[chosen[-1]]], most).of_candidates(every.rows)[:, 0])
        near[chosen] = 0
    return Pivots([sample[i] for i in chosen], most)


def _valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return some.where(F.col("embedding").isNotNull() & finite)


def _packed(held: list[tuple[int, np.ndarray, np.ndarray]], pivots: Pivots, queries: bool, rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about `rows` vectors of one width, ordered by their nearest pivot. held: (width, ids, vectors)."""
    for width in sorted({w for w, _, _ in held}):
        x = np.concatenate([v for w, _, v in held if w == width])
        ids = np.concatenate([i for w, i, _ in held if w == width])
        d = pivots.of_queries(x) if queries else pivots.of_candidates(x)
        order = np.argsort(d.argmin(axis=1), kind="stable")
        for a in range(0, len(order), rows):
            at = order[a : a + rows]
            block = [[len(at)], [width], [[None if i == NO_ID else i for i in ids[at].tolist()]], [x[at].tobytes()], [d[at].tobytes()], [d[at].min(axis=0).astype(float).tolist()], [d[at].max(axis=0).astype(float).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(block, ARROW)], schema=ARROW)


def index(vectors: DataFrame, pivots: Pivots, scale: int = SCALE, queries: bool = False, rows: int = BLOCK) -> DataFrame:
    """The pivot table of valid vectors (vec_id, embedding), in blocks; as queries, with the distances queries have."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            values = integers(lists.flatten().to_numpy(zero_copy_only=False), scale)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for w in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == w)
                held.append((w, ids[own], values[starts[own][:, None] + np.arange(w)[None]].reshape(len(own), w)))
                size += 4 * w * len(own) + 16 * len(own)
            if size > HELD:
                yield from _packed(held, pivots, queries, rows)
                held, size = [], 0
        yield from _packed(held, pivots, queries, rows)

    return vectors.mapInArrow(blocks, BLOCKS)


def _matrix(cell: pa.BinaryScalar, n: int, width: int, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind).reshape(n, width) if n * width else np.zeros((n, width), kind)


def thresholds(queries: DataFrame, sample: list[tuple[int | None, np.ndarray]], pivots: Pivots, k: int) -> DataFrame:
    """Query blocks with `floors`, a score for each query that its k-th best can't be below, and the least cap of the block:
    the k-th best of the sample, without vectors of the query's own id; the least number where these are fewer."""
    none = np.iinfo(np.int64).min
    width = max((len(v) for _, v in sample), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in sample], np.int32).reshape(len(sample), width)
    ids = np.array([NO_ID if i is None else i for i, _ in sample], np.int64)
    schema = ARROW.append(pa.field("floors", pa.binary())).append(pa.field("least", pa.float64())).append(pa.field("norm", pa.float64()))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _matrix(batch.column("vectors")[i], batch.column("n")[i].as_py(), batch.column("width")[i].as_py())
                own = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                s = inner(q, x)
                s[own[:, None] == ids[None]] = none
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(q), none)
                norm = norms(q)
                # the query's own radius: candidates farther away can't reach its floor
                radius = np.where(floor == none, np.inf, np.sqrt(np.maximum(norm + pivots.most - 2 * (floor.astype(float) - 2), 0)) + pivots.slack)
                row = [*(c.slice(i, 1) for c in batch.columns), pa.array([floor.astype(np.int64).tobytes()], pa.binary()), pa.array([float(radius.max(initial=0))]), pa.array([float(norm.max(initial=0))])]
                yield pa.RecordBatch.from_arrays(row, schema=schema)

    return queries.mapInArrow(floors, f"{BLOCKS}, floors binary, least double, norm double")


def block_pairs(queries: DataFrame, candidates: DataFrame, slices: int) -> DataFrame:
    """query_block, block, apart: pairs of blocks whose ranges of distances to every pivot come within the widest radius of the block's queries.

    The stated queries against all rows, in blocks: summaries of query blocks go to each of the slices
    of candidate blocks; a row stands for QUERIES_A_BLOCK x BLOCK pairs of vectors."""
    apart = F.coalesce(F.array_max(F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("qlo", "qhi"), lambda c, q: F.greatest(c["lo"] - q["qhi"], q["qlo"] - c["hi"], F.lit(0.0)))), F.lit(0.0))
    q = queries.select("query_block", "least", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    c = candidates.select("block", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"))
    return q.join(c, "slice").withColumn("apart", apart).where(F.col("apart") <= F.col("least")).select("query_block", "block", "apart")


def best_of(joined: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """The best k of each query within each part, from rows of a query block beside a candidate block, those of
    one (query_block, part) together and by `apart`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
                now = (get("query_block"), get("part"))
                if now != key:
                    if state is not None:
                        yield state.rows()
                    key, state = now, Best(batch, i, pivots, k)
                state.meet(batch, i)
        if state is not None:
            yield state.rows()

    return joined.mapInArrow(found, FOUND)


class Best:
    """The best k candidates so far of each query of a block."""

    def __init__(self, batch: pa.RecordBatch, i: int, pivots: Pivots, k: int):
        self.pivots, self.k = pivots, k
        self.block = batch.column("query_block")[i].as_py()
        self.ids = batch.column("query_ids")[i].as_py()
        n, width = batch.column("query_n")[i].as_py(), batch.column("query_width")[i].as_py()
        self.vectors = _matrix(batch.column("query_vectors")[i], n, width).copy()
        self.distances = _matrix(batch.column("query_distances")[i], n, len(pivots.rows), np.float32).copy()
        self.floors = np.frombuffer(batch.column("floors")[i].as_buffer(), np.int64).copy()
        self.norms = norms(self.vectors)
        self.own = np.array([inner(v[None], v[None])[0, 0] for v in self.vectors], np.int64)
        self.scores = [np.zeros(0, np.int64) for _ in range(n)]
        self.found = [np.zeros(0, np.int64) for _ in range(n)]

    def meet(self, batch: pa.RecordBatch, i: int) -> None:
        n, width = batch.column("n")[i].as_py(), batch.column("width")[i].as_py()
        x = _matrix(batch.column("vectors")[i], n, width)
        d = _matrix(batch.column("distances")[i], n, len(self.pivots.rows), np.float32)
        ids = batch.column("ids")[i].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for q in range(len(self.vectors)):
            bound = np.abs(d - self.distances[q]).max(axis=1, initial=0)
            cap = self.pivots.cap(self.norms[q], bound.astype(np.float64))
            open_ = np.flatnonzero(cap >= self.floors[q])
            open_ = open_[np.argsort(-cap[open_], kind="stable")]
            for a in range(0, len(open_), CHUNK):
                at = open_[a : a + CHUNK]
                if cap[at[0]] < self.floors[q]:
                    break  # and so are all that follow
                self._take(q, inner(x[at], self.vectors[q : q + 1])[:, 0], ids[at])

    def _take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Puts candidates among the best; one more than k is kept, since a query's own row may be one of them."""
        good = scores >= self.floors[q]
        scores, ids = np.concatenate([self.scores[q], scores[good]]), np.concatenate([self.found[q], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k + 1]
        self.scores[q], self.found[q] = scores[order], ids[order]
        if len(order) > self.k:
            self.floors[q] = max(self.floors[q], scores[order[self.k]])

    def rows(self) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(s) for s in self.scores])
        ids = np.concatenate(self.found)
        columns = [pa.array(np.full(len(at), self.block, np.int64)), pa.array(at), pa.array(np.concatenate(self.scores)), pa.array(ids, mask=ids == NO_ID), pa.array(np.array(self.ids, np.int64)[at]), pa.array(self.own[at])]
        return pa.RecordBatch.from_arrays(columns, schema=FOUND_ARROW)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by `every`. vectors: vec_id, embedding."""
    valid = _valid(vectors)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    most = valid.agg(F.max(norm)).first()[0] or 0.0
    picked = valid.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = [(r["vec_id"], integers(np.array(r["embedding"], np.float64), scale)) for r in picked]
    pivots = choose_pivots([v for _, v in sample], n_pivots, most * (1 + 1e-12))
    candidates = materialize(index(valid, pivots, scale).withColumn("block", F.monotonically_increasing_id()), "pivots")
    chosen = valid.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = thresholds(index(chosen, pivots, scale, queries=True, rows=QUERIES_A_BLOCK), sample, pivots, k)
    queries = materialize(asked.withColumn("query_block", F.monotonically_increasing_id()), "queries")
    blocks = candidates.count()
    tasks = partitions(candidates)
    pairs = block_pairs(queries, candidates, max(1, min(tasks, blocks // GROUP)))
    parts = max(1, -(-blocks // GROUP))
    asking = queries.select("query_block", "floors", *[F.col(c).alias(f"query_{c}") for c in ("n", "width", "ids", "vectors", "distances")])
    joined = pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).join(candidates.drop("lo", "hi"), "block").join(asking, "query_block")
    sorted_ = joined.repartition(tasks, "query_block", "part").sortWithinPartitions("query_block", "part", "apart")
    found = materialize(best_of(sorted_, pivots, k), "found")
    discard(queries, candidates)
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of all parts of each query, without its own row: of rows with its id and its own
    score, which nothing tells apart, the first."""
    each = Window.partitionBy("query_block", "query_row")
    placed = found.withColumn("place", F.row_number().over(each.orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))).where(F.col("place") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(each)
    rank = F.col("place") - F.when(F.col("place") > F.col("itself"), 1).otherwise(0)
    rest = placed.withColumn("itself", itself).where(F.col("itself").isNull() | (F.col("place") != F.col("itself"))).withColumn("rank", rank)
    return rest.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every vector whose id is divisible by 100, among all others."""
    return top_k(read(spark, sf_dir, "embeddings"))


QUERIES = {"op13_search": op13_search}
ORACLE = {
    "op13_search": f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
}

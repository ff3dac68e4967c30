"""Centroid clustering by Delta Lloyd: rounds that compare only what has changed.

Vectors are turned into integers and kept in blocks of a written table, beside them
their assignments: owner and squared distance. The driver keeps the centroids and the
global sums and counts they are made of. A round reads the blocks, compares vectors with
the centroids that have changed, and vectors whose own centroid has moved with all of
them, and writes the blocks with their new assignments. Each block adds what went from
one centroid to another as signed integers; only these few numbers are read back, added
up by centroid and component, and put on the global sums. Sums are exact, so results
don't depend on how rows are dealt out, and nothing is shuffled but a block's transfers.

A vector counts if it has exactly `size` components, none null or non-finite; others
give no row. Repeated rows count each; rows with a null vec_id count but are never
starting centroids. Fewer vectors than centroids give fewer centroids, no vectors no
rows. Components beyond 2^27 after scaling are an error: distances wouldn't fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 27

TRANSFERS = "transfers array<struct<centroid:int,n:bigint,distance:bigint,sums:array<bigint>>>"
BLOCKS = f"ids array<bigint>, vectors binary, owners binary, distances binary, {TRANSFERS}"
KIND = pa.list_(pa.struct([("centroid", pa.int32()), ("n", pa.int64()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64()))]))
ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("owners", pa.binary()), ("distances", pa.binary()), ("transfers", KIND)])


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite values, as int32."""
    x = np.floor(values.astype(np.float64) * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}")
    return x.astype(np.int32)


def blocks(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """A row for each Arrow batch of the vectors that count, none of them assigned. vectors: vec_id, embedding."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls are NaN
            fine = np.isfinite(x).all(axis=1)
            if n := int(fine.sum()):
                ids = batch.column(0).filter(pa.array(fine))
                row = [pa.array([ids.to_pylist()], ARROW.field(0).type)]
                row += [pa.array([b], pa.binary()) for b in (integers(x[fine], scale).tobytes(), np.full(n, -1, np.int32).tobytes(), np.zeros(n, np.int64).tobytes())]
                yield pa.RecordBatch.from_arrays([*row, pa.array([[]], KIND)], schema=ARROW)

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return chosen.where(F.size("embedding") == size).mapInArrow(packed, BLOCKS)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact, of every row of x to every row of c: through doubles where all sums stay below 2^53."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, c))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T)).astype(np.int64)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after some centroids have changed; ties go to the smaller number.

    A vector whose owner stands still keeps its distance, and only a changed centroid can be nearer;
    one whose owner moved, or that has none yet, is compared with all."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = squared_distances(x[moved], centroids)
        owner[moved] = d.argmin(axis=1)  # the first of equal ones
        distance[moved] = d.min(axis=1)
    rest, some = np.flatnonzero(~moved), np.flatnonzero(changed)
    if rest.size and some.size:
        d = squared_distances(x[rest], centroids[some])
        at = d.argmin(axis=1)
        best, number = d[np.arange(rest.size), at], some[at]
        nearer = (best < distance[rest]) | (best == distance[rest]) & (number < owner[rest])
        owner[rest[nearer]], distance[rest[nearer]] = number[nearer], best[nearer]
    return owner, distance


def _round(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The blocks with new assignments. Transfers of a block: for each centroid the vectors that came less those that
    left, their signed sums, and the distances of all it now has."""
    size, k = centroids.shape[1], len(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32).reshape(-1, size)
                before = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                owner, distance = reassigned(x, before, np.frombuffer(batch.column(3)[i].as_buffer(), np.int64), centroids, changed)
                went = np.flatnonzero(owner != before)
                n, sums, far = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
                np.add.at(far, owner, distance)
                for side, sign in ((owner[went], 1), (before[went], -1)):
                    for c in range(k):
                        own = went[side == c]
                        n[c] += sign * own.size
                        sums[c] += sign * x[own].sum(axis=0, dtype=np.int64)
                told = [{"centroid": c, "n": int(n[c]), "distance": int(far[c]), "sums": sums[c].tolist()} for c in range(k) if far[c] or n[c] or sums[c].any()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([owner.astype(np.int32).tobytes()], pa.binary()), pa.array([distance.tobytes()], pa.binary()), pa.array([told], KIND)],
                    schema=ARROW,
                )

    return state.mapInArrow(assigned, BLOCKS)


def _transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed counts and sums by centroid, and the distances it now has: k x (size + 2) numbers at the driver."""
    each = state.select(F.explode("transfers").alias("t"))
    told = F.concat(F.array("t.n", "t.distance"), F.col("t.sums"))
    rows = each.select(F.col("t.centroid").alias("c"), F.posexplode(told).alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((k, size + 2), object)
    for c, i, x in rows:
        out[c, i] = x
    return out[:, 0], out[:, 1], out[:, 2:]


def starting_centroids(vectors: DataFrame, k: int = CENTROIDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The k vectors whose sha256 of `seed:vec_id` is least, in that order (equal ids: by components)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & finite & F.col("vec_id").isNotNull())
    hashed = some.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    rows = hashed.orderBy("h", "embedding").limit(k).collect()
    return integers(np.array([r["embedding"] for r in rows], np.float64).reshape(-1, size), scale).astype(np.int64)


def delta_lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(blocks with their last assignments, a written table; centroids; the inertia of each).

    Stops early where no centroid changes: further rounds would repeat the last."""
    centroids = starting_centroids(vectors, k, size, scale, seed)
    k = len(centroids)
    state = materialize(blocks(vectors, size, scale), "vectors")
    if not k:  # no vector at all, or none with an id
        return state, centroids, []
    changed = np.ones(k, bool)
    counts, sums = np.zeros(k, object), np.zeros((k, size), object)
    for number in range(rounds + 1):
        before, state = state, materialize(_round(state, centroids, changed), "assigned")
        discard(before)
        n, inertia, delta = _transfers(state, k, size)
        counts, sums = counts + n, sums + delta
        if number == rounds:
            break
        moved = centroids.copy()
        for c in range(k):
            if counts[c]:
                moved[c] = [int(s) // int(counts[c]) for s in sums[c]]  # floor, of negative sums too
        changed = (moved != centroids).any(axis=1)
        centroids = moved
        if not changed.any():
            break
    return state, centroids, [int(x) for x in inertia]


def assignments(state: DataFrame) -> DataFrame:
    """vec_id, cluster, distance: a row a vector."""
    kind = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                owner, distance = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32), np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(owner), pa.array(distance)], schema=kind)

    return state.select("ids", "owners", "distances").mapInArrow(rows, "vec_id long, cluster int, distance long").where("cluster >= 0")


def clusters(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    state, centroids, inertia = delta_lloyd(vectors, **settings)
    told = [(c, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    of = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assignments(state).join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings` in 8 clusters."""
    return clusters(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds as plain SQL, each comparing all with all."""
    far = "list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT row, min(CAST({far} AS BIGINT) * {CENTROIDS} + c) AS best FROM v CROSS JOIN c{i} GROUP BY row)"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = {SIZE})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS BIGINT) AS c, v AS cv FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts += [
            nearest(i),
            f"""m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mv FROM (SELECT best % {CENTROIDS} AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT best, unnest(v) AS x, unnest(range(1, {SIZE + 1})) AS i FROM v JOIN a{i} USING (row)) GROUP BY ALL) GROUP BY c)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(mv, cv) AS cv FROM c{i} LEFT JOIN m{i} USING (c))",
        ]
    parts += [nearest(ROUNDS), f"f AS (SELECT vec_id, CAST(best % {CENTROIDS} AS INTEGER) AS cluster, best // {CENTROIDS} AS distance FROM v JOIN a{ROUNDS} USING (row))"]
    return f"""WITH {", ".join(parts)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} ON c = cluster"""


QUERIES = {"op11_clusters": op11_clusters}
ORACLE = {"op11_clusters": _sql()}

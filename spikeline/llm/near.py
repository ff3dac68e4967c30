"""N-gram Jaccard join by MinHash banding, and the classes that its links form.

Every text becomes its set of five-word shingles. Documents with equal sets form
one class (a copy costs nothing beyond its signature). A class's MinHash values
are cut into bands; classes that agree in a band meet in a bucket, and every
pair of a bucket is verified on the full shingle sets, rebuilt from the texts.
Rows and bands are the sharpest whose chance to miss a pair at the threshold
stays below 1 - recall.

A pair is verified in the first band it agrees in and nowhere else, so links are
counted once; a bucket with the same members as one of an earlier band is left
out. Buckets beyond BLOCK members or BLOCK_BYTES of text are cut into blocks and
every two blocks meet in a task of their own: a task holds two blocks, and counts
links instead of listing pairs.

A group of n near copies with n different sets still costs all its pairs, since every
link is counted; equal sets cost nothing more.

Nulls: a null text counts as empty; rows without doc_id link to nothing, their
class is null. Texts without words share one empty set and are copies of each
other; texts of fewer than five words have one shingle, the whole text. Every row is a
document: those that repeat a doc_id are copies if their sets are equal and go by their own
texts if not. Extra columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Vocabulary, discard, free_name, gram_hashes, materialize, mixed, partitions, read, runs, text_hashes, utf8, words_of

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 144  # at most
BLOCK = 512
BLOCK_BYTES = 8 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose number of bands for the recall keeps within `most` hashes; ValueError if none does."""
    found = None
    for rows in range(1, most + 1):
        bands = 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            found = (bands, rows)
    if found is None:
        raise ValueError(f"{most} hashes don't reach a recall of {recall} at {threshold}")
    return found


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1), mixed(np.arange(1 << 32, (1 << 32) + n, dtype=np.uint64))


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One value for each band; that of an empty set is as good as any other."""
    a, b = _seeds(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, shingles.size, 512):
        np.minimum(least, (shingles[at : at + 512, None] * a + b).min(axis=0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out) + least[k::rows]
    return mixed(out).view(np.int64)


def shingle_set(text: str | bytes | None, vocabulary: Vocabulary, n: int = GRAM) -> np.ndarray:
    return np.unique(gram_hashes(vocabulary.hashes(words_of(text))[0], n))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h1 and h2 (128 bits of the text), k1 and k2 (of the shingle set), n_bytes, and one column for each band."""
    names = ["doc_id", "h1", "h2", "k1", "k2", "n_bytes", *[f"b{i}" for i in range(bands)]]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                texts, *others = batch.slice(part, 2000).columns
                out = np.empty((len(names) - 3, len(texts)), np.int64)
                for i, text in enumerate(texts):
                    data = text.as_py()
                    x = shingle_set(data, vocabulary, n)
                    out[:2, i] = np.frombuffer(set_key(x), np.int64)
                    out[2, i] = len(data)
                    out[3:, i] = band_hashes(x, bands, rows)
                yield pa.RecordBatch.from_arrays([*others, *map(pa.array, out)], schema=schema)

    rows_in = _named(docs).select("text", "doc_id", "h1", "h2")
    return rows_in.mapInArrow(signed, ", ".join(f"{x} long" for x in names))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and text (binary) of the rows with a doc_id."""
    h1, h2 = text_hashes()
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), utf8().alias("text"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0-1 columns, some shingles at a time."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = np.intersect1d(sets[i], sets[j], assume_unique=True).size
        return out
    sizes = [x.size for x in sets]
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    number = np.cumsum(seen > 1) - 1  # of a shingle that more than one set holds
    shared = (seen > 1)[column]
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, (4 << 20) // m)
    for first in range(0, int(number[-1]) + 1 if number.size else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((m, width), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _linked(threshold: float, n: int, bands: int, rows: int):
    """Pairs of a bucket's block, or of two blocks, verified: links and the least linked class of each."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for run in runs(batches, ["key", "i", "j"]):
            if run.num_rows < 2:
                continue
            sets = [shingle_set(x.as_py(), vocabulary, n) for x in run.column("text")]
            ids, copies, block = (run.column(x).to_numpy() for x in ("node", "copies", "block"))
            band = run.column("band")[0].as_py()
            hashes = np.stack([band_hashes(x, bands, rows) for x in sets])
            sizes = np.array([x.size for x in sets])
            both = intersections(sets)
            linked = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
            for k in range(band):
                linked &= hashes[:, k, None] != hashes[None, :, k]
            if run.column("i")[0].as_py() != run.column("j")[0].as_py():
                linked &= block[:, None] != block
            np.fill_diagonal(linked, False)
            some = np.flatnonzero(linked.any(axis=1))
            if some.size:
                linked, root = linked[np.ix_(some, some)], ids[some].copy()
                while True:
                    least = np.minimum(root, np.where(linked, root, np.iinfo(np.int64).max).min(axis=1))
                    if (least == root).all():
                        break
                    root = least
                yield pa.RecordBatch.from_pydict({"node": ids[some], "links": linked @ copies[some], "root": root})

    return verify


def components(edges: DataFrame) -> DataFrame:
    """node and its component's least node, of edges (a, b): labels move to neighbours
    and jump to their label's label until none changes. Tables are written each round, the last one stays."""
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    moved = not labels.isEmpty()
    while moved:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = materialize(step.join(top, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        discard(labels)
        labels, moved = new, not new.where("old <> label").isEmpty()
    discard(both)
    out = labels.select("node", "label")
    out._written_at = labels._written_at
    return out


def _classed(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the signatures of rows with a doc_id; and k1, k2, copies_id, comp, class_id and n_links of every set."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    names = [f"b{i}" for i in range(bands)]
    first = F.min(F.struct("doc_id", "h1", "h2")).alias("x")
    sets = signed.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), *[F.max(x).alias(x) for x in names])
    classes = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("x.doc_id").alias("rep"), "x.h1", "x.h2", "copies", "n_bytes", *names), "classes")
    members = classes.select("node", "rep", "h1", "h2", "copies", "n_bytes", F.posexplode(F.array(*names)).alias("band", "key"))
    who = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"who{i}") for i in (1, 2)]  # 128 bits of the members
    buckets = members.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), *who).where("n > 1")
    once = buckets.groupBy("who1", "who2", "n").agg(F.min(F.struct("band", "key", "bytes")).alias("x")).select("x.*", "n")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    kept = materialize(once.select("key", blocks.alias("blocks")), "buckets")
    hits = members.join(kept, "key").select("key", "band", "node", "rep", "h1", "h2", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    hits = materialize(hits, "hits")
    needed = hits.select("node", "rep", "h1", "h2").distinct()
    own = _named(docs).groupBy("doc_id", "h1", "h2").agg(F.first("text").alias("text"))  # rows that repeat are one
    texts = materialize(own.join(needed.withColumnRenamed("rep", "doc_id").hint("merge"), ["doc_id", "h1", "h2"]).select("node", "text"), "texts")
    pairs = hits.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "band", "node", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    filled = pairs.hint("merge").join(texts, "node")  # neither side has a bound, so neither is broadcast
    grouped = filled.repartition(partitions(texts), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialize(grouped.mapInArrow(_linked(threshold, n, bands, rows), "node long, links long, root long"), "links")
    discard(kept, hits, texts)
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "node", "rep", "copies").join(counts, "node", "left").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    leaders = known.groupBy("comp").agg(F.min("rep").alias("class_id"))
    out = materialize(known.join(leaders, "comp").select("k1", "k2", F.col("rep").alias("copies_id"), "comp", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    discard(classes, links, labels)
    return signed, out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least document that links lead to), copies_id (the least
    with an equal shingle set), n_links (documents at the threshold or above)."""
    signed, known = _classed(docs, threshold, n, recall)
    out = signed.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "class_id", "copies_id", "n_links")
    nameless = docs.where(F.col("doc_id").isNull()).select(*[F.lit(None).cast("long").alias(x) for x in ("doc_id", "class_id", "copies_id")], F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id (of its unlike texts the
    one with the least hash); of rows that repeat both, the least. Rows without doc_id stay."""
    signed, known = _classed(docs, threshold, GRAM, RECALL)
    first = signed.select("doc_id", "h1", "h2", "k1", "k2").join(known.select("k1", "k2", "comp"), ["k1", "k2"]).groupBy("comp").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("x"))
    kept = materialize(first.select("x.*"), "kept")
    discard(signed, known)
    id_, a, b, row = (free_name(docs, x) for x in ("_id", "_h1", "_h2", "_row"))
    h1, h2 = text_hashes()
    least = F.first if "map<" in docs.schema.simpleString() else F.min  # maps have no order
    named = docs.where(F.col("doc_id").isNotNull())
    one = named.groupBy(F.col("doc_id").cast("long").alias(id_), h1.alias(a), h2.alias(b)).agg(least(F.struct(*docs.columns)).alias(row))
    same = (one[id_] == kept["doc_id"]) & (one[a] == kept["h1"]) & (one[b] == kept["h2"])
    return one.join(kept.hint("merge"), same, "left_semi").select(f"{row}.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class and number of links at 0.8 or more on five-word shingles."""
    return near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_near": op3_near}
ORACLE = {
    # every pair that shares a shingle, counted: exact, where the operator's banding has a recall
    "op3_near": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {GRAM - 2}), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' '))) END AS g FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(g) AS gram FROM g),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM x p JOIN x q ON p.gram = q.gram AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b, c = len(p.g) AND c = len(q.g) AS equal FROM common JOIN g p ON p.doc_id = a JOIN g q ON q.doc_id = b WHERE c >= {THRESHOLD}::DOUBLE * (len(p.g) + len(q.g) - c) - 1e-9
    UNION ALL SELECT p.doc_id, q.doc_id, TRUE FROM g p JOIN g q ON len(p.g) = 0 AND len(q.g) = 0 AND p.doc_id <> q.doc_id),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS class_id, least(doc_id, (SELECT min(b) FROM links WHERE a = doc_id AND equal)) AS copies_id,
    (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM g"""
}

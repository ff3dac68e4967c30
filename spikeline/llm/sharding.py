"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records by a seeded hash into buckets that fit in memory; pass
two puts each bucket into random order (Spark's `shuffle` is a Fisher-Yates
shuffle with a seed) and writes it: buckets follow one another, and shard N holds
the N-th of equal parts of that sequence. So records move once, from the input to
their bucket's task, which writes them to the one or two shards it reaches.
Shard sizes differ by one row at most, slots have no gaps, and the same rows,
seed and shard count give the same shards however the input was partitioned.

How many records a bucket gets, and so where it starts, is counted beforehand by 128
hash bits of each record. Records that repeat more than a share of REPEATS (MOST_HOT of
them at most, by that bound) are counted before the scatter and their copies dealt one by one, so
that one that makes up a third of all rows still spreads over all buckets.

Null keys and texts are values like others; maps can't be hashed and aren't taken;
columns named like those added stay, and the added ones get underscores before their
names; no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, read, shared_dir, utf8

BUCKET_ROWS = 4096  # a task holds a bucket's records
BUCKET_BYTES = 32 << 20  # of whole records
MOST_PARTITIONS = 50_000
REPEATS = 512
MOST_HOT = 1_000_000


def _identity(records: DataFrame) -> tuple[Column, Column]:
    """128 bits of a record; hashes skip nulls, so these are told apart by flags."""
    flags = [F.col(f"`{c}`").isNull() for c in records.columns]
    return tuple(F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in records.columns], *flags) for i in (1, 2))


def _size(records: DataFrame) -> Column:
    text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in records.schema if f.dataType.typeName() in ("string", "binary")]
    return sum(text, F.lit(0)).cast("long")


def shuffled(records: DataFrame, shards: int = 16, seed: int = 42, buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES, repeats: int = REPEATS) -> DataFrame:
    """The records with `shard` and `slot`. buckets: by default as many as keep each within BUCKET_ROWS and bucket_bytes."""
    names = records.columns
    a, b, n, bucket, copy, before, place, record, shard, slot = (free_name(records, x) for x in ("_a", "_b", "_n", "_bucket", "_copy", "_before", "_place", "_record", "shard", "slot"))
    h1, h2 = _identity(records)
    marked = records.withColumn(a, h1).withColumn(b, h2)
    counts = materialize(marked.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.max(_size(records)).alias("size")), "counts")
    rows, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    buckets = buckets or max(1, -(-rows // BUCKET_ROWS), -(-size // bucket_bytes))
    limit = max(repeats, -(-rows // MOST_HOT))
    of = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")
    hot = materialize(counts.where(F.col("n") > limit).select(a, b), "hot")  # MOST_HOT rows at most
    some = not hot.isEmpty()
    single = counts.where(F.col("n") <= limit).select(of(a, b).alias(bucket), "n")
    scattered = marked.select(*names, of(a, b).alias(bucket))
    if some:
        each = lambda k: F.explode(F.sequence(F.lit(1).cast("long"), F.col(k))).alias(copy)
        single = single.unionByName(counts.where(F.col("n") > limit).select(a, b, each("n")).select(of(a, b, copy).alias(bucket), F.lit(1).cast("long").alias("n")))
        few = F.broadcast(hot)
        scattered = marked.join(few, [a, b], "left_anti").select(*names, of(a, b).alias(bucket))
        many = marked.join(few, [a, b], "left_semi").groupBy(*names, a, b).agg(F.count(F.lit(1)).alias(n))
        scattered = scattered.unionByName(many.select(*names, a, b, each(n)).select(*names, of(a, b, copy).alias(bucket)))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = single.groupBy(bucket).agg(F.sum("n").alias("n")).select(bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    offsets = materialize(offsets, "offsets")
    discard(counts)
    # a bucket's start travels with its records; one bucket a task, in order where there are more
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]
    sent = scattered.withColumn(before, F.lit(None).cast("long")).unionByName(offsets.select(*nothing, bucket, before))
    own = F.collect_list(F.when(F.col(before).isNull(), F.struct(*names)))
    bundles = sent.repartitionById(min(buckets, MOST_PARTITIONS), bucket).groupBy(bucket).agg(F.max(before).alias(before), F.sort_array(own).alias(record))
    # the seeded shuffle repeats itself, since partitions and their order are always the same
    placed = bundles.sortWithinPartitions(bucket).select(before, F.shuffle(record, seed).alias(record))
    index = f"(`{before}` + `{place}`)"
    dealt = placed.select(before, F.posexplode(record).alias(place, record)).withColumn(shard, F.expr(f"cast((({index} + 1) * {shards}L - 1) div {max(rows, 1)}L as int)"))
    return dealt.select(f"{record}.*", shard, F.expr(f"{index} - (`{shard}` * {rows}L) div {shards}L").alias(slot))


def write_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, repeats: int = REPEATS) -> DataFrame:
    """Writes whole records as Parquet to path/shard=N/, in slot order within a file; returns what is read back, with shard and slot."""
    ordered = shuffled(df, shards, seed, None, bucket_bytes, repeats)
    shard, slot = ordered.columns[-2:]
    ordered.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`: whole records are written, and told from what is read back."""
    written = write_shards(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    text = utf8()
    return written.select("doc_id", (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE: dict[str, str] = {}

"""A Parquet store of days, parted by month, whose versions each rewrite only the months they touch.

A version is a manifest: for each month the folder that holds it. Writing one puts the touched months into a folder
of their own, and then the manifest in its place by a rename, so a reader has a whole version or the one before. The store has
one writer at a time. Writing a version again replaces it, which makes a repeated batch harmless.

    {store}/data/{version}-{unique}/month=YYYY-MM-01/*.parquet
    {store}/versions/version={n}/   month, folder
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import upsert
from .written import discard, exists, remove, swap_parquet, written

MANIFEST = "month string, folder string"
FILES = 8  # of a month, at most


def _at(store: str, version: int) -> str:
    return f"{store}/versions/version={version}"


def versions(spark: SparkSession, store: str) -> list[int]:
    """The versions that are whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.globStatus(path(f"{store}/versions/version=*/_SUCCESS"))
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found or [])


def manifest(spark: SparkSession, store: str, version: int) -> dict[str, str]:
    """Month to folder; as many rows as months."""
    if not exists(spark, _at(store, version)):
        raise FileNotFoundError(f"version {version} of {store} is missing")
    return {r["month"]: r["folder"] for r in spark.read.schema(MANIFEST).parquet(_at(store, version)).collect()}


def _months(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """A version of the store, the last whole one by default."""
    if version is None:
        known = versions(spark, store)
        if not known:
            raise FileNotFoundError(f"{store} has no version")
        version = known[-1]
    folders = sorted(manifest(spark, store, version).values())
    if not folders:
        raise FileNotFoundError(f"version {version} of {store} has no rows")
    return spark.read.parquet(*folders)


def write_version(new: DataFrame, store: str, version: int, keys: tuple[str, ...] = ("ticker", "date"), sequence: str | None = None, day: str = "date", kept: int = 2) -> dict[str, str]:
    """Upserts rows into version - 1 (none before 0) as `version`; returns the months it wrote. Of rows with equal keys the
    last by `sequence` stays, new ones before stored ones. Of older versions `kept` stay, with the folders they name."""
    spark = new.sparkSession
    before = manifest(spark, store, version - 1) if version else {}
    rows = written(new.withColumn("month", F.date_format(F.trunc(day, "MM"), "yyyy-MM-dd")), "new-rows")
    touched = sorted(r[0] for r in rows.where(F.col("month").isNotNull()).select("month").distinct().collect())
    now = dict(before)
    if touched:
        stored = _months(spark, [before[m] for m in touched if m in before], new.schema)
        merged = upsert(stored, rows.where(F.col("month").isNotNull()).drop("month"), keys, "last", sequence)
        base = f"{store}/data/{version}-{uuid.uuid4().hex}"
        parted = merged.withColumn("month", F.date_format(F.trunc(day, "MM"), "yyyy-MM-dd"))
        parted.repartition("month", F.pmod(F.xxhash64(*keys), F.lit(FILES))).write.partitionBy("month").parquet(base)
        now |= {m: f"{base}/month={m}" for m in touched}
    swap_parquet(spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1), _at(store, version))
    discard(rows)
    _forget(spark, store, version - kept)
    return {m: now[m] for m in touched}


def _forget(spark: SparkSession, store: str, last: int) -> None:
    """Removes versions up to `last`, and the folders that no version after them names."""
    known = versions(spark, store)
    old = [v for v in known if v <= last]
    if not old:
        return
    needed = {f for v in known if v > last for f in manifest(spark, store, v).values()}
    for folder in {f for v in old for f in manifest(spark, store, v).values()} - needed:
        remove(spark, folder)
    for v in old:
        remove(spark, _at(store, v))

"""Tables written on the way, and sinks: Parquet with a swap, CSV, JSON, raw text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet and read again by all that follows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., tuple[DataFrame, ...]]]:
    """What written() writes inside is deleted at the end, but for the tables given to the function that this yields: those go over
    to the scope around it, or stay. Results that are read from the others have to be written or collected before."""
    _scopes.append([])

    def keep(*tables: DataFrame) -> tuple[DataFrame, ...]:
        for df in tables:
            _scopes[-1].remove(df._written_at)
            if len(_scopes) > 1:
                _scopes[-2].append(df._written_at)
        return tables

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df._written_at)
        for scope in _scopes:
            if df._written_at in scope:
                scope.remove(df._written_at)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has been completed."""
    files, at = _files(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def exists_folder(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def swap_parquet(df: DataFrame, path: str) -> None:
    """Replaces the Parquet table at path by df, which may read it: written beside it, then put in its place by two renames."""
    spark = df.sparkSession
    parent, _, name = path.rpartition("/")
    staged, old = (f"{parent}/.{name}.{what}-{uuid.uuid4().hex}" for what in ("staged", "old"))  # hidden from readers of the parent
    df.write.parquet(staged)
    files, at = _files(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path
    had = files.exists(at)
    if had and not files.rename(at, to(old)) or not files.rename(to(staged), at):
        raise OSError(f"{path} can't be replaced; its new content is in {staged}")
    if had:
        files.delete(to(old), True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty, empty strings quoted."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("nullValue", "").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a row; nulls are written, so that every object has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_raw(documents: DataFrame, path: str, column: str = "document") -> None:
    """Documents as the source sent them, a line each, in a folder for each value of the other columns."""
    others = [c for c in documents.columns if c != column]
    documents.where(F.col(column).isNotNull()).select(*others, F.col(column).alias("value")).write.mode("overwrite").partitionBy(*others).text(path)


def load_or_bootstrap(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none, it is made and stored first."""
    if not exists(spark, path):
        swap_parquet(make(), path)
    return spark.read.parquet(path)


def alerts_to(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores messages (column `message`) as text, one folder for each batch: a repeated batch replaces its own."""

    def send(rows: DataFrame, number: int) -> None:
        rows.select(F.to_json(F.struct("message")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return send

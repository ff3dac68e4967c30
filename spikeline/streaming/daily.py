"""The live path as micro-batches: points stream in, days are upserted, new events come out.

Row-frame windows don't run on streams, so each batch recomputes events from the
stored series, which also makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import new_events
from ..sources.store import read_store, versions, write_version
from ..sources.written import exists, swap_parquet


def daily_rollup(points: DataFrame, late: str = "1 day") -> DataFrame:
    """ticker, date, v, tone of a stream of points (ticker, ts, vol, tone): complete days only, once the watermark has passed."""
    days = points.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 day").alias("w"))
    return days.agg(F.sum("vol").alias("v"), F.avg("tone").alias("tone")).select("ticker", F.to_date("w.start").alias("date"), "v", "tone")


def upsert_stream(stream: DataFrame, store: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, keys: tuple[str, ...] = ("ticker", "date"), sequence: str | None = None, kept: int = 2) -> StreamingQuery:
    """Upserts rows into versions of a store parted by month, one version a batch, which rewrites the months it touches;
    `then` gets the store to read what it needs of it.

    A checkpoint remembers the version it began on, so that batch n always writes version first + n: a repeated
    batch replaces its own, and a new checkpoint goes on after the versions that are there. A missing earlier
    version is an error. Of rows of one batch with equal keys the last by `sequence` stays. Of older versions `kept` stay."""
    spark = stream.sparkSession
    base = f"{checkpoint}-first-version"
    if not exists(spark, base):
        swap_parquet(spark.createDataFrame([(max(versions(spark, store), default=-1) + 1,)], "first long"), base)
    first = spark.read.parquet(base).first()["first"]

    def batch(rows: DataFrame, number: int) -> None:
        write_version(rows, store, first + number, keys, sequence, kept=kept)
        if then:
            then(read_store(rows.sparkSession, store, first + number), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The last version that was written whole."""
    return read_store(spark, store)


def on_change(events_of: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame, int], None], known: str) -> Callable[[DataFrame, int], None]:
    """A `then` for upsert_stream: hands on the events of the store that aren't yet among the known ones, and adds them there.
    They are sent before they are known, so that a failure between the two sends them again rather than never."""

    def then(store: DataFrame, number: int) -> None:
        spark = store.sparkSession
        events = events_of(store)
        fresh = new_events(events, spark.read.parquet(known)) if exists(spark, known) else events
        send(fresh, number)
        swap_parquet(events.select("ticker", "event_date").unionByName(spark.read.parquet(known).select("ticker", "event_date")).distinct() if exists(spark, known) else events.select("ticker", "event_date").distinct(), known)

    return then

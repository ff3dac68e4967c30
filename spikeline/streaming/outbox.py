"""Alerts that are sent at least once, and told apart: an outbox keyed by ticker and event day.

What a version of the store brings is put down under its number before anything is sent; what has been
acknowledged is put down after. A run that dies between the two sends again what wasn't acknowledged, with the same
id; a batch that is repeated puts the same rows in the same place, and sends nothing that was acknowledged.

    {outbox}/pending/version={n}/   ticker, event_date, message
    {outbox}/acknowledged/run={unique}/   ticker, event_date
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import discard, exists_folder, swap_parquet, written

KEY = ["ticker", "event_date"]


def enqueue(messages: DataFrame, outbox: str, version: int) -> None:
    """Puts down messages (ticker, event_date, message) of a version, in place of those it had."""
    swap_parquet(messages.select(*KEY, "message"), f"{outbox}/pending/version={version}")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists_folder(spark, path) else spark.createDataFrame([], schema)


def waiting(spark: SparkSession, outbox: str) -> DataFrame:
    """ticker, event_date, message, id of events that aren't acknowledged; an event of several versions is one, with the message
    of the last."""
    pending = _table(spark, f"{outbox}/pending", "ticker string, event_date date, message string, version int")
    done = _table(spark, f"{outbox}/acknowledged", "ticker string, event_date date").select(*KEY)
    last = pending.groupBy(*KEY).agg(F.max_by("message", "version").alias("message"))
    return last.join(done, KEY, "left_anti").select(*KEY, "message", F.concat_ws("_", *KEY).alias("id"))


def deliver(spark: SparkSession, outbox: str, send: Callable[[DataFrame], None]) -> int:
    """Sends what is waiting, then acknowledges it; how many that were. An error of `send` leaves all waiting."""
    batch = written(waiting(spark, outbox), "alerts")
    n = batch.count()
    if n:
        send(batch)
        swap_parquet(batch.select(*KEY), f"{outbox}/acknowledged/run={uuid.uuid4().hex}")
    discard(batch)
    return n

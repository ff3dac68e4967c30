"""One day of the live path: gaps, upsert, events, scores, alerts, and what may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alert_message
from ..operators import incremental, scoring, signals
from ..sources import store
from ..sources.written import discard, exists, swap_parquet, written
from ..streaming import outbox


def days_to_fetch(stored: DataFrame, entities: DataFrame, target: str, backfill: str | None = None) -> DataFrame:
    """ticker, gap_start, gap_end up to the target day: after an entity's last stored day, or from the backfill day for all that are stored."""
    if backfill is None:
        return incremental.gap_ranges(stored, entities, target)
    known = stored.select("ticker").distinct()
    start, end = F.to_date(F.lit(backfill)), F.to_date(F.lit(target))
    return entities.select("ticker").distinct().join(known, "ticker").select("ticker", start.alias("gap_start"), end.alias("gap_end")).where("gap_start <= gap_end")


def run_day(spark: SparkSession, home: str, source: DataFrame, day: str, verdict: str | DataFrame, terciles: DataFrame, backfill: str | None = None, send=None, most_age: int = 4) -> DataFrame:
    """Brings the store below `home` up to `day` and returns the latest events, for publishing.

    source: ticker, date, v, tone, read only for the days that are missing. Stops, with an error and before anything is scored or sent, where
    the verdict isn't NULL; and before anything is published, where the store is still more than most_age days old. Scores of new events are
    appended to home/scores by the day of the run, their alerts go through home/outbox. A run that is repeated finds the same new events and
    writes them to the same place; they are known, and so no longer new, once they were scored and sent."""
    scoring.guard(verdict)
    path, known = f"{home}/days", f"{home}/known"
    number = store.versions(spark, path)[-1] + 1
    gaps = days_to_fetch(store.read_store(spark, path), source.select("ticker").distinct(), day, backfill)
    fetched = source.join(gaps, "ticker").where(F.col("date").between(F.col("gap_start"), F.col("gap_end"))).select(source.columns)
    store.write_version(fetched, path, number)
    scored = written(signals.with_zscores(store.read_store(spark, path)), "scored")
    events = written(signals.gated_events(scored), "events")
    new = written(incremental.new_events(events, spark.read.parquet(known)) if exists(spark, known) else events, "new-events")
    scores = scoring.score(new, events, signals.spike_events(scored, 2.0, 3.0), terciles, verdict)
    scores.write.mode("overwrite").parquet(f"{home}/scores/run={day}")
    if send:
        told = scoring.attach(new, spark.read.schema(scores.schema).parquet(f"{home}/scores/run={day}"))
        outbox.enqueue(told.select("ticker", "event_date", alert_message().alias("message")), f"{home}/outbox", number)
        outbox.deliver(spark, f"{home}/outbox", send)
    swap_parquet(events.select("ticker", "event_date"), known)
    incremental.require_fresh(scored, day, most_age)
    feed = written(incremental.latest(events), "feed")
    discard(scored, events, new)
    return feed

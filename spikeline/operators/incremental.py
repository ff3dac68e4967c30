"""Gap detection, upserts, differences between runs, and what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_ranges(store: DataFrame, entities: DataFrame, target: str) -> DataFrame:
    """ticker, gap_start, gap_end of known entities whose last stored day is before the target."""
    last = store.groupBy("ticker").agg(F.max("date").alias("last"))
    joined = entities.join(last, "ticker").select("ticker", F.date_add("last", 1).alias("gap_start"), F.to_date(F.lit(target)).alias("gap_end"))
    return joined.where("gap_start <= gap_end")


def upsert(store: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("ticker", "date"), keep: str = "last", sequence: str | None = None) -> DataFrame:
    """store and new, of equal keys the last (or first) written: new rows come after stored ones, rows of one
    side in the order of `sequence`, and where that is equal or not given, of their other columns."""
    within = [sequence] * bool(sequence) + [c for c in store.columns if c not in {*keys, sequence}]
    both = store.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    order = [F.col(c).desc() if keep == "last" else F.col(c) for c in ("_seq", *within)]
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn", "_seq")


def new_events(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("ticker", "event_date"), ["ticker", "event_date"], "left_anti")


def latest(events: DataFrame, n: int = 30) -> DataFrame:
    return events.orderBy(F.col("event_date").desc(), "ticker").limit(n)


def ticker_counts(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Every entity with its number of events (0 where there are none) and the largest |vol_z|."""
    counts = events.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_events"), F.max(F.abs("vol_z")).alias("max_vol_z"))
    return entities.join(counts, "ticker", "left").select("ticker", F.coalesce("n_events", F.lit(0)).alias("n_events"), "max_vol_z")


def ticker_history(events: DataFrame) -> DataFrame:
    """Per ticker its events, the latest first, as place 1, 2, ..."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("event_date").desc())))


def site_summary(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("ticker").alias("n_tickers"), F.count(F.lit(1)).alias("n_events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"), F.count_if(F.col("direction") > 0).alias("n_positive"))


def freshness(store: DataFrame, asof: str, most: int = 4) -> DataFrame:
    """Days since the store's last one, and whether that is too long."""
    age = F.datediff(F.to_date(F.lit(asof)), F.max("date"))
    return store.agg(age.alias("age_days")).withColumn("stale", F.col("age_days") > most)


def require_fresh(store: DataFrame, asof: str, most: int = 4) -> None:
    row = freshness(store, asof, most).first()
    if row["stale"] is not False:
        raise ValueError(f"the store is {row['age_days']} days old")

"""Daily series, trailing z-scores and spike events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

TIMELINE = "timeline array<struct<series:string,data:array<struct<date:string,value:double>>>>"


def parse_timeline(documents: DataFrame, column: str = "document") -> DataFrame:
    """Columns beside `column`, date and value of every point of the first series; none where it is missing."""
    others = [c for c in documents.columns if c != column]
    parsed = documents.withColumn("_doc", F.from_json(column, TIMELINE))
    points = parsed.select(*others, F.inline(F.get(F.col("_doc.timeline"), F.lit(0))["data"]))
    return points.withColumn("date", F.to_date(F.to_timestamp("date", "yyyyMMdd'T'HHmmss'Z'")))


def daily(points: DataFrame, kind: str) -> DataFrame:
    """ticker, date, value: sums of volume ("vol"), means of tone."""
    return points.groupBy("ticker", "date").agg((F.sum if kind == "vol" else F.avg)("value").alias("value"))


def strict_timelines(documents: DataFrame, years: list[int]) -> DataFrame:
    """ticker, date, value of the tickers that have a document (ticker, year, document) for every year; the others are
    left out whole. Of repeated days the one of the earliest year, then the smallest value, stays."""
    wanted = documents.where(F.col("year").isin(years) & F.col("document").isNotNull())
    complete = wanted.groupBy("ticker").agg(F.countDistinct("year").alias("n")).where(F.col("n") == len(set(years))).select("ticker")
    points = parse_timeline(wanted.join(complete, "ticker", "left_semi"))
    return points.groupBy("ticker", "date").agg(F.min(F.struct("year", "value")).alias("x")).select("ticker", "date", F.col("x.value").alias("value"))


def complete_day(now: str | Column) -> Column:
    """The last UTC day that is over at a time."""
    stamp = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    return F.date_sub(F.to_date(F.to_utc_timestamp(stamp, F.current_timezone())), 1)


def before(series: DataFrame, end: str) -> DataFrame:
    """Days before `end`: the source's end is inclusive."""
    return series.where(F.col("date") < F.to_date(F.lit(end)))


def zscore(x: str, window: int = 90) -> Column:
    """(x - mean) / std of exactly `window` earlier rows, all of them known; infinite where these don't vary but x differs."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-window, -1)
    m, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
    inf = F.lit(float("inf"))
    z = F.when(sd != 0, F.try_divide(F.col(x) - m, sd)).when(F.col(x) > m, inf).when(F.col(x) < m, -inf)
    return F.when(F.count(x).over(w) == window, z)


def without_nan(series: DataFrame, *columns: str) -> DataFrame:
    """series with NaN taken as unknown, so that comparisons, which hold NaN for the largest number, don't see it."""
    return series.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def with_zscores(series: DataFrame, window: int = 90) -> DataFrame:
    return without_nan(series, "v", "tone").select("*", zscore("v", window).alias("vol_z"), zscore("tone", window).alias("tone_z"))


def _flag(vol_z: float, v: float) -> Column:
    return F.coalesce((F.nanvl("vol_z", F.lit(None).cast("double")) >= vol_z) & (F.col("v") >= v), F.lit(False))


def _event_columns() -> list[Column]:
    return [F.col("ticker"), F.col("date").alias("event_date"), *map(F.col, ("v", "vol_z", "tone", "tone_z")), F.signum("tone_z").alias("direction")]


def _run_starts(scored: DataFrame, **flags: Column) -> DataFrame:
    """scored with a column for each flag: whether a run of rows that have it starts here. One window for all."""
    order = Window.partitionBy("ticker").orderBy("date")
    marked = scored.withColumns(flags)
    return marked.withColumns({k: F.col(k) & ~F.lag(k, 1, False).over(order) for k in flags})


def spike_events(scored: DataFrame, vol_z: float = 3.0, v: float = 5.0) -> DataFrame:
    """The first row of each run of rows with vol_z and v at their thresholds or above."""
    return _run_starts(scored, _start=_flag(vol_z, v)).where("_start").select(*_event_columns())


def gated_events(scored: DataFrame, gate: int = 150, strict: tuple = (3.0, 5.0), loose: tuple = (2.0, 3.0)) -> DataFrame:
    """The strict events, or the loose ones instead of all of them if the strict are fewer than `gate`. Both are found in one
    pass and written, before they are counted."""
    found = _run_starts(scored, _strict=_flag(*strict), _loose=_flag(*loose)).where("_strict OR _loose")
    found = written(found, "flagged")
    few = found.agg((F.count_if("_strict") < gate).alias("_few"))
    return found.crossJoin(F.broadcast(few)).where(F.when(F.col("_few"), F.col("_loose")).otherwise(F.col("_strict"))).select(*_event_columns())  # one row


def joined_series(vol: DataFrame, tone: DataFrame) -> DataFrame:
    """ticker, date, v, tone of the days that both series (ticker, date, value) have: a day that one lacks is left out, so that its
    neighbours follow each other in windows over rows."""
    key = ["ticker", "date"]
    return vol.select(*key, F.col("value").alias("v")).join(tone.select(*key, F.col("value").alias("tone")), key)


ARTICLES = "articles array<struct<title:string,url:string,seendate:string>>"


def parse_articles(documents: DataFrame, column: str = "document") -> DataFrame:
    """Columns beside `column`, and articles, in the document's order: null where it is broken or has no list of them."""
    others = [c for c in documents.columns if c != column]
    return documents.select(*others, F.from_json(column, ARTICLES)["articles"].alias("articles"))


def top_spikes(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.abs("vol_z").desc(), "ticker", "event_date").limit(n)


def with_headlines(events: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """events left outer articles (ticker, event_date, articles: array<struct<title,url,seendate>>): a placeholder where there are none."""
    joined = events.join(articles, ["ticker", "event_date"], "left")
    rows = joined.select("event_date", "ticker", "vol_z", "tone_z", F.size(F.coalesce("articles", F.array())).alias("_n"), F.inline_outer(F.slice("articles", 1, most)))
    title = F.when(F.col("_n") == 0, "(no articles retrieved)").otherwise(F.coalesce("title", F.lit("")))
    return rows.select("event_date", "ticker", "vol_z", "tone_z", title.alias("headline"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("seendate", F.lit("")).alias("seendate"))

"""Coverage of series and quality of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(series: DataFrame, years: float) -> DataFrame:
    """Per ticker: total, days with any, those per year (one decimal), the largest day."""
    days = F.count_if(F.col("v") > 0)
    return series.groupBy("ticker").agg(F.sum("v").cast("long").alias("total_articles"), days.alias("nonzero_days"), F.round(days / F.lit(years), 1).alias("nonzero_days_per_year"), F.coalesce(F.max("v"), F.lit(0.0)).cast("long").alias("max_daily_count"))


def coverage_gate(report: DataFrame, least: float = 30.0) -> DataFrame:
    """The exact median of the rounded days per year, and whether it passes."""
    return report.agg(F.median("nonzero_days_per_year").alias("median_days"), F.count(F.lit(1)).alias("entities")).withColumn("passed", F.col("median_days") >= least)


def price_integrity(prices: DataFrame, symbols: DataFrame, benchmark: str, slack: int = 21, most_missing: float = 5.0) -> DataFrame:
    """Per symbol: rows, first and last day, missing share of the benchmark's rows, closes at or below 0, jumps, status.
    ValueError where the benchmark has no price: nothing could be held against it."""
    if prices.where((F.col("ticker") == benchmark) & F.col("close").isNotNull()).isEmpty():
        raise ValueError(f"the benchmark {benchmark} has no prices")
    order = Window.partitionBy("ticker").orderBy("date")
    known = prices.where(F.col("close").isNotNull()).withColumn("_r", F.ln(F.try_divide(F.col("close"), F.lag("close").over(order))))
    per = known.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("close") <= 0).alias("nonpositive_close"), F.count_if(F.abs("_r") > 0.5).alias("extreme_moves"))
    bench = per.where(F.col("ticker") == benchmark).select(F.col("rows").alias("_rows"), F.col("first_date").alias("_first"), F.col("last_date").alias("_last"))
    missing = 100.0 * (1 - F.try_divide(F.col("rows").cast("double"), F.col("_rows").cast("double")))
    late = (F.col("first_date") > F.date_add("_first", slack)) | (F.col("last_date") < F.date_sub("_last", slack))
    status = F.when(F.col("rows").isNull(), "DROPPED-no-data").when(late | (F.col("missing") > most_missing) | (F.col("nonpositive_close") > 0), "DROPPED-insufficient-coverage").otherwise("OK")
    joined = symbols.join(per, "ticker", "left").join(F.broadcast(bench), how="left").withColumn("missing", missing)  # one row
    return joined.select("ticker", F.coalesce("rows", F.lit(0)).alias("rows"), "first_date", "last_date", F.round("missing", 4).alias("missing_pct"), F.coalesce("nonpositive_close", F.lit(0)).alias("nonpositive_close"), F.coalesce("extreme_moves", F.lit(0)).alias("extreme_moves"), status.alias("status"))


def level_breaks(stored: DataFrame, fetched: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per ticker with days in both: days, first_day, ratio (median of fetched / stored close), spread (median distance from it),
    jump (log of the last stored close before the overlap to the first fetched one) and verdict.

    Adjusted prices move as a whole: after a split or dividend the fetched days stand at another level than those stored before, and
    an upsert leaves a break at the first fetched day. One ratio for all of them, away from 1, says so (BREAK);
    ratios of which half or more differ say that the days themselves were revised (REVISED). The overlap is the days fetched again, some
    ten a ticker."""
    key = ["ticker", "date"]
    known = lambda df, name: df.where(F.col("close") > 0).select(*key, F.col("close").alias(name))
    both = known(stored, "before").join(known(fetched, "after"), key).withColumn("r", F.col("after") / F.col("before"))
    middle = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.median("r").alias("ratio"), F.min_by("after", "date").alias("opens"), F.collect_list("r").alias("rs"))
    spread = middle.select("ticker", "days", "first_day", "ratio", "opens", F.explode("rs").alias("r")).groupBy("ticker", "days", "first_day", "ratio", "opens").agg(F.median(F.abs(F.col("r") - F.col("ratio"))).alias("spread"))
    last = known(stored, "close").join(middle.select("ticker", "first_day"), "ticker").where("date < first_day").groupBy("ticker").agg(F.max_by("close", "date").alias("closes"))
    verdict = F.when(F.col("spread") > tolerance, "REVISED").when(F.abs(F.col("ratio") - 1) > tolerance, "BREAK").otherwise("SAME")
    return spread.join(last, "ticker", "left").select("ticker", "days", "first_day", "ratio", "spread", F.ln(F.col("opens") / F.col("closes")).alias("jump"), verdict.alias("verdict"))


def sound_prices(prices: DataFrame, benchmark: str) -> DataFrame:
    """The prices of symbols whose integrity status is OK."""
    report = price_integrity(prices, prices.select("ticker").distinct(), benchmark)
    return prices.join(F.broadcast(report.where("status = 'OK'").select("ticker")), "ticker", "left_semi")  # a row a symbol

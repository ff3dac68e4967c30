"""The engine's inputs as entity x day panels, made of the star-schema tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "^ALL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts, vol, tone of events, as a stream of the files named like the table."""
    kinds = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("vol"), F.col("value").alias("tone"))


def csv_table(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A CSV file with a header and an explicit schema; missing strings are empty, missing values of other kinds null.
    lines: values may hold line breaks, so that a file is read by one task."""
    options = {"header": True, "emptyValue": "", "nullValue": "\0", "escape": '"', "multiLine": lines}
    return spark.read.schema(schema).options(**options).csv(path).fillna("")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files with the file each came from; broken ones are null."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("document"))


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, v (orders), tone (mean order value; 0 on days without): segments by order days."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    daily = orders.join(customer, "o_custkey").groupBy("ticker", "date").agg(F.count("o_orderkey").cast("double").alias("v"), F.avg("o_totalprice").alias("tone"))
    grid = customer.select("ticker").distinct().crossJoin(F.broadcast(orders.select("date").distinct()))  # a calendar's days
    filled = grid.join(daily, ["ticker", "date"], "left")
    return filled.select("ticker", "date", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("tone", F.lit(0.0)).alias("tone"))


def timeline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts (15-minute buckets), vol, tone: events by type."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value")
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900)
    return events.groupBy("ticker", bucket.alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("vol"), F.avg("value").alias("tone"))


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close: mean unit price by segment and ship day, and of all segments as BENCHMARK.

    Line items are read once: the benchmark adds up the segments' sums, those of unknown orders among them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    owners = orders.join(customer, "o_custkey", "left").select("l_orderkey", "ticker")
    sums = lines.join(owners, "l_orderkey", "left").groupBy("ticker", "date").agg(F.sum("price").alias("s"), F.count("price").alias("n"))
    every = sums.groupBy("date").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.lit(BENCHMARK).alias("ticker"), "date", "s", "n")
    both = sums.where(F.col("ticker").isNotNull()).unionByName(every)
    return both.select("ticker", "date", F.try_divide("s", F.col("n").cast("double")).alias("close"))


def wide_by_day(closes: DataFrame, batches: int = 8) -> DataFrame:
    """date, batch and prices, a map of symbol to close: what bulk downloads of a batch of symbols each bring. Symbols are dealt by
    hash, so that a row holds one day of one batch, however many symbols there are."""
    batch = F.pmod(F.xxhash64("ticker"), F.lit(batches)).cast("int").alias("batch")
    return closes.groupBy("date", batch).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "close"))).alias("prices"))


def maps_to_long(wide: DataFrame) -> DataFrame:
    """ticker, date, close of rows with a map of closes by symbol; unknown ones left out."""
    return wide.select("date", F.explode("prices").alias("ticker", "close")).where(F.col("close").isNotNull() & ~F.isnan("close")).select("ticker", "date", "close")


def wide_to_long(wide: DataFrame, symbols: list[str]) -> DataFrame:
    """ticker, date, close of a table with a day a row and a column of closes for each symbol; unknown ones left out."""
    return wide.unpivot(["date"], symbols, "ticker", "close").where(F.col("close").isNotNull() & ~F.isnan("close")).select("ticker", "date", "close")


def probe(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """source and ok, whether it can be read and has a row."""

    def readable(name: str) -> bool:
        try:
            return not table(spark, sf_dir, name).isEmpty()
        except AnalysisException as e:  # anything else, such as a lost cluster, is an error
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    return spark.createDataFrame([(x, readable(x)) for x in names], "source string, ok boolean")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, company_name, aliases (parted by |), sector: the nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey)
    aliases = F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.initcap("n_name"), F.lit(" | "))).otherwise(F.concat(F.lower("n_name"), F.lit("|"), F.initcap("n_name")))
    return names.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("company_name"), aliases.alias("aliases"), F.col("r_name").alias("sector"))

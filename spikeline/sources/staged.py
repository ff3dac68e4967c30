"""Documents by entity and year as a source: staged files, one for each, that stand for what a fetch has brought.

    spark.dataSource.register(StagedTimelines)
    spark.read.format("staged_timelines").option("years", "2023,2024").option("tickers", '["A"]').load(folder)

gives ticker, year, document: a partition for each entity and year, read by a task of its own. A year that an entity lacks is a row
with a null document, so that what is missing is reported, not passed over. Years and, if they are given, tickers reach
the source, which lists and reads nothing else. They are options rather than pushed filters, because
Spark 4.1 keeps what one query of a DataFrame has pushed to a Python source for the next query of it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


class EntityYear(InputPartition):
    def __init__(self, ticker: str, year: int, files: list[str]):
        self.ticker, self.year, self.files = ticker, year, files


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Reader(DataSourceReader):
    def __init__(self, path: str, years: list[int], tickers: list[str] | None):
        self.path, self.years, self.tickers = path, years, tickers

    def partitions(self) -> list[InputPartition]:
        from urllib.parse import unquote

        from pyarrow import fs

        store, root = _files(self.path)
        below = lambda at: store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        out = []
        for entity in sorted((x for x in below(root) if x.base_name.startswith("ticker=")), key=lambda x: x.path):
            ticker = unquote(entity.base_name.partition("=")[2])
            if self.tickers is not None and ticker not in self.tickers:
                continue
            years = {x.base_name.partition("=")[2]: x.path for x in below(entity.path)}
            for y in self.years:
                files = sorted(x.path for x in below(years[str(y)]) if not x.base_name.startswith(("_", "."))) if str(y) in years else []
                out.append(EntityYear(ticker, y, files))
        return out or [EntityYear("", 0, [])]

    def read(self, partition: EntityYear) -> Iterator[tuple]:
        if not partition.ticker:
            return
        store, _ = _files(self.path)
        found = False
        for name in partition.files:
            with store.open_input_stream(name) as f:
                for line in f.read().decode().splitlines():
                    found = True
                    yield partition.ticker, partition.year, line
        if not found:
            yield partition.ticker, partition.year, None


class StagedTimelines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_timelines"

    def schema(self) -> str:
        return "ticker string, year int, document string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], [int(y) for y in self.options["years"].split(",")], json.loads(self.options.get("tickers", "null")))


def staged_timelines(spark: SparkSession, path: str, years: list[int], tickers: list[str] | None = None) -> DataFrame:
    """The documents below path of these years, of these tickers or all, by entity and year; null where a year is missing."""
    spark.dataSource.register(StagedTimelines)
    return spark.read.format("staged_timelines").options(years=",".join(map(str, sorted(set(years)))), tickers=json.dumps(tickers)).load(path)


def missing_years(documents: DataFrame) -> DataFrame:
    """ticker, missing: the years an entity lacks, in order; entities that have all aren't listed."""
    lacking = documents.groupBy("ticker", "year").agg(F.count("document").alias("n")).where("n = 0")
    return lacking.groupBy("ticker").agg(F.array_sort(F.collect_set("year")).alias("missing"))

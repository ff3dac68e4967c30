"""Spike events of a stream, from state: each ticker's last rows are kept, and nothing is computed again."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

EVENTS = "ticker string, event_date date, v double, vol_z double, tone double, tone_z double, direction double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scores(x: pd.Series, window: int) -> pd.Series:
    """(x - mean) / std of exactly `window` earlier rows, all of them known; infinite where these don't vary but x differs."""
    before = x.shift(1).rolling(window, min_periods=window)
    # each frame by itself: running sums would keep the noise of rows that have left it
    mean, sd = before.apply(lambda w: w.mean(), raw=True), before.apply(lambda w: w.std(ddof=1) if (w != w[0]).any() else 0.0, raw=True)
    off = x - mean
    return (off / sd.where(sd != 0)).where(sd != 0, off.where(off == 0, off * float("inf")).where(off != 0))


class SpikeState(StatefulProcessor):
    """A ticker's last `window` rows and whether the last of them was above the thresholds, all a new row needs.

    Rows have to come in the order of their days, as daily_rollup() lets them out; one that isn't after the last day seen is left
    out, so that a file that comes twice changes nothing (late corrections go to the store)."""

    def __init__(self, window: int = 90, vol_z: float = 3.0, v: float = 5.0):
        self.window, self.vol_z, self.v = window, vol_z, v

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "days array<date>, v array<double>, tone array<double>, above boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.rows.get() if self.rows.exists() else ([], [], [], False)
        old = pd.DataFrame({"date": list(kept[0]), "v": pd.Series(list(kept[1]), dtype="float64"), "tone": pd.Series(list(kept[2]), dtype="float64")})
        new = pd.concat(list(rows))[["date", "v", "tone"]].sort_values(["date", "v", "tone"]).drop_duplicates("date", keep="last")
        if len(old):
            new = new[new["date"] > old["date"].iloc[-1]]
        if not len(new):
            return
        both = pd.concat([old, new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        both["vol_z"], both["tone_z"] = scores(both["v"], self.window), scores(both["tone"], self.window)
        above = ((both["vol_z"] >= self.vol_z) & (both["v"] >= self.v)).tolist()
        first = len(old)
        before = [kept[3] if i == first else above[i - 1] for i in range(first, len(both))]
        start = [x and not y for x, y in zip(above[first:], before)]
        last = both.tail(self.window)
        self.rows.update((last["date"].tolist(), last["v"].tolist(), last["tone"].tolist(), bool(above[-1])))
        found = both.iloc[first:][start]
        if len(found):
            sign = found["tone_z"].map(lambda z: None if pd.isna(z) else float((z > 0) - (z < 0)))
            yield pd.DataFrame({"ticker": key[0], "event_date": found["date"], "v": found["v"], "vol_z": found["vol_z"], "tone": found["tone"], "tone_z": found["tone_z"], "direction": sign})

    def close(self) -> None:
        pass


def stream_spike_events(days: DataFrame, **thresholds) -> DataFrame:
    """Events of a stream of days (ticker, date, v, tone), each once, as its day comes. State: a window of rows a ticker, in RocksDB."""
    days.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = days.select("ticker", "date", "v", "tone")
    return rows.groupBy("ticker").transformWithStateInPandas(SpikeState(**thresholds), EVENTS, "append", "None")

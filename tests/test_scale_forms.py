"""The forms that hold at any size, against the plain ones."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spikeline.operators import eventstudy, inference, ordered, scoring

DAY = dt.date(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def returns(spark, n=700, seed=1):
    """Tickers with gaps, a constant market, a drifting level and NaN among their returns."""
    r = random.Random(seed)
    rows = []
    for t in ("FULL", "GAPS", "FLAT", "HIGH", "SHORT"):
        for i in range(n if t != "SHORT" else 70):
            m = 0.0123 if t == "FLAT" else r.gauss(0, 0.02) + (1e3 + i if t == "HIGH" else 0)
            y = 0.4 * m + r.gauss(0, 0.01)
            if t == "GAPS" and r.random() < 0.2:
                y = r.choice([None, NAN])
            rows.append((t, i, DAY + dt.timedelta(i), y, m if r.random() > 0.01 or t != "GAPS" else None))
    return spark.createDataFrame(rows, "ticker string, idx long, date date, r double, m double")


def test_frames_equal_the_frame_form(spark):
    rets = returns(spark)
    w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(-119, 0)
    clean = rets.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("r", "m")})
    plain = clean.select("ticker", "idx", F.regr_count("r", "m").over(w).alias("n"), F.regr_intercept("r", "m").over(w).alias("a"), F.regr_slope("r", "m").over(w).alias("b"))
    want = {(x["ticker"], x["idx"]): x for x in plain.collect()}
    got = eventstudy.frames(rets).collect()
    assert len(got) == len(want)
    near = lambda x, y: abs(x - y) <= 1e-9 * max(1, abs(y))
    for x in got:
        y = want[x["ticker"], x["idx"]]
        assert x["n"] == y["n"]
        if x["ticker"] == "FLAT":
            assert x["b"] is None and x["a"] is None
        elif y["n"] > 1:
            assert near(x["b"], y["b"]) and abs(x["a"] - y["a"]) <= 1e-9 * (1 if x["ticker"] != "HIGH" else 1e4), (x, y)


def test_frames_take_one_shuffle_and_no_frame_over_the_window(spark):
    plan = eventstudy.frames(returns(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "RowFrame, -119" not in plan


def test_models_and_returns_by_one_row_an_event(spark):
    """As regressing each event's own 120 days and adding up its own abnormal returns would give."""
    rets = returns(spark).withColumn("r", F.nanvl("r", F.lit(None).cast("double"))).where("ticker <> 'HIGH'")
    entered = spark.createDataFrame([(t, DAY + dt.timedelta(i), i + 1, None if i is None else 1.0) for t in ("FULL", "GAPS", "FLAT", "SHORT") for i in (20, 139, 140, 300, 555, 690)], "ticker string, event_date date, entry_idx long, direction double")
    days = eventstudy.day_table(rets)
    models = {(x["ticker"], x["entry_idx"]): x for x in eventstudy.cars(eventstudy.market_models(entered, days), days).collect()}
    by = {}
    for x in rets.collect():
        by.setdefault(x["ticker"], {})[x["idx"]] = (x["r"], x["m"])
    assert set(models) == {(t, i + 1) for t in ("FULL", "GAPS", "FLAT") for i in (139, 140, 300, 555, 690)}
    for (t, e), x in models.items():
        pairs = [p for i in range(e - 140, e - 20) if None not in (p := by[t][i])]
        assert x["n_est_obs"] == len(pairs)
        if len(pairs) >= 90 and t != "FLAT":
            b, a = np.polyfit([m for _, m in pairs], [r for r, _ in pairs], 1)
            assert x["beta_source"] == "market_model" and abs(x["alpha"] - a) < 1e-9 and abs(x["beta"] - b) < 1e-9
        elif len(pairs) < 90:
            assert (x["beta_source"], x["alpha"], x["beta"]) == ("market_adjusted", 0.0, 1.0)
        for h in (1, 5, 20):
            ahead = [by[t].get(e + k, (None, None)) for k in range(1, h + 1)]
            want = sum(r - x["alpha"] - x["beta"] * m for r, m in ahead) if t != "FLAT" and all(None not in p for p in ahead) else None
            assert x[f"CAR_t{h}"] is None if want is None else abs(x[f"CAR_t{h}"] - want) < 1e-12


def test_quantiles_equal_sorting(spark):
    r = random.Random(2)
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    cases = {
        "normal": [r.gauss(0, 1) for _ in range(3000)],
        "tied": [float(r.randrange(4)) for _ in range(2000)] + [1.5],
        "sizes": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(2000)],
        "close": [1.0 + k * 2**-52 for k in range(50) for _ in range(20)],
        "huge": [-1.7e308, 1.7e308] * 40 + [0.0],
        "one": [7.0] * 500,
        "single": [3.0],
    }
    for name, values in cases.items():
        df = spark.createDataFrame([(x,) for x in [*values, None, NAN]], "x double").repartition(3)
        got = ordered.exact_quantiles(df, "x", shares, bins=16, collected=30)
        values = sorted(values)
        for s, g in zip(shares, got):
            p = s * (len(values) - 1)
            a, b = values[math.floor(p)], values[math.ceil(p)]
            assert g == (a if a == b else a + (b - a) * (p - math.floor(p))), name
    odd = spark.createDataFrame([(x,) for x in [-INF] * 5 + [INF] * 5 + [1.0, 2.0]], "x double")
    assert ordered.exact_quantiles(odd, "x", [0.0, 5 / 11, 6 / 11, 1.0]) == [-INF, 1.0, 2.0, INF]
    assert ordered.exact_quantiles(odd.limit(0), "x", [0.5]) == [None]
    assert inference.tercile_edges(odd.limit(0), "x").first()["e1"] is None


def test_scans_in_ranges_equal_one_order(spark):
    """Several groups with orders of their own, ties, empty stretches and rows before, between and after all that is known."""
    r = random.Random(3)
    rows = [(r.choice("ab"), DAY + dt.timedelta(r.randrange(400)), r.randrange(2), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, d date, kind int, v long").dropDuplicates(["g", "d", "kind"])
    have = [tuple(x) for x in df.collect()]
    ranged = ordered.with_range(df, "d", 50)
    assert ranged.select("_range").distinct().count() > 8 and ordered.with_range(df, "d") is None
    keys = df.groupBy("g", "d").agg(F.sum("v").alias("v"))
    for rows_a_range in (40, 10**6):
        got = {(x["g"], x["d"]): x["s"] for x in ordered.running(keys, "d", F.col("v"), "s", ("g",), rows_a_range).collect()}
        assert got == {(g, d): sum(v for h, e, _, v in have if h == g and e <= d) for g, d, _, _ in have}
        found = ordered.following(df, "d", "kind", F.col("kind") == 0, {"next_v": F.col("v"), "next_d": F.col("d")}, ("g",), rows_a_range).collect()
        assert len(found) == len(have)
        for x in found:
            later = [(e, k, v) for h, e, k, v in have if h == x["g"] and k == 0 and (e, k) > (x["d"], x["kind"])]
            want = min(later, default=None)
            assert (x["next_d"], x["next_v"]) == ((want[0], want[2]) if want else (None, None))


def test_entries_of_entities_with_calendars_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ordered.following, "__defaults__", ((), 20, None))
    days = spark.createDataFrame([(x, DAY + dt.timedelta(i), i // (1 if x == "N" else 2)) for x in "NS" for i in range(0, 60, 1 if x == "N" else 2)], "place string, date date, idx long")
    events = spark.createDataFrame([("N", "A", DAY), ("S", "B", DAY), ("S", "C", DAY + dt.timedelta(1)), ("S", "D", DAY + dt.timedelta(58)), ("N", "E", DAY + dt.timedelta(58)), ("N", "F", DAY)], "place string, ticker string, event_date date")
    got = {x["ticker"]: (x["entry_idx"], x["entry_date"] and (x["entry_date"] - DAY).days) for x in eventstudy.entries(events, days, ("place",)).collect()}
    assert got == {"A": (1, 1), "B": (1, 2), "C": (1, 2), "D": (None, None), "E": (59, 59), "F": (1, 1)}


def test_calendar_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered.running, "__defaults__", ((), 25))
    rows = [("^ALL", DAY + dt.timedelta(i * 3), 1.0 if i % 5 else None) for i in range(200)] + [("A", DAY + dt.timedelta(1), 2.0)]
    got = eventstudy.calendar(spark.createDataFrame(rows, "ticker string, date date, close double"), "^ALL").orderBy("date").collect()
    assert [x["idx"] for x in got] == list(range(160)) and [x["date"] for x in got] == [d for t, d, c in rows if t == "^ALL" and c]


def test_intensity_in_ranges_with_infinite_ties(spark, monkeypatch):
    monkeypatch.setattr(ordered.running, "__defaults__", ((), 30))
    r = random.Random(4)
    ref = [r.choice([r.gauss(0, 3), INF, -INF, 2.5, 0.0]) for _ in range(400)]
    ev = [(str(i), DAY, x) for i, x in enumerate([*ref[:40], 100.0, 2.4999, None])]
    got = {x["ticker"]: x["intensity_percentile"] for x in scoring.intensity(spark.createDataFrame(ev, "ticker string, event_date date, vol_z double"), spark.createDataFrame([(x,) for x in ref], "vol_z double")).collect()}
    sizes = [round(abs(x), 12) for x in ref]
    for t, _, x in ev:
        if x is not None:
            a, b = sum(y < round(abs(x), 12) for y in sizes), sum(y <= round(abs(x), 12) for y in sizes)
            assert got[t] == pytest.approx((a + b + (a < b)) * 50 / len(ref))
    assert len(got) == len(ev) - 1

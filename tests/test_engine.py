import datetime as dt

import pytest
from pyspark.sql import functions as F

from spikeline.functions import normal, text
from spikeline.functions.text import query_string
from spikeline.operators import incremental, inference, scoring, signals
from spikeline.sources import tables, written
from spikeline.streaming import daily

DAY = dt.date(2024, 1, 1)


def series(spark, values, ticker="A"):
    rows = [(ticker, DAY + dt.timedelta(i), None if v is None else float(v), float(i % 3)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, v double, tone double")


def test_zscore_needs_every_earlier_row(spark):
    z = [r["vol_z"] for r in signals.with_zscores(series(spark, [1, 3] * 45 + [20, 2])).orderBy("date").collect()]
    assert z[:90] == [None] * 90 and z[90] > 3
    gap = [1, 3] * 45 + [20]
    gap[40] = None
    assert signals.with_zscores(series(spark, gap)).where("vol_z IS NOT NULL").count() == 0


def test_spike_after_a_constant_stretch_is_infinite_and_runs_merge(spark):
    found = signals.spike_events(signals.with_zscores(series(spark, [0] * 90 + [9, 9, 9, 0]))).collect()
    assert [r["event_date"] for r in found] == [DAY + dt.timedelta(90)] and found[0]["vol_z"] == float("inf")


def test_upsert_keeps_the_last(spark):
    store = spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, 1.0)], "ticker string, date date, v double")
    new = spark.createDataFrame([("A", DAY, 2.0)], store.schema)
    once = incremental.upsert(store, new)
    assert sorted((r["ticker"], r["v"]) for r in once.collect()) == [("A", 2.0), ("B", 1.0)]
    assert sorted(incremental.upsert(once, new).collect()) == sorted(once.collect())


def test_fdr_steps_up(spark):
    p = [0.001, 0.03, 0.031, 0.5]
    got = {r["name"]: r["rejected"] for r in inference.bh_fdr(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "name string, p double"), 0.05).collect()}
    assert got == {"0": True, "1": True, "2": True, "3": False}


def test_percentile_of_score(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(20)], "vol_z double")
    ev = spark.createDataFrame([("A", DAY, 0.0), ("B", DAY, 19.0), ("C", DAY, 9.5)], "ticker string, event_date date, vol_z double")
    assert {r["ticker"]: r["intensity_percentile"] for r in scoring.intensity(ev, ref).collect()} == {"A": 5.0, "B": 100.0, "C": 50.0}


def test_claims_audit(spark):
    rows = spark.createDataFrame([("A", 0.1, scoring.DISCLAIMER)], "ticker string, tercile_mean_car5 double, calibration_disclaimer string")
    assert scoring.claims_audit(rows) is rows
    for bad in (rows.withColumn("Car_T5", F.lit(1.0)), rows.drop("calibration_disclaimer"), rows.withColumn("calibration_disclaimer", F.lit("other"))):
        with pytest.raises(ValueError):
            scoring.claims_audit(bad)
    with pytest.raises(ValueError):
        scoring.guard("SIGNAL")


def test_query_strings(spark):
    df = spark.createDataFrame([("Ab", " X | |y "), ("Cd", None)], "company_name string, aliases string")
    assert [r[0] for r in df.select(query_string()).collect()] == ['("Ab" OR "X" OR "y") sourcecountry:IN', '"Cd" sourcecountry:IN']


def test_power_identities():
    assert normal.mde(2.0, 0.5) == pytest.approx(2 * 1.6448536269514722)
    assert normal.achieved_power(0.0, 1.0) == pytest.approx(0.05)


def test_locked_statistic_matches_or_raises(spark, tmp_path, monkeypatch):
    from spikeline.plans import queries

    events = lambda car: spark.createDataFrame([(1.0, car), (-1.0, 0.5)], "direction double, CAR_t5 double")
    told = lambda car: (events(car), queries.t5(events(car), "by_day"))
    spark.createDataFrame([(-0.125,)], "locked double").write.parquet(f"{tmp_path}/locked")
    monkeypatch.setattr(queries, "by_day", lambda *_: told(0.25))
    rows = lambda: {r["off"]: (r["recomputed"], r["stale"]) for r in queries.QUERIES["staleness_check"](spark, "/tables").collect()}
    assert rows() == {0.0: (-0.125, False), 1e-10: (-0.125, False), 1e-8: (-0.125, True), -1e-8: (-0.125, True)}
    spark.conf.set("spark.spikeline.locked", f"{tmp_path}/locked")
    try:
        assert len(rows()) == 4
        monkeypatch.setattr(queries, "by_day", lambda *_: told(0.25 + 1e-8))
        monkeypatch.setattr(queries, "nulls", lambda *_: (events(0.25 + 1e-8), None, None))
        for name in ("staleness_check", "power_analysis"):
            with pytest.raises(ValueError, match="locked"):
                queries.QUERIES[name](spark, "/tables")
        spark.conf.set("spark.spikeline.locked", f"{tmp_path}/nothing")
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            rows()
    finally:
        spark.conf.unset("spark.spikeline.locked")
    one = spark.createDataFrame([(0.5,)], "recomputed double")
    for locked in ([], [(None,)], [(0.5,), (0.5,)]):
        with pytest.raises(ValueError, match="locked"):
            inference.require_current(one, spark.createDataFrame(locked, "locked double"))


def test_missing_benchmark_stops(spark):
    from spikeline.operators import audits

    rows = spark.createDataFrame([("A", DAY, 1.0), ("^ALL", DAY, None)], "ticker string, date date, close double")
    for f in (lambda: audits.sound_prices(rows, "^ALL"), lambda: audits.price_integrity(rows, rows.select("ticker").distinct(), "^ALL")):
        with pytest.raises(ValueError, match="benchmark"):
            f()


def test_dropped_symbols_dont_enter_returns(spark, monkeypatch):
    from spikeline.plans import queries

    days = [DAY + dt.timedelta(i) for i in range(100)]
    kept = {"^ALL": days, "GOOD": days[:-2], "THIN": days[::2], "LATE": days[40:], "ZERO": days}
    rows = [(t, x, 0.0 if t == "ZERO" and i == 50 else 10.0 + i % 7) for t, own in kept.items() for i, x in enumerate(own)]
    panel = spark.createDataFrame(rows, "ticker string, date date, close double")
    monkeypatch.setattr(queries.tables, "price_panel", lambda *_: panel)
    assert {r[0] for r in queries.rets(spark, "").select("ticker").distinct().collect()} == {"GOOD"}
    assert {r[0] for r in queries.prices(spark, "").select("ticker").distinct().collect()} == {"GOOD", "^ALL"}


NAN, INF = float("nan"), float("inf")


def test_nan_is_unknown(spark):
    gap = series(spark, [1, 3] * 45 + [NAN, 20])
    assert signals.with_zscores(gap).where("vol_z IS NOT NULL").count() == 0
    odd = spark.createDataFrame([("A", DAY, 9.0, NAN, 0.0, 0.0)], "ticker string, date date, v double, vol_z double, tone double, tone_z double")
    assert signals.spike_events(odd).count() == 0 and signals.gated_events(odd).count() == 0


def test_gate_takes_loose_events_instead(spark):
    z = signals.with_zscores(series(spark, [1, 3] * 45 + [20, 1, 6, 6, 1]))
    strict, loose = signals.spike_events(z).count(), signals.spike_events(z, 0.1, 3.0).count()
    assert 0 < strict < loose
    assert signals.gated_events(z, gate=strict).count() == strict
    assert signals.gated_events(z, gate=strict + 1, loose=(0.1, 3.0)).count() == loose


def test_unknown_tones_and_tied_edges_are_errors(spark):
    reference = spark.createDataFrame([("mid", 0.0, 1.0, 0.1, 5)], "tercile_label string, e1 double, e2 double, tercile_mean_car5 double, tercile_n long")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "tone_z double")
    assert [r["tercile_label"] for r in scoring.classify(rows(-INF, 0.0, 0.5, 1.0, INF), reference).collect()] == ["bottom", "bottom", "mid", "mid", "top"]
    for bad in (None, NAN):
        with pytest.raises(Exception, match="unknown"):
            scoring.classify(rows(bad), reference).collect()
    with pytest.raises(Exception, match="tie"):
        inference.tercile_edges(rows(1.0, 1.0, 1.0, 2.0), "tone_z").collect()
    assert tuple(inference.tercile_edges(rows(0.0, 1.0, 2.0, 3.0, NAN, None), "tone_z").first()) == pytest.approx((0, 1, 2, 3))


def test_draws_are_permutations_and_never_too_few(spark):
    """All slots of a ticker with as many events as days draw each day once; fewer draw a start of the same order."""
    pool = spark.createDataFrame([("A", 3 * i) for i in range(101)] + [("B", i) for i in range(4)] + [("C", 9)], "ticker string, idx long")
    slots = lambda *n: spark.createDataFrame([(t, i) for t, k in n for i in range(1, k + 1)], "ticker string, slot int")

    def drawn(numbered):
        got = {}
        for r in inference.draws(pool, numbered, 20).collect():
            got.setdefault((r["perm"], r["ticker"]), {})[r["slot"]] = r["idx"]
        return got

    whole = drawn(slots(("A", 101), ("B", 4), ("C", 1)))
    assert len(whole) == 60
    days = {"A": [3 * i for i in range(101)], "B": list(range(4)), "C": [9]}
    assert all(sorted(x.values()) == days[t] and sorted(x) == list(range(1, len(x) + 1)) for (_, t), x in whole.items())
    assert len({tuple(sorted(x.items())) for (_, t), x in whole.items() if t == "A"}) == 20
    few = drawn(slots(("A", 5)))
    assert all(x == {s: whole[key][s] for s in range(1, 6)} for key, x in few.items())
    for bad in (slots(("B", 5)), slots(("D", 1))):
        with pytest.raises(Exception, match="fewer candidate days"):
            inference.draws(pool, bad, 3).collect()


def test_draws_are_uniform(spark):
    """Every day of 10 is drawn first, and second, about as often; so is every pair of days."""
    rows = spark.range(1, 20_001).select(F.col("id").cast("int").alias("perm"), F.lit("A").alias("ticker"), F.lit(10).cast("long").alias("m"), F.explode(F.expr("array(0L, 1L)")).alias("j"))
    at = {}
    for r in inference.permuted(rows).select("perm", "j", "at").collect():
        at.setdefault(r["perm"], {})[r["j"]] = r["at"]
    pairs = {}
    for x in at.values():
        pairs[x[0], x[1]] = pairs.get((x[0], x[1]), 0) + 1
    assert len(pairs) == 90 and all(a != b for a, b in pairs)
    chi = sum((n - 20_000 / 90) ** 2 / (20_000 / 90) for n in pairs.values())
    assert chi < 89 + 5 * (2 * 89) ** 0.5


def test_declustering_counts_all_events(spark):
    days = [DAY + dt.timedelta(i) for i in range(2)]
    events = spark.createDataFrame([(t, days[0]) for t in "ABCD"] + [("A", days[1])], "ticker string, event_date date")
    cars = spark.createDataFrame([("A", days[0], 1.0, 0.5), ("A", days[1], -1.0, 0.2), ("B", days[1], 1.0, None)], "ticker string, event_date date, direction double, CAR_t5 double")
    null = spark.createDataFrame([(-0.3,), (-0.1,), (None,)], "T5 double")
    assert tuple(inference.declustered(cars, events, null).first()) == (1, -0.2, pytest.approx(2 / 3))


def test_upsert_follows_the_sequence(spark):
    kind = "ticker string, date date, v double, n long"
    store = spark.createDataFrame([("A", DAY, 9.0, 9), ("B", DAY, 1.0, 1)], kind)
    new = spark.createDataFrame([("A", DAY, 5.0, 1), ("A", DAY, 2.0, 2)], kind)
    assert {r["ticker"]: r["v"] for r in incremental.upsert(store, new, sequence="n").collect()} == {"A": 2.0, "B": 1.0}
    assert {r["ticker"]: r["v"] for r in incremental.upsert(store, new, keep="first", sequence="n").collect()} == {"A": 9.0, "B": 1.0}


def test_alerts_take_infinite_values_and_counts_have_plurals(spark):
    rows = spark.createDataFrame([("A", DAY, INF, 1.0, 99.5), ("B", DAY, 3.0, -1.0, None)], "ticker string, event_date date, vol_z double, direction double, intensity_percentile double")
    a, b = (r[0] for r in rows.select(text.alert_message()).collect())
    assert "A — 2024-01-01\nTone: positive | Intensity: 100th pct" in a and "negative | Intensity: ?th" in b
    n = spark.createDataFrame([(1, 0.01234), (1234, -0.5)], "n long, x double")
    assert [tuple(r) for r in n.select(text.counted("n", "event"), text.signed_percent("x")).collect()] == [("1 event", "+1.23%"), ("1,234 events", "-50.00%")]


def test_percentile_of_score_with_infinite_and_tied_values(spark):
    ref = spark.createDataFrame([(x,) for x in (-2.0, 2.0, 2.0005, 5.0, INF, None, NAN)], "vol_z double")
    ev = spark.createDataFrame([(str(i), DAY, x) for i, x in enumerate((2.0, 2.0004, INF, 1.0))], "ticker string, event_date date, vol_z double")
    got = {r["ticker"]: r["intensity_percentile"] for r in scoring.intensity(ev, ref).collect()}
    assert got == {"0": 30.0, "1": 40.0, "2": 100.0, "3": 0.0}


def test_strict_timelines_want_every_year(spark):
    doc = lambda v: '{"timeline":[{"data":[{"date":"20240101T000000Z","value":%s}]}]}' % v
    rows = [("A", 1, doc(1)), ("A", 2, doc(2)), ("B", 1, doc(3)), ("C", 1, doc(4)), ("C", 2, None)]
    got = signals.strict_timelines(spark.createDataFrame(rows, "ticker string, year int, document string"), [1, 2]).collect()
    assert [tuple(r) for r in got] == [("A", DAY, 1.0)]


def test_sinks_and_scans(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\n\"b\"", DAY), (2, "", None), (3, None, None)], "k int, s string, d date")
    written.write_csv(rows, f"{tmp_path}/c")
    got = sorted(map(tuple, tables.csv_table(spark, f"{tmp_path}/c", "k int, s string, d date", lines=True).collect()))
    assert got == [(1, "a,\n\"b\"", DAY), (2, "", None), (3, "", None)]
    written.write_json(rows, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(f"{tmp_path}/j").collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.json").write_text('{"a":\n1}')
    (tmp_path / "docs" / "y.json").write_text("broken")
    docs = {r["file"].rpartition("/")[2]: r["document"] for r in tables.json_documents(spark, f"{tmp_path}/docs", "a int").collect()}
    assert docs["x.json"]["a"] == 1 and (docs["y.json"] is None or docs["y.json"]["a"] is None)
    calls = []
    make = lambda: calls.append(1) or rows
    for _ in range(2):
        assert written.load_or_bootstrap(spark, f"{tmp_path}/store", make).count() == 3
    written.swap_parquet(spark.read.parquet(f"{tmp_path}/store").where("k > 1"), f"{tmp_path}/store")
    assert not list(tmp_path.glob(".store*"))
    assert calls == [1] and spark.read.parquet(f"{tmp_path}/store").count() == 2 and {x.name for x in tmp_path.iterdir()} >= {"store"} and not list(tmp_path.glob("store.*"))
    wide = spark.createDataFrame([(DAY, 1.0, None), (DAY + dt.timedelta(1), NAN, 2.0)], "date date, X double, Y double")
    assert sorted(r["ticker"] for r in tables.wide_to_long(wide, ["X", "Y"]).collect()) == ["X", "Y"]


def test_stream_upserts_late_rows_and_goes_on(spark, tmp_path):
    kind = "ticker string, ts timestamp, vol double, tone double, n long"
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    put = lambda *rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    store, seen, sent = f"{tmp_path}/store", [], []

    def run(checkpoint):
        days = source().select("ticker", F.to_date("ts").alias("date"), F.col("vol").alias("v"), "n")
        then = daily.on_change(lambda s: s.where("v > 5").select("ticker", F.col("date").alias("event_date"), "v"), lambda x, k: sent.append(sorted(r["v"] for r in x.collect())), f"{tmp_path}/known")
        query = daily.upsert_stream(days, store, f"{tmp_path}/{checkpoint}", lambda s, k: (seen.append(k), then(s, k)), sequence="n")
        query.awaitTermination()
        return {(r["ticker"], r["date"].day): r["v"] for r in daily.stored(spark, store).collect()}

    put(("A", at(1, 0), 1.0, 0.0, 1), ("A", at(1, 5), 7.0, 0.0, 2))
    assert run("one") == {("A", 1): 7.0}
    assert run("one") == {("A", 1): 7.0}  # nothing new
    put(("A", at(1, 9), 3.0, 0.0, 1), ("B", at(2, 0), 8.0, 0.0, 1))
    assert run("one") == {("A", 1): 3.0, ("B", 2): 8.0}
    assert [x for x in sent if x] == [[7.0], [8.0]] and len(list((tmp_path / "store" / "versions").glob("version=*"))) == 2
    put(("C", at(3, 0), 1.0, 0.0, 1))
    assert run("two")["C", 3] == 1.0  # a new checkpoint goes on after what is there
    for old in (tmp_path / "store" / "versions").glob("version=*"):
        old.rename(tmp_path / f"gone-{old.name}")
    put(("D", at(4, 0), 1.0, 0.0, 1))
    with pytest.raises(Exception, match="missing"):
        run("two")


def test_daily_rollup_drops_what_comes_after_the_watermark(spark, tmp_path):
    kind = "ticker string, ts timestamp, vol double, tone double"
    put = lambda *rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        daily.upsert_stream(daily.daily_rollup(stream), f"{tmp_path}/store", f"{tmp_path}/progress").awaitTermination()
        return {r["date"].day: (r["v"], r["tone"]) for r in daily.stored(spark, f"{tmp_path}/store").collect()}

    put(("A", dt.datetime(2024, 1, 1, 3), 2.0, 1.0), ("A", dt.datetime(2024, 1, 1, 4), 3.0, 3.0), ("A", dt.datetime(2024, 1, 4, 1), 1.0, 0.0))
    assert run() == {1: (5.0, 2.0)}
    put(("A", dt.datetime(2024, 1, 1, 5), 100.0, 0.0), ("A", dt.datetime(2024, 1, 9, 1), 1.0, 0.0))
    assert run() == {1: (5.0, 2.0), 4: (1.0, 0.0)}


def test_shared_folder_is_wanted_beyond_one_machine(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://there:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        written.shared_folder(Cluster)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["ticker", "event_date"]

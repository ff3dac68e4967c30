"""The live path: stops, stores, streams with state, staged documents and alerts."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from spikeline.operators import audits, eventstudy, incremental, scoring, signals
from spikeline.plans import live
from spikeline.sources import staged, store, tables, written
from spikeline.streaming import outbox, spikes

DAY = dt.date(2024, 1, 1)
DAYS = "ticker string, date date, v double, tone double"


def day(i):
    return DAY + dt.timedelta(i)


def test_verdict_stops_scoring_before_anything_is_read(spark):
    for verdict in ("SIGNAL", None, spark.createDataFrame([("SIGNAL",)], "verdict string"), spark.createDataFrame([], "verdict string")):
        with pytest.raises(ValueError, match="verdict"):
            scoring.score(None, None, None, None, verdict)
        with pytest.raises(ValueError, match="verdict"):
            live.run_day(spark, "/nowhere", None, "2024-01-01", verdict, None)
    scoring.guard(spark.createDataFrame([("NULL",)], "verdict string"))


def test_queries_that_score_ask_for_the_verdict(spark, monkeypatch):
    from spikeline.plans import queries

    monkeypatch.setattr(queries, "study", lambda *_: (None, None, None, None))
    for module, name in ((queries, "null_of"), (queries, "observed_of"), (queries.inference, "p_values")):
        monkeypatch.setattr(module, name, lambda *_: None)
    monkeypatch.setattr(queries.inference, "verdict", lambda *_: spark.createDataFrame([("SIGNAL",)], "verdict string"))
    for name in ("calibration_attach", "score_new_events", "scores_attached", "daily_run"):
        with pytest.raises(ValueError, match="SIGNAL"):
            queries.QUERIES[name](spark, "/tables")


def test_stale_stores_arent_published(spark):
    rows = spark.createDataFrame([(day(0),), (day(3),)], "date date")
    incremental.require_fresh(rows, "2024-01-08")
    for asof, bad in (("2024-01-09", rows), ("2024-01-02", rows.limit(0))):
        with pytest.raises(ValueError, match="days old"):
            incremental.require_fresh(bad, asof)


def test_scores_are_attached_by_key(spark):
    events = spark.createDataFrame([("A", day(0), 3.0), ("B", day(0), 4.0)], "ticker string, event_date date, vol_z double")
    scores = spark.createDataFrame([("A", day(0), 9.0, "top"), ("A", day(1), 9.0, "mid")], "ticker string, event_date date, vol_z double, tercile_label string")
    assert sorted(map(tuple, scoring.attach(events, scores).collect())) == [("A", day(0), 3.0, "top"), ("B", day(0), 4.0, None)]
    with pytest.raises(Exception, match="scored twice"):
        scoring.attach(events, scores.union(scores)).collect()


def test_series_join_makes_neighbours_of_what_is_left(spark):
    vol = spark.createDataFrame([("A", day(i), float(i)) for i in range(5)], "ticker string, date date, value double")
    tone = spark.createDataFrame([("A", day(i), 1.0) for i in (0, 1, 3, 4, 9)] + [("B", day(0), 1.0)], vol.schema)
    z = signals.with_zscores(signals.joined_series(vol, tone), 2)
    assert [(r["date"], r["v"]) for r in z.orderBy("date").collect()] == [(day(i), float(i)) for i in (0, 1, 3, 4)]
    assert z.where(F.col("date") == day(3)).first()["vol_z"] == pytest.approx(2.5 / 0.5**0.5)


def test_articles_are_parsed_in_order(spark):
    rows = [("A", '{"articles":[{"title":"x","url":"u"},{"seendate":"s"}]}'), ("B", "{}"), ("C", "broken"), ("D", None), ("E", '{"articles":[]}')]
    got = {r["ticker"]: r["articles"] for r in signals.parse_articles(spark.createDataFrame(rows, "ticker string, document string")).collect()}
    assert [tuple(x) for x in got["A"]] == [("x", "u", None), (None, None, "s")] and got["B"] is None and got["C"] is None and got["D"] is None and got["E"] == []


def test_level_breaks(spark):
    kind = "ticker string, date date, close double"
    stored = spark.createDataFrame([(t, day(i), 100.0 + i) for t in ("SAME", "SPLIT", "REVISED", "OLD") for i in range(20)], kind)
    factor = {"SAME": lambda i: 1.0, "SPLIT": lambda i: 0.25, "REVISED": lambda i: 1 + 0.1 * (i % 3), "NEW": lambda i: 1.0}
    fetched = spark.createDataFrame([(t, day(i), (100.0 + i) * f(i) if i != 18 else None) for t, f in factor.items() for i in range(12, 25)], kind)
    got = {r["ticker"]: r for r in audits.level_breaks(stored, fetched).collect()}
    assert {t: r["verdict"] for t, r in got.items()} == {"SAME": "SAME", "SPLIT": "BREAK", "REVISED": "REVISED"}
    assert (got["SPLIT"]["days"], got["SPLIT"]["ratio"], got["SPLIT"]["first_day"]) == (7, 0.25, day(12)) and got["SPLIT"]["jump"] == pytest.approx(math.log(28 / 111))


def test_store_rewrites_touched_months_only(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = [("A", day(i), float(i)) for i in range(100)] + [("B", day(i), 0.0) for i in range(100)]
    kind = "ticker string, date date, v double"
    assert len(store.write_version(spark.createDataFrame(rows, kind), path, 0)) == 4
    files = lambda: {str(x) for x in (tmp_path / "store" / "data").rglob("*.parquet")}
    first = files()
    late = spark.createDataFrame([("A", day(40), -1.0), ("C", day(41), 5.0)], kind)
    before = store.read_store(spark, path)  # of a reader that has begun
    for _ in range(2):  # a repeated batch replaces its own version
        assert list(store.write_version(late, path, 1)) == ["2024-02-01"]
    assert files() >= first and all("month=2024-02-01" in x for x in files() - first)
    got = {(r["ticker"], r["date"]): r["v"] for r in store.read_store(spark, path).collect()}
    assert got == {**{(t, d): v for t, d, v in rows}, ("A", day(40)): -1.0, ("C", day(41)): 5.0}
    assert before.where("v = -1").count() == 0 and before.count() == 200
    now = store.manifest(spark, path, 1)
    assert [m for m, f in now.items() if f != store.manifest(spark, path, 0)[m]] == ["2024-02-01"]
    store.write_version(late.limit(0), path, 2)
    assert store.versions(spark, path) == [1, 2] and store.read_store(spark, path).count() == 201  # the months of version 0 that are still named stay
    with pytest.raises(FileNotFoundError, match="missing"):
        store.write_version(late, path, 9)


def test_half_a_version_isnt_seen(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    rows = spark.createDataFrame([("A", day(0), 1.0)], "ticker string, date date, v double")
    store.write_version(rows, path, 0)

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "swap_parquet", dies)  # after the months were written, before the manifest is
    with pytest.raises(OSError, match="lost"):
        store.write_version(rows.withColumn("v", F.lit(2.0)), path, 1)
    assert [r["v"] for r in store.read_store(spark, path).collect()] == [1.0]


def test_streamed_events_equal_the_batch_ones(spark, tmp_path):
    """Batches that cut runs and windows anywhere, a restart, and files that come a second time."""
    r = random.Random(5)
    rows = []
    for t in "AB":
        v = [float(r.randrange(4)) for _ in range(260)]
        v[100:200] = [1.0] * 100  # a constant stretch: infinite scores
        for i in (95, 96, 97, 150, 199, 200, 201, 240):
            v[i] = 30.0
        rows += [(t, day(i), x, r.gauss(0, 1)) for i, x in enumerate(v)]
    whole = spark.createDataFrame(rows, DAYS)
    key = lambda x: (x["ticker"], x["event_date"], x["v"], *(round(x[c], 9) for c in ("vol_z", "tone", "tone_z", "direction")))
    want = sorted(map(key, signals.spike_events(signals.with_zscores(whole)).collect()))
    put = lambda a, b: whole.where(F.col("date").between(day(a), day(b))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        days = spark.readStream.schema(DAYS).parquet(f"{tmp_path}/in")
        query = spikes.stream_spike_events(days).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        return sorted(map(key, spark.read.schema(spikes.EVENTS).parquet(f"{tmp_path}/out").collect()))

    put(0, 95)
    run()
    put(96, 199)
    run()
    put(150, 199)  # again
    put(200, 259)
    assert run() == want and len(want) > 6


def test_staged_documents_are_read_by_entity_and_year(spark, tmp_path):
    rows = [(t, y, f'{{"n":"{t}{y}"}}') for t in ("A", "B c", "D") for y in (2022, 2023, 2024) if (t, y) != ("D", 2023)]
    written.write_raw(spark.createDataFrame(rows, "ticker string, year int, document string"), f"{tmp_path}/docs")
    docs = staged.staged_timelines(spark, f"{tmp_path}/docs", [2023, 2024, 2025])
    want = {(t, y): next((d for a, b, d in rows if (a, b) == (t, y)), None) for t in ("A", "B c", "D") for y in (2023, 2024, 2025)}
    assert {(r["ticker"], r["year"]): r["document"] for r in docs.collect()} == want
    assert docs.rdd.getNumPartitions() == 9
    some = staged.staged_timelines(spark, f"{tmp_path}/docs", [2024], ["A", "B c", "X"])
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    assert docs.where("year = 1999").count() == 0 and docs.where("ticker = 'A'").count() == 3
    assert {r["ticker"]: r["missing"] for r in staged.missing_years(docs).collect()} == {"A": [2025], "B c": [2025], "D": [2023, 2025]}
    assert staged.staged_timelines(spark, f"{tmp_path}/none", [1]).count() == 0


def test_alerts_are_sent_again_until_acknowledged(spark, tmp_path, monkeypatch):
    box, sent = f"{tmp_path}/box", []
    kind = "ticker string, event_date date, message string"
    rows = spark.createDataFrame([("A", day(0), "a"), ("B", day(1), "b")], kind)
    send = lambda batch: sent.append(sorted(r["id"] for r in batch.collect()))
    assert outbox.deliver(spark, box, send) == 0
    outbox.enqueue(rows, box, 0)
    with monkeypatch.context() as m:  # the message is out, the acknowledgement isn't
        m.setattr(outbox, "swap_parquet", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            outbox.deliver(spark, box, send)
    assert outbox.deliver(spark, box, send) == 2 and sent == [["A_2024-01-01", "B_2024-01-02"]] * 2
    outbox.enqueue(rows, box, 0)  # the batch is repeated
    outbox.enqueue(rows.union(spark.createDataFrame([("C", day(1), "c")], kind)), box, 1)
    assert outbox.deliver(spark, box, send) == 1 and sent[-1] == ["C_2024-01-02"]

    def refuses(_):
        raise ConnectionError("no")

    outbox.enqueue(spark.createDataFrame([("D", day(2), "d")], kind), box, 2)
    with pytest.raises(ConnectionError):
        outbox.deliver(spark, box, refuses)
    assert [r["ticker"] for r in outbox.waiting(spark, box).collect()] == ["D"]


def test_a_day_runs_to_the_end_and_again(spark, tmp_path):
    home, sent = str(tmp_path), []
    r = random.Random(6)
    rows = [(t, day(i), 30.0 if i in (100, 150, 170) else float(r.randrange(4)), r.gauss(0, 1)) for t in "AB" for i in range(180)]
    source = spark.createDataFrame(rows, DAYS)
    store.write_version(source.where(F.col("date") < day(140)), f"{home}/days", 0)
    written.swap_parquet(signals.gated_events(signals.with_zscores(source.where(F.col("date") < day(140)))).select("ticker", "event_date"), f"{home}/known")
    terciles = spark.createDataFrame([("bottom", -0.5, 0.5, 0.1, 5), ("mid", -0.5, 0.5, 0.0, 6), ("top", -0.5, 0.5, -0.1, 7)], "tercile_label string, e1 double, e2 double, tercile_mean_car5 double, tercile_n long")
    send = lambda batch: sent.extend(x["id"] for x in batch.collect())
    feed = live.run_day(spark, home, source, str(day(160)), "NULL", terciles, send=send)
    assert feed.first()["event_date"] == day(150) and sorted(sent) == [f"{t}_{day(150)}" for t in "AB"]
    live.run_day(spark, home, source, str(day(160)), "NULL", terciles, send=send)  # nothing new
    assert len(sent) == 2
    live.run_day(spark, home, source, str(day(179)), "NULL", terciles, backfill=str(day(120)), send=send)
    assert sorted(sent)[-1] == f"B_{day(170)}" and len(sent) == 4
    scores = spark.read.parquet(f"{home}/scores/run={day(179)}")
    assert {x["novelty_days"] for x in scores.collect()} == {20} and not scoring.FORBIDDEN & {c.lower() for c in scores.columns}
    assert live.days_to_fetch(source, source.select("ticker").distinct(), str(day(181))).select("gap_start").distinct().collect() == [(day(180),)]
    with pytest.raises(ValueError, match="days old"):
        live.run_day(spark, home, source, str(day(190)), "NULL", terciles)


def test_probe_tells_missing_from_broken(spark, tmp_path, monkeypatch):
    spark.range(1).write.parquet(f"{tmp_path}/there.parquet")
    assert {r["source"]: r["ok"] for r in tables.probe(spark, str(tmp_path), ["there", "absent"]).collect()} == {"there": True, "absent": False}
    monkeypatch.setattr(tables, "table", lambda *_: (_ for _ in ()).throw(RuntimeError("the cluster is gone")))
    with pytest.raises(RuntimeError):
        tables.probe(spark, str(tmp_path), ["there"])


def test_maps_of_prices_by_day(spark):
    rows = [(f"S{i}", day(k), None if i == k else float(i + k)) for i in range(40) for k in range(3)]
    wide = tables.wide_by_day(spark.createDataFrame(rows, "ticker string, date date, close double"), 4)
    assert wide.count() == 12
    assert sorted(map(tuple, tables.maps_to_long(wide).collect())) == sorted(r for r in rows if r[2] is not None)


def test_scratch_is_cleared(spark):
    with written.scratch(spark):
        with written.scratch(spark) as keep:
            gone, kept = (written.written(spark.range(3), "numbers") for _ in range(2))
            assert gone.count() == 3 and keep(kept) == (kept,)
        assert not written.exists_folder(spark, gone._written_at) and kept.count() == 3
    assert not written.exists_folder(spark, kept._written_at)


@pytest.fixture
def restless(spark, monkeypatch):
    """The labels that queries should give over a daily series that comes out otherwise whenever it is computed anew; the verdict is NULL."""
    from spikeline.plans import queries

    pick, first = random.Random(3), dt.date(1996, 1, 1)
    days = [first + dt.timedelta(i) for i in range(500)]
    series = spark.createDataFrame([(t, x, 30.0 if i % 23 == k else float(pick.randint(0, 4)), pick.gauss(0, 1)) for k, t in enumerate("ABC") for i, x in enumerate(days)], DAYS)
    closes = spark.createDataFrame([(t, x, pick.uniform(90, 110)) for t in ("A", "B", "C", tables.BENCHMARK) for x in days], "ticker string, date date, close double")
    asked = []

    def obs_daily(*_):
        asked.append(None)
        return series if len(asked) == 1 else series.withColumn("tone", -F.col("tone"))

    monkeypatch.setattr(tables, "obs_daily", obs_daily)
    monkeypatch.setattr(queries, "prices", lambda *_: written.written(closes, "prices"))
    for module, name in ((queries, "null_of"), (queries, "observed_of"), (queries.inference, "p_values")):
        monkeypatch.setattr(module, name, lambda *_: None)
    monkeypatch.setattr(queries.inference, "verdict", lambda *_: spark.createDataFrame([("NULL",)], "verdict string"))
    events = signals.gated_events(signals.with_zscores(series))
    e = eventstudy.entries(events, eventstudy.calendar(closes, tables.BENCHMARK))
    table = eventstudy.day_table(eventstudy.returns(closes, tables.BENCHMARK))
    cars = written.written(eventstudy.cars(eventstudy.market_models(e, table), table), "cars")
    found = scoring.calibrate(events, scoring.tercile_reference(cars)).collect()
    return {(r["ticker"], r["event_date"]): r["tercile_label"] for r in found}


def test_calibration_sees_one_series(spark, restless):
    from spikeline.plans import queries

    got = queries.QUERIES["calibration_attach"](spark, "/tables").collect()
    assert {(r["ticker"], r["event_date"]): r["tercile_label"] for r in got} == restless and len(set(restless.values())) == 3


def test_daily_run_sees_the_series_of_its_terciles(spark, restless):
    from spikeline.plans import queries

    got = queries.QUERIES["daily_run"](spark, "/tables").collect()
    assert {(r["ticker"], r["event_date"]): r["tercile_label"] for r in got} == {k: v for k, v in restless.items() if k[1] >= dt.date(1997, 1, 1)} and len(got) > 9

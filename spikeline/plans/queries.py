"""The engine's queries over the star-schema tables, and equivalent SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.text import alert_message, counted, query_string, signed_percent
from ..operators import audits, eventstudy, incremental, inference, scoring, signals
from ..sources import staged, store, tables
from ..sources.written import discard, load_or_bootstrap, new_path, remove, scratch, swap_parquet, write_csv, write_json, write_raw, written
from ..streaming import daily, outbox, spikes
from . import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Named parts of the SQL: (what they stand on, text).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), """SELECT g.ticker, g.date, CAST(coalesce(d.v, 0) AS DOUBLE) AS v, coalesce(d.tone, 0.0) AS tone
        FROM (SELECT ticker, date FROM (SELECT DISTINCT c_mktsegment AS ticker FROM customer), (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)) g
        LEFT JOIN (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS v, avg(o_totalprice) AS tone
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) d USING (ticker, date)"""),
    "z": (("obs",), """SELECT *, CASE WHEN nv = 90 THEN CASE WHEN sv <> 0 THEN (v - mv) / sv WHEN v > mv THEN CAST('inf' AS DOUBLE) WHEN v < mv THEN CAST('-inf' AS DOUBLE) END END AS vol_z,
        CASE WHEN nt = 90 THEN CASE WHEN st <> 0 THEN (tone - mt) / st WHEN tone > mt THEN CAST('inf' AS DOUBLE) WHEN tone < mt THEN CAST('-inf' AS DOUBLE) END END AS tone_z
        FROM (SELECT *, count(v) OVER w AS nv, avg(v) OVER w AS mv, stddev_samp(v) OVER w AS sv, count(tone) OVER w AS nt, avg(tone) OVER w AS mt, stddev_samp(tone) OVER w AS st
            FROM obs WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))"""),
    "flags": (("z",), """SELECT *, lag(strict, 1, FALSE) OVER w AS strict_before, lag(loose, 1, FALSE) OVER w AS loose_before
        FROM (SELECT *, coalesce(vol_z >= 3 AND v >= 5, FALSE) AS strict, coalesce(vol_z >= 2 AND v >= 3, FALSE) AS loose FROM z)
        WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "strict_events": (("flags",), "SELECT ticker, date AS event_date, v, vol_z, tone, tone_z, CAST(sign(tone_z) AS DOUBLE) AS direction FROM flags WHERE strict AND NOT strict_before"),
    "loose_events": (("flags",), "SELECT ticker, date AS event_date, v, vol_z, tone, tone_z, CAST(sign(tone_z) AS DOUBLE) AS direction FROM flags WHERE loose AND NOT loose_before"),
    "ev": (("strict_events", "loose_events"), "SELECT * FROM strict_events WHERE (SELECT count(*) FROM strict_events) >= 150 UNION ALL SELECT * FROM loose_events WHERE (SELECT count(*) FROM strict_events) < 150"),
    "points": ((), """SELECT event_type AS ticker, to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT)) AT TIME ZONE 'UTC' AS ts, CAST(count(*) AS DOUBLE) AS vol, avg(value) AS tone FROM events GROUP BY ALL"""),
    "prices": ((), """SELECT c_mktsegment AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
        UNION ALL SELECT '^ALL', CAST(l_shipdate AS DATE), avg(l_extendedprice / l_quantity) FROM lineitem GROUP BY ALL"""),
    "cal": (("prices",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM prices WHERE ticker = '^ALL' AND close IS NOT NULL"),
    "grid": (("prices", "cal"), """SELECT ticker, idx, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY idx)) AS r
        FROM (SELECT t.ticker, cal.idx, cal.date, p.close FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN cal LEFT JOIN prices p ON p.ticker = t.ticker AND p.date = cal.date)"""),
    "rets": (("grid",), "SELECT a.ticker, a.idx, a.date, a.r, b.r AS m FROM grid a JOIN grid b ON a.idx = b.idx AND b.ticker = '^ALL' WHERE a.ticker <> '^ALL'"),
    "entered": (("ev", "cal"), "SELECT e.*, c.idx AS entry_idx, c.date AS entry_date FROM ev e ASOF LEFT JOIN cal c ON e.event_date < c.date"),
    "models": (("entered", "rets"), """SELECT e.*, CASE WHEN n >= 90 THEN a ELSE 0.0 END AS alpha, CASE WHEN n >= 90 THEN b ELSE 1.0 END AS beta, n AS n_est_obs,
            CASE WHEN n >= 90 THEN 'market_model' ELSE 'market_adjusted' END AS beta_source
        FROM entered e JOIN (SELECT e.ticker, e.event_date, regr_slope(r, m) AS b, regr_intercept(r, m) AS a, CAST(regr_count(r, m) AS BIGINT) AS n
            FROM entered e JOIN rets ON rets.ticker = e.ticker AND rets.idx BETWEEN e.entry_idx - 140 AND e.entry_idx - 21
            WHERE e.entry_idx >= 140 GROUP BY ALL) USING (ticker, event_date)"""),
    "ars": (("models", "rets"), """SELECT x.ticker, x.event_date, CAST(x.d AS INTEGER) AS d, r - (alpha + beta * m) AS ar
        FROM (SELECT *, unnest(range(1, 21)) AS d FROM models) x LEFT JOIN rets ON rets.ticker = x.ticker AND rets.idx = x.entry_idx + x.d"""),
    "cars": (("models", "ars"), """SELECT m.*, t1 AS CAR_t1, t5 AS CAR_t5, t20 AS CAR_t20 FROM models m JOIN (SELECT ticker, event_date,
        CASE WHEN count(ar) FILTER (d <= 1) = 1 THEN sum(ar) FILTER (d <= 1) END AS t1, CASE WHEN count(ar) FILTER (d <= 5) = 5 THEN sum(ar) FILTER (d <= 5) END AS t5,
        CASE WHEN count(ar) FILTER (d <= 20) = 20 THEN sum(ar) FILTER (d <= 20) END AS t20 FROM ars GROUP BY ALL) USING (ticker, event_date)"""),
    "adjusted": (("entered", "rets"), """SELECT x.ticker, x.event_date, CASE WHEN count(r - m) FILTER (d <= 5) = 5 THEN sum(r - m) FILTER (d <= 5) END AS CAR_t5
        FROM (SELECT *, unnest(range(1, 21)) AS d FROM entered WHERE entry_idx >= 140) x LEFT JOIN rets ON rets.ticker = x.ticker AND rets.idx = x.entry_idx + x.d GROUP BY ALL"""),
    "rolling": (("rets",), """SELECT ticker, idx, date, CASE WHEN n = 120 THEN a END AS alpha, CASE WHEN n = 120 THEN b END AS beta FROM (SELECT *, count(r + m) OVER w AS n, regr_slope(r, m) OVER w AS b, regr_intercept(r, m) OVER w AS a
        FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))"""),
    "daycars": (("rets", "rolling"), """SELECT ticker, idx, date, CASE WHEN n1 = 1 THEN r1 - 1 * alpha - beta * m1 END AS car1, CASE WHEN n5 = 5 THEN r5 - 5 * alpha - beta * m5 END AS car5,
            CASE WHEN n20 = 20 THEN r20 - 20 * alpha - beta * m20 END AS car20, CASE WHEN n5 = 5 THEN r5 - m5 END AS adj5
        FROM (SELECT x.ticker, x.idx, x.date, o.alpha, o.beta, sum(r) OVER w1 AS r1, sum(m) OVER w1 AS m1, count(r + m) OVER w1 AS n1, sum(r) OVER w5 AS r5, sum(m) OVER w5 AS m5, count(r + m) OVER w5 AS n5,
                sum(r) OVER w20 AS r20, sum(m) OVER w20 AS m20, count(r + m) OVER w20 AS n20
            FROM rets x LEFT JOIN rolling o ON o.ticker = x.ticker AND o.idx = x.idx - 21
            WINDOW w1 AS (PARTITION BY x.ticker ORDER BY x.idx ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), w5 AS (PARTITION BY x.ticker ORDER BY x.idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
                w20 AS (PARTITION BY x.ticker ORDER BY x.idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))"""),
    "pool": (("cars", "rets", "cal"), """SELECT ticker, idx FROM rets WHERE idx >= 141 AND idx < (SELECT max(idx) FROM cal) AND date BETWEEN (SELECT min(event_date) FROM cars) AND (SELECT max(event_date) FROM cars)
        AND ticker IN (SELECT ticker FROM cars) AND NOT EXISTS (SELECT 1 FROM cars c WHERE c.ticker = rets.ticker AND rets.idx BETWEEN c.entry_idx - 5 AND c.entry_idx + 5)"""),
    "edges": (("cars",), "SELECT quantile_cont(tone_z, 1/3.0::DOUBLE) AS e1, quantile_cont(tone_z, 2/3.0::DOUBLE) AS e2 FROM cars WHERE CAR_t5 IS NOT NULL"),
    "slots": (("cars", "edges"), """SELECT ticker, event_date, direction, CASE WHEN CAR_t5 IS NOT NULL AND tone_z IS NOT NULL THEN CASE WHEN tone_z <= e1 THEN 'bottom' WHEN tone_z <= e2 THEN 'mid' ELSE 'top' END END AS tercile,
        row_number() OVER (PARTITION BY ticker ORDER BY event_date) AS slot FROM cars, edges"""),
    "seats": (("pool", "slots"), """SELECT ticker, k, m, a, greatest(CAST(ceil(m / CAST(a AS DOUBLE)) AS BIGINT), 1) AS b FROM (SELECT ticker, count(*) AS m, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM pool GROUP BY ticker)
        JOIN (SELECT ticker, count(*) AS k FROM slots GROUP BY ticker) USING (ticker)"""),
    "walk": (("seats",), f"""SELECT perm, ticker, m, a, b, j, 0 AS i, j % a AS l, j // a AS r FROM (SELECT *, unnest(range(0, k)) AS j FROM seats), (SELECT CAST(unnest(range(1, {inference.PERMUTATIONS + 1})) AS INTEGER) AS perm)
        UNION ALL SELECT perm, ticker, m, a, b, j, i + 1, CASE WHEN i % 2 = 0 THEN (l + CAST('0x' || substr(md5('{inference.SEED}|' || perm || '|' || ticker || '|' || (i % {inference.MIXING}) || '|' || r), 1, 8) AS BIGINT)) % a ELSE l END,
            CASE WHEN i % 2 = 1 THEN (r + CAST('0x' || substr(md5('{inference.SEED}|' || perm || '|' || ticker || '|' || (i % {inference.MIXING}) || '|' || l), 1, 8) AS BIGINT)) % b ELSE r END
        FROM walk WHERE i = 0 OR i % {inference.MIXING} <> 0 OR r * a + l >= m"""),
    "drawn": (("pool", "walk"), f"""SELECT perm, ticker, j + 1 AS slot, idx FROM walk JOIN (SELECT ticker, idx, row_number() OVER (PARTITION BY ticker ORDER BY idx) - 1 AS pos FROM pool) days USING (ticker)
        WHERE i > 0 AND i % {inference.MIXING} = 0 AND pos = r * a + l"""),
    "nulls": (("drawn", "slots", "daycars"), """SELECT perm, avg(direction * car1) AS T1, avg(direction * car5) AS T5, avg(direction * car20) AS T20, avg(abs(car1)) AS M1, avg(abs(car5)) AS M5, avg(abs(car20)) AS M20,
        avg(direction * adj5) AS T5_adj, avg(car5) FILTER (tercile = 'top') - avg(car5) FILTER (tercile = 'bottom') AS tercile_spread
        FROM drawn JOIN slots USING (ticker, slot) JOIN daycars USING (ticker, idx) GROUP BY perm"""),
    "observed": (("cars", "slots"), """SELECT avg(c.direction * CAR_t1) AS T1, avg(c.direction * c.CAR_t5) AS T5, avg(c.direction * CAR_t20) AS T20, avg(abs(CAR_t1)) AS M1, avg(abs(c.CAR_t5)) AS M5, avg(abs(CAR_t20)) AS M20,
        avg(c.direction * c.CAR_t5) AS T5_adj, avg(c.CAR_t5) FILTER (tercile = 'top') - avg(c.CAR_t5) FILTER (tercile = 'bottom') AS tercile_spread
        FROM cars c JOIN slots s USING (ticker, event_date)"""),
    "pvals": (("nulls", "observed"), """SELECT name, max(observed) AS observed, count(*) AS n, (1 + count(*) FILTER (value >= observed)) / CAST(1 + count(*) AS DOUBLE) AS p
        FROM (UNPIVOT nulls ON T1, T5, T20, M1, M5, M20, T5_adj, tercile_spread INTO NAME name VALUE value) JOIN (UNPIVOT observed ON T1, T5, T20, M1, M5, M20, T5_adj, tercile_spread INTO NAME name VALUE observed) USING (name)
        WHERE value IS NOT NULL GROUP BY name"""),
    "secondary": (("pvals",), """SELECT name, p, i <= coalesce(max(i) FILTER (p <= i / CAST(n AS DOUBLE) * 0.10) OVER (), 0) AS rejected
        FROM (SELECT name, p, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS n FROM pvals WHERE name IN ('T1', 'T20', 'M1', 'M5', 'M20', 'tercile_spread'))"""),
    "intensities": (("ev", "loose_events"), """SELECT ticker, event_date, (l + r + CASE WHEN l < r THEN 1 ELSE 0 END) * 50.0 / n AS intensity_percentile FROM (SELECT e.ticker, e.event_date,
        count(*) FILTER (round(abs(x.vol_z), 12) < round(abs(e.vol_z), 12)) AS l, count(*) FILTER (round(abs(x.vol_z), 12) <= round(abs(e.vol_z), 12)) AS r, count(*) AS n FROM ev e, loose_events x GROUP BY e.ticker, e.event_date)"""),
    "reference": (("cars", "edges"), """SELECT CASE WHEN tone_z <= e1 THEN 'bottom' WHEN tone_z <= e2 THEN 'mid' ELSE 'top' END AS tercile_label, max(e1) AS e1, max(e2) AS e2, avg(CAR_t5) AS tercile_mean_car5, count(*) AS tercile_n
        FROM cars, edges WHERE CAR_t5 IS NOT NULL AND tone_z IS NOT NULL GROUP BY 1"""),
}


def sql(*parts: str, select: str) -> str:
    """select under WITH clauses of the parts it names and those they stand on."""
    found: list[str] = []

    def need(name: str) -> None:
        for x in PARTS[name][0]:
            need(x)
        if name not in found:
            found.append(name)

    for name in parts:
        need(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in found) + " " + select if found else select


def query(name: str, *parts: str, select: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if select:
            ORACLE[name] = sql(*parts, select=select)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round_sql(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


# -- the parts that queries share --------------------------------------------


def daily_series(spark: SparkSession, d: str, at: str | None = None) -> DataFrame:
    """The daily series. at: a path, where the first call stores it and later ones find it. Means of values that arrive in another order
    differ in their last digits; what compares events with quantiles of events has to see one series."""
    make = lambda: tables.obs_daily(spark, d)
    return load_or_bootstrap(spark, at, make) if at else make()


def scored(spark: SparkSession, d: str, at: str | None = None) -> DataFrame:
    return signals.with_zscores(daily_series(spark, d, at))


def events(spark: SparkSession, d: str, at: str | None = None) -> DataFrame:
    return signals.gated_events(scored(spark, d, at))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """The price panel, aggregated from the line items once and written: a row for each symbol and day."""
    return written(tables.price_panel(spark, d), "panel")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """The price panel of symbols that pass price_integrity, written: the gate is asked once."""
    with scratch(spark) as keep:
        return keep(written(audits.sound_prices(panel(spark, d), tables.BENCHMARK), "prices"))[0]


def rets(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(written(eventstudy.returns(prices(spark, d), tables.BENCHMARK), "returns"))[0]


def entered_of(spark: SparkSession, d: str, days: DataFrame, at: str | None = None) -> DataFrame:
    """Events with their entry days in a calendar, written. at: of daily_series(), here and below."""
    with scratch(spark) as keep:
        return keep(written(eventstudy.entries(written(events(spark, d, at), "events"), days), "entered"))[0]


def entered(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(entered_of(spark, d, written(eventstudy.calendar(prices(spark, d), tables.BENCHMARK), "calendar")))[0]


def entered_and_days(spark: SparkSession, d: str, at: str | None = None) -> tuple[DataFrame, ...]:
    """(events with entries, returns, what each day would be as an entry), all written."""
    with scratch(spark) as keep:
        sound = prices(spark, d)
        calendar = written(eventstudy.calendar(sound, tables.BENCHMARK), "calendar")
        r = written(eventstudy.returns(sound, tables.BENCHMARK, calendar), "returns")
        return keep(entered_of(spark, d, calendar, at), r, written(eventstudy.day_table(r), "days"))


def cars_of(e: DataFrame, days: DataFrame) -> DataFrame:
    return written(eventstudy.cars(eventstudy.market_models(e, days), days), "cars")


def cars(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        e, _, days = entered_and_days(spark, d)
        return keep(cars_of(e, days))[0]


def study(spark: SparkSession, d: str, at: str | None = None) -> tuple[DataFrame, ...]:
    """(cars, days, slots, pool); each computed once."""
    with scratch(spark) as keep:
        e, _, days = entered_and_days(spark, d, at)
        c = cars_of(e, days)
        return keep(c, days, written(inference.slots(c), "slots"), pool_of(c, days))


def pool_of(c: DataFrame, days: DataFrame) -> DataFrame:
    return written(inference.candidate_pool(days.select("ticker", "idx", "date"), c), "pool")


def nulls(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(cars, slots, the null distribution, written: a row a permutation)."""
    with scratch(spark) as keep:
        c, days, numbered, pool = study(spark, d)
        return keep(c, numbered, null_of(days, numbered, pool))


def null_of(days: DataFrame, numbered: DataFrame, pool: DataFrame) -> DataFrame:
    return written(inference.null_distribution(inference.draws(pool, numbered), numbered, eventstudy.cars_of_all_days(days)), "nulls")


def observed_of(c: DataFrame, numbered: DataFrame) -> DataFrame:
    """The statistics of the events; against the market-adjusted null too goes the market-model T5."""
    rows = c.join(numbered.select("ticker", "event_date", "tercile"), ["ticker", "event_date"])
    return inference.statistics(rows.select("direction", "tercile", F.col("CAR_t1").alias("car1"), F.col("CAR_t5").alias("car5"), F.col("CAR_t20").alias("car20"), F.col("CAR_t5").alias("adj5")))


def p_of(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        c, numbered, null = nulls(spark, d)
        return keep(written(inference.p_values(null, observed_of(c, numbered)), "p-values"))[0]


def documents(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """ticker and a JSON document of all its points, as the source would send it."""
    points = tables.timeline_points(spark, d)
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    series = points.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(stamp.alias("date"), F.col(kind).alias("value")))).alias("data"))
    return series.select("ticker", F.to_json(F.struct(F.array(F.struct(F.lit(kind).alias("series"), "data")).alias("timeline"))).alias("document"))


CLOSE = "round(round(close, 9), 6) AS close"  # means of cents often end in a 5: the noise of sums goes first


def _close(df: DataFrame) -> DataFrame:
    return df.withColumn("close", F.round(F.round("close", 9), 6))


# -- queries -----------------------------------------------------------------

EVENT = "ticker, event_date, v, " + _round_sql("vol_z") + ", round(tone, 4) AS tone, " + _round_sql("tone_z") + ", direction"


def _events_out(df: DataFrame) -> DataFrame:
    return df.select("ticker", "event_date", "v", F.round("vol_z", 6).alias("vol_z"), F.round("tone", 4).alias("tone"), F.round("tone_z", 6).alias("tone_z"), "direction")


@query("obs_daily", "obs", select="SELECT ticker, date, v, round(tone, 4) AS tone FROM obs")
def _(spark, d):
    return tables.obs_daily(spark, d).withColumn("tone", F.round("tone", 4))


@query("price_panel", "prices", select=f"SELECT ticker, date, {CLOSE} FROM prices")
def _(spark, d):
    return _close(tables.price_panel(spark, d))


@query("zscores", "z", select="SELECT ticker, date, " + _round_sql("vol_z tone_z") + " FROM z")
def _(spark, d):
    return rounded(scored(spark, d).select("ticker", "date", "vol_z", "tone_z"))


@query("spike_events_strict", "strict_events", select=f"SELECT {EVENT} FROM strict_events")
def _(spark, d):
    return _events_out(signals.spike_events(scored(spark, d)))


@query("spike_events_fallback", "loose_events", select=f"SELECT {EVENT} FROM loose_events")
def _(spark, d):
    return _events_out(signals.spike_events(scored(spark, d), 2.0, 3.0))


@query("spike_events_gated", "ev", select=f"SELECT {EVENT} FROM ev")
def spike_events_gated(spark, d):
    return _events_out(events(spark, d))


@query("top_spikes", "ev", select=f"SELECT {EVENT} FROM ev ORDER BY abs(ev.vol_z) DESC, ticker, event_date LIMIT 20")
def _(spark, d):
    return _events_out(signals.top_spikes(events(spark, d)))


ARTICLES = "CASE WHEN day(event_date) % 3 = 0 THEN 0 WHEN day(event_date) % 3 = 1 THEN 2 ELSE 7 END"


@query(
    "headline_left_outer",
    "ev",
    select=f"""SELECT event_date, ticker, round(vol_z, 6) AS vol_z, round(tone_z, 6) AS tone_z, CASE WHEN k = 0 THEN '(no articles retrieved)' WHEN i = 1 THEN '' ELSE 'story ' || i END AS headline,
        CASE WHEN k = 0 THEN '' ELSE 'https://example.org/' || ticker || '/' || i END AS url, CASE WHEN k = 0 THEN '' ELSE CAST(event_date AS VARCHAR) END AS seendate
        FROM (SELECT *, {ARTICLES} AS k, unnest(range(1, greatest(1, least(5, {ARTICLES})) + 1)) AS i FROM (SELECT * FROM ev ORDER BY abs(vol_z) DESC, ticker, event_date LIMIT 20))""",
)
def _(spark, d):
    top = signals.top_spikes(events(spark, d))
    k = F.expr(ARTICLES)
    story = lambda i: F.struct(F.when(i == 1, None).otherwise(F.concat(F.lit("story "), i.cast("string"))).alias("title"), F.concat(F.lit("https://example.org/"), "ticker", F.lit("/"), i.cast("string")).alias("url"), F.col("event_date").cast("string").alias("seendate"))
    sent = top.where(k > 0).select("ticker", "event_date", F.to_json(F.struct(F.transform(F.sequence(F.lit(1), k), story).alias("articles"))).alias("document"))
    return rounded(signals.with_headlines(top, signals.parse_articles(sent)))


@query("timeline_daily_sum", "points", select="SELECT ticker, CAST(ts AS DATE) AS date, sum(vol) AS value FROM points GROUP BY ALL")
def _(spark, d):
    return signals.daily(tables.timeline_points(spark, d).select("ticker", F.to_date("ts").alias("date"), F.col("vol").alias("value")), "vol")


@query("timeline_daily_mean", "points", select="SELECT ticker, CAST(ts AS DATE) AS date, round(round(avg(tone), 10), 6) AS value FROM points GROUP BY ALL")
def _(spark, d):
    return rounded(rounded(signals.daily(tables.timeline_points(spark, d).select("ticker", F.to_date("ts").alias("date"), F.col("tone").alias("value")), "tone"), 10))  # the noise of sums goes first


@query("timeline_json_roundtrip", "points", select="SELECT ticker, CAST(ts AS DATE) AS date, round(round(avg(tone), 10), 6) AS value FROM points GROUP BY ALL")
def _(spark, d):
    return rounded(rounded(signals.daily(signals.parse_timeline(documents(spark, d, "tone")), "tone"), 10))


@query("json_props_extract", select="SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("gap_boundary_filter", "points", select="SELECT * FROM (SELECT ticker, CAST(ts AS DATE) AS date, sum(vol) AS value FROM points GROUP BY 1, 2) WHERE date < (SELECT max(CAST(ts AS DATE)) FROM points)")
def _(spark, d):
    days = signals.daily(tables.timeline_points(spark, d).select("ticker", F.to_date("ts").alias("date"), F.col("vol").alias("value")), "vol")
    return signals.before(days, str(days.agg(F.max("date")).first()[0]))


@query(
    "query_string_builder",
    select="""SELECT 'N' || n_nationkey AS ticker, CASE n_nationkey % 3 WHEN 0 THEN '"' || n_name || '" sourcecountry:IN'
        WHEN 1 THEN '("' || n_name || '" OR "' || upper(n_name[1:1]) || lower(n_name[2:]) || '") sourcecountry:IN'
        ELSE '("' || n_name || '" OR "' || lower(n_name) || '" OR "' || upper(n_name[1:1]) || lower(n_name[2:]) || '") sourcecountry:IN' END AS query FROM nation""",
)
def _(spark, d):
    return tables.universe(spark, d).select("ticker", query_string().alias("query"))


@query(
    "coverage_summary",
    "obs",
    select="SELECT ticker, CAST(sum(v) AS BIGINT) AS total_articles, count(*) FILTER (v > 0) AS nonzero_days, round(count(*) FILTER (v > 0) / 7.0, 1) AS nonzero_days_per_year, CAST(max(v) AS BIGINT) AS max_daily_count FROM obs GROUP BY ticker",
)
def coverage_summary(spark, d):
    return audits.coverage(tables.obs_daily(spark, d), 7.0)


@query(
    "coverage_median_gate",
    "obs",
    select="SELECT *, median_days >= 30 AS passed FROM (SELECT median(x) AS median_days, count(*) AS entities FROM (SELECT ticker, round(count(*) FILTER (v > 0) / 7.0, 1) AS x FROM obs GROUP BY ticker))",
)
def _(spark, d):
    return audits.coverage_gate(coverage_summary(spark, d))


@query(
    "price_integrity",
    "prices",
    select="""SELECT s.ticker, coalesce(rows, 0) AS rows, first_date, last_date, round(missing, 4) AS missing_pct, coalesce(nonpositive_close, 0) AS nonpositive_close, coalesce(extreme_moves, 0) AS extreme_moves,
        CASE WHEN rows IS NULL THEN 'DROPPED-no-data' WHEN first_date > f + 21 OR last_date < l - 21 OR missing > 5 OR nonpositive_close > 0 THEN 'DROPPED-insufficient-coverage' ELSE 'OK' END AS status
        FROM (SELECT DISTINCT ticker FROM prices UNION ALL SELECT 'ABSENT') s LEFT JOIN
        (SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (close <= 0) AS nonpositive_close, count(*) FILTER (abs(r) > 0.5) AS extreme_moves,
            100.0::DOUBLE * (1 - count(*) / CAST((SELECT count(*) FROM prices WHERE ticker = '^ALL') AS DOUBLE)) AS missing
            FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM prices) GROUP BY ticker) USING (ticker),
        (SELECT min(date) AS f, max(date) AS l FROM prices WHERE ticker = '^ALL')""",
)
def _(spark, d):
    closes = panel(spark, d)
    symbols = closes.select("ticker").distinct().unionByName(spark.createDataFrame([("ABSENT",)], "ticker string"))
    return audits.price_integrity(closes, symbols, tables.BENCHMARK)


@query("calendar", "cal", select="SELECT date, idx FROM cal")
def _(spark, d):
    return eventstudy.calendar(prices(spark, d), tables.BENCHMARK)


@query("log_returns_calendar", "rets", select="SELECT ticker, idx, date, " + _round_sql("r m") + " FROM rets")
def _(spark, d):
    return rounded(rets(spark, d))


@query("log_returns_own_rows", "prices", select="SELECT ticker, date, round(ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)), 6) AS r FROM prices")
def _(spark, d):
    return rounded(eventstudy.own_returns(tables.price_panel(spark, d)))


@query("rolling_alpha_beta", "rolling", select="SELECT ticker, idx, date, " + _round_sql("alpha beta") + " FROM rolling")
def _(spark, d):
    return rounded(eventstudy.rolling_models(rets(spark, d)))


@query("entry_asof", "entered", select="SELECT ticker, event_date, entry_idx, entry_date FROM entered")
def _(spark, d):
    return entered(spark, d).select("ticker", "event_date", "entry_idx", "entry_date")


@query("market_model_ols", "models", select="SELECT ticker, event_date, entry_date, " + _round_sql("alpha beta") + ", n_est_obs, beta_source FROM models")
def _(spark, d):
    e, _, days = entered_and_days(spark, d)
    return rounded(eventstudy.market_models(e, days).select("ticker", "event_date", "entry_date", "alpha", "beta", "n_est_obs", "beta_source"))


@query("abnormal_returns", "ars", select="SELECT ticker, event_date, d, round(ar, 6) AS ar FROM ars")
def _(spark, d):
    e, r, days = entered_and_days(spark, d)
    return rounded(eventstudy.abnormal(eventstudy.market_models(e, days), r))


@query("car_by_event", "cars", select="SELECT ticker || '_' || event_date AS event_id, ticker, event_date, entry_date, direction, " + _round_sql("CAR_t1 CAR_t5 CAR_t20") + " FROM cars")
def _(spark, d):
    named = cars(spark, d).withColumn("event_id", F.concat_ws("_", "ticker", "event_date"))
    return rounded(named.select("event_id", "ticker", "event_date", "entry_date", "direction", "CAR_t1", "CAR_t5", "CAR_t20"))


@query("car_market_adjusted", "adjusted", select="SELECT ticker, event_date, round(CAR_t5, 6) AS CAR_t5 FROM adjusted")
def _(spark, d):
    e, _, days = entered_and_days(spark, d)
    return rounded(eventstudy.cars(eventstudy.market_adjusted(e), days).select("ticker", "event_date", "CAR_t5"))


@query("candidate_pool", "pool", select="SELECT ticker, idx FROM pool")
def _(spark, d):
    with scratch(spark) as keep:
        e, _, days = entered_and_days(spark, d)
        return keep(pool_of(cars_of(e, days), days))[0]


@query("permutation_draws", "drawn", select="SELECT ticker, slot, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum, CAST(sum(idx * perm) AS BIGINT) AS check_sum FROM drawn GROUP BY ALL")
def _(spark, d):
    _, _, numbered, pool = study(spark, d)
    drawn = inference.draws(pool, numbered)
    return drawn.groupBy("ticker", F.col("slot").cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"), F.sum(F.col("idx") * F.col("perm")).alias("check_sum"))


@query("null_distribution", "nulls", select="SELECT perm, " + _round_sql(" ".join(inference.NAMES)) + " FROM nulls")
def null_distribution(spark, d):
    return rounded(nulls(spark, d)[2].select("perm", *inference.NAMES))


@query("observed_stats", "observed", select="SELECT " + _round_sql(" ".join(inference.NAMES)) + " FROM observed")
def _(spark, d):
    c, _, numbered, _ = study(spark, d)
    return rounded(observed_of(c, numbered).select(*inference.NAMES))


@query("p_values", "pvals", select="SELECT name, round(observed, 6) AS observed, n, round(p, 6) AS p FROM pvals")
def _(spark, d):
    return rounded(p_of(spark, d))


@query("bh_fdr", "secondary", select="SELECT name, round(p, 6) AS p, rejected FROM secondary")
def _(spark, d):
    p = p_of(spark, d).where(F.col("name").isin("T1", "T20", "M1", "M5", "M20", "tercile_spread"))
    return rounded(inference.bh_fdr(p.select("name", "p")))


@query("verdict", "secondary", "pvals", select="""SELECT round(primary_p, 6) AS primary_p, survivors, CASE WHEN primary_p < 0.05 OR survivors > 0 THEN 'SIGNAL' ELSE 'NULL' END AS verdict
    FROM (SELECT max(p) AS primary_p FROM pvals WHERE name = 'T5'), (SELECT count(*) FILTER (rejected) AS survivors FROM secondary)""")
def _(spark, d):
    return rounded(inference.verdict(p_of(spark, d)))


@query("tercile_spread_null", "nulls", select="SELECT count(tercile_spread) AS n, round(avg(tercile_spread), 6) AS mean, round(stddev_samp(tercile_spread), 6) AS sd FROM nulls")
def _(spark, d):
    null = nulls(spark, d)[2]
    return rounded(null.agg(F.count("tercile_spread").alias("n"), F.avg("tercile_spread").alias("mean"), F.stddev_samp("tercile_spread").alias("sd")))


@query("simultaneity", "ev", select="SELECT event_date, count(*) AS n FROM ev GROUP BY event_date")
def _(spark, d):
    return inference.simultaneity(events(spark, d))


@query(
    "declustered_primary",
    "ev",
    "cars",
    "nulls",
    select="""SELECT n, round(T5, 6) AS T5, round((1 + (SELECT count(*) FROM nulls WHERE nulls.T5 >= s.T5)) / CAST(1 + (SELECT count(nulls.T5) FROM nulls) AS DOUBLE), 6) AS p
    FROM (SELECT count(*) AS n, avg(direction * CAR_t5) AS T5 FROM cars WHERE CAR_t5 IS NOT NULL AND event_date NOT IN (SELECT event_date FROM ev GROUP BY event_date HAVING count(*) > 3)) s""",
)
def _(spark, d):
    c, _, null = nulls(spark, d)
    return rounded(inference.declustered(c, events(spark, d), null))


def errors_of(c: DataFrame, null: DataFrame) -> DataFrame:
    x = F.col("direction") * F.col("CAR_t5")
    return null.agg(F.stddev_samp("T5").alias("empirical_se")).crossJoin(c.agg((F.stddev_samp(x) / F.sqrt(F.count(x))).alias("parametric_se")))  # a row each


@query("standard_errors", "cars", "nulls", select="""SELECT round((SELECT stddev_samp(T5) FROM nulls), 6) AS empirical_se, round(stddev_samp(direction * CAR_t5) / sqrt(count(direction * CAR_t5)), 6) AS parametric_se FROM cars""")
def standard_errors(spark, d):
    c, _, null = nulls(spark, d)
    return rounded(errors_of(c, null))


def t5(c: DataFrame, name: str) -> DataFrame:
    return c.agg(F.avg(F.col("direction") * F.col("CAR_t5")).alias(name))


def locked_statistic(spark: SparkSession, d: str) -> DataFrame | None:
    """The stored T5 statistic of these tables (column locked), where spark.spikeline.locked names the table that holds it."""
    path = spark.conf.get("spark.spikeline.locked", None)
    return spark.read.schema("locked double").parquet(path) if path else None


def by_day(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cars, the T5 statistic by the long way: every abnormal return of every event, added up)."""
    with scratch(spark) as keep:
        e, r, days = entered_and_days(spark, d)
        models = eventstudy.market_models(e, days)
        five = eventstudy.abnormal(models, r).where("d <= 5").groupBy("ticker", "event_date").agg(F.when(F.count("ar") == 5, F.sum("ar")).alias("CAR_t5"))
        long_way = t5(models.select("ticker", "event_date", "direction").join(five, ["ticker", "event_date"]), "by_day")
        return keep(cars_of(e, days), written(long_way, "by-day"))


Z = {0.5: 0.0, 0.8: 0.8416212335729143, 0.9: 1.2815515655446004, 0.95: 1.6448536269514722}  # quantiles of the normal distribution: fixed values


@query(
    "power_analysis",
    "nulls",
    select=f"""SELECT kind, "at", round(value, 6) AS value FROM (SELECT 'mde' AS kind, "at", (z + {Z[0.95]}) * se AS value FROM (SELECT stddev_samp(T5) AS se FROM nulls), (VALUES (0.5::DOUBLE, {Z[0.5]}::DOUBLE), (0.8, {Z[0.8]}), (0.9, {Z[0.9]})) q("at", z)
    UNION ALL SELECT 'power', "at", CASE WHEN x > 9 THEN 1.0 WHEN x < -9 THEN 0.0 ELSE 0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: x * exp(k * ln(greatest(x * x, 1e-300)) - k * ln(2.0) - (lgamma(k + 1.5) - lgamma(1.5))))) END
    FROM (SELECT "at", "at" / se - {Z[0.95]} AS x FROM (SELECT stddev_samp(T5) AS se FROM nulls), (VALUES (0.0::DOUBLE), (0.005), (0.01)) q("at")))""",
)
def _(spark, d):
    """Least detectable effects and achieved power of the empirical standard error: three scalars through the driver."""
    c, _, null = nulls(spark, d)
    if (locked := locked_statistic(spark, d)) is not None:
        inference.require_current(t5(c, "recomputed"), locked)
    se = errors_of(c, null).first()["empirical_se"]
    rows = [("mde", x, normal.mde(se, x)) for x in (0.5, 0.8, 0.9)] + [("power", x, normal.achieved_power(x, se)) for x in (0.0, 0.005, 0.01)] if se else []
    return rounded(spark.createDataFrame(rows, "kind string, at double, value double"))


@query("staleness_check", "cars", "ars", select="""SELECT off, round(x, 6) AS recomputed, round(l + off, 6) AS locked, coalesce(abs(x - (l + off)) >= 1e-9, x IS NULL <> (l IS NULL)) AS stale FROM (SELECT avg(direction * CAR_t5) AS x FROM cars),
    (SELECT avg(direction * c) AS l FROM models JOIN (SELECT ticker, event_date, CASE WHEN count(ar) = 5 THEN sum(ar) END AS c FROM ars WHERE d <= 5 GROUP BY ALL) USING (ticker, event_date)), (VALUES (0.0::DOUBLE), (1e-10), (1e-8), (-1e-8)) o(off)""")
def _(spark, d):
    """The T5 statistic against the one by the long way, and against that moved by less and by more than the tolerance; where a
    stored one is named, against that too: another value raises."""
    c, long_way = by_day(spark, d)
    recomputed = written(t5(c, "recomputed"), "statistic")
    if (locked := locked_statistic(spark, d)) is not None:
        inference.require_current(recomputed, locked)
    moved = long_way.select(F.explode(F.array(*[F.lit(x) for x in (0.0, 1e-10, 1e-8, -1e-8)])).alias("off"), "by_day").select("off", (F.col("by_day") + F.col("off")).alias("locked"))
    return inference.staleness(recomputed, moved).select("off", F.round("recomputed", 6).alias("recomputed"), F.round("locked", 6).alias("locked"), "stale")


@query("tercile_reference", "reference", select="SELECT tercile_label, " + _round_sql("e1 e2 tercile_mean_car5") + ", tercile_n FROM reference")
def _(spark, d):
    return rounded(scoring.tercile_reference(cars(spark, d)))


SCORED = """SELECT e.ticker, event_date, t.tercile_label, round(tercile_mean_car5, 6) AS tercile_mean_car5, tercile_n FROM
    (SELECT ev.*, CASE WHEN tone_z <= e1 THEN 'bottom' WHEN tone_z <= e2 THEN 'mid' ELSE 'top' END AS tercile_label FROM ev, edges) e LEFT JOIN reference t ON t.tercile_label = e.tercile_label"""


def published(spark: SparkSession, d: str, at: str):
    """(cars, the verdict, tercile reference, all events), written, after the guard: without a NULL verdict there are no scores.

    Cars and events come of the one daily series at `at`: an edge of the terciles may be an event's own tone, and that event has to be found on it."""
    with scratch(spark) as keep:
        c, days, numbered, pool = study(spark, d, at)
        null = null_of(days, numbered, pool)
        verdict = written(inference.verdict(inference.p_values(null, observed_of(c, numbered))), "verdict")
        scoring.guard(verdict)
        return keep(c, verdict, written(scoring.tercile_reference(c), "reference"), written(events(spark, d, at), "events"))


@query("calibration_attach", "ev", "reference", select=SCORED)
def _(spark, d):
    at = new_path(spark, "obs")
    _, _, terciles, now = published(spark, d, at)
    remove(spark, at)
    out = scoring.claims_audit(scoring.calibrate(now, terciles))
    return rounded(out.select("ticker", "event_date", "tercile_label", "tercile_mean_car5", "tercile_n"))


def intensities(spark: SparkSession, d: str) -> DataFrame:
    z = written(scored(spark, d), "scored")
    out = scoring.intensity(signals.gated_events(z), signals.spike_events(z, 2.0, 3.0))
    discard(z)  # both sides are written by now
    return out


@query("intensity_percentile", "intensities", select="SELECT ticker, event_date, round(intensity_percentile, 6) AS intensity_percentile FROM intensities")
def _(spark, d):
    return rounded(intensities(spark, d))


@query("novelty_days", "ev", select="SELECT ticker, event_date, CAST(date_diff('day', lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date), event_date) AS INTEGER) AS novelty_days FROM ev")
def _(spark, d):
    return scoring.novelty(events(spark, d)).select("ticker", "event_date", "novelty_days")


CUT = "1997-01-01"


@query("gap_ranges", "obs", select=f"SELECT ticker, max(date) + 1 AS gap_start, DATE '1997-06-30' AS gap_end FROM obs WHERE date < DATE '{CUT}' - CAST(length(ticker) AS INTEGER) GROUP BY ticker HAVING max(date) + 1 <= DATE '1997-06-30'")
def _(spark, d):
    obs = tables.obs_daily(spark, d)
    store = obs.where(F.col("date") < F.date_sub(F.to_date(F.lit(CUT)), F.length("ticker")))
    return incremental.gap_ranges(store, obs.select("ticker").distinct(), "1997-06-30")


@query("upsert_keep_last", "obs", select=f"SELECT ticker, date, CASE WHEN date >= DATE '{CUT}' - 10 THEN v + 1 ELSE v END AS v FROM obs")
def _(spark, d):
    obs = tables.obs_daily(spark, d).select("ticker", "date", "v")
    cut = F.to_date(F.lit(CUT))
    return incremental.upsert(obs.where(F.col("date") < cut), obs.where(F.col("date") >= F.date_sub(cut, 10)).withColumn("v", F.col("v") + 1))


@query("new_event_diff", "ev", select=f"SELECT {EVENT} FROM ev WHERE event_date >= DATE '{CUT}'")
def _(spark, d):
    now = events(spark, d)
    return _events_out(incremental.new_events(now, now.where(F.col("event_date") < F.to_date(F.lit(CUT)))))


NEW_SCORES = f"""SELECT s.*, round(i.intensity_percentile, 6) AS intensity_percentile, n.novelty_days FROM ({SCORED}) s JOIN intensities i USING (ticker, event_date)
    JOIN (SELECT ticker, event_date, CAST(date_diff('day', lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date), event_date) AS INTEGER) AS novelty_days FROM ev) n USING (ticker, event_date) WHERE event_date >= DATE '{CUT}'"""


def new_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events since CUT, their scores)."""
    at = new_path(spark, "obs")
    _, verdict, terciles, now = published(spark, d, at)
    new = incremental.new_events(now, now.where(F.col("event_date") < F.to_date(F.lit(CUT))))
    return new, scoring.score(new, now, signals.spike_events(scored(spark, d, at), 2.0, 3.0), terciles, verdict)


@query("score_new_events", "ev", "reference", "intensities", select=NEW_SCORES)
def _(spark, d):
    out = new_scores(spark, d)[1]
    return rounded(out.select("ticker", "event_date", "tercile_label", "tercile_mean_car5", "tercile_n", "intensity_percentile", "novelty_days"))


@query("scores_attached", "ev", "reference", "intensities", select=f"""SELECT e.ticker, e.event_date, round(e.vol_z, 6) AS vol_z, x.tercile_label, x.intensity_percentile, x.novelty_days FROM ev e
    LEFT JOIN (SELECT * FROM ({NEW_SCORES}) WHERE length(ticker) > 8) x ON x.ticker = e.ticker AND x.event_date = e.event_date WHERE e.event_date >= DATE '{CUT}'""")
def _(spark, d):
    """New events beside a stored table of scores, by ticker and day; here it lacks the tickers with short names."""
    new, scores = new_scores(spark, d)
    path = new_path(spark, "scores")
    swap_parquet(scores.where(F.length("ticker") > 8), path)
    out = scoring.attach(new, spark.read.schema(scores.schema).parquet(path))
    return rounded(out.select("ticker", "event_date", "vol_z", "tercile_label", "intensity_percentile", "novelty_days"))


@query("feed_latest30", "ev", select=f"SELECT {EVENT} FROM ev ORDER BY event_date DESC, ticker LIMIT 30")
def _(spark, d):
    return _events_out(incremental.latest(events(spark, d)))


@query("ticker_counts", "ev", select="SELECT u.ticker, count(ev.ticker) AS n_events, round(max(abs(vol_z)), 6) AS max_vol_z FROM (SELECT DISTINCT c_mktsegment AS ticker FROM customer UNION ALL SELECT 'QUIET') u LEFT JOIN ev ON ev.ticker = u.ticker GROUP BY u.ticker")
def _(spark, d):
    entities = tables.table(spark, d, "customer").select(F.col("c_mktsegment").alias("ticker")).distinct().unionByName(spark.createDataFrame([("QUIET",)], "ticker string"))
    return rounded(incremental.ticker_counts(entities, events(spark, d)))


@query("ticker_history", "ev", select="SELECT ticker, event_date, CAST(row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC) AS INTEGER) AS place FROM ev")
def _(spark, d):
    return incremental.ticker_history(events(spark, d)).select("ticker", "event_date", "place")


@query("site_summary", "ev", select="SELECT count(DISTINCT ticker) AS n_tickers, count(*) AS n_events, min(event_date) AS first_event, max(event_date) AS last_event, count(*) FILTER (direction > 0) AS n_positive FROM ev")
def _(spark, d):
    return incremental.site_summary(events(spark, d))


@query("freshness", "obs", select="SELECT CAST(date_diff('day', max(date), DATE '1999-01-01') AS INTEGER) AS age_days, date_diff('day', max(date), DATE '1999-01-01') > 4 AS stale FROM obs")
def _(spark, d):
    return incremental.freshness(tables.obs_daily(spark, d), "1999-01-01")


@query(
    "alert_messages",
    "ev",
    "intensities",
    select="""SELECT ticker, event_date, 'New event' || chr(10) || ticker || ' — ' || event_date || chr(10) || 'Tone: ' || CASE WHEN direction > 0 THEN 'positive' ELSE 'negative' END || ' | Intensity: '
    || CAST(CAST(round_even(intensity_percentile, 0) AS BIGINT) AS VARCHAR) || 'th pct' || chr(10) || '(NULL verdict on record — no forward-return implication)' AS message FROM ev JOIN intensities USING (ticker, event_date)""",
)
def _(spark, d):
    joined = events(spark, d).join(intensities(spark, d), ["ticker", "event_date"])
    return joined.select("ticker", "event_date", alert_message().alias("message"))


@query("null_histogram", "nulls", select="""SELECT CAST(least(floor((T5 - lo) / ((hi - lo) / 40)) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM nulls, (SELECT min(T5) AS lo, max(T5) AS hi FROM nulls) WHERE T5 IS NOT NULL AND hi > lo GROUP BY 1""")
def _(spark, d):
    null = nulls(spark, d)[2].where("T5 IS NOT NULL")
    bounds = null.agg(F.min("T5").alias("lo"), F.max("T5").alias("hi"))
    inside = null.join(F.broadcast(bounds), how="cross").where("hi > lo")  # one row
    return inside.groupBy(F.least(F.floor((F.col("T5") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)) + 1, F.lit(40)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("car_by_horizon", "nulls", "observed", select="""SELECT name, round(observed, 6) AS observed, round(avg(value), 6) AS null_mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high
    FROM (UNPIVOT (SELECT T1, T5, T20 FROM nulls) ON T1, T5, T20 INTO NAME name VALUE value) JOIN (UNPIVOT (SELECT T1, T5, T20 FROM observed) ON T1, T5, T20 INTO NAME name VALUE observed) USING (name) GROUP BY name, observed""")
def _(spark, d):
    c, numbered, null = nulls(spark, d)
    long = null.unpivot(["perm"], ["T1", "T5", "T20"], "name", "value").where("value IS NOT NULL")
    seen = observed_of(c, numbered).unpivot([], ["T1", "T5", "T20"], "name", "observed")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    per = long.groupBy("name").agg(F.avg("value").alias("null_mean"), q.alias("q"))
    return rounded(per.join(F.broadcast(seen), "name").select("name", "observed", "null_mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high")))


@query("tercile_bars", "cars", "edges", select="""SELECT CASE WHEN tone_z <= e1 THEN 'bottom' WHEN tone_z <= e2 THEN 'mid' ELSE 'top' END AS tercile, round(avg(CAR_t5), 6) AS mean, count(*) AS n, round(stddev_samp(CAR_t5) / sqrt(count(*)), 6) AS sem
    FROM cars, edges WHERE CAR_t5 IS NOT NULL AND tone_z IS NOT NULL GROUP BY 1""")
def _(spark, d):
    c = cars(spark, d).where("CAR_t5 IS NOT NULL AND tone_z IS NOT NULL")
    labelled = c.join(F.broadcast(inference.tercile_edges(c, "tone_z")), how="cross").withColumn("tercile", inference.tercile("tone_z"))
    return rounded(labelled.groupBy("tercile").agg(F.avg("CAR_t5").alias("mean"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("CAR_t5") / F.sqrt(F.count(F.lit(1)))).alias("sem")))


# -- sources, sinks and streams ------------------------------------------------

PART = "least((day(date) - 1) // 10, 2)"


def parts_of_months(spark: SparkSession, d: str) -> DataFrame:
    """A document for each ticker and third of a month, as years would have them; one is missing for tickers of five letters."""
    day = F.to_date("ts")
    part = F.least(F.floor((F.day(day) - 1) / 10), F.lit(2)).cast("int")
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    series = tables.timeline_points(spark, d).groupBy("ticker", part.alias("year")).agg(F.sort_array(F.collect_list(F.struct(stamp.alias("date"), F.col("tone").alias("value")))).alias("data"))
    return series.where(~((F.length("ticker") == 5) & (F.col("year") == 2))).select("ticker", "year", F.to_json(F.struct(F.array(F.struct(F.lit("tone").alias("series"), "data")).alias("timeline"))).alias("document"))


@query(
    "timeline_strict_years",
    "points",
    select=f"""SELECT ticker, date, round(round(min(tone), 10), 6) AS value FROM (SELECT *, CAST(ts AS DATE) AS date FROM points)
    WHERE ticker IN (SELECT ticker FROM (SELECT ticker, CAST(ts AS DATE) AS date FROM points) WHERE NOT (length(ticker) = 5 AND {PART} = 2) GROUP BY ticker HAVING count(DISTINCT {PART}) = 3) GROUP BY ALL""",
)
def _(spark, d):
    """Tickers that lack a document for one of the thirds of a month (here those of five letters) are left out whole."""
    path = new_path(spark, "staged")
    write_raw(parts_of_months(spark, d), path)
    return rounded(rounded(signals.strict_timelines(staged.staged_timelines(spark, path, [0, 1, 2]), [0, 1, 2]), 10))


@query("timeline_missing_years", "points", select=f"""SELECT ticker, string_agg(part, ',' ORDER BY part) AS missing FROM (SELECT DISTINCT event_type AS ticker FROM events) CROSS JOIN (VALUES (0), (1), (2), (3)) p(part)
    WHERE part = 3 OR length(ticker) = 5 AND part = 2 OR NOT EXISTS (SELECT 1 FROM (SELECT ticker AS t, {PART} AS q FROM (SELECT ticker, CAST(ts AS DATE) AS date FROM points)) WHERE t = ticker AND q = part) GROUP BY ticker""")
def _(spark, d):
    """What a load has to fetch: of the thirds of a month as above and a year that nobody has."""
    path = new_path(spark, "staged")
    write_raw(parts_of_months(spark, d), path)
    out = staged.missing_years(staged.staged_timelines(spark, path, [0, 1, 2, 3]))
    return out.select("ticker", F.array_join(F.transform("missing", lambda y: y.cast("string")), ",").alias("missing"))


@query("csv_roundtrip", "obs", select="SELECT ticker, date, v, round(tone, 4) AS tone FROM obs")
def _(spark, d):
    path = new_path(spark, "csv")
    write_csv(tables.obs_daily(spark, d), path)
    return tables.csv_table(spark, path, "ticker string, date date, v double, tone double").withColumn("tone", F.round("tone", 4))


@query("json_roundtrip", "ev", select="SELECT ticker, event_date, round(vol_z, 6) AS vol_z FROM ev")
def _(spark, d):
    path = new_path(spark, "json")
    write_json(events(spark, d).select("ticker", "event_date", F.round("vol_z", 6).alias("vol_z")), path)
    return spark.read.schema("ticker string, event_date date, vol_z double").json(path)


@query("raw_documents_roundtrip", "points", select="SELECT ticker, CAST(ts AS DATE) AS date, sum(vol) AS value FROM points GROUP BY ALL")
def _(spark, d):
    """Raw documents are stored as they came; the daily series is made from what is stored."""
    path = new_path(spark, "raw")
    write_raw(documents(spark, d, "vol").select("ticker", F.lit(2024).alias("year"), "document"), path)
    return signals.daily(signals.parse_timeline(staged.staged_timelines(spark, path, [2024]).drop("year")), "vol")


@query("store_swap_upsert", "obs", select=f"SELECT ticker, date, CASE WHEN date >= DATE '{CUT}' THEN v + 1 ELSE v END AS v FROM obs")
def _(spark, d):
    """A store that isn't there is bootstrapped, then replaced by itself with newer rows."""
    path = new_path(spark, "store")
    obs = tables.obs_daily(spark, d).select("ticker", "date", "v")
    have = load_or_bootstrap(spark, path, lambda: obs)
    swap_parquet(incremental.upsert(have, obs.where(F.col("date") >= F.to_date(F.lit(CUT))).withColumn("v", F.col("v") + 1)), path)
    return load_or_bootstrap(spark, path, lambda: obs.limit(0))


@query(
    "stream_daily_rollup",
    select="""SELECT event_type AS ticker, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS v, round(round(avg(value), 10), 6) AS tone FROM events
    WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def _(spark, d):
    """Days that the watermark has passed, streamed into a store of versions."""
    store, checkpoint = new_path(spark, "stream"), new_path(spark, "progress")
    running = daily.upsert_stream(daily.daily_rollup(tables.event_stream(spark, d)), store, checkpoint)
    running.awaitTermination()
    return rounded(rounded(daily.stored(spark, store), 10))


@query("beta_source_counts", "models", select="SELECT beta_source, count(*) AS n FROM models GROUP BY beta_source")
def _(spark, d):
    e, _, days = entered_and_days(spark, d)
    return eventstudy.market_models(e, days).groupBy("beta_source").agg(F.count(F.lit(1)).alias("n"))


@query("sector_list", select="SELECT string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS sectors FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    return tables.universe(spark, d).agg(F.array_join(F.sort_array(F.collect_set("sector")), ", ").alias("sectors"))


@query("prices_wide_to_long", "prices", select=f"SELECT ticker, date, {CLOSE} FROM prices WHERE close IS NOT NULL")
def _(spark, d):
    """The panel as downloads have it, a day of a batch of symbols a row, and back."""
    return _close(tables.maps_to_long(tables.wide_by_day(panel(spark, d))))


@query(
    "chart_overlay",
    "prices",
    "ev",
    select=f"SELECT p.ticker, p.date, {CLOSE}, e.direction FROM prices p LEFT JOIN ev e ON e.ticker = p.ticker AND e.event_date = p.date WHERE p.ticker <> '^ALL'",
)
def _(spark, d):
    """What a price chart with marked events shows."""
    marks = events(spark, d).select("ticker", F.col("event_date").alias("date"), "direction")
    return _close(panel(spark, d).where(F.col("ticker") != tables.BENCHMARK).join(marks, ["ticker", "date"], "left"))


@query("last_complete_day", select="SELECT CAST(max(ts) AS DATE) - 1 AS day FROM events")
def _(spark, d):
    return tables.table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("now")).select(signals.complete_day(F.col("now")).alias("day"))


SOURCES = ("orders", "lineitem", "events", "absent")


@query("source_probe", select="SELECT * FROM (VALUES ('orders', (SELECT count(*) > 0 FROM orders)), ('lineitem', (SELECT count(*) > 0 FROM lineitem)), ('events', (SELECT count(*) > 0 FROM events)), ('absent', FALSE)) t(source, ok)")
def _(spark, d):
    return tables.probe(spark, d, list(SOURCES))


@query(
    "timeline_join",
    "points",
    select="""SELECT ticker, date, v, round(tone, 6) AS tone, CAST(date_diff('day', lag(date) OVER w, date) AS INTEGER) AS days_before, round(v - avg(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS above
    FROM (SELECT ticker, CAST(ts AS DATE) AS date, sum(vol) AS v, round(avg(tone), 10) AS tone FROM points GROUP BY ALL) WHERE day(date) % 7 <> 3 AND day(date) % 5 <> 1 WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
)
def _(spark, d):
    """Volume and tone, of which each lacks some days, by day: rows on both sides of a missing day are neighbours."""
    points = tables.timeline_points(spark, d).withColumn("date", F.to_date("ts"))
    vol = signals.daily(points.select("ticker", "date", F.col("vol").alias("value")), "vol").where(F.day("date") % 7 != 3)
    tone = signals.daily(points.select("ticker", "date", F.col("tone").alias("value")), "tone").where(F.day("date") % 5 != 1)
    order = Window.partitionBy("ticker").orderBy("date")
    both = signals.joined_series(vol, tone)
    return both.select("ticker", "date", "v", F.round(F.round("tone", 10), 6).alias("tone"), F.datediff("date", F.lag("date").over(order)).alias("days_before"), F.round(F.col("v") - F.avg("v").over(order.rowsBetween(-3, -1)), 6).alias("above"))


@query("store_by_month", "obs", select=f"SELECT ticker, date, CASE WHEN date >= DATE '{CUT}' AND date < DATE '{CUT}' + 40 THEN v + 1 ELSE v END AS v FROM obs")
def _(spark, d):
    """A store by month that gets late rows of two of its months; the others stay the files they were."""
    path = new_path(spark, "store")
    obs = written(tables.obs_daily(spark, d).select("ticker", "date", "v"), "obs")
    cut = F.to_date(F.lit(CUT))
    store.write_version(obs, path, 0)
    store.write_version(obs.where((F.col("date") >= cut) & (F.col("date") < F.date_add(cut, 40))).withColumn("v", F.col("v") + 1), path, 1)
    return store.read_store(spark, path)


@query("stream_spike_events", "strict_events", select=f"SELECT {EVENT} FROM strict_events")
def _(spark, d):
    """The daily series as a stream, its years one after the other; events come from each ticker's state."""
    path = new_path(spark, "days")
    obs = written(tables.obs_daily(spark, d), "obs")
    years = sorted(r[0] for r in obs.select(F.year("date")).distinct().collect())
    for y in years:
        obs.where(F.year("date") == y).coalesce(1).write.mode("append").parquet(path)
    out = new_path(spark, "events")
    days = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 2).parquet(path)
    spikes.stream_spike_events(days).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    return _events_out(spark.read.schema(spikes.EVENTS).parquet(out))


@query(
    "price_level_breaks",
    "prices",
    select=f"""SELECT ticker, days, first_day, round(ratio, 6) AS ratio, round(spread, 6) AS spread, round(ln(opens / closes), 6) AS jump, CASE WHEN spread > 0.005 THEN 'REVISED' WHEN abs(ratio - 1) > 0.005 THEN 'BREAK' ELSE 'SAME' END AS verdict
    FROM (SELECT ticker, count(*) AS days, min(date) AS first_day, max(ratio) AS ratio, median(abs(r - ratio)) AS spread, arg_min(after, date) AS opens FROM
        (SELECT *, median(r) OVER (PARTITION BY ticker) AS ratio FROM (SELECT ticker, date, close * f AS after, f AS r FROM
            (SELECT ticker, date, close, CASE WHEN ticker = 'FURNITURE' THEN 0.5 WHEN ticker = 'MACHINERY' THEN 1 + 0.05 * (day(date) % 3) ELSE 1.0 END::DOUBLE AS f FROM prices WHERE date >= DATE '{CUT}' - 10 AND date < DATE '{CUT}'))) GROUP BY ticker)
    LEFT JOIN (SELECT ticker, arg_max(close, date) AS closes FROM prices WHERE date < DATE '{CUT}' - 10 GROUP BY ticker) USING (ticker)""",
)
def _(spark, d):
    """Ten days fetched again, with a split in one segment and revised days in another."""
    closes = panel(spark, d)
    cut = F.to_date(F.lit(CUT))
    factor = F.when(F.col("ticker") == "FURNITURE", 0.5).when(F.col("ticker") == "MACHINERY", 1 + 0.05 * (F.day("date") % 3)).otherwise(1.0)
    fetched = closes.where(F.col("date") >= F.date_sub(cut, 10)).withColumn("close", F.col("close") * factor)
    return rounded(audits.level_breaks(closes.where(F.col("date") < cut), fetched))


@query("alert_outbox", "ev", "intensities", select="SELECT ticker, event_date, count(*) AS n_sent FROM ev JOIN intensities USING (ticker, event_date) GROUP BY ALL")
def _(spark, d):
    """Messages of two versions that share events, the second put down twice: each is sent once while all goes well."""
    box, sent = new_path(spark, "outbox"), new_path(spark, "sent")
    joined = events(spark, d).join(intensities(spark, d), ["ticker", "event_date"])
    rows = written(joined.select("ticker", "event_date", alert_message().alias("message")), "messages")
    send = lambda batch: batch.write.mode("append").parquet(sent)
    outbox.enqueue(rows.where(F.day("event_date") < 20), box, 0)
    outbox.deliver(spark, box, send)
    for _ in range(2):
        outbox.enqueue(rows.where(F.day("event_date") > 10), box, 1)
        outbox.deliver(spark, box, send)
    return spark.read.schema("ticker string, event_date date, message string, id string").parquet(sent).groupBy("ticker", "event_date").agg(F.count(F.lit(1)).alias("n_sent"))


@query("site_feed", "ev", select=f"SELECT {EVENT} FROM ev ORDER BY event_date DESC, ticker LIMIT 30")
def _(spark, d):
    """The feed of a site whose store is fresh on the day after its last; a stale one raises."""
    obs = written(tables.obs_daily(spark, d), "obs")
    today = obs.agg((F.max("date") + F.expr("INTERVAL 1 DAY")).cast("date")).first()[0]
    incremental.require_fresh(obs, str(today))
    return _events_out(incremental.latest(signals.gated_events(signals.with_zscores(obs))))


@query("ticker_lines", "cars", select="""SELECT ticker, format('{:,}', n) || CASE WHEN n = 1 THEN ' event' ELSE ' events' END AS events, printf('%+.2f%%', 100 * x) AS mean_car FROM (SELECT ticker, count(*) AS n, avg(CAR_t5) AS x FROM cars GROUP BY ticker) WHERE x IS NOT NULL""")
def _(spark, d):
    """The line of a ticker's page: how many events, and their mean return as a percentage."""
    per = cars(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("CAR_t5").alias("x")).where("x IS NOT NULL")
    return per.select("ticker", counted("n", "event").alias("events"), signed_percent("x").alias("mean_car"))


@query("daily_run", "ev", "reference", "intensities", select=NEW_SCORES)
def _(spark, d):
    """A store that ends before CUT, brought up to date by one run with a backfill date: the scores of the events it finds."""
    at = new_path(spark, "obs")
    _, verdict, terciles, now = published(spark, d, at)
    obs = daily_series(spark, d, at)  # what the edges of the terciles come of
    home = new_path(spark, "home")
    last = str(obs.agg(F.max("date")).first()[0])
    cut = F.to_date(F.lit(CUT))
    store.write_version(obs.where(F.col("date") < cut), f"{home}/days", 0)
    swap_parquet(now.where(F.col("event_date") < cut).select("ticker", "event_date"), f"{home}/known")
    live.run_day(spark, home, obs, last, verdict, terciles, backfill=CUT, send=lambda batch: batch.write.mode("append").parquet(f"{home}/sent"))
    out = spark.read.parquet(f"{home}/scores")
    return rounded(out.select("ticker", "event_date", "tercile_label", "tercile_mean_car5", "tercile_n", "intensity_percentile", "novelty_days"))

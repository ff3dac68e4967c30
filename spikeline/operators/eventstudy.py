"""Returns on a benchmark's calendar, market models, abnormal returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import following, running

WINDOW, GAP, LEAST, HORIZONS = 120, 21, 90, (1, 5, 20)


def calendar(prices: DataFrame, benchmark: str) -> DataFrame:
    """date and its number, of days with a benchmark price. prices are read several times."""
    days = prices.where((F.col("ticker") == benchmark) & F.col("close").isNotNull()).select("date").distinct()
    return running(days, "date", F.lit(1).cast("long"), "n").select("date", (F.col("n") - 1).alias("idx"))


def returns(prices: DataFrame, benchmark: str, days: DataFrame | None = None) -> DataFrame:
    """ticker, idx, date, r (log return on the calendar; null after a missing day) and m, the benchmark's. days: its calendar, if there is one already."""
    days = calendar(prices, benchmark) if days is None else days
    grid = prices.select("ticker").distinct().crossJoin(F.broadcast(days))  # a calendar's days
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("idx"))))
    own = grid.join(prices, ["ticker", "date"], "left").select("ticker", "idx", "date", r.alias("r"))
    market = own.where(F.col("ticker") == benchmark).select("idx", F.col("r").alias("m"))
    return own.where(F.col("ticker") != benchmark).join(F.broadcast(market), "idx").select("ticker", "idx", "date", "r", "m")


def own_returns(prices: DataFrame) -> DataFrame:
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))))
    return prices.where(F.col("close").isNotNull()).select("ticker", "date", r.alias("r"))


def entries(events: DataFrame, days: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """events with entry_idx and entry_date, the first calendar day strictly after; null after the last.

    by: columns that tell calendars apart, where events and days have several. Days of events and of
    calendars go in one order, events after the calendar's own; a row a day, whatever the number of events. Both are read several times."""
    both = days.select(*by, "date", "idx", F.lit(0).alias("kind")).unionByName(events.select(*by, F.col("event_date").alias("date"), F.lit(None).cast("long").alias("idx"), F.lit(1).alias("kind")).distinct())
    found = following(both, "date", "kind", F.col("kind") == 0, {"entry_idx": F.col("idx"), "entry_date": F.col("date")}, by, n=days.count() + events.count())
    return events.join(found.where("kind = 1").select(*by, F.col("date").alias("event_date"), "entry_idx", "entry_date"), [*by, "event_date"])


def _sums(m: Column, r: Column, known: Column) -> Column:
    """What a regression of r on m needs of the known pairs of a row."""
    each = {"n": F.lit(1.0), "m": m, "r": r, "mm": m * m, "mr": m * r}
    return F.struct(*[F.when(known, v).otherwise(0.0).alias(k) for k, v in each.items()])


def frames(rets: DataFrame, window: int = WINDOW) -> DataFrame:
    """ticker, idx, date, r, m; n, a, b: the known pairs of the `window` rows up to each, and their regression line
    (null where m doesn't vary). The same work a row for any window; one shuffle, by ticker.

    Rows are cut into chunks of `window`, so a frame is the end of one chunk and the start of the next: running sums of
    its own chunk, and the last chunk's total less its running sums `window` rows before. Sums are of
    deviations from the chunk's means, and brought to one centre before they meet, so nothing large cancels out
    and no error grows with the series. NaN and infinite returns count as unknown."""
    ticker = Window.partitionBy("ticker").orderBy("idx")
    chunk = Window.partitionBy("ticker", "_chunk").orderBy("idx")
    whole = chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    known = fine("r") & fine("m")
    rows = rets.select("ticker", "idx", "date", "r", "m").repartition("ticker").withColumn("_chunk", F.floor((F.row_number().over(ticker) - 1) / window)).withColumn("_known", known)
    for c in ("m", "r"):
        rows = rows.withColumn(f"_c{c}", F.coalesce(F.avg(F.when(F.col("_known"), F.col(c))).over(whole), F.lit(0.0)))
    rows = rows.withColumn("_x", _sums(F.col("m") - F.col("_cm"), F.col("r") - F.col("_cr"), F.col("_known")))
    names = ("n", "m", "r", "mm", "mr")
    here = F.struct(*[F.sum(f"_x.{k}").over(chunk.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in names])
    left = F.struct(*[(F.sum(f"_x.{k}").over(whole) - F.sum(f"_x.{k}").over(chunk.rowsBetween(Window.unboundedPreceding, 0))).alias(k) for k in names], F.col("_cm").alias("cm"), F.col("_cr").alias("cr"))
    both = rows.withColumns({"_p": here, "_left": left}).withColumn("_q", F.lag("_left", window).over(ticker))
    q, p = (lambda k: F.coalesce(F.col(f"_q.{k}"), F.lit(0.0))), (lambda k: F.col(f"_p.{k}"))
    dm, dr = F.when(q("n") > 0, F.col("_q.cm") - F.col("_cm")).otherwise(0.0), F.when(q("n") > 0, F.col("_q.cr") - F.col("_cr")).otherwise(0.0)
    n = p("n") + q("n")
    sums = both.select("ticker", "idx", "date", "r", "m", "_cm", "_cr", n.alias("n"), (p("m") + q("m") + q("n") * dm).alias("sm"), (p("r") + q("r") + q("n") * dr).alias("sr"),
        (p("mm") + q("mm") + 2 * dm * q("m") + q("n") * dm * dm).alias("smm"), (p("mr") + q("mr") + dm * q("r") + dr * q("m") + q("n") * dm * dr).alias("smr"))
    xx = F.col("smm") - F.try_divide(F.col("sm") * F.col("sm"), F.col("n"))
    noise = 1e-26 * (F.col("smm") + F.col("n") * F.col("_cm") * F.col("_cm"))  # of a constant m
    b = F.when(xx > noise, F.try_divide(F.col("smr") - F.try_divide(F.col("sm") * F.col("sr"), F.col("n")), xx))
    line = sums.select("ticker", "idx", "date", "r", "m", F.col("n").cast("long").alias("n"), b.alias("b"), "_cm", "_cr", "sm", "sr")
    a = F.col("_cr") + F.try_divide("sr", F.col("n").cast("double")) - F.col("b") * (F.col("_cm") + F.try_divide("sm", F.col("n").cast("double")))
    return line.select("ticker", "idx", "date", "r", "m", "n", a.alias("a"), "b")


def day_table(rets: DataFrame) -> DataFrame:
    """What any day would be as an entry: ticker, idx, date; n, a, b of the WINDOW days that end GAP days before; for each
    horizon h the sums r{h}, m{h} of the h days after, null unless all their pairs are known.

    rets: a row for every calendar day of each ticker, as returns() makes them. An event joins one row here, whatever the windows' lengths."""
    order = Window.partitionBy("ticker").orderBy("idx")
    pair = F.col("r").isNotNull() & F.col("m").isNotNull()
    model = {f: F.lag(f, GAP).over(order) for f in ("n", "a", "b")}

    def total(c: str, h: int) -> Column:
        w = order.rowsBetween(1, h)
        return F.when(F.count(F.when(pair, 1)).over(w) == h, F.sum(c).over(w))

    ahead = {f"{c}{h}": total(c, h) for h in HORIZONS for c in ("r", "m")}
    return frames(rets).select("ticker", "idx", "date", *[v.alias(k) for k, v in {**model, **ahead}.items()])


def _usable(entered: DataFrame) -> DataFrame:
    """Events whose estimation window starts on the calendar."""
    return entered.where(F.col("entry_idx") - (GAP + WINDOW - 1) >= 0)


def _at_entry(events: DataFrame, days: DataFrame, how: str = "inner") -> DataFrame:
    """events beside their entry's row of day_table(). How to join is Spark's choice: events may be many."""
    of = days.drop("date").withColumnRenamed("idx", "_idx").withColumnRenamed("ticker", "_ticker")
    return events.join(of, (events["ticker"] == of["_ticker"]) & (events["entry_idx"] == of["_idx"]), how).drop("_ticker", "_idx")


ESTIMATED, FALLBACK = "market_model", "market_adjusted"


def market_models(entered: DataFrame, days: DataFrame) -> DataFrame:
    """entered events whose estimation window starts on the calendar, with alpha, beta, n_est_obs and beta_source:
    their entry's line of day_table(), or the market itself where too few of its days are known."""
    usable = _usable(entered)
    enough = F.col("n") >= LEAST
    return _at_entry(usable, days).select(*usable.columns, F.when(enough, F.col("a")).otherwise(0.0).alias("alpha"), F.when(enough, F.col("b")).otherwise(1.0).alias("beta"), F.col("n").alias("n_est_obs"), F.when(enough, ESTIMATED).otherwise(FALLBACK).alias("beta_source"))


def abnormal(models: DataFrame, rets: DataFrame) -> DataFrame:
    """ticker, event_date, d (1 to the longest horizon), ar: null where a return is missing."""
    days = models.select("ticker", "event_date", "alpha", "beta", "entry_idx", F.explode(F.sequence(F.lit(1), F.lit(max(HORIZONS)))).alias("d")).withColumn("idx", F.col("entry_idx") + F.col("d"))
    ar = F.col("r") - (F.col("alpha") + F.col("beta") * F.col("m"))
    return days.join(rets.select("ticker", "idx", "r", "m"), ["ticker", "idx"], "left").select("ticker", "event_date", "d", ar.alias("ar"))


def _car(h: int, alpha: Column, beta: Column) -> Column:
    """Sum of the abnormal returns of h days; null unless every day's return is known."""
    return F.col(f"r{h}") - h * alpha - beta * F.col(f"m{h}")


def cars(models: DataFrame, days: DataFrame) -> DataFrame:
    """models with CAR_t1, CAR_t5, CAR_t20 from their entry's row of day_table()."""
    known = [_car(h, F.col("alpha"), F.col("beta")).alias(f"CAR_t{h}") for h in HORIZONS]
    return _at_entry(models, days, "left").select(*models.columns, *known)


def market_adjusted(entered: DataFrame) -> DataFrame:
    return _usable(entered).withColumns({"alpha": F.lit(0.0), "beta": F.lit(1.0)})


def rolling_models(rets: DataFrame) -> DataFrame:
    """alpha and beta over the WINDOW rows up to each day, where all pairs are known."""
    full = F.col("n") == WINDOW
    return frames(rets).select("ticker", "idx", "date", F.when(full, F.col("a")).alias("alpha"), F.when(full, F.col("b")).alias("beta"))


def cars_of_all_days(days: DataFrame) -> DataFrame:
    """ticker, idx, date, car1, car5, car20 and adj5 if the day were an entry, of day_table(): models need all WINDOW days.

    The permutation null joins these rows and never refits."""
    full = F.col("n") == WINDOW
    a, b = F.when(full, F.col("a")), F.when(full, F.col("b"))
    return days.select("ticker", "idx", "date", *[_car(h, a, b).alias(f"car{h}") for h in HORIZONS], _car(5, F.lit(0.0), F.lit(1.0)).alias("adj5"))

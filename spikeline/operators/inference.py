"""Permutation null by keyed permutations, p-values, false discovery rate, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_quantiles

SEED, PERMUTATIONS, NEAR, FIRST = 42, 1000, 5, 141
MIXING = 10  # rounds of a permutation, an even number: with fewer, the first draws of ten days aren't uniform


def tercile_edges(df: DataFrame, column: str) -> DataFrame:
    """One row: e0..e3, the linear-interpolated terciles; an error if two of them tie, nulls without values. Reads df
    several times, and no more than some thousand values of it at once."""
    q = exact_quantiles(df, column, [0.0, 1 / 3, 2 / 3, 1.0])
    if q[0] is not None and any(a >= b for a, b in zip(q, q[1:])):
        raise ValueError(f"edges of the terciles of {column} tie: {q}")
    return df.sparkSession.createDataFrame([tuple(q)], "e0 double, e1 double, e2 double, e3 double")


def tercile(column: str) -> Column:
    """Right-closed bins by inner edges; a null or NaN has none, and none has one where the edges are unknown."""
    return F.when(F.col(column).isNull() | F.isnan(column) | F.col("e1").isNull(), None).when(F.col(column) <= F.col("e1"), "bottom").when(F.col(column) <= F.col("e2"), "mid").otherwise("top")


def candidate_pool(days: DataFrame, events: DataFrame) -> DataFrame:
    """ticker, idx: entry days in the events' period, not near any of the ticker's own entries."""
    near = events.select("ticker", F.explode(F.sequence(F.col("entry_idx") - NEAR, F.col("entry_idx") + NEAR)).alias("idx")).distinct()
    bounds = events.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).crossJoin(days.agg(F.max("idx").alias("last")))
    inside = (F.col("idx") >= FIRST) & (F.col("idx") < F.col("last")) & F.col("date").between(F.col("lo"), F.col("hi"))
    pool = days.join(F.broadcast(bounds), how="cross").where(inside).select("ticker", "idx")  # one row
    return pool.join(events.select("ticker").distinct(), "ticker", "left_semi").join(near, ["ticker", "idx"], "left_anti")


def slots(cars: DataFrame) -> DataFrame:
    """Events numbered within their ticker, with the tercile of tone among those whose CAR_t5 is known."""
    edges = tercile_edges(cars.where(F.col("CAR_t5").isNotNull()), "tone_z")
    label = F.when(F.col("CAR_t5").isNotNull(), tercile("tone_z"))
    return cars.join(F.broadcast(edges), how="cross").select("ticker", "event_date", "direction", label.alias("tercile"), F.row_number().over(Window.partitionBy("ticker").orderBy("event_date")).alias("slot"))


def _mix(seed: int, number: Column, value: Column) -> Column:
    """32 bits of a round's function of one half."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "perm", "ticker", number.cast("string"), value.cast("string")))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def permuted(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (perm, ticker, j, m, ...) with `at`: where a permutation of 0..m-1, keyed by seed, perm and ticker, puts j.

    The numbers below a * b, the least product of near-square roots that reaches m, are pairs (j mod a, j div a); rounds add
    to one half a hash of the other, which is one-to-one. What lands at m or beyond, less than one in the root
    of m, walks on along its cycle until it lands below: so each j is computed by itself, without looking at the others."""
    sized = rows.withColumn("_a", F.greatest(F.ceil(F.sqrt("m")), F.lit(1)).cast("long")).withColumn("_b", F.greatest(F.ceil(F.col("m") / F.col("_a")), F.lit(1)).cast("long"))
    out = sized.withColumn("_l", F.col("j") % F.col("_a")).withColumn("_r", F.floor(F.col("j") / F.col("_a")))
    for i in range(MIXING):
        half, other, size = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_b")
        out = out.withColumn(half, (F.col(half) + _mix(seed, F.lit(i), F.col(other))) % F.col(size))
    at = F.col("_r") * F.col("_a") + F.col("_l")

    def step(s: Column, e: Column) -> Column:
        i = e % MIXING
        landed = s["done"] | ((i == 0) & (s["r"] * F.col("_a") + s["l"] < F.col("m")))
        left = F.when(i % 2 == 0, (s["l"] + _mix(seed, i, s["r"])) % F.col("_a")).otherwise(s["l"])
        right = F.when(i % 2 == 1, (s["r"] + _mix(seed, i, s["l"])) % F.col("_b")).otherwise(s["r"])
        return F.struct(F.when(landed, s["l"]).otherwise(left).alias("l"), F.when(landed, s["r"]).otherwise(right).alias("r"), landed.alias("done"))

    start = F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"), F.lit(False).alias("done"))
    rounds = F.sequence(F.lit(0).cast("long"), MIXING * (F.col("_a") * F.col("_b") - F.col("m")))  # a cycle leaves the rest after so many at most
    walked = F.aggregate(rounds, start, step, lambda s: s["r"] * F.col("_a") + s["l"])
    landed = F.coalesce(F.when(at < F.col("m"), at).otherwise(walked), F.lit(-1))  # never null, so that a join on it doesn't ask twice
    return out.select(*rows.columns, landed.alias("at"))


def draws(pool: DataFrame, numbered: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """perm, ticker, slot, idx: as many days per ticker and permutation as it has events, without
    replacement; an error where a ticker has more events than days.

    Slot j of a permutation is the day where a keyed permutation of the ticker's candidate days puts j: the work is that of
    the draws, whatever the number of days, and the same however the data are partitioned."""
    days = pool.select("ticker", "idx", (F.row_number().over(Window.partitionBy("ticker").orderBy("idx")) - 1).cast("long").alias("at"))
    wanted = numbered.groupBy("ticker").agg(F.count(F.lit(1)).alias("k"))
    sizes = wanted.join(pool.groupBy("ticker").agg(F.count(F.lit(1)).alias("m")), "ticker", "left")
    enough = F.when(F.col("k") > F.coalesce("m", F.lit(0)), F.raise_error(F.concat(F.lit("fewer candidate days than events: "), "ticker"))).otherwise(F.col("k"))
    each = sizes.select("ticker", "m", enough.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    asked = each.select("perm", "ticker", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    # few rows, from which all draws grow: dealt out anew, so that every core hashes, and Spark sees how many they are
    asked = asked.repartition(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "perm")
    return permuted(asked, seed).join(days, ["ticker", "at"]).select("perm", "ticker", (F.col("j") + 1).cast("int").alias("slot"), "idx")


def statistics(rows: DataFrame, *by: str) -> DataFrame:
    """T and M of each horizon, T5_adj, and the spread of the terciles' means. rows: direction, tercile, car1, car5, car20, adj5."""
    signed = [F.avg(F.col("direction") * F.col(f"car{h}")).alias(f"T{h}") for h in (1, 5, 20)]
    sizes = [F.avg(F.abs(f"car{h}")).alias(f"M{h}") for h in (1, 5, 20)]
    mean = lambda which: F.avg(F.when(F.col("tercile") == which, F.col("car5")))
    return rows.groupBy(*by).agg(*signed, *sizes, F.avg(F.col("direction") * F.col("adj5")).alias("T5_adj"), (mean("top") - mean("bottom")).alias("tercile_spread"))


def null_distribution(drawn: DataFrame, numbered: DataFrame, day_cars: DataFrame) -> DataFrame:
    paired = drawn.join(numbered, ["ticker", "slot"]).join(day_cars, ["ticker", "idx"])
    return statistics(paired, "perm")


NAMES = ("T1", "T5", "T20", "M1", "M5", "M20", "T5_adj", "tercile_spread")


def p_values(null: DataFrame, observed: DataFrame) -> DataFrame:
    """name, observed, n, p: (1 + draws at or above) / (1 + draws), upper tail; unknown draws don't count."""
    long = null.unpivot(["perm"], list(NAMES), "name", "value")
    seen = observed.unpivot([], list(NAMES), "name", "observed")
    joined = long.join(F.broadcast(seen), "name").where(F.col("value").isNotNull())
    return joined.groupBy("name").agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n"), ((1 + F.count_if(F.col("value") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


def bh_fdr(p: DataFrame, q: float = 0.10) -> DataFrame:
    """p with rejected: the step-up rule over all its rows (a family of tests)."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = p.withColumn("_i", F.row_number().over(Window.orderBy("p", "name"))).withColumn("_n", n)
    last = F.max(F.when(F.col("p") <= F.col("_i") / F.col("_n") * q, F.col("_i"))).over(Window.partitionBy())
    return ranked.withColumn("rejected", F.col("_i") <= F.coalesce(last, F.lit(0))).drop("_i", "_n")


def simultaneity(events: DataFrame) -> DataFrame:
    """event_date and n, the tickers with an event on that day: over all events, whether their CAR is known or not."""
    return events.groupBy("event_date").agg(F.count("ticker").alias("n"))


def declustered(cars: DataFrame, events: DataFrame, null: DataFrame, most: int = 3) -> DataFrame:
    """One row: n, T5 and its p against the null, of events with a known CAR_t5 on days with at most `most` tickers."""
    busy = simultaneity(events).where(F.col("n") > most).select("event_date")
    rest = cars.where(F.col("CAR_t5").isNotNull()).join(busy, "event_date", "left_anti")
    seen = rest.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("direction") * F.col("CAR_t5")).alias("T5"))
    drawn = null.where(F.col("T5").isNotNull()).select(F.col("T5").alias("value")).crossJoin(F.broadcast(seen))  # one row
    return drawn.groupBy("n", "T5").agg(((1 + F.count_if(F.col("value") >= F.col("T5"))) / (1 + F.count(F.lit(1)))).alias("p"))


def verdict(p: DataFrame, q: float = 0.10, alpha: float = 0.05) -> DataFrame:
    """SIGNAL if the primary test (T5) passes or a secondary one survives the false-discovery rate, else NULL."""
    secondary = bh_fdr(p.where(F.col("name").isin("T1", "T20", "M1", "M5", "M20", "tercile_spread")), q).agg(F.count_if("rejected").alias("survivors"))
    primary = p.where("name = 'T5'").agg(F.max("p").alias("primary_p"))
    both = primary.crossJoin(secondary)  # a row each
    return both.withColumn("verdict", F.when((F.col("primary_p") < alpha) | (F.col("survivors") > 0), "SIGNAL").otherwise("NULL"))


def staleness(recomputed: DataFrame, locked: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Every row of `locked` beside the one `recomputed` value: stale where they differ, or where only one is known."""
    apart = F.coalesce(F.abs(F.col("recomputed") - F.col("locked")) >= tolerance, F.col("recomputed").isNull() != F.col("locked").isNull())
    return locked.crossJoin(F.broadcast(recomputed)).withColumn("stale", apart)  # one row


def require_current(recomputed: DataFrame, locked: DataFrame, tolerance: float = 1e-9) -> None:
    """ValueError unless there is one locked value and the recomputed one equals it."""
    rows = staleness(recomputed, locked.select(F.col("locked").cast("double").alias("locked")), tolerance).collect()
    if len(rows) != 1 or rows[0]["stale"]:
        raise ValueError(f"the recomputed T5 statistic doesn't match the locked one: {rows}")

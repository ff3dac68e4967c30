"""Ordinals, running sums, next known values and exact quantiles over orders that no single task can hold.

A prefix scan in two levels: keys are dealt into ranges, each range is ordered by itself, and one row a range
carries what lies before (or after) it. Ranges are cut at quantiles of the keys, so that equal keys share one;
callers make keys unique first (by grouping) where many rows may hold one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders, about.
ROWS = 200_000
MOST_RANGES = 10_000


def _number(key: str, kind: str) -> Column:
    """The key as a double in the same order, for cutting ranges only."""
    if kind == "date":
        return F.unix_date(key).cast("double")
    return F.unix_micros(F.col(key).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(key).cast("double")


def with_range(df: DataFrame, key: str, rows: int = ROWS, n: int | None = None) -> DataFrame | None:
    """df with `_range`, a number that grows with the key (a number, date or time): about `rows` rows each; null keys are in
    the first. None where one range holds them all. n: how many rows df has at most, where that is known."""
    number = _number(key, dict(df.dtypes)[key])
    wanted = min(MOST_RANGES, -(-(df.count() if n is None else n) // rows))
    if wanted < 2:
        return None
    shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    cuts = np.unique(df.agg(F.percentile_approx(number, shares, max(10_000, 4 * wanted))).first()[0] or [])
    if not len(cuts):
        return None

    @F.pandas_udf("int")
    def place(x):
        import pandas as pd

        return pd.Series(np.where(x.isna(), 0, np.searchsorted(cuts, x.fillna(cuts[0]).to_numpy(), "right"))).astype("int32")

    return df.withColumn("_range", place(number))


def running(df: DataFrame, key: str, value: Column, out: str, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """df with `out`: the sum of value over the rows of the same `by` up to and with this one, by key. df is read several times."""
    upward = Window.unboundedPreceding, 0
    ranged = with_range(df, key, rows)
    if ranged is None:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(key).rowsBetween(*upward)))
    ranged = ranged.withColumn("_value", value)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    offsets = ranged.groupBy(*by, "_range").agg(F.sum("_value").alias("_own")).select(*by, "_range", F.sum("_own").over(before).alias("_before"))
    local = F.sum("_value").over(Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(*upward))
    return ranged.withColumn(out, local).join(offsets, [*by, "_range"]).withColumn(out, F.coalesce("_before", F.lit(0)) + F.col(out)).drop("_range", "_value", "_before")


def following(df: DataFrame, key: str, second: str, known: Column, columns: dict[str, Column], by: tuple[str, ...] = (), rows: int = ROWS, n: int | None = None) -> DataFrame:
    """df with columns: their values in the first later row (by key, then second) of the same `by` that is known; null after
    the last. Rows of equal key and second take each other's in any order."""
    value = F.when(known, F.struct(F.col(key).alias("_key"), F.col(second).alias("_second"), *[v.alias(k) for k, v in columns.items()]))
    # from the last row to the first, so that "the next" is the last seen: a frame that only grows
    back = lambda *part: Window.partitionBy(*part).orderBy(F.col(key).desc(), F.col(second).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranged = with_range(df, key, rows, n)
    if ranged is None:
        return df.withColumn("_next", F.last(value, True).over(back(*by))).select(*df.columns, *[F.col("_next")[k].alias(k) for k in columns])
    ranged = ranged.withColumn("_known", value)
    later = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    firsts = ranged.groupBy(*by, "_range").agg(F.min("_known").alias("_first")).select(*by, "_range", F.last("_first", True).over(later).alias("_carry"))
    found = ranged.withColumn("_next", F.last("_known", True).over(back(*by, "_range"))).join(firsts, [*by, "_range"]).withColumn("_next", F.coalesce("_next", "_carry"))
    return found.select(*df.columns, *[F.col("_next")[k].alias(k) for k in columns])


# -- exact quantiles -----------------------------------------------------------

BINS, COLLECTED = 4096, 20_000


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """0 to bins - 1, never falling as x grows; halved first, so that the width of a range can't overflow."""
    width = hi / 2 - lo / 2
    return F.least(F.floor((x / 2 - lo / 2) / width * bins), F.lit(bins - 1)).cast("int")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], bins: int = BINS, collected: int = COLLECTED) -> list[float | None]:
    """The linear-interpolated quantiles of a column's values, as sorting them all would give; nulls and NaN don't count.

    Ranks are found by refining a histogram: a round counts the bins of each range of values that still holds a wanted
    rank, and keeps the one bin where it lies. A range of one value, or of few rows, ends it; the driver sees
    bins counts or `collected` values a range at most. The first round's bins are even in the logarithm, so that
    values of very different sizes part early; infinite values have bins of their own. df is read once a round."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    values = df.select(x.alias("x")).where("x IS NOT NULL")
    inf = float("inf")
    finite = F.when(F.abs("x") != inf, F.col("x"))
    n, below, above, lo, hi = values.agg(F.count(F.lit(1)), F.count_if(F.col("x") == -inf), F.count_if(F.col("x") == inf), F.min(finite), F.max(finite)).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found: dict[int, float] = {r: -inf if r < below else inf for r in ranks if r < below or r >= n - above}
    #: (first rank, rows, least value, largest value) of ranges that hold wanted ranks
    todo = [(below, n - below - above, lo, hi)]
    first_round = True
    while todo := [t for t in todo if any(t[0] <= r < t[0] + t[1] for r in ranks if r not in found)]:
        wide, small = [], []
        for t in todo:
            if t[2] == t[3]:
                found |= {r: t[2] for r in ranks if t[0] <= r < t[0] + t[1]}
            else:
                (small if t[1] <= collected else wide).append(t)
        if small:
            among = F.lit(False)
            for _, _, a, b in small:
                among = among | F.col("x").between(a, b)
            rows = sorted(r[0] for r in values.where(among).collect())
            for start, count, a, b in small:
                own = [v for v in rows if a <= v <= b]
                found |= {r: own[r - start] for r in ranks if start <= r < start + count}
        if wide:
            size = F.signum("x") * F.log1p(F.abs("x"))
            which = F.lit(None).cast("struct<t:int,b:int>")
            for i, (_, _, a, b) in enumerate(wide):
                even = _bin(F.col("x"), a, b, bins)
                if first_round:
                    la, lb = (math.copysign(math.log1p(abs(v)), v) for v in (a, b))
                    even = F.greatest(F.lit(0), _bin(size, la, lb, bins)) if lb > la else even
                which = F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("t"), even.alias("b"))).otherwise(which)
            counted = values.withColumn("w", which).where("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("w").collect()
            todo = []
            start, last = 0, None
            for row in counted:
                t = row["w"]["t"]
                if t != last:
                    start, last = wide[t][0], t
                todo.append((start, row["c"], row["a"], row["b"]))
                start += row["c"]
        else:
            todo = []
        first_round = False
    out = []
    for p in places:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a if a == b else a + (b - a) * (p - math.floor(p)))
    return out

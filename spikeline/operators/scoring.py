"""Scores that a NULL verdict still allows, and the audit that guards them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written
from .inference import tercile, tercile_edges
from .ordered import running

FORBIDDEN = {"car_t1", "car_t5", "car_t20", "expected_return", "prediction", "signal"}
DISCLAIMER = "Historical group mean; no evidence of predictive power."


def intensity(events: DataFrame, reference: DataFrame) -> DataFrame:
    """intensity_percentile: mean of the shares below and at most |vol_z| in the reference.

    Both sides are counted by value first, infinite and tied ones too, so a value is one row of the order; a
    running count over the values, in ranges, is joined back to the events."""
    size = lambda: F.round(F.abs(F.nanvl("vol_z", F.lit(None).cast("double"))), 12)  # noqa: E731  digits beyond are noise of the sums
    values = lambda df, c: df.select(size().alias("x"), F.lit(c).cast("long").alias("c")).where("x IS NOT NULL")
    counted = written(values(reference, 1).unionByName(values(events, 0)).groupBy("x").agg(F.sum("c").alias("same")), "values")
    placed = running(counted, "x", F.col("same"), "at_most")
    n = F.broadcast(counted.agg(F.sum("same").alias("n")))  # one row
    score = (2 * F.col("at_most") - F.col("same") + F.when(F.col("same") > 0, 1).otherwise(0)) * 50.0 / F.col("n")
    return events.withColumn("x", size()).join(placed, "x").crossJoin(n).select("ticker", "event_date", score.alias("intensity_percentile"))


def novelty(events: DataFrame) -> DataFrame:
    """novelty_days: days since the ticker's previous event."""
    w = Window.partitionBy("ticker").orderBy("event_date")
    return events.withColumn("novelty_days", F.datediff("event_date", F.lag("event_date").over(w)))


def tercile_reference(cars: DataFrame) -> DataFrame:
    """tercile_label, e1, e2, tercile_mean_car5, tercile_n: three rows."""
    known = cars.where(F.col("CAR_t5").isNotNull() & F.col("tone_z").isNotNull())
    labelled = known.join(F.broadcast(tercile_edges(known, "tone_z")), how="cross").withColumn("tercile_label", tercile("tone_z"))
    return labelled.groupBy("tercile_label").agg(F.first("e1").alias("e1"), F.first("e2").alias("e2"), F.avg("CAR_t5").alias("tercile_mean_car5"), F.count(F.lit(1)).alias("tercile_n"))


def classify(events: DataFrame, reference: DataFrame) -> DataFrame:
    """tercile_label by the reference's inner edges; a null or NaN tone is an error."""
    edges = reference.agg(F.max("e1").alias("e1"), F.max("e2").alias("e2"))
    checked = F.when(F.col("tone_z").isNull() | F.isnan("tone_z"), F.raise_error(F.lit("tone_z is unknown"))).otherwise(tercile("tone_z"))
    return events.join(F.broadcast(edges), how="cross").withColumn("tercile_label", checked).drop("e1", "e2")


def calibrate(events: DataFrame, reference: DataFrame) -> DataFrame:
    """events with the tercile's label, mean and size, and the disclaimer that goes with them."""
    means = reference.select("tercile_label", "tercile_mean_car5", "tercile_n")
    return classify(events, reference).join(F.broadcast(means), "tercile_label", "left").withColumn("calibration_disclaimer", F.lit(DISCLAIMER))


def claims_audit(scored: DataFrame) -> DataFrame:
    """scored itself; ValueError if it claims more than the verdict allows."""
    if bad := {c.lower() for c in scored.columns} & FORBIDDEN:
        raise ValueError(f"forbidden columns: {sorted(bad)}")
    if "tercile_mean_car5" in scored.columns:
        if "calibration_disclaimer" not in scored.columns:
            raise ValueError("the disclaimer is missing")
        fine = scored.agg(F.coalesce(F.bool_and(F.col("calibration_disclaimer").eqNullSafe(F.lit(DISCLAIMER))), F.lit(True))).first()[0]
        if not fine:
            raise ValueError("a row has another disclaimer")
    return scored


def guard(verdict: str | DataFrame) -> None:
    """Scoring is for NULL verdicts: ValueError for any other, or where there isn't exactly one."""
    found = [r["verdict"] for r in verdict.select("verdict").limit(2).collect()] if isinstance(verdict, DataFrame) else [verdict]
    if found != ["NULL"]:
        raise ValueError(f"the verdict is {found}")


def score(events: DataFrame, known: DataFrame, reference: DataFrame, terciles: DataFrame, verdict: str | DataFrame) -> DataFrame:
    """What may be published of new events: intensity, novelty, tercile and its history, and the disclaimer.

    The verdict comes first: without NULL nothing is read. known: all events so far, the new ones among them, for
    novelty; reference: the events whose sizes intensity is a share of; terciles: tercile_reference(). The claims are audited last."""
    guard(verdict)
    key = ["ticker", "event_date"]
    labelled = calibrate(events, terciles)
    since = novelty(known.select(*key).distinct())
    return claims_audit(labelled.join(intensity(events, reference), key, "left").join(since, key, "left"))


def attach(events: DataFrame, scores: DataFrame) -> DataFrame:
    """events with the scores that a table holds for their ticker and day; null where it has none. An error where it has two."""
    key = ["ticker", "event_date"]
    once = scores.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in scores.columns if c not in {*key, *events.columns}])
    checked = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("scored twice: "), F.concat_ws(" ", *key)))).otherwise(F.col("_n"))).where("_n = 1")
    return events.join(checked.drop("_n"), key, "left")

"""Text columns of the live pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alias_list(aliases: str = "aliases") -> Column:
    """The names between the bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(aliases), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def query_string(name: str = "company_name", aliases: str = "aliases", suffix: str = "sourcecountry:IN") -> Column:
    """"name" suffix, or ("a" OR "b") suffix where there are aliases."""
    quoted = F.transform(F.concat(F.array(name), alias_list(aliases)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    joined = F.array_join(quoted, " OR ")
    return F.when(F.size(quoted) == 1, F.concat(joined, F.lit(" " + suffix))).otherwise(F.concat(F.lit("("), joined, F.lit(") " + suffix)))


#: Fixed values of the alert's layout.
ALERT = "New event\n%s \u2014 %s\nTone: %s | Intensity: %sth pct\n(NULL verdict on record \u2014 no forward-return implication)"


def alert_message() -> Column:
    """The text for a new event: ticker, day, sign of the tone, intensity percentile. Infinite z-scores don't enter it."""
    sign = F.when(F.col("direction") > 0, "positive").otherwise("negative")
    share = F.when(F.col("intensity_percentile").isNull(), "?").otherwise(F.format_string("%.0f", F.bround("intensity_percentile", 0)))
    return F.format_string(ALERT, F.col("ticker"), F.col("event_date").cast("string"), sign, share)


def signed_percent(column: str, digits: int = 2) -> Column:
    """A share as +1.23%."""
    return F.format_string(f"%+.{digits}f%%", F.col(column) * 100)


def counted(column: str, one: str, many: str | None = None) -> Column:
    """1 event, 2 events, 1,234 events."""
    return F.concat(F.format_number(column, 0), F.lit(" "), F.when(F.col(column) == 1, one).otherwise(many or one + "s"))

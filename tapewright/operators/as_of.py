"""What was known on a day: validity intervals of restated facts, and their join with a table of days.

A filed value holds from the day it was filed until the day the next value of the same fact was. Days are joined through the months that
hold any of them: an interval is dealt to those of its months, so the join is on equality and its work follows its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import latest_per

FACT = ["cik", "taxonomy", "concept", "unit", "period_start", "period_end"]
#: Days that are broadcast, one short row each: some 270 years of them.
MOST_DAYS = 100_000


def validity(facts: DataFrame, keys: list[str] = FACT, filed: str = "filed") -> DataFrame:
    """facts with valid_until, the day before which the next value was not yet filed, null for the last; of one day's values the last counts."""
    one = latest_per(facts, [*keys, filed], [F.col("accn").desc(), F.col("val").desc()])
    return one.withColumn("valid_until", F.lead(filed).over(W.partitionBy(*keys).orderBy(filed)))


def _month(day: Column | str) -> Column:
    return F.year(day) * 12 + F.month(day)


def on_days(intervals: DataFrame, days: DataFrame, begin: str = "filed", end: str = "valid_until", day: str = "as_of") -> DataFrame:
    """One row for each interval and each of days(as_of) in it: begin <= day < end, a null end open, a null begin never. Repeated days count once."""
    asked = days.select(day).where(F.col(day).isNotNull()).distinct()
    months = sorted(r[0] for r in asked.select(_month(day)).distinct().collect())  # a number a month
    dated = asked.withColumn("_m", _month(day))
    dated = F.broadcast(dated) if asked.count() <= MOST_DAYS else dated
    if not months:
        return intervals.withColumn(day, F.lit(None).cast("date")).limit(0)
    last = F.coalesce(_month(F.date_sub(end, 1)), F.lit(months[-1]))
    held = F.filter(F.array(*[F.lit(m) for m in months]), lambda m: m.between(_month(F.col(begin)), last))
    dealt = intervals.where(F.col(begin).isNotNull()).withColumn("_m", F.explode(held))
    return dealt.join(dated, "_m").where((F.col(day) >= F.col(begin)) & (F.col(end).isNull() | (F.col(day) < F.col(end)))).drop("_m")


def facts_as_of(facts: DataFrame, days: DataFrame) -> DataFrame:
    """For each of days(as_of) the facts as they stood then: all filed up to that day, restated ones by their newest value."""
    return on_days(validity(facts), days)

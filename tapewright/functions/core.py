"""Small column and frame helpers that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_up(x: Column | str, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: rounds raw doubles alike on every engine."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def anchored(df: DataFrame, column: str, days: int, inclusive: bool = False) -> DataFrame:
    """Rows of the last `days` days before the newest date in the data; the maximum is one row."""
    newest = df.agg(F.max(column).alias("_newest"))
    lower = F.date_sub(F.col("_newest"), days)
    keep = F.col(column) >= lower if inclusive else F.col(column) > lower
    return df.crossJoin(F.broadcast(newest)).where(keep).drop("_newest")


def on_newest(df: DataFrame, column: str) -> DataFrame:
    """Rows of the newest date in the data."""
    newest = df.agg(F.max(column).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("_newest")).drop("_newest")


def exact(x: Column | str, precision: int = 18, scale: int = 4) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(f"decimal({precision},{scale})")


def text_date(x: Column | str, *formats: str) -> Column:
    """First format that parses; null otherwise."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])

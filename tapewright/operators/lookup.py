"""Point look-ups over clustered stores: the ranges of keys stand beside the files, so that one key opens one file and few of its row groups.

A store is published as a whole (see sinks.publish): its files, dealt and sorted by key, and a table of each file's least and greatest key.
A look-up reads the table first and gives Spark the files that can hold the keys, so planning lists and opens nothing else; within a file
the row groups' own statistics prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import publish, state_of

#: Bytes of a row group: small, so that a key reads little of its file.
GROUP_BYTES = 8 << 20


def publish_clustered(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Publish df dealt into ranges of keys and sorted by them, with the ranges of the first key by file. Rows without that key are kept, in a file of their own range."""

    def write(rows: DataFrame, to: str) -> None:
        laid = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
        laid.sortWithinPartitions(*keys).write.option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(f"{to}/data")
        stored = rows.sparkSession.read.parquet(f"{to}/data").groupBy(F.col("_metadata.file_name").alias("file"))  # reads one column
        ranges = stored.agg(F.min(keys[0]).alias("least"), F.max(keys[0]).alias("greatest"), F.count("*").alias("n"))
        ranges.orderBy("least").write.parquet(f"{to}/ranges")

    publish(df, path, write=write)


def key_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, least, greatest, n) of the newest state, a row a file."""
    return spark.read.parquet(f"{_state(spark, path)}/ranges")


def _state(spark: SparkSession, path: str) -> str:
    at = state_of(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    return at


def look_up(spark: SparkSession, path: str, key: str, values: list, ranges: list | None = None) -> DataFrame:
    """The rows whose key is one of a few values; files that can't hold any are not opened.

    ranges: the rows of key_ranges() if they are at hand, for one look-up after the other; they must be of the newest state.
    """
    at = _state(spark, path)
    values = [v for v in values if v is not None]
    if ranges is None:
        hit = F.lit(False)
        for v in values:
            hit = hit | F.lit(v).between(F.col("least"), F.col("greatest"))
        files = [r["file"] for r in spark.read.parquet(f"{at}/ranges").where(hit).select("file").collect()]  # the files of a few keys
    else:
        files = [r["file"] for r in ranges if r["least"] is not None and any(r["least"] <= v <= r["greatest"] for v in values)]
    rows = spark.read.parquet(*[f"{at}/data/{f}" for f in sorted(files)]) if files else spark.read.parquet(f"{at}/data").limit(0)
    return rows.where(F.col(key).isin(values))

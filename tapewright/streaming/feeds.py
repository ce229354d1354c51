"""Streaming forms of accrual, news deduplication and session counting; state ends with the watermark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.day_store import accrue_days
from ..operators.sinks import publish


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream for good; another checkpoint is another stream, with batches of its own."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def accrue_stream(stream: DataFrame, store: str, checkpoint: str, keys: list[str], metric: str, day: str) -> StreamingQuery:
    """Rows join a store by day, the largest metric of each key within a day stays; all there is now, then it ends.

    A batch replaces the days it touches and is logged by the same rename, so one that runs again changes nothing.
    """

    def apply(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        accrue_days(spark, store, df, keys, metric, day, (stream_id(spark, checkpoint), batch))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended to a folder of Parquet, each once: the folder's log names the files of finished batches."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_news(stream: DataFrame, key: str = "link", at: str = "published", late: str = "2 days") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed its first row by `late`, rows older than the watermark go."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def publish_states(counts: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Every state of an aggregation, whole, to a published store; a batch that runs again publishes the same state."""
    return counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: publish(df, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(stream: DataFrame, at: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Events of each day and type, for append mode: a day comes once, when the watermark has passed its end, and its state goes; later rows are dropped.

    late=None is for complete mode: no row is dropped, rows without a time count as a day of their own, and the state is the result.
    """
    if late is None:
        return stream.groupBy(F.to_date(at).alias("as_of"), "event_type").agg(F.count("*").alias("n"))
    days = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.to_date("window.start").alias("as_of"), "event_type", "n")

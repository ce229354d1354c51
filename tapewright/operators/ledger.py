"""A ledger of files: which are new, changed, the same or gone. Files of any size are digested by ranges, unchanged ones not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch

#: Bytes of the ranges that are digested apart. Part of what a digest means: another size gives others.
RANGE = 128 << 20


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """(path, url, size, modified) of the files that match; no content is read. Files without a byte don't count: Spark's scans leave them out."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("_metadata.file_path").alias("url"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def digests(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(url, sha256): the SHA-256 of the digests of a file's ranges. A range holds the lines that begin in it, so that tasks share one file.

    Lines are read as bytes, in turn, and never held together.
    """
    own = spark.newSession()
    for key in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(key, str(RANGE))
    exact = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(u)) for u in urls]
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "url"), ("file_block_start", "start"))]
    lines = own.read.option("lineSep", "\n").text(exact).select(F.col("value").cast("binary").alias("line"), *meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], ["url", "start", "sha"])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for line, *here in zip(*(part.column(c).to_pylist() for c in ("line", "url", "start"))):
                    if here != key:
                        if key:
                            yield done()
                        key, sha = here, hashlib.sha256()
                    sha.update(line)
                    sha.update(b"\n")
        if key:
            yield done()

    per = lines.mapInArrow(run, "url string, start long, sha string").groupBy("url")
    found = per.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "sha"))), lambda x: x["sha"]), ","), 256).alias("sha256"))  # one for each range
    at = scratch(spark, "digests")
    found.write.parquet(at)
    return spark.read.parquet(at)


def file_ledger(spark: SparkSession, glob: str, before: DataFrame | None) -> DataFrame:
    """path, sha256, size, modified and status (new, changed, same, gone) of files against an earlier ledger.

    A file whose size and time of change are as they were is the same and isn't read; others are digested, and one with the old digest and size is the
    same too. sha256 is that of digests(); the size says whether the last line has an end.
    """
    now = listing(spark, glob)
    none = spark.createDataFrame([], "path string, sha256 string, size long, modified timestamp, status string")
    old = (before if before is not None else none).where("status <> 'gone'").select("path", F.col("sha256").alias("old_sha"), F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    both = now.join(old, "path", "left").withColumn("kept", (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified")))
    at = scratch(spark, "listing")
    both.withColumn("kept", F.coalesce("kept", F.lit(False))).write.parquet(at)
    both = spark.read.parquet(at)
    urls = sorted(r[0] for r in both.where("not kept").select("url").collect())  # names of files, as the listing itself has them
    found = digests(spark, urls) if urls else spark.createDataFrame([], "url string, sha256 string")
    state = both.join(found, "url", "left").withColumn("sha256", F.when(F.col("kept"), F.col("old_sha")).otherwise(F.col("sha256")))
    state = state.select("path", "sha256", "size", "modified")
    return state.withColumn("status", F.lit("new")) if before is None else ledger_change(state, before)


def ledger_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """A ledger's files against an earlier ledger, by path; what was gone before may come back as new."""
    now = now.select("path", "sha256", "size", "modified")
    old = before.where("status <> 'gone'").select("path", F.col("sha256").alias("old_sha"), F.col("size").alias("old_size"))
    same = (F.col("sha256") == F.col("old_sha")) & (F.col("size") == F.col("old_size"))
    state = F.when(F.col("old_sha").isNull(), "new").when(F.col("sha256").isNull(), "gone").when(same, "same").otherwise("changed")
    return now.join(old, "path", "full").select("path", "sha256", "size", "modified", state.alias("status"))

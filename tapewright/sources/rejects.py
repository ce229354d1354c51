"""Readers that keep what they reject: (rows, rejects) of one pass, so that rows and rejects together are the input's records.

rejects are (file, record, reason, raw): where the record stood, what names it there, why it is none, and its text. The pass is written
once; both frames read that.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import scratch
from .headers import distinct_names, grouped, normal_name


def _split(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df with _reason, _record and _raw, null for rows, written once and read as (rows, rejects)."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(at)
    held = spark.read.schema(df.schema).parquet(at)
    bad = held.where("_reason is not null").select(F.col("file_path").alias("file"), F.col("_record").alias("record"), F.col("_reason").alias("reason"), F.col("_raw").alias("raw"))
    return held.where("_reason is null").drop("_reason", "_record", "_raw"), bad


def csv_checked(spark: SparkSession, glob: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """scan_csv_glob() and the lines whose number of fields isn't their header's; record is such a line's first field."""
    out = None
    for header, paths in grouped(spark, glob, sep):
        names = distinct_names([normal_name(h) for h in header])
        schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(header))] + [T.StructField("_raw", T.StringType())])
        exact = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in paths]
        read = spark.read.schema(schema).option("sep", sep).option("header", True).option("multiLine", any("\n" in h for h in header))
        df = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").csv(exact).select("*", F.col("_metadata.file_path").alias("file_path"))
        bad = F.col("_raw").isNotNull()
        df = df.select(*[F.when(~bad, F.col(f"_{k}")).alias(n) for k, n in enumerate(names)], "file_path", F.when(bad, F.lit(f"not {len(header)} fields")).alias("_reason"), F.when(bad, F.split_part("_raw", F.lit(sep), F.lit(1))).alias("_record"), "_raw")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(glob)
    return _split(out, "csv-checked")


def json_checked(spark: SparkSession, glob: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """One JSON document a file, and the files that are none or are no object; record is the file's name."""
    s = schema if isinstance(schema, str) else schema.simpleString()
    whole = spark.read.text(glob, wholetext=True).select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("file_path"))
    kind = F.schema_of_variant(F.try_parse_json("_raw"))
    reason = F.when(kind.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "no object")
    t = whole.withColumns({"_reason": reason, "d": F.from_json("_raw", s)}).withColumn("_record", F.when(F.col("_reason").isNotNull(), F.element_at(F.split("file_path", "/"), -1)))
    return _split(t.select("d.*", "file_path", "_reason", "_record", F.when(F.col("_reason").isNotNull(), F.col("_raw")).alias("_raw")), "json-checked")

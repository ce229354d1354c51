"""Readers of messy market files: text columns, headers matched by name, the folder's date as data."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archive_ranges import scan_zip_members  # noqa: F401
from .headers import grouped, normal_name, scan_csv_glob, scan_group  # noqa: F401  normal_name is part of this module's interface


def folder_date(path: Column | str) -> Column:
    """The date that the parent folder's name is, with either path separator; null when it is none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.try_to_date(F.element_at(F.split(path, r"[/\\]"), -2), "yyyyMMdd")


def scan_csv_skip(spark: SparkSession, glob: str, columns: list[str], keep: str) -> DataFrame:
    """Files with lines before the header: a stated schema; `keep`, a condition on the data, drops disclaimers and headers."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(glob)
    return df.select(*columns, F.col("_metadata.file_path").alias("file_path")).where(keep)


def scan_tsv_glob(spark: SparkSession, glob: str) -> DataFrame:
    return scan_csv_glob(spark, glob, sep="\t")


def scan_parquet(spark: SparkSession, path: str, union_by_name: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", union_by_name).parquet(path)


def optional_source(spark: SparkSession, path: str, schema: T.StructType | str, read=None) -> DataFrame:
    """A source, or an empty frame of its schema when there is none: one absent feed doesn't stop the rest.

    read: how to read the path (scan_csv_glob() and the like), by default as Parquet of the schema; columns that the feed lacks are null.
    """
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], schema)
    try:
        df = read(spark, path) if read else spark.read.schema(schema).parquet(path)
    except FileNotFoundError:
        return empty
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


#: Short interest columns by their feed name. Fixed values.
INTEREST_COLUMNS = {
    "symbolCode": "symbol", "issueName": "issue_name", "issuerServicesGroupExchangeCode": "exchange_code", "marketClassCode": "market_class", "currentShortPositionQuantity": "short_interest", "previousShortPositionQuantity": "short_interest_prev",
    "stockSplitFlag": "split_flag", "averageDailyVolumeQuantity": "avg_daily_volume", "daysToCoverQuantity": "days_to_cover", "revisionFlag": "revision_flag", "changePercent": "change_pct", "changePreviousNumber": "change_shares", "settlementDate": "settlement_date",
}


def _named(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def scan_short_interest(spark: SparkSession, glob: str) -> tuple[DataFrame, list[str]]:
    """Pipe-delimited settlement files, each read by its own header, and the columns that all of them lack (null here)."""
    df = scan_csv_glob(spark, glob, sep="|", with_path=False)
    missing = [c for c in INTEREST_COLUMNS if c.lower() not in df.columns]
    out = df.select(*[_named(df, c.lower()).alias(n) for c, n in INTEREST_COLUMNS.items()])
    return out.withColumn("symbol", F.upper(F.trim("symbol"))), missing


def scan_short_volume(spark: SparkSession, glob: str) -> DataFrame:
    """Pipe-delimited daily files, each read by its own header; the trailing summary line has no symbol and goes; volumes may be fractional."""
    df = scan_csv_glob(spark, glob, sep="|", with_path=False)
    num = lambda c: _named(df, c).try_cast("double")
    symbol = F.upper(F.trim(_named(df, "symbol")))
    out = df.select(F.try_to_date(_named(df, "date"), "yyyyMMdd").alias("as_of"), symbol.alias("symbol"), num("shortvolume").alias("short_volume"), num("shortexemptvolume").alias("short_exempt_volume"), num("totalvolume").alias("total_volume"), _named(df, "market").alias("markets"))
    return out.where("symbol <> ''")


def normalise_bars(raw: DataFrame, dataset: str, job: str, fixed_point: bool) -> DataFrame:
    """Daily bars of a job: the UTC day of ts_event; prices are integers of 1e-9 when fixed_point."""
    px = lambda c: (F.col(c).try_cast("double") * (F.lit(1e-9) if fixed_point else F.lit(1.0))).alias(c)
    return raw.select("symbol", F.to_date(F.to_timestamp("ts_event")).alias("as_of"), *[px(c) for c in ("open", "high", "low", "close")], F.col("volume").try_cast("double").alias("volume"), F.col("instrument_id").try_cast("long").alias("instrument_id"), F.lit(dataset).alias("dataset"), F.lit(job).alias("job"))


def wide_to_long(wide: DataFrame, day: str, fields: list[str]) -> DataFrame:
    """(day, SYMBOL_field ...) columns to one row for each day and symbol; rows without any value go."""
    names = sorted({c.rsplit("_", 1)[0] for c in wide.columns if c != day and c.rsplit("_", 1)[-1] in fields})
    rows = F.array(*[F.struct(F.lit(s).alias("symbol"), *[(F.col(f"`{s}_{f}`") if f"{s}_{f}" in wide.columns else F.lit(None)).cast("double").alias(f) for f in fields]) for s in names])
    return wide.select(day, F.inline(rows)).where(F.coalesce(*fields).isNotNull())


def missing_from(roster: DataFrame, bars: DataFrame) -> DataFrame:
    """Roster symbols that have no bar."""
    return roster.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def scan_index_csv(spark: SparkSession, glob: str, wanted: dict[str, str]) -> DataFrame:
    """Filing indexes whose headers hold line feeds: wanted maps output names to fragments of headers, looked for in each file's own header.

    A header's first match counts; a file without a column for url gives no rows. url must end in .xml; of rows with one url the last file's
    stays, within a file the greatest by all columns.
    """
    out = None
    for header, paths in grouped(spark, glob):
        flat = [re.sub(r"\s+", " ", h).strip().lower() for h in header]
        pick = {n: next((k for k, h in enumerate(flat) if frag.lower() in h), None) for n, frag in wanted.items()}
        if pick["url"] is None:
            continue
        df = scan_group(spark, header, paths, multi_line=True, escape='"')
        df = df.select(*[(F.trim(F.col(f"_{k}")) if k is not None else F.lit(None).cast("string")).alias(n) for n, k in pick.items()], F.element_at(F.split("file_path", "/"), -1).alias("file"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise FileNotFoundError(glob)
    best = F.max(F.struct("file", *wanted)).alias("r")
    return out.where(F.lower("url").endswith(".xml")).groupBy("url").agg(best).select(*[f"r.{n}" for n in wanted])


def scan_json_docs(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file; a file that doesn't parse is left out."""
    s = schema if isinstance(schema, str) else schema.simpleString()
    whole = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = whole.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", s).alias("d"), "file")
    return parsed.where("d is not null").select("d.*", "file")


def unzipped(members: DataFrame, depth: int = 3) -> DataFrame:
    """members(zip, member, content) with archives and gzip files among them opened, again and again up to `depth` times; the outer name stays before a !."""

    def leaves(name: str, content: bytes, left: int) -> Iterator[tuple[str, bytes]]:
        low = name.lower()
        try:
            if left and low.endswith(".zip"):
                z = zipfile.ZipFile(io.BytesIO(content))
                for m in z.namelist():
                    if not m.endswith("/"):
                        yield from leaves(f"{name}!{m}", z.read(m), left - 1)
                return
            if left and low.endswith(".gz"):
                yield from leaves(name[:-3], gzip.decompress(content), left - 1)
                return
        except (zipfile.BadZipFile, OSError, EOFError):
            return
        yield name, content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for z, m, c in zip(pdf["zip"], pdf["member"], pdf["content"]):
                for name, content in leaves(m, c, depth):
                    yield pd.DataFrame({"zip": [z], "member": [name], "content": [content]})

    return members.mapInPandas(run, "zip string, member string, content binary")

"""Headers of separated files, found by tasks: a table of files and their headers, and readers that bind columns by name.

Spark binds the columns of a scan by position, so files that order or name their columns differently have to be read apart. The headers come
from a job that reads the beginning of each file; the driver receives names and paths only, and no file is opened there.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = {"security", "order", "group", "select", "table", "user"}
#: One file to a task while headers are read: a file counts as this large at least, and no task takes more.
ALONE = "134217728"


def normal_name(header: str) -> str:
    """Lower case, spaces to _, other signs out; a reserved word or a leading digit gets a _ before."""
    x = re.sub(r"[^0-9a-z_().]", "", re.sub(r"\s+", "_", header.strip().lower()))
    return f"_{x}" if x in RESERVED or x[:1].isdigit() else x


def distinct_names(names: list[str]) -> list[str]:
    """Names of one header; a repeated one gets _1, _2 ..., one without signs its place."""
    out: list[str] = []
    for k, name in enumerate(names):
        name = base = name or f"column{k}"
        n = 0
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def first_record(lines: Iterator[str], sep: str) -> list[str] | None:
    """Fields of the first record that isn't blank; a quoted field may go on over lines. A byte order mark is no part of a name."""
    text = ""
    for line in lines:
        line = line.rstrip("\r")
        if not text and not line.strip("﻿ \t"):
            continue
        text = f"{text}\n{line}" if text else line.removeprefix("﻿")
        if text.count('"') % 2 == 0:
            break
    return next(csv.reader(text.split("\n") if "\n" not in text else iter(text.splitlines(keepends=True)), delimiter=sep), None) if text else None


def headers(spark: SparkSession, glob: str, sep: str = ",") -> DataFrame:
    """(path, header) of the files that match, header a list of the names as they stand; files without a record have none.

    A task takes the beginning of one file and leaves the rest unread.
    """
    own = spark.newSession()
    for key in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(key, ALONE)
    alone = own.conf.get("spark.sql.files.openCostInBytes") == ALONE  # settings may be held fast; then tasks read on to their next file
    lines = own.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str, int]]:
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    part = b.slice(at, 100)
                    yield from zip(*(part.column(c).to_pylist() for c in ("path", "value", "start")))

        source, done, held = rows(), None, None
        while (row := held or next(source, None)) is not None:
            path, _, start = row
            held = None
            if (path, start) == done or start:
                if alone:
                    return
                continue

            def own_lines(row=row, path=path):
                nonlocal held
                yield row[1]
                for more in source:
                    if more[0] != path:
                        held = more
                        return
                    yield more[1]

            found, done = first_record(own_lines(), sep), (path, start)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found], pa.list_(pa.string()))], ["path", "header"])

    return lines.mapInArrow(run, "path string, header array<string>")


def grouped(spark: SparkSession, glob: str, sep: str = ",") -> list[tuple[list[str], list[str]]]:
    """(header, paths) for each distinct header, in order of the headers."""
    found = headers(spark, glob, sep).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # names and paths, as the scan's own file index holds them
    return sorted((list(r["header"]), list(r["paths"])) for r in found.collect())


def scan_group(spark: SparkSession, header: list[str], paths: list[str], sep: str = ",", multi_line: bool = False, escape: str = "\\") -> DataFrame:
    """The rows of files with one header as text columns _0, _1 ... and file_path, in one scan."""
    schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(header))])
    exact = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in paths]  # Spark names files as URLs and reads patterns
    whole = multi_line or any("\n" in h for h in header)
    read = spark.read.schema(schema).option("sep", sep).option("header", True).option("multiLine", whole).option("escape", escape)
    return read.csv(exact).select("*", F.col("_metadata.file_path").alias("file_path"))


def scan_csv_glob(spark: SparkSession, glob: str, sep: str = ",", with_path: bool = True, multi_line: bool = False) -> DataFrame:
    """All files that match, every column as text, united by normalised header; file_path tells the origin. Files are read in one scan a header."""
    out = None
    for header, paths in grouped(spark, glob, sep):
        names = distinct_names([normal_name(h) for h in header])
        df = scan_group(spark, header, paths, sep, multi_line)
        df = df.select(*[F.col(f"_{k}").alias(n) for k, n in enumerate(names)], *(["file_path"] if with_path else []))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(glob)
    return out

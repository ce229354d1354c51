"""Members of zip archives by byte ranges: many tasks for one archive, of any size, on any storage that Spark reads.

Spark's line reader cuts files at line feeds, without decoding them; a line and its line feed are the file's bytes again, and the lengths of the
splits before give each its place. The bytes are written once as a table of blocks by place. From it the end record and the central
directory are read, which name each member's range, and each member is inflated from the blocks of its own range.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import scratch

#: Bytes of a block, and of the grid that members and blocks meet on.
BLOCK = 1 << 20
#: An end record lies within so many bytes of the end: itself, its comment, and the records of large archives before it.
TAIL = 22 + 65_535 + 20 + 56
#: Splits whose places are broadcast, one short row each.
MOST_SPLITS = 1_000_000
#: Bytes of the largest member handed on, as one value holds at most.
MOST_BYTES = (1 << 31) - (1 << 20)
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def byte_blocks(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, at, n, data): all bytes of the files that match, in blocks of about BLOCK, each with its place in the file."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_size", "size"), ("file_block_start", "start"))]
    lines = spark.read.option("lineSep", "\n").text(glob).select(F.col("value").cast("binary").alias("line"), *meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, rel = None, [], 0, 0

        def flush() -> pa.RecordBatch:
            data = b"\n".join([*held, b""])
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]]), pa.array([rel]), pa.array([len(data)]), pa.array([data], pa.binary())], ["path", "size", "start", "rel", "n", "data"])

        for b in batches:
            for line, *here in zip(*(b.column(c).to_pylist() for c in ("line", "path", "size", "start"))):
                if here != key or size >= BLOCK:
                    if held:
                        yield flush()
                    rel = 0 if here != key else rel + size
                    key, held, size = here, [], 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield flush()

    at = scratch(spark, "archive-blocks")
    lines.mapInArrow(run, "path string, size long, start long, rel long, n long, data binary").write.option("compression", "none").parquet(at)
    blocks = spark.read.parquet(at)
    splits = blocks.groupBy("path", "start").agg(F.sum("n").alias("bytes"))  # reads no data
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = splits.select("path", "start", before.alias("before"))
    places = F.broadcast(places) if splits.count() <= MOST_SPLITS else places
    return blocks.join(places, ["path", "start"]).select("path", "size", (F.col("before") + F.col("rel")).alias("at"), "n", "data")


def directory_range(tail: bytes, first: int) -> tuple[int, int, int] | None:
    """(place, bytes, shift) of the central directory, from the archive's last bytes, which begin at `first`; shift is what stands before the archive."""
    at = tail.rfind(_END)
    if at < 0 or len(tail) < at + 22:
        return None
    size, offset = struct.unpack("<LL", tail[at + 12 : at + 20])
    end = at
    if tail[at - 20 : at - 16] == _LOCATOR64 and (end := tail.rfind(_END64, 0, at)) >= 0:
        size, offset = struct.unpack("<QQ", tail[end + 40 : end + 56])
    elif 0xFFFFFFFF in (size, offset):
        return None
    end = end if end >= 0 else at
    place = first + end - size
    return place, size, place - offset


def entries(directory: bytes, shift: int) -> list[tuple[str, int, int, int, int, int, int]]:
    """(member, place of its local header, packed bytes, bytes, method, checksum, flags) of a central directory."""
    out, at = [], 0
    while directory[at : at + 4] == _ENTRY:
        flags, method, crc, packed, size, a, b, c, offset = struct.unpack("<8xHH4xLLLHHH8xL", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + a].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra, k = directory[at + 46 + a : at + 46 + a + b], 0
        while k + 4 <= len(extra):  # sizes that don't fit in four bytes
            kind, n = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                size = next(wide, size) if size == 0xFFFFFFFF else size
                packed = next(wide, packed) if packed == 0xFFFFFFFF else packed
                offset = next(wide, offset) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        out.append((name, offset + shift, packed, size, method, crc, flags))
        at += 46 + a + b + c
    return out


def _joined(t: pd.DataFrame) -> tuple[bytes, int]:
    t = t.sort_values("at")
    return b"".join(t["data"]), int(t["at"].iloc[0])


def member_index(blocks: DataFrame) -> DataFrame:
    """(path, member, place, until, packed, bytes, method, crc, flags) of the archives in byte_blocks(); files that are no archives have none.

    A directory is read by one task, which holds it whole (some 80 bytes a member); of blocks, those of its range alone are read.
    """

    def find(t: pd.DataFrame) -> pd.DataFrame:
        tail, first = _joined(t)
        cut = max(0, len(tail) - TAIL - 2)
        found = directory_range(tail[cut:], first + cut)
        return pd.DataFrame([(t["path"].iloc[0], *found)] if found else [], columns=["path", "cd_at", "cd_size", "shift"])

    def parse(t: pd.DataFrame) -> pd.DataFrame:
        data, first = _joined(t)
        cd, size, shift = (int(t[c].iloc[0]) for c in ("cd_at", "cd_size", "shift"))
        rows = sorted(entries(data[cd - first : cd - first + size], shift), key=lambda r: r[1])
        ends = [r[1] for r in rows[1:]] + [cd]
        kept = [(t["path"].iloc[0], r[0], r[1], e, *r[2:]) for r, e in zip(rows, ends) if not r[0].endswith("/")]
        return pd.DataFrame(kept, columns=["path", "member", "place", "until", "packed", "bytes", "method", "crc", "flags"])

    tails = blocks.where(F.col("at") + F.col("n") >= F.col("size") - TAIL).groupBy("path").applyInPandas(find, "path string, cd_at long, cd_size long, shift long")
    at = scratch(blocks.sparkSession, "archive-ends")
    tails.write.parquet(at)
    ends = blocks.sparkSession.read.parquet(at)
    of = blocks.join(F.broadcast(ends), "path").where("at < cd_at + cd_size and at + n > cd_at")  # a row an archive
    return of.groupBy("path").applyInPandas(parse, "path string, member string, place long, until long, packed long, bytes long, method int, crc long, flags int")


def inflate(pieces: list[bytes], packed: int, size: int, method: int, crc: int, flags: int) -> tuple[bytes | None, str | None]:
    """(content, None) of a member from the bytes of its range, or (None, what is wrong)."""
    head = b"".join(pieces[:1]) if len(pieces[0]) >= 30 else b"".join(pieces)
    if head[:4] != _LOCAL:
        return None, "no local header"
    if flags & 1:
        return None, "encrypted"
    if method not in (0, 8):
        return None, f"method {method}"
    if size > MOST_BYTES:
        return None, "too large for one value"
    skip = 30 + sum(struct.unpack("<HH", head[26:30]))
    data = b"".join(pieces)[skip : skip + packed]
    if len(data) < packed:
        return None, "cut off"
    if method == 8:
        try:
            opened = zlib.decompressobj(-15)
            data = opened.decompress(data, size + 1)
        except zlib.error:
            return None, "damaged"
    return (data, None) if len(data) == size and zlib.crc32(data) == crc else (None, "damaged")


def read_ranges(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(zip, member, content, problem) for each row of a member_index(): its content, or why there is none.

    Blocks and members meet on a grid of BLOCK bytes and only the bytes that belong to a member travel, so tasks share out one archive's
    members as they do those of many. Members with one name are distinct by their places.
    """
    cell = lambda x: F.expr(f"({x}) div {BLOCK}")
    b = blocks.select("path", "at", "n", "data", F.explode(F.sequence(cell("at"), cell("at + n - 1"))).alias("cell"))
    m = index.withColumn("cell", F.explode(F.sequence(cell("place"), cell("until - 1"))))
    both = b.join(m, ["path", "cell"]).where(f"at < until and at + n > place and cell = greatest(at, place) div {BLOCK}")
    low, high = F.greatest("at", "place"), F.least(F.col("at") + F.col("n"), "until")
    piece = F.substring("data", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    cols = ["path", "member", "place", "packed", "bytes", "method", "crc", "flags"]
    laid = both.select(*cols, low.alias("low"), piece.alias("piece")).repartition("path", "place").sortWithinPartitions("path", "place", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, []

        def result() -> pa.RecordBatch:
            content, problem = inflate(pieces, *held[3:])
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([content], pa.binary()), pa.array([problem], pa.string())], ["zip", "member", "content", "problem"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*cols, "piece"))):
                if held != row[:-1]:
                    if held:
                        yield result()
                    held, pieces = row[:-1], []
                pieces.append(row[-1])
        if held:
            yield result()

    return laid.mapInArrow(run, "zip string, member string, content binary, problem string")


def zip_members(spark: SparkSession, glob: str, pattern: str = ".*") -> DataFrame:
    """(zip, member, content, problem) of the members whose whole name matches, in all archives that match; others' bytes don't travel."""
    blocks = byte_blocks(spark, glob)
    return read_ranges(blocks, member_index(blocks).where(F.col("member").rlike(f"^(?:{pattern})$")))


def scan_zip_members(spark: SparkSession, glob: str, pattern: str = ".*") -> DataFrame:
    """(zip, member, content) of the members that can be read."""
    return zip_members(spark, glob, pattern).where("problem is null").drop("problem")


def write_files(rows: DataFrame, path: str) -> None:
    """rows(name, content) as files path/name=.../part-*, each content followed by one line feed. For archives that queries make themselves."""
    laid = rows.select("name", F.col("content").cast("string").alias("value")).repartition("name")
    laid.write.partitionBy("name").text(path)

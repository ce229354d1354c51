"""Shards by jump consistent hashing: the key and the number of shards decide, without a ring or a table.

A key's jumps are the places where it would move as shards are appended one by one; its shard is the last jump below their number. One more
shard therefore takes rows only into itself, one in `shards + 1` of them on average. Rows of a shard are numbered in the order of a hash of
their keys by range-partitioned parts and the counts of the parts before, so that no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, small

_FACTOR = np.uint64(2862933555777941757)  # of the linear congruential step that the published method names


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    state, last, at = keys.astype(np.uint64), np.full(len(keys), -1.0), np.zeros(len(keys))
    while (more := at < shards).any():
        last = np.where(more, at, last)
        state = np.where(more, state * _FACTOR + np.uint64(1), state)
        at = np.where(more, np.floor((last + 1) * (2.0**31 / ((state >> np.uint64(33)).astype(np.float64) + 1))), at)
    return last.astype(np.int32)


def key_hash(key: Column) -> Column:
    """The 16 bytes of the key's MD5, taken as text; a null key counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))


def shard_of(hashed: Column, shards: int) -> Column:
    """The shard of each key_hash(), from its first eight bytes."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    return F.pandas_udf(lambda s: pd.Series(jump(np.frombuffer(b"".join(s), ">u8")[::2], shards), dtype="int32"), "int")(hashed)


def with_shard(docs: DataFrame, key: str | Column, shards: int, out: str = "shard") -> DataFrame:
    """docs with one more column, the row's shard. Rows with equal keys, those without a key among them, share a shard."""
    return docs.withColumn(out, shard_of(key_hash(F.col(key) if isinstance(key, str) else key), shards))


def moving(docs: DataFrame, key: str | Column, shards: int, grown: int) -> DataFrame:
    """The rows that move when shards are appended until there are `grown`, with the columns `shard` and `grown_shard`."""
    both = with_shard(with_shard(docs, key, shards, a := fresh(docs, "shard")), key, grown, b := fresh(docs, "grown_shard"))
    return both.where(F.col(a) != F.col(b))


def numbered(rows: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """rows with one more column: 0, 1, 2 ... within each group, without gaps, in the given order.

    Rows are dealt into ranges of (group, order); each task numbers its own, and the counts of the ranges before are added. Rows that tie
    follow their order in the input, which also splits a run of equal rows, however long. Written once, so a lost task can't renumber.
    """
    seq, part, at = (fresh(rows, c) for c in ("seq", "part", "at"))
    held = materialise(rows.withColumn(seq, F.monotonically_increasing_id()), "unnumbered")
    schema = held.drop(seq).withColumns({part: F.lit(0), at: F.lit(0).cast("long")}).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        task = TaskContext.get().partitionId()
        for b in batches:
            groups = b.column(group).to_pylist()
            places = np.empty(len(groups), np.int64)
            for k, g in enumerate(groups):
                places[k] = seen[g] = seen.get(g, -1) + 1
            b = b.drop_columns([seq])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(groups), task, np.int32)), pa.array(places)], [*b.schema.names, part, at])

    sorted_ = held.repartitionByRange(group, *order, seq).sortWithinPartitions(group, *order, seq)
    placed = materialise(sorted_.mapInArrow(number, schema), "numbered")
    ends = placed.groupBy(group, part).agg(F.count("*").alias("n"))  # a row a range, or two where groups meet
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select(F.col(group).alias("_group"), F.col(part).alias("_part"), before.alias("_before"))
    joined = placed.join(small(starts), F.col(group).eqNullSafe(F.col("_group")) & (F.col(part) == F.col("_part")))
    return joined.withColumn(out, F.col("_before") + F.col(at)).drop("_group", "_part", "_before", part, at)


def write_shards(docs: DataFrame, path: str, key: str, shards: int) -> None:
    """Write docs under path in folders shard=0, shard=1 ..., rows in the order of the hash of their keys.

    A shard is cut into several files by ranges of the hash, so none has to fit in one task. Columns named shard or _key are refused.
    """
    if {c.lower() for c in docs.columns} & {"shard", "_key"}:
        raise ValueError("shard and _key name the columns that are added here")
    placed = with_shard(docs.withColumn("_key", key_hash(F.col(key))), key, shards)
    placed.repartitionByRange("shard", "_key").sortWithinPartitions("shard", "_key").drop("_key").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's bytes in UTF-8 plus 1, null counting as none; law is `key`; grown_shard is the shard with one more. Slots follow the
    MD5 of the id, then id, size and checksum; rows equal in all of them are interchangeable. A null id is the empty key. Repeated rows each
    have a slot. Texts are measured whole in the JVM and not shuffled. Empty input gives no rows; other columns are not read.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key_hash(F.col("doc_id")).alias("hashed"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("hashed"), shards), "grown_shard": shard_of(F.col("hashed"), shards + 1)})
    out = numbered(rows, "shard", ["hashed", "doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

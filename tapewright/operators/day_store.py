"""Stores by day that a load changes all at once: folders a day that never change, and a published list of those that count.

A load writes the merged days it touches to new folders, then publishes the list with those days exchanged, by one rename of a pointer. Days
that it doesn't touch are neither read nor moved. The list also names, for each stream, the last batch that went in: a batch that runs
again after a crash finds either nothing of itself or all of it. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import scratch
from . import sinks

LIST = "kind string, name string, at string, n long"


def listed(spark: SparkSession, path: str) -> list[Row]:
    """The published list: a row for each day, one for each stream and one for the schema; empty before the first load."""
    rows = sinks.published(spark, f"{path}/_days")
    return [] if rows is None else rows.collect()


def stored_days(spark: SparkSession, path: str, only: set[str] | None = None) -> DataFrame | None:
    """The store, or of it the days with the folder names `only`; None where it has none."""
    rows = listed(spark, path)
    folders = [f"{path}/{r['at']}" for r in rows if r["kind"] == "day" and (only is None or r["name"] in only)]
    if not folders:
        return None
    schema = T.StructType.fromJson(json.loads(next(r["at"] for r in rows if r["kind"] == "schema")))
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def applied(rows: list[Row], batch: tuple[str, int] | None) -> bool:
    return batch is not None and any(r["kind"] == "batch" and r["name"] == batch[0] and r["n"] >= batch[1] for r in rows)


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = sinks._fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p) if "=" in x.getPath().getName()] if fs.exists(p) else []


def merge_days(spark: SparkSession, path: str, new: DataFrame, day: str, merge, batch: tuple[str, int] | None = None) -> bool:
    """Replace the days that `new` touches by merge(their stored rows or None, new rows); False if the batch (stream, number) has gone in before.

    The new rows are staged first, so that they are computed once and nothing is read while it is replaced. Rows of a day are dealt over tasks by
    their content. Folders that neither this list nor the one before names, those of dead writers among them, are removed at the end.
    """
    rows = listed(spark, path)
    if applied(rows, batch):
        return False
    staged = scratch(spark, "new-days")
    new.write.partitionBy(day).parquet(staged)
    touched = set(_folders(spark, staged))
    load, before = f"load={uuid.uuid4().hex}", {r["name"]: r["at"] for r in rows if r["kind"] == "day"}
    kept = [(r["kind"], r["name"], r["at"], r["n"]) for r in rows if r["kind"] != "schema" and not (r["kind"] == "day" and r["name"] in touched) and not (batch and r["kind"] == "batch" and r["name"] == batch[0])]
    schema = new.schema.json() if touched or not rows else next(r["at"] for r in rows if r["kind"] == "schema")
    if touched:
        fresh = spark.read.schema(new.schema).parquet(staged).select(*new.columns)
        done = merge(stored_days(spark, path, touched), fresh)
        schema = done.schema.json()
        salt = F.pmod(F.xxhash64(*[c for c, kind in done.dtypes if not kind.startswith(("map", "variant"))]), F.lit(32))
        done.repartition(day, salt).sortWithinPartitions(day).write.partitionBy(day).parquet(f"{path}/{load}")
        kept += [("day", name, f"{load}/{name}", None) for name in _folders(spark, f"{path}/{load}")]
    kept += [("batch", batch[0], None, batch[1])] if batch else []
    kept.append(("schema", None, schema, None))
    sinks.publish(spark.createDataFrame(kept, LIST).coalesce(1), f"{path}/_days")  # a row a day
    named = {at for kind, _, at, _ in kept if kind == "day"} | set(before.values())
    for old in _folders(spark, path):
        days = _folders(spark, f"{path}/{old}")
        dead = [d for d in days if f"{old}/{d}" not in named]
        for at in [old] if len(dead) == len(days) else [f"{old}/{d}" for d in dead]:
            fs, p = sinks._fs(spark, f"{path}/{at}")
            fs.delete(p, True)
    return True


def accrue_days(spark: SparkSession, path: str, new: DataFrame, keys: list[str], metric: str, day: str, batch: tuple[str, int] | None = None) -> bool:
    """accrue() for a store by day: of each key within a day the largest metric stays, and only the days of the new rows are read and replaced."""
    order = [F.col(metric).desc_nulls_last()]
    return merge_days(spark, path, new, day, lambda old, rows: sinks.merged(old, rows, [day, *[k for k in keys if k != day]], order), batch)


def split_by_day(df: DataFrame, path: str, day: Column, url: str | None) -> DataFrame:
    """Rows by their own date, once for each filing url or else content hash, merged with what the store has of their days.

    A frame with the number of rows without a date comes back.
    """
    spark = df.sparkSession
    body = F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    key = F.coalesce(F.nullif(F.trim(F.col(url)), F.lit("")), body) if url else body
    keyed = df.withColumns({"_key": key, "as_of": day})
    order = [F.col(c).asc_nulls_first() for c in df.columns]
    merge_days(spark, path, keyed.where("as_of is not null"), "as_of", lambda old, rows: sinks.merged(old, rows, ["as_of", "_key"], order))
    return keyed.agg(F.count_if(F.col("as_of").isNull()).alias("undated"))

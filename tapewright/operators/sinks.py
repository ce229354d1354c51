"""Stores and their upkeep: clustered writes, staged publishing, accrual, day splits, guards, ledgers and versions.

A published store is a folder of states, each a Parquet folder that is never changed, and a pointer to the newest. The pointer is
replaced by one rename, atomic on file systems (on object stores as far as they rename atomically), so a reader sees the old state or the
new one, and a writer that dies leaves the old one. Stores by day, of which a load rewrites the days it touches, are in day_store.py.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_clustered(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that row groups' ranges prune; Zstandard."""
    laid = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def state_of(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest published state, None before the first."""
    if not exists(spark, f"{path}/{POINTER}"):
        return None
    fs, p = _fs(spark, f"{path}/{POINTER}")
    stream = fs.open(p)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{name}"


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest published state; None before the first."""
    at = state_of(spark, path)
    return None if at is None else spark.read.parquet(at)


def publish(df: DataFrame, path: str, keep: int = 2, write=None) -> None:
    """Write a new state, then move the pointer to it; the last `keep` states stay, for readers that are under way.

    write(df, folder) lays a state out, by default as Parquet.
    """
    spark, name = df.sparkSession, f"state-{uuid.uuid4().hex}"
    before = state_of(spark, path)
    (write or (lambda rows, to: rows.write.parquet(to)))(df, f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    fs, staged = _fs(spark, f"{path}/{POINTER}-{name}")
    out = fs.create(staged, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, _fs(spark, f"{path}/{POINTER}")[1], options)
    states = sorted(((x.getModificationTime(), x.getPath()) for x in fs.listStatus(_fs(spark, path)[1]) if x.getPath().getName().startswith("state-")), key=lambda x: x[0])
    spared = {name, before and before.rsplit("/", 1)[-1]}
    for _, old in states[: max(0, len(states) - keep)]:
        if old.getName() not in spared:
            fs.delete(old, True)


def merged(store: DataFrame | None, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Store and new rows, one row for each key by the order; what ties there falls to the content of the whole row."""
    both = new if store is None else store.unionByName(new, allowMissingColumns=True)
    whole = [F.col(c).desc_nulls_last() for c, kind in both.dtypes if c not in keys and not kind.startswith(("map", "variant"))]
    return both.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order, *whole))).where("_rank = 1").drop("_rank")


def accrue(spark: SparkSession, path: str, new: DataFrame, keys: list[str], metric: str, day: str | None = None) -> None:
    """Add new rows to the published store, keeping the largest metric of each key; with `day`, dates already stored are skipped."""
    store = published(spark, path)
    if store is not None and day:
        new = new.join(store.select(day).distinct(), day, "left_anti")
    publish(merged(store, new, keys, [F.col(metric).desc_nulls_last()]), path)


def union_never_shrink(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Distinct rows of store and new; refuses to publish fewer than the store has. Returns the rows stored."""
    store = published(spark, path)
    had = store.count() if store is not None else 0
    both = (store.unionByName(new) if had else new).distinct()
    n = both.count()
    if n < had:
        raise ValueError(f"{n} distinct rows would replace {had}")
    publish(both, path)
    return n


def member_days(members: DataFrame) -> DataFrame:
    """(member, content) of archives -> (as_of, name, sha256, content): date DDMMYYYY from the name, sidecar files out, repeats once."""
    name = F.element_at(F.split("member", "/"), -1)
    t = members.withColumn("name", name).where(~F.col("member").contains("__MACOSX") & ~F.col("name").startswith("._"))
    t = t.withColumns({"as_of": F.try_to_date(F.regexp_extract("name", r"(\d{8})", 1), "ddMMyyyy"), "sha256": F.sha2("content", 256)})
    return t.groupBy("as_of", "name", "sha256").agg(F.first("content").alias("content"))


def snapshot_publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], stamp: str) -> dict[str, str]:
    """Each table as a new version in a folder of its own, then a history row that names it; a failing table doesn't stop the others.

    The history decides what a version is: a publish that dies before its row leaves a folder that no reader sees and the next version does
    not meet. Returns failures.
    """
    failed = {}
    for name, df in tables.items():
        try:
            folder = f"v-{uuid.uuid4().hex}"
            done = snapshot_history(spark, root, name)
            n = (done.agg(F.max("version")).first()[0] or 0) + 1 if done is not None else 1
            df.write.parquet(f"{root}/{name}/{folder}")
            rows = spark.read.schema(df.schema).parquet(f"{root}/{name}/{folder}").count()
            spark.createDataFrame([(n, stamp, rows, folder)], "version int, stamp string, rows long, folder string").coalesce(1).write.mode("append").parquet(f"{root}/_history/{name}")
        except Exception as e:  # noqa: BLE001  reported to the caller, table by table
            failed[name] = str(e)
    return failed


def snapshot_history(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    path = f"{root}/_history/{name}"
    return spark.read.parquet(path) if exists(spark, path) else None


def snapshot_read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The newest version up to `version`; only versions in the history count. FileNotFoundError where there is none."""
    done = snapshot_history(spark, root, name)
    at = done.where(F.col("version") <= version) if done is not None and version is not None else done
    newest = at.orderBy(F.col("version").desc(), "stamp", "folder").first() if at is not None else None
    if newest is None:
        raise FileNotFoundError(f"{root}/{name}" + (f" up to version {version}" if version is not None else ""))
    return spark.read.parquet(f"{root}/{name}/{newest['folder']}")

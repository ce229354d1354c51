"""Shared helpers: tables, scratch space on the shared folder, word hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after its size was counted; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: ASCII whitespace that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, one for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most `rows` rows, counted now; otherwise Spark picks a shuffle join.

    Call it on materialised, narrow tables only: the count then reads Parquet footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Rows cross to Python in batches of at most so many meanwhile, so that neither side holds thousands of whole texts at a time.

    It holds for what runs inside: a plan that is only handed back takes the session's own batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable stands for it, where a column's expression would be copied."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fold_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """word -> 64-bit hash; keeps at most `limit` words, others are hashed anew each time."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z lower-cased; bytes.split() uses exactly the six characters of SPACES."""
    return text.translate(_LOWER_BYTES).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Bytes of texts hashed at a time; a longer text is cut between words.
PIECE = 1_000_000
_GAP = re.compile(rb"[ \t-\r]")
_IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_BYTE_CODES = np.where(_IS_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _buffer_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of a buffer that ends with a space: a polynomial over codes of its bytes, mixed with its length."""
    b = np.frombuffer(data, np.uint8)
    gap = _IS_SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(b) and not gap[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    length = last - first
    runs = np.concatenate(([0], first))
    at = np.arange(len(b), dtype=np.int32) - np.repeat(runs.astype(np.int32), np.diff(np.append(runs, len(b))))
    longest = int(length.max())
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest, _BASE))), dtype=np.uint64)
    values = _BYTE_CODES[b] * powers[np.minimum(at, longest)]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64)), first


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (as split_words() gives them), one after the other, and each text's number of words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held, owner, size = [], [], 0

    def flush() -> None:
        starts = np.cumsum([0] + [len(x) + 1 for x in held])
        h, first = _buffer_words(b"\n".join([*held, b""]))
        hashes.append(h)
        np.add.at(counts, owner, np.diff(np.searchsorted(first, starts)))

    for k, t in enumerate(texts):
        at, t = 0, (t or b"").translate(_LOWER_BYTES)
        while at < len(t):
            cut = _GAP.search(t, at + PIECE)
            held.append(t[at : cut.start() if cut else len(t)])
            owner.append(k)
            size += len(held[-1])
            at = cut.start() if cut else len(t)
            if size >= PIECE:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


class Keys:
    """A set of 64-bit hashes with values, sorted; a table of where each run of leading bits starts finds a key in a step or two.

    ordered: the keys are sorted already, so that no copy is made.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None, ordered: bool = False):
        if not ordered:
            order = np.argsort(keys)
            keys, values = keys[order], None if values is None else values[order]
        self.keys, self.values = keys, values
        bits = min(26, max(1, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.start = np.full((1 << bits) + 1, len(self.keys), np.int32)
        for at in range(0, 1 << bits, 1 << 16):  # in parts, for the sake of memory
            part = np.arange(at, min(at + (1 << 16), 1 << bits), dtype=np.uint64)
            self.start[at : at + len(part)] = np.searchsorted(self.keys, part << self.shift)

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in q that are in the set, their places in the set)."""
        run = (q >> self.shift).astype(np.int64)
        to, end = self.start[run], self.start[run + 1]
        at = np.flatnonzero(to < end)
        to, end, found = to[at], end[at], np.full(len(q), -1, np.int64)
        while len(at):
            hit = self.keys[to] == q[at]
            found[at[hit]] = to[hit]
            to += 1
            more = ~hit & (to < end)
            at, to, end = at[more], to[more], end[more]
        has = np.flatnonzero(found >= 0)
        return has, found[has]


#: Bits of a table of hashes for each of them, bits of it at most (256 MB), and bits of a page.
BITS_EACH, MOST_BITS, PAGE = 16, 1 << 31, 1 << 23


def bit_table(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bit for each of keys(h), 64-bit hashes, at the place that its low bits name: BITS_EACH bits a key, `most_bits` at most.

    What isn't there is taken for a key once in BITS_EACH times, beyond `most_bits` more often; no key is ever missed. Tasks put pages together; the driver
    receives bits, never keys.
    """
    size = 1 << int(np.clip(np.ceil(np.log2(BITS_EACH * max(keys.count(), 1))), 3, np.log2(most_bits)))

    def page(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        bits = np.zeros(min(size, PAGE), np.uint8)
        bits[at % PAGE] = 1
        return pa.table({"page": [int(at[0] // PAGE)], "bits": [np.packbits(bits).tobytes()]})

    placed = keys.select((F.col("h").bitwiseAND(size - 1)).alias("at")).withColumn("page", F.expr(f"at div {PAGE}"))
    table = np.zeros(max(size // 8, 1), np.uint8)
    for part in placed.groupBy("page").applyInArrow(page, "page long, bits binary").toArrow().to_batches():
        for k, bits in zip(part.column("page").to_pylist(), part.column("bits").to_pylist()):
            table[k * PAGE // 8 : k * PAGE // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be a key of a bit_table()."""
    at = h.view(np.int64) & (8 * len(table) - 1)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


_ODD = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by position; empty when there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc = h[: len(h) - n + 1] * _ODD[0]
    for k in range(1, n):
        acc = acc + h[k : len(h) - n + 1 + k] * _ODD[k]
    return mix(acc + np.uint64(n))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that what Python holds at a time doesn't follow Spark's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def connected(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): one row (node, root) for each node, root the smallest node reachable.

    Alternates large-star and small-star steps, each a min-aggregation and a join, until the edges stop changing.
    A hub is never gathered in one group: only its minimum is, and the join on it can be split. Null ends are dropped.
    """
    edges = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u")
        edges = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(edges, "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

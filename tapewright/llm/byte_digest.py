"""Quartile bucket digests: similar texts have similar fingerprints.

Byte triplets of a sliding five-byte window are hashed into 128 buckets. Each bucket's count becomes two bits, its quartile among the
text's buckets; one more byte holds the length on a log scale. Digests differ by a score: the sum of quartile steps (a step of three
counts six) plus the step in length; likeness is 1 - score / MOST, within 0 and 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, small

BUCKETS = 128
#: Triplets of a window of five bytes that hold its last byte, as distances back from it.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Expected score of independent digests (128 buckets, 1.625 a bucket); from there on likeness is 0.
MOST = 208
_STEP = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)])
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Bytes of texts in a range of neighbours, and ids sampled a range to cut them.
RANGE_BYTES, SAMPLED = 64 << 20, 50
#: Ids sampled in all, 32 MB on the driver.
MOST_SAMPLED = 4_000_000


def counts(data: bytes) -> np.ndarray:
    n = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data), 1), PIECE):
        b = np.frombuffer(data[max(0, at - 4) : at + PIECE], np.uint8).astype(np.uint64)
        new = min(at, 4)
        for k, (x, y, z) in enumerate(TRIPLETS):
            far = max(x, y, z)
            last = np.arange(max(far, new), len(b))
            if len(last):
                h = mix((b[last - x] << np.uint64(16)) | (b[last - y] << np.uint64(8)) | b[last - z] | np.uint64(k + 1 << 24))
                n += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return n


def digest(text: str) -> str:
    """66 hex digits: two for the length, 64 for the quartiles; equal texts have equal digests, the empty text too."""
    data = text.encode("utf-8", "surrogatepass")
    n = counts(data)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    packed = code.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    size = min(255, int(round(8 * np.log2(len(data) + 1))))
    return f"{size:02x}" + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Score of two digests: 0 when they are equal."""
    x, y = (np.frombuffer(bytes.fromhex(d[2:]), np.uint8) for d in (a, b))
    codes = [((v[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel() for v in (x, y)]
    steps = abs(int(a[:2], 16) - int(b[:2], 16))
    return int(_STEP[codes[0], codes[1]].sum()) + max(0, steps - 1)


def likeness(a: str, b: str) -> float:
    return 1.0 - min(difference(a, b), MOST) / MOST


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with one more column, the digest of each whole text; null counts as the empty text. Rows stand for themselves."""
    make = F.pandas_udf(lambda s: s.fillna("").map(digest), "string")
    return docs.withColumn(out, make(F.col(text)))


def cuts_of(ids: DataFrame, ranges: int) -> np.ndarray:
    """Ids that cut ids(doc_id) into about so many even ranges, ascending: quantiles of a sample of SAMPLED ids a range, MOST_SAMPLED in all. They set the balance alone."""
    rows = ids.where("doc_id is not null")
    n = rows.count()
    if ranges < 2 or not n:
        return np.empty(0, np.int64)
    wanted = min(SAMPLED * ranges, MOST_SAMPLED)
    some = rows.select("doc_id") if n <= wanted else rows.select("doc_id").sample(fraction=wanted / n, seed=1)
    found = np.sort(some.toArrow().column(0).to_numpy().astype(np.int64))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found


def neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) in descending order of doc_id, dealt into ranges that each end with the first row of the next.

    Gives (part, doc_id, text, extra): `extra` marks those repeated first rows; the last range ends with the first of all. Within a
    part, rows follow the order doc_id descending, null last, equal ids by the text's md5, extra rows last. The number of ranges follows
    the bytes of the texts; rows of one id, and those without, stay in one range. The driver receives the cuts of ranges, 8 bytes for 64 MB of text.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cuts = cuts_of(docs.select("doc_id"), max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // range_bytes)))
    held, n = spark.sparkContext.broadcast(cuts), len(cuts)
    # Ids above the k-th highest cut lie in part k, a cut itself in the part below it; a row without an id lies in part n + 1.
    part = F.pandas_udf(lambda c: pd.Series(len(held.value) - np.searchsorted(held.value, c.to_numpy(np.int64), side="left")), "long")
    placed = d.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(part(F.coalesce("doc_id", F.lit(0)))).cast("int"))
    # Parts 1 to n hold their cuts. The first and the last may be empty: what there is of either is asked for.
    some = docs.agg(F.bool_or(F.col("doc_id") > F.lit(int(cuts[-1]) if n else -(1 << 63))).alias("top"), F.bool_or(F.col("doc_id").isNull()).alias("bottom"), F.bool_or(F.col("doc_id").isNotNull()).alias("any")).first()
    first = 0 if some["top"] or (not n and some["any"]) else 1 if n else n + 1
    last = n + 1 if some["bottom"] else n
    heads = placed.groupBy("part").agg(F.min(F.struct(F.expr("-doc_id").alias("o"), "m")).alias("h"))
    before = F.when(F.col("part") == first, F.lit(last)).when((F.col("part") == n + 1) & F.lit(n == 0), F.lit(0)).otherwise(F.col("part") - 1)
    heads = materialise(heads.select(F.col("part").alias("p"), F.expr("-h.o").alias("d"), F.col("h.m").alias("hm"), before.cast("int").alias("before")), "range-heads")
    extra = placed.join(small(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("m") == F.col("hm")))  # one row a range
    extra = extra.groupBy("before", "doc_id", "m").agg(F.first("text").alias("text")).select(F.col("before").alias("part"), "doc_id", "text", "m", F.lit(True).alias("extra"))
    return placed.withColumn("extra", F.lit(False)).select("part", "doc_id", "text", "m", "extra").unionByName(extra)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): its digest, the digest of its edited text, and the likeness of both and of the next row's.

    The edited text keeps the first half and takes the same number of code points from the front of the next text in descending order of
    doc_id (all of it when it is shorter; a single row is its own next). Rows of one doc_id follow each other by the md5 of the text; a null
    doc_id comes last. Null texts are empty. Repeated rows follow each other. Empty input gives no rows. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    laid = neighbours(docs)
    order = [F.col("part"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("m")]
    rows = laid.repartition("part").sortWithinPartitions(*order).select("part", "doc_id", "text", "extra")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches):
            out = []
            for part, doc, text, extra in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text", "extra"))):
                mark = digest(text)
                if held and held[0] == part:
                    _, prev, old, print_ = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    e = digest(edited)
                    out.append((prev, len(old), hashlib.sha256(edited.encode()).hexdigest(), print_, e, likeness(print_, e), likeness(print_, mark)))
                held = None if extra else (part, doc, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names)

    return rows.mapInArrow(run, schema)

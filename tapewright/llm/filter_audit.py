"""How document filters interact: what each order of applying them keeps, removes and wastes, from counts of failure masks alone.

Each document's failures are a mask of bits, one for each filter. Whatever an order keeps, removes or removes again at a step is a sum over
masks, so documents are counted by (part, mask) once and all orders are read off the counts.

The filter on repeated texts needs the whole table. A counting Bloom sketch, cut into blocks by the texts' hashes, first clears texts that
are certainly unique: tasks count what they hold, blocks add the counts up, and a key with a counter of one is alone. What is left goes into a
filter of bounded size that every task applies while it reads, so of the texts only possible repeats are shuffled, grouped whole, and give the
least id of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BITS, UPPER, bit_table, materialise, may_hold, slices, texts_of

#: Distinct texts a block of the sketch is made for, counters for each of them, and counters that a text adds to.
BLOCK, COUNTERS, PROBES = 1 << 17, 16, 4
#: Keys a task counts at a time.
HELD = 1 << 20
#: Bytes of a text whose words are cut at a time.
PIECE = 1 << 20

_GAP = re.compile(rb"[ \t-\r]")
_UPPER, _FOLLOWING, _MARKS = UPPER.encode(), bytes(range(0x80, 0xC0)), b"#$%&*|"


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct, capitals, points, at = 0, set(), 0, 0, 0
    marked = False
    while at < len(text):
        cut = _GAP.search(text, at + PIECE) if len(text) > at + PIECE else None
        piece = text[at : cut.start() if cut else len(text)]
        found = piece.split()
        words += len(found)
        distinct.update(found)
        points += len(piece.translate(None, _FOLLOWING))
        capitals += len(piece) - len(piece.translate(None, _UPPER))
        marked = marked or len(piece.translate(None, _MARKS)) < len(piece)
        at += len(piece)
    return (words < 100) | (100 * len(distinct) < 80 * words) << 1 | (100 * capitals > 10 * points) << 2 | marked << 3


def with_failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, part, text) as (doc_id, part, mask, key, h): failures A to D, the SHA-256 of the text and a 64-bit hash; the text is left behind."""
    keyed = docs.select("doc_id", "part", "text", F.unhex(F.sha2("text", 256)).alias("key"), F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            mask = pa.array([failures(t) for t in texts_of(b, "text")], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), mask, b.column("key"), b.column("h")], ["doc_id", "part", "mask", "key", "h"])

    return keyed.mapInArrow(run, keyed.select("doc_id", "part", F.lit(0).alias("mask"), "key", "h").schema)


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """PROBES distinct counters of each key, by row; size is a power of two. The bits that choose the block are not used."""
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(16)) | np.uint64(1)
    return ((first + step * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(size - 1)).astype(np.int64)


def possible_repeats(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """The distinct values of keys(h) that may occur more than once: all that do, and a few that don't.

    Every task counts its keys and hands on each once, with whether it came more often, so a key of any frequency costs a row a task. Blocks
    hold an even share of the distinct keys.
    """
    bits = max(0, int(np.ceil(np.log2(max(keys.count(), 1) / block))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(n > 1)], ["block", "h", "more"])

        for b in batches:
            held.append(b.column("h").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def merge(t: pa.Table) -> pa.Table:
        h, more = t.column("h").to_numpy().view(np.uint64), t.column("more").to_numpy()
        size = 1 << max(8, int(np.ceil(np.log2(COUNTERS * min(len(h), 2 * block)))))
        counters = np.zeros(size, np.uint32)
        for at in _places(h, size):
            counters += np.bincount(at, 1 + more, minlength=size).astype(np.uint32)
        maybe = np.unique(h[np.minimum.reduce([counters[at] for at in _places(h, size)]) > 1])
        return pa.table({"h": pa.array(maybe.view(np.int64))})

    return keys.select("h").mapInArrow(partial, "block long, h long, more boolean").groupBy("block").applyInArrow(merge, "h long")


def membership(keys: DataFrame, most_bits: int = MOST_BITS):
    """A function of a column: whether a 64-bit hash may be one of keys(h). No key is missed."""
    held = keys.sparkSession.sparkContext.broadcast(bit_table(keys, most_bits))
    return F.pandas_udf(lambda h: pd.Series(may_hold(held.value, h.to_numpy(np.int64))), "boolean")


def with_repeats(docs: DataFrame, marked: DataFrame, bit: int = 16) -> DataFrame:
    """marked, as with_failures() gives it, as (doc_id, part, mask): `bit` is added where a smaller id has the same text.

    Texts are compared whole. Rows without an id are neither repeats nor repeated; rows of one id and text are not smaller than each other.
    """
    maybe = membership(materialise(possible_repeats(marked), "possible-repeats"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where(maybe("h"))
    first = texts.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = materialise(first.select(F.unhex(F.sha2("text", 256)).alias("key"), "first"), "least-ids")
    open_ = marked.withColumn("maybe", maybe("h"))
    asked = open_.where("maybe").join(first, "key", "left")
    again = F.when(F.col("doc_id") > F.col("first"), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))
    return open_.where("not maybe").select("doc_id", "part", "mask").unionByName(asked.select("doc_id", "part", again.alias("mask")))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """All orders of the filters `letters` over counts(part, mask, n, good, toxic), one row a mask; filter k fails where bit k is set.

    For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley, the filter's removals summed over
    all orders. Zeros included.
    """
    orders = ["".join(p) for p in permutations(letters)]
    share = F.array(*[F.lit(0 if k == 0 else len(orders) // k) for k in range(len(letters) + 1)])  # of all orders, those in which one of k filters comes first
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters entries at most
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bit = lambda x: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), x) - 1)
    before = F.aggregate(F.filter(F.split("filter_order", ""), lambda x: (x != "") & (F.instr("filter_order", x) < F.col("step"))), F.lit(0), lambda a, x: a + bit(x))
    steps = steps.withColumns({"before": before, "own": bit(F.expr("substring(filter_order, step, 1)"))})
    own, prior = F.col("own"), F.col("before")
    total = lambda cond, value: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(cond(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))
    fails, earlier, n = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(prior) != 0), (lambda c: c["n"])
    here = lambda m: fails(m) & ~earlier(m)
    return steps.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~earlier(m), n).alias("kept"), total(here, n).alias("removed"), total(lambda m: fails(m) & earlier(m), n).alias("redundant"),
        total(lambda m: m == own, n).alias("unique_fails"), total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * F.element_at(share, F.bit_count(c["mask"]) + 1)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str | Column = "lang") -> DataFrame:
    """The five filters A to E over docs(doc_id, text, part), in all 120 orders; see interactions() for the columns.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals A-Z > 10 * code points; D: one of # $ % & * |; E: the text of a
    smaller id. Null texts are empty, a null part is the empty text. labels(doc_id, quality, toxic) may name a document more than once: one
    row suffices. Rows without an id have no label. Repeated rows count each. An empty table gives no rows. Texts are read whole.
    """
    part = F.col(part) if isinstance(part, str) else part
    rows = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    masks = with_repeats(rows, materialise(with_failures(rows), "failures"))
    named = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    held = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    counts = masks.join(named, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), held("good"), held("toxic"))
    return interactions(counts, "ABCDE")

"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles. Its sketch is the k smallest of them. Documents with
equal sets are one class, known by a 128-bit hash of the set. Two sets of Jaccard similarity t share a known least number
of retained values (least_overlap(): exact while both sketches hold whole sets, otherwise Z standard deviations below
the mean, which misses a pair at the threshold with a chance of about 3 in 100,000 and a closer pair hardly ever). Inverted lists hold, for each class, only its rarest retained values:
of two sketches that share at least s values, each ordered from the rarest value of the corpus on, the first size - s + 1 have
one in common. So values that very many documents share enter a list only for documents that consist of them. Every list
first compares its members with its smallest member. After those links are contracted, only members of different
components are compared, without any cap; the join emits a pair once, and only when the sketches overlap enough. The
union-sketch estimate then filters the pairs, and full shingle sets confirm them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, fresh, gram_hashes, hashed_words, materialise, slices, small, texts_of

SKETCH = 160
#: Standard deviations below the mean overlap of sketches at the threshold that still count as a candidate.
Z = 4.0


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `size` make one shingle, none make none."""
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    return [np.unique(gram_hashes(words[z - n : z], min(size, int(n)))) if n else np.empty(0, np.uint64) for n, z in zip(counts, ends)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values)))


def _key(s: np.ndarray) -> bytes:
    """128 bits that know a set, two hashes of 64: at 10 ** 11 sets, the chance that any two share them is below 10 ** -16."""
    data = s.tobytes()
    return xxhash.xxh3_64_digest(data) + xxhash.xxh3_64_digest(data, seed=1)


def _sampled(union: Column, percent: int, k: int) -> Column:
    """Least number of shared values among the k smallest of a union of that size, at the threshold: a draw without replacement."""
    t = percent / 100
    left = F.lit(1.0) - F.least(F.lit(1.0), F.lit(float(k)) / union)
    return F.floor(F.lit(k * t) - F.lit(Z * math.sqrt(k * t * (1 - t))) * F.sqrt(left))


def least_overlap(n: Column, percent: int, k: int) -> Column:
    """Least number of values that the sketch of a set of n shares with that of any set of similarity percent / 100 or more.

    Their union has n to n / t shingles. Within k, both sketches are whole and share t * n values at least; beyond k, they are samples,
    and the largest union gives the least. A set of at most k may be in either case, so the smaller bound holds for it.
    """
    t = percent / 100
    sampled = _sampled(n / F.lit(t), percent, k)
    return F.greatest(F.lit(1), F.when(n <= k, F.least(F.ceil(n * F.lit(percent) / 100), sampled)).otherwise(sampled)).cast("int")


def similar(a: Column, b: Column, n: Column, m: Column, percent: int, k: int) -> Column:
    """Whether sketches a and b of sets of n and m may belong to a pair: exact when they hold the union, otherwise the union-sketch estimate."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both, size = F.size(F.array_intersect(F.array_intersect(union, a), b)), F.size(union)
    return F.when(size < k, both * 100 >= size * percent).otherwise(both >= _sampled((n + m) / F.lit(1 + percent / 100), percent, k))


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(texts_of(batch, "text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), _lists([s[:k] for s in sets])],
                ["doc_id", "n_shingles", "node", "sketch"],
            )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(texts_of(batch, "text"), size)
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), _lists(sets)], ["node", "full"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, k: int = SKETCH) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets. component_id is the
    smallest doc_id reachable over links; kept marks the document that has it. Null or empty texts and texts without
    words have an empty set and stand alone. Rows with equal sets are one class and link at once; repeated rows of one
    doc_id all carry the same result. A null doc_id takes part, never names a component that has another id, and is
    never kept unless its whole component has null ids. Other columns of docs are ignored. Empty input gives no rows.
    """
    rows = materialise(docs.select("doc_id", "text").mapInArrow(_sketches(shingle, k), "doc_id long, n_shingles long, node binary, sketch array<long>"), "sketches")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.withColumn("least", least_overlap(F.col("n"), percent, k)), "nodes")

    postings = nodes.select("node", F.explode("sketch").alias("v"))
    shared = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    # Values that only one class has sort first in any prefix: they need no list but use up its places.
    ranked = postings.join(shared, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    size = F.least("n", F.lit(k)).cast("int")
    ranked = ranked.join(nodes.select("node", "n", "least", size.alias("size")), "node").withColumn("take", F.size("vs") - F.col("least") + 1)
    entries = ranked.where("take > 0").select("node", "n", F.transform(F.slice("vs", F.lit(1), F.col("take")), lambda x: x["v"]).alias("prefix"))
    entries = materialise(entries, "prefixes")

    lists = entries.select("node", F.explode("prefix").alias("v"))
    leaders = lists.groupBy("v").agg(F.min("node").alias("lead"))
    stars = lists.join(leaders, "v").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = confirm(docs, nodes, stars, percent, shingle, k)
    roots = materialise(connected(first), "roots")

    placed = materialise(lists.join(roots, "node", "left").select("v", "node", F.coalesce("root", "node").alias("root")), "placed")
    by_root = placed.groupBy("v", "root").agg(F.count("*").alias("c"))
    mixed = materialise(by_root.groupBy("v").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots"), "mixed")
    here = placed.join(small(mixed), "v").join(entries, "node").join(nodes.select("node", "sketch"), "node")
    here = materialise(here, "mixed-lists")
    others = here.where("root <> main").select("v", *[F.col(c).alias(f"o_{c}") for c in ("node", "root", "n", "prefix", "sketch")])
    # Cheap tests first: other components, sizes, then the pair's first common list, then the sketches.
    cheap = f"o_root <> root and (root = main or o_node < node) and 100 * least(o_n, n) >= {int(percent)} * greatest(o_n, n) and array_min(array_intersect(o_prefix, prefix)) = v"
    pairs = others.join(here, "v").where(F.expr(cheap) & similar(F.col("o_sketch"), F.col("sketch"), F.col("o_n"), F.col("n"), percent, k))
    pairs = pairs.select(F.least("o_node", "node").alias("a"), F.greatest("o_node", "node").alias("b")).distinct()
    second = confirm(docs, nodes, pairs, percent, shingle, k)
    whole = materialise(connected(first.union(second)), "components")

    ids = nodes.select("node", "rep").join(whole, "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(ids, "root").select("node", "component_id")
    answer = materialise(nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = rows.select("doc_id", "n_shingles", "node").join(answer, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, shingle: int, k: int) -> DataFrame:
    """Of pairs(a, b) of nodes, those whose union-sketch estimate passes and whose full sets reach the similarity."""
    at = lambda side: nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "sketch", "n")])
    likely = pairs.join(at("a"), F.col("a") == F.col("node_a")).join(at("b"), F.col("b") == F.col("node_b"))
    likely = likely.where(f"100 * least(n_a, n_b) >= {int(percent)} * greatest(n_a, n_b)")
    likely = likely.where(similar(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), percent, k))
    likely = materialise(likely.select("a", "b"), "likely")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(wanted.join(nodes.select("node", "rep"), "node"), "wanted")
    ids = materialise(wanted.select("rep").distinct(), "wanted-ids")
    texts = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    full = texts.select("text").mapInArrow(_full_sets(shingle), "node binary, full array<long>")
    full = materialise(full.join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "full-sets")
    fa, fb = full.select(F.col("node").alias("a"), F.col("full").alias("fa")), full.select(F.col("node").alias("b"), F.col("full").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb")).cast("long")
    done = likely.join(fa, "a").join(fb, "b").select("a", "b", both.alias("i"), (F.size("fa") + F.size("fb")).cast("long").alias("s"))
    return materialise(done.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * int(percent)).select("a", "b"), "links")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; all columns stay.

    Of repeated rows with one doc_id, one stays. Rows with a null doc_id stay: nothing names them.
    """
    found = materialise(near_duplicates(docs, percent), "near")
    name = fresh(docs, "gone")
    gone = materialise(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "gone")
    left = docs.join(small(gone), F.col("doc_id") == F.col(name), "left_anti")
    if found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        left = left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
    return left

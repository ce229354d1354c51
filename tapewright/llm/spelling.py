"""Groups spelling variants: words one edit apart, the rarer led to the far more frequent.

A word is a point, its counts of letters. One edit moves a point by one (a letter put in or left out) or by two (a letter replaced) in L1
distance, so near words lie in a small ball. For each length a k-d tree over a sample cuts the space into cells of bounded size; every word
lives in one cell and is sent to the cells of its own and the neighbouring lengths whose boxes its ball touches. There a k-d tree over the
cell's points, pruned by boxes in the same way, gives candidates, and the order of letters is verified. Crossing a cut costs a distance
of one at least, so a word visits a number of cells, and of leaves, that grows with the square of the tree's depth at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, slices

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: A run whose checksum this divides loses a letter.
DAMAGED = 31
#: Words of a cell aimed at, words sampled to cut cells, points of a leaf, and pairs compared at a time.
CELL, SAMPLE, LEAF, PAIRS = 8192, 200_000, 40, 1 << 20
#: Axes of the space; code points that are equal modulo it share one, which never makes a distance larger.
AXES = 32
#: Code points of a text taken at a time, and words counted before they are handed on.
PIECE, WORDS_HELD = 1 << 20, 200_000

_RUN, _GAP = re.compile(RUNS), re.compile(RUNS.replace("[", "[^").rstrip("+"))
_CASE = str.maketrans(UPPER, LOWER)


def run_counts(text: str) -> Counter:
    """Maximal runs of letters with A-Z lower-cased. A piece of the text is cut where no letter stands."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + PIECE) if len(text) > at + PIECE else None
        end = cut.start() if cut else len(text)
        found.update(_RUN.findall(text[at:end].translate(_CASE)))
        at = end
    return found


def damaged(doc: str, run: str) -> str:
    """The run, or where DAMAGED divides the checksum of `doc:run`, the run without the letter that the checksum names."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc.encode() + b":"))
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of docs(doc_id, text) of at least `length` code points that occur `least` times or more over all texts.

    Null texts have no words; a null id is the empty text in the checksum; repeated rows count each. Tasks count before they shuffle, so a
    word of any frequency costs a row for each WORDS_HELD others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                for w, n in run_counts(text or "").items():
                    if len(w) >= length and len(w := damaged(doc, w)) >= length:
                        held[w] += n
                if len(held) >= WORDS_HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def points(codes: np.ndarray) -> np.ndarray:
    """Counts of letters by axis, one row for each word."""
    at = (codes % AXES).astype(np.int64) + np.arange(len(codes), dtype=np.int64)[:, None] * AXES
    return np.bincount(at.ravel(), minlength=len(codes) * AXES).reshape(-1, AXES).astype(np.int32)


def _cut(p: np.ndarray) -> tuple[int, int] | None:
    """(axis, value) that halves the points best: those up to the value and those above it; None when all are equal."""
    best = None
    for axis in np.argsort(-p.var(axis=0))[:4]:
        value = int(np.median(p[:, axis]))
        for v in (value - 1, value):
            left = int((p[:, axis] <= v).sum())
            if 0 < left < len(p) and (best is None or abs(2 * left - len(p)) < best[0]):
                best = (abs(2 * left - len(p)), int(axis), v)
    if best is None:
        axis = int(np.argmax(np.ptp(p, axis=0)))
        v = int(p[:, axis].min())
        return (axis, v) if p[:, axis].max() > v else None
    return best[1:]


def _tree(p: np.ndarray, size: float, first: int) -> tuple:
    """Nested (axis, value, left, right); a cell is a number, `first` and up, of at most `size` of the points unless they are equal."""
    cut = _cut(p) if len(p) > size else None
    if cut is None:
        return first, first + 1
    above = p[:, cut[0]] > cut[1]
    left, first = _tree(p[~above], size, first)
    right, first = _tree(p[above], size, first)
    return (*cut, left, right), first


def _walk(tree, p: np.ndarray, rows: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(cell, rows) of the points p[rows] whose balls touch the cell's box; left is the distance that each row has yet."""
    if not isinstance(tree, tuple):
        yield tree, rows
        return
    axis, value, below, above = tree
    x = p[rows, axis]
    old = np.maximum(np.maximum(low[axis] - x, x - high[axis]), 0)
    for side, lo, hi in ((below, low[axis], min(value, high[axis])), (above, max(value + 1, low[axis]), high[axis])):
        rest = left - (np.maximum(np.maximum(lo - x, x - hi), 0) - old)
        near = np.flatnonzero(rest >= 0)
        if len(near):
            box_low, box_high = low.copy(), high.copy()
            box_low[axis], box_high[axis] = lo, hi
            yield from _walk(side, p, rows[near], rest[near], box_low, box_high)


def touched(tree, p: np.ndarray, radius: int):
    """(cell, rows of p) for each cell whose box lies within `radius` of the points."""
    yield from _walk(tree, p, np.arange(len(p)), np.full(len(p), radius), np.full(AXES, -1), np.full(AXES, np.iinfo(np.int32).max))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; b is as long as a or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head, tail = a != b[:, :-1], a != b[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), n)  # letters before it are equal
    last = np.where(tail.any(axis=1), n - 1 - tail[:, ::-1].argmax(axis=1), -1)  # letters after it are equal, one further on
    return last < first


def _by_masks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart, by what is left when a letter is taken out: linear in the letters, for points that no cut parts."""
    table: dict = {}
    same = a.shape[1] == b.shape[1]
    for k, row in enumerate(b):
        for mask in {(i if same else -1, np.delete(row, i).tobytes()) for i in range(len(row))}:
            table.setdefault(mask, []).append(k)
    pairs = []
    for j, row in enumerate(a):
        for mask in [(i, np.delete(row, i).tobytes()) for i in range(len(row))] if same else [(-1, row.tobytes())]:
            pairs += [(j, k) for k in table.get(mask, ()) if not same or a[j, mask[0]] != b[k, mask[0]]]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def near_pairs(home: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asked, rows of home) one edit apart, in parts; either holds words of one length, the lengths differ by one at most."""
    step = asked.shape[1] - home.shape[1]
    radius = 1 if step else 2
    p, q = points(home), points(asked)
    weights = np.uint64(1) << np.arange(AXES, dtype=np.uint64)
    odd_p, odd_q = ((x & 1).astype(np.uint64) @ weights for x in (p, q))
    leaves: dict[int, np.ndarray] = {}

    def build(rows: np.ndarray):
        cut = _cut(p[rows]) if len(rows) > LEAF else None
        if cut is None:
            leaves[len(leaves)] = rows
            return len(leaves) - 1
        above = p[rows, cut[0]] > cut[1]
        return (*cut, build(rows[~above]), build(rows[above]))

    for leaf, near in touched(build(np.arange(len(p))), q, radius):
        rows = leaves[leaf]
        if len(rows) > 4 * LEAF:
            short, long = (home[rows], asked[near]) if step > 0 else (asked[near], home[rows])
            x, y = _by_masks(short, long)
            yield (near[y], rows[x]) if step > 0 else (near[x], rows[y])
            continue
        for at in range(0, len(near), PAIRS // len(rows)):
            some = near[at : at + PAIRS // len(rows)]
            x, y = np.nonzero(np.bitwise_count(odd_q[some][:, None] ^ odd_p[rows][None, :]) <= radius)
            x, y = some[x], rows[y]
            ok = one_edit(home[y], asked[x]) if step > 0 else one_edit(asked[x], home[y])
            yield x[ok], y[ok]


def near_words(counts: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, near_n, near) for each of counts(word, n), words distinct, that has a near word: how many, and the most frequent.

    Two words are near if they differ by exactly one code point put in, left out or replaced; ties of frequency go to the first in code-point
    order. A sample of SAMPLE words at most cuts the cells, which sets their balance alone: every word is indexed and asked for. Words of
    equal letter counts stay in one cell; no word longer than one of the same letters is near it, and they are never compared with each other.
    """
    spark = counts.sparkSession
    total = counts.count()
    share = min(1.0, SAMPLE / max(total, 1))
    some = counts.select("word").where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else counts.select("word")
    by_length: dict[int, list[str]] = {}
    for w in some.toArrow().column(0).to_pylist():
        by_length.setdefault(len(w), []).append(w)
    trees, first = {}, 0
    for n, words in sorted(by_length.items()):
        trees[n], first = _tree(points(letters(words)), max(1.0, cell * share), first)
    # Words of lengths that the sample lacks: one cell a length, numbered below 0.
    held = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 50_000):
            words = b.column("word").to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            sent = []  # (rows, cell, whether it is their home)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                p = points(letters([words[k] for k in rows]))
                for other, radius in ((n - 1, 1), (n, 2), (n + 1, 1)):
                    tree, at_home = held.value.get(int(other), -int(other)), np.full(len(rows), np.iinfo(np.int64).min)
                    for c, own in touched(tree, p, 0) if other == n else ():
                        at_home[own] = c
                    sent += [(rows[near], np.full(len(near), c), at_home[near] == c) for c, near in touched(tree, p, radius)]
            if sent:
                rows, cells, home = map(np.concatenate, zip(*sent))
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(home), part.column("word"), part.column("n")], ["cell", "home", "word", "n"])

    def search(t: pa.Table) -> pa.Table:
        words, n, home = (t.column(c).to_pylist() for c in ("word", "n", "home"))
        order = sorted((k for k in range(len(words)) if home[k]), key=lambda k: (-n[k], words[k]))  # the best form first
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        out = {"word": [], "n_near": [], "best": []}
        if order:
            own = letters([words[k] for k in order])
            for asked in by_size.values():
                number, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(order))
                for x, y in near_pairs(own, letters([words[k] for k in asked])):
                    number += np.bincount(x, minlength=len(asked))
                    np.minimum.at(best, x, y)
                for k in np.flatnonzero(number):
                    top = order[best[k]]
                    out["word"].append(words[asked[k]])
                    out["n_near"].append(int(number[k]))
                    out["best"].append({"o": -n[top], "near": words[top]})
        return pa.table(out, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("o", pa.int64()), ("near", pa.string())]))]))

    routed = counts.select("word", "n").mapInArrow(route, "cell long, home boolean, word string, n long")
    found = routed.groupBy("cell").applyInArrow(search, "word string, n_near long, best struct<o:long,near:string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.o")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each of forms(word, form): where following forms ends. Each round halves the ways that are left."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialise(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").head(1):
            return at.select("word", "root")
        at = at.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs(doc_id, text); see count_words() for words and near_words() for near ones.

    form is the near word of largest n if that is FACTOR times the word's at least, else null; root is where forms lead, the word itself
    without one. n grows along forms, so there are no rings. An empty table, or one without words, gives no rows.
    """
    words = materialise(count_words(docs), "words")
    near = near_words(words)
    held = materialise(words.join(near, "word", "left"), "near")
    leads = F.col("near_n") >= FACTOR * F.col("n")
    out = held.select("word", F.when(leads, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("near_n")).alias("form_n"))
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Seeds are the pairs of words that stand next to each other or one word apart, so that a changed, dropped or inserted word leaves seeds on both
of its sides. One pass over the corpus counts all pairs of the test items; of each item, the rarer half (ties: those whose first word comes
earlier) are its rare seeds. A second pass finds the items of which a document has at least `cover` of the rare seeds, by number and within
one stretch of text, and aligns that stretch with the item. So an item that is copied everywhere is found as one that is copied once, at any
size of the corpus, while common phrases alone start no alignment. A score of half the perfect one leaves room for at most an item's
length of inserted words, so stretches reach that far to both sides. Items are taken in blocks of bounded size; each block is a broadcast
and two passes, and no block joins all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Keys, fresh, hashed_words, materialise, mix, slices, small, texts_of

LEAST_SCORE = 0.5
#: A document that has this share of an item's rare seeds is aligned with it.
COVER = 0.2
#: Words of test items in one block; a longer item is a block by itself.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_PLAIN = bytes.maketrans(UPPER.encode() + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", LOWER.encode() + b" " * 32)


def plain(text: bytes | None) -> bytes:
    """The text in lower case, letters beyond ASCII too, with spaces for ASCII punctuation."""
    if not text:
        return b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_PLAIN)


def local_score(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of word sequences a and b, and the end (exclusive) of its part of b.

    Row by row over a; a gap in b along the row is a running maximum. Of equal scores, the first row and column win.
    """
    best, end = 0, 0
    if not len(a) or not len(b):
        return best, end
    prev = np.zeros(len(b) + 1, np.int64)
    slope = -GAP * np.arange(len(b) + 1)
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(prev[:-1] + np.where(b == x, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
        prev = row
    return best, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item within words."""
    score, end = local_score(item, words)
    back, length = local_score(item[::-1], words[:end][::-1])
    return score, end - length if back == score else 0, end


_PAIR = np.uint64(0x8EBC6AF09C88C6E3)


def pairs(h: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the first word, hash) of word pairs at distances of one and of two words. text: the number of the text of each word."""
    out = []
    for apart in (1, 2):
        at = np.flatnonzero(text[apart:] == text[:-apart]) if len(h) > apart else np.empty(0, np.int64)
        out.append((at, mix(h[at] * _PAIR + h[at + apart])))
    return out


class Seeds:
    """A block's items and their seeds: distinct hashes, and for each the items and places that have it. An item of one word has that as its seed."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        item = np.repeat(np.arange(len(items)), [len(h) for _, h in items])
        words = np.concatenate([h for _, h in items])
        starts = np.cumsum([0] + [len(h) for _, h in items])
        found = pairs(words, item)
        alone = starts[:-1][np.diff(starts) == 1]
        self.singles = bool(len(alone))
        at, key = np.concatenate([alone, *[a for a, _ in found]]), np.concatenate([words[alone], *[k for _, k in found]])
        distinct, seed = np.unique(key, return_inverse=True)
        order = np.lexsort((at, seed))
        self._set(distinct, seed[order], item[at[order]], (at - starts[item[at]])[order])
        self.least = np.zeros(len(items), np.int64)

    def _set(self, distinct: np.ndarray, seed: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.keys, self.seed, self.item, self.place = Keys(distinct), seed, item, place
        self.first = np.searchsorted(seed, np.arange(len(distinct) + 1))

    def rare(self, n: np.ndarray, cover: float) -> "Seeds":
        """The same with the rarer half of each item's seeds. n: how often each seed stands in the corpus."""
        own, entry = np.unique(self.item * np.int64(len(n)) + self.seed, return_inverse=True)
        item, seed = own // len(n), own % len(n)
        place = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(place, entry, self.place)
        order = np.lexsort((place, n[seed], item))
        size = np.bincount(item, minlength=len(self.items))
        rank = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        half = (size + 1) // 2
        keep = np.zeros(len(own), bool)
        keep[order] = rank < half[item[order]]
        keep = keep[entry]
        used, seed = np.unique(self.seed[keep], return_inverse=True)
        out = object.__new__(Seeds)
        out.items, out.singles = self.items, self.singles
        out._set(self.keys.keys[used], seed, self.item[keep], self.place[keep])
        out.least = np.maximum(1, np.ceil(cover * half)).astype(np.int64)
        return out

    def hits(self, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, seed) of all seeds in texts, given their words' hashes and numbers."""
        looked = [(np.arange(len(h)), h)] if self.singles else []
        at, seed = [], []
        for place, key in [*looked, *pairs(h, text)]:
            has, to = self.keys.find(key)
            at.append(place[has])
            seed.append(to)
        return np.concatenate(at), np.concatenate(seed)


def _laid_out(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a batch, the number of the text of each, and the place of each text's first word."""
    h, n = hashed_words([plain(t) for t in texts_of(b, "text")])
    return h, np.repeat(np.arange(len(n)), n), np.cumsum(n) - n


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = held.value
        total = np.zeros(len(seeds.first) - 1, np.int64)
        for b in slices(batches):
            h, text, _ = _laid_out(b)
            total += np.bincount(seeds.hits(h, text)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["at", "n"])

    return run


def _stretches(diagonal: np.ndarray, length: int, text: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, which seeds) of parts of a text that may hold an item of that length, by its seeds' diagonals; overlapping parts are one."""
    order = np.argsort(diagonal, kind="stable")
    lo, hi = np.maximum(diagonal[order] - length, 0), np.minimum(diagonal[order] + 2 * length, text)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    for a, z in zip(new, np.append(new[1:], len(order))):
        yield int(lo[a]), int(hi[z - 1]), order[a:z]


def _score(held, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = held.value
        for b in slices(batches):
            h, text, begin = _laid_out(b)
            at, seed = seeds.hits(h, text)
            times = seeds.first[seed + 1] - seeds.first[seed]
            entry = np.repeat(seeds.first[seed] - np.cumsum(times) + times, times) + np.arange(times.sum())
            at, seed = np.repeat(at, times), np.repeat(seed, times)
            pair = text[at] * np.int64(len(seeds.items)) + seeds.item[entry]
            order = np.lexsort((seed, pair))
            at, seed, entry, pair = at[order], seed[order], entry[order], pair[order]
            distinct = np.concatenate(([True], (pair[1:] != pair[:-1]) | (seed[1:] != seed[:-1])))[: len(pair)]
            cut = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
            has = np.add.reduceat(distinct.astype(np.int64), cut) if len(cut) else cut
            cut = np.append(cut, len(pair))
            ids, out = b.column("doc_id").to_pylist(), []
            for k in np.flatnonzero(has >= seeds.least[pair[cut[:-1]] % len(seeds.items)]):
                mine = slice(cut[k], cut[k + 1])
                doc, number = divmod(int(pair[cut[k]]), len(seeds.items))
                ref, item = seeds.items[number]
                words = h[begin[doc] : begin[doc + 1] if doc + 1 < len(begin) else len(h)]
                best = (0, 0, 0)
                for lo, hi, which in _stretches(at[mine] - begin[doc] - seeds.place[entry[mine]], len(item), len(words)):
                    if len(np.unique(seed[mine][which])) >= seeds.least[number]:
                        s, x, y = align(item, words[lo:hi])
                        if s > best[0]:
                            best = s, lo + x, lo + y
                score = best[0] / (MATCH * len(item))
                if score >= least_score:
                    out.append((ids[doc], ref, score, best[1], best[2]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their word hashes, in blocks; an iterator that holds one partition of items at a time."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        h = hashed_words([plain(r["text"].encode())])[0]
        if block and size + len(h) > most:
            yield block
            block, size = [], 0
        if len(h):
            block.append((r["item_id"], h))
            size += len(h)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, least_score: float = LEAST_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of docs(doc_id, text) and benchmark(item_id, text): doc_id, item_id, score, start_word, end_word.

    score is the best Smith-Waterman score (words; match 2, mismatch and gap -1) over twice the item's length in words, from
    least_score to 1; the words from start_word to end_word (exclusive) of the text, in words without punctuation,
    are the aligned passage. Whole texts of any length are searched. Null or empty texts and items, and items with a null id, match
    nothing. An item of one word is its own seed. Repeated rows give repeated results;
    an item id with several texts gives a row for each that matches. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = None
    for block in _blocks(benchmark, block_words):
        seeds = Seeds(block)
        held = spark.sparkContext.broadcast(seeds)
        got = docs.select("text").mapInArrow(_count(held), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        held.destroy()
        n = np.zeros(len(seeds.first) - 1, np.int64)
        n[got.column("at").to_numpy()] = got.column("n").to_numpy()
        rare = spark.sparkContext.broadcast(seeds.rare(n, cover))
        part = docs.mapInArrow(_score(rare, least_score), "doc_id long, item_id long, score double, start_word long, end_word long")
        part = materialise(part, "passages")
        rare.destroy()  # one block's seeds are held at a time, however many blocks there are
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which contaminated() finds an item; rows with a null id stay."""
    name = fresh(docs, "leaked")
    bad = materialise(contaminated(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "leaked")
    return docs.join(small(bad), F.col("doc_id") == F.col(name), "left_anti")

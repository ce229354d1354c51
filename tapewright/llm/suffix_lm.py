"""A probabilistic suffix tree over words as language model, and an add-one unigram base to hold it against.

Symbols are words (A-Z lower-cased) and one end. A context is a run of up to `depth` words; the state of a place is the longest retained
suffix of the words before it in its text. With n(c) the times a context was followed by a symbol and n(c, x) by x, its distribution keeps
the symbols it tells about and leaves the rest to its longest retained suffix:

    P(x | c) = (n(c, x) - 1) / n(c) [x kept] + b(c) * P(x | suffix),   b(c) = 1 - sum over kept x of (n(c, x) - 1) / n(c)

Taking one from each count is the discount for what was seen once; the root is the add-one unigram distribution. Two divergence tests decide,
at any size of the corpus alike: a symbol is kept where n(c, x) * ln(n(c, x) / n(c) / P(x | suffix)) reaches `least_symbol_gain` nats, and
a context where n(c) times the divergence that its distribution explains, sum n(c, x) * ln(P(x | c) / P(x | suffix)), reaches `least_gain`.
Contexts and kept symbols other than the end occur at least `least_count` times. There is no bound on their number: it grows with the corpus.

Since P(x | c) is P(x | suffix) times b(c) times, for kept symbols, one more factor, a text's log10 probability is its base score plus
the logarithms of the factors of the retained contexts and kept symbols that it meets. Counting goes level by level: tasks count
their own grams, hand them on in blocks dealt by the gram's hash, and the blocks of a bucket are merged. Contexts and symbols travel
as places in tables of the frequent ones while those have at most CACHE rows, else as 64-bit keys. Factors are looked up in a
broadcast of at most SCORE_CACHE rows, or of the most frequent ones if there are more; of the rest a table of bits tells which can be
there at all, and those alone are found by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Keys, bit_table, hashed_words, materialise, may_hold, mix, slices, small, small_batches, texts_of

DEPTH = 2
LEAST_COUNT = 16
LEAST_GAIN = 16.0
LEAST_SYMBOL_GAIN = 16.0
#: The symbol after the last word.
END = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a table that may be broadcast for look-ups.
CACHE = 5_000_000
#: Rows of a table that scoring holds in each task, the most frequent ones; others are found by a join.
SCORE_CACHE = 5_000_000
#: Words, and places with their contexts, that a task holds before it hands their counts on; places in all that a bucket gets about.
WORDS_HELD, HELD, BUCKET = 6_000_000, 3_000_000, 1_500_000
#: Ranges of buckets in which a task sorts what it holds and hands it on, so that only one is copied at a time.
RANGES = 16
#: Texts laid out at a time.
SLICE = 100
_NEXT, _CONTEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def extended(context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Key of a context with one more word at its end."""
    return mix(context * _NEXT + x)


def laid_out(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the texts one after the other, each symbol's place in its text, and the ends' places."""
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts + 1) - 1
    w = np.empty(len(words) + len(texts), np.uint64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = words, END
    return w, np.arange(len(w)) - np.repeat(ends - counts, counts + 1), ends


def contexts(w: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: the places that have so many words before them, and the context's key at each place."""
    key = None
    for d in range(1, depth + 1):
        before = np.zeros(len(w), np.uint64)
        if d == 1:
            before[1:] = w[:-1]
        else:
            before[1:] = extended(key[:-1], w[:-1])
        key = before
        yield np.flatnonzero(place >= d), key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): how often each symbol stands in what a task has held."""

    def counted() -> pa.RecordBatch:
        keys = np.concatenate(held) if held else np.empty(0, np.uint64)
        held.clear()
        keys.sort()
        at = _firsts(keys)
        return pa.RecordBatch.from_arrays([_signed(keys[at]), pa.array(np.diff(np.append(at, len(keys))))], ["key", "n"])

    held, size = [], 0
    for b in slices(batches, SLICE):
        held.append(laid_out(texts_of(b, "text"))[0])
        size += len(held[-1])
        if size > WORDS_HELD:
            yield counted()
            size = 0
    yield counted()


def _columns(d: int) -> list[str]:
    """The shorter contexts, the context and the next symbol."""
    return [*[f"p{j}" for j in range(1, d)], "s", "x"]


def _placed(d: int, tables: list[np.ndarray | None]) -> list[bool]:
    """Which columns of level d travel as places."""
    return [tables[k - 1] is not None for k in (*range(1, d + 1), 1)]


def _blocks(d: int, buckets: int, tables):
    """(bucket, columns of grams of level d, n) of what a task has held. tables: the sorted alphabet and contexts of 2, 3, ... words; None where they can't be sent."""
    names = _columns(d)

    def counted(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Empties parts, which hold the columns and last the grams; sorts, and hands on, a range of buckets at a time."""
        cols = []
        for _ in range(len(names) + 1):
            cols.append(np.concatenate([p[0] for p in parts]))
            for p in parts:
                del p[0]
        parts.clear()
        gram = cols.pop()
        bucket = (gram % np.uint64(buckets)).astype(np.int32)
        step = -(-buckets // RANGES)
        for low in range(0, buckets, step):
            at = np.flatnonzero((bucket >= low) & (bucket < low + step))
            if not len(at):
                continue
            keys = gram[at]
            order = np.argsort(keys)
            at, first = at[order], _firsts(keys[order])
            n = np.diff(np.append(first, len(at))).astype(np.int32)
            at = at[first]
            order = np.lexsort((cols[-2][at], bucket[at]))  # equal contexts side by side take less room
            at, n = at[order], n[order]
            cut = _firsts(bucket[at])
            offsets = pa.array(np.append(cut, len(at)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[at] if c.dtype == np.int32 else c[at].view(np.int64))) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[cut]]), *lists, pa.ListArray.from_arrays(offsets, pa.array(n))], ["bucket", *names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [None if t is None else Keys(t, ordered=True) for t in tables.value]
        parts, size = [], 0
        for b in slices(batches, SLICE):
            w, place, _ = laid_out(texts_of(b, "text"))
            keys = [key for _, key in contexts(w, place, d)]
            at, cols = np.flatnonzero(place >= d), []
            for col, known in [(w, sets[0]), *zip(keys[::-1], sets[d - 1 :: -1])]:  # the symbol, the context, its suffixes
                if known is None:
                    cols.append(col[at])
                else:
                    has, to = known.find(col[at])
                    at, cols = at[has], [c[has] for c in cols] + [to.astype(np.int32)]
            gram = extended(keys[-1][at], w[at])
            parts.append([*cols[::-1][:-2], cols[1], cols[0], gram])
            size += len(at)
            if size > HELD:
                yield from counted(parts)
                size = 0
        if size:
            yield from counted(parts)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def _merged(d: int, tables, factors):
    """The grams of a bucket that were seen twice or more, by their keys. With factors, a broadcast of suffix_factors(), the sum of the suffixes' own comes in their place."""
    names, found = _columns(d), []

    def run(table: pa.Table) -> pa.Table:
        flat = {c: np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in table.column(c).chunks]) for c in [*names, "n"]}
        gram = extended(*[flat[c].astype(np.int64).view(np.uint64) for c in ("s", "x")])
        order = np.argsort(gram)
        at = _firsts(gram[order])
        n = np.add.reduceat(flat["n"][order].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        twice = order[at[n > 1]]
        level = dict(zip(names, [*range(1, d), d, 1]))
        cols = {c: flat[c][twice] if tables.value[k - 1] is None else tables.value[k - 1][flat[c][twice]].view(np.int64) for c, k in level.items()}
        cols["n"] = n[n > 1]
        if factors is not None:
            if not found:
                found.append(Keys(*factors.value, ordered=True))  # once a task
            cols["lift"], x = np.zeros(len(twice)), cols["x"].view(np.uint64)
            for p in (cols.pop(f"p{j}").view(np.uint64) for j in range(1, d)):
                for key in (p ^ _CONTEXT, extended(p, x)):
                    has, to = found[0].find(key)
                    cols["lift"][has] += found[0].values[to]
        return pa.table(cols)

    return run


def sent(keys: DataFrame) -> np.ndarray | None:
    """The sorted keys s of a materialised table of at most CACHE rows, else None."""
    return np.sort(keys.select("s").toArrow().column(0).to_numpy().view(np.uint64)) if keys.count() <= CACHE else None


def grams_of(train: DataFrame, d: int, held, factors, tokens: int) -> DataFrame:
    """Grams of level d that occur twice or more: the context s, the symbol x, n and lift, the sum of the suffixes' factors; without factors, the suffixes p1, p2, ... instead.

    held, factors: broadcasts of the tables and of suffix_factors(). They are looked up where a bucket is merged, not by a step behind it: each Python step of
    a stage takes a worker of its own, and workers keep what they have grown to.
    """
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = ", ".join(f"{c} array<{'int' if placed else 'long'}>" for c, placed in zip(_columns(d), _placed(d, held.value)))
    blocks = train.select("text").mapInArrow(_blocks(d, max(parts, tokens // BUCKET), held), f"bucket int, {lists}, n array<int>")
    shape = ", ".join(f"{c} long" for c in _columns(d)) + ", n long" if factors is None else "s long, x long, n long, lift double"
    return blocks.groupBy("bucket").applyInArrow(_merged(d, held, factors), shape)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s, x = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("s", "x"))
        yield pa.RecordBatch.from_arrays([_signed(extended(s, x)), b.column("n")], ["s", "n_s"])


def suffix_factors(levels: list[tuple[DataFrame, DataFrame]]) -> tuple[np.ndarray, np.ndarray] | None:
    """looked_up() natural logarithms of the factors of levels: (retained contexts, kept symbols) of 1, 2, ... words. None without levels, and beyond CACHE rows."""
    if not levels or sum(c.count() + x.count() for c, x in levels) > CACHE:
        return None
    rows = None
    for kept_contexts, kept_symbols in levels:
        part = kept_contexts.select("s", F.lit(0).cast("long").alias("x"), F.col("log_b").alias("value")).unionByName(kept_symbols.select("s", "x", F.col("more").alias("value")))
        rows = part if rows is None else rows.unionByName(part)
    return looked_up(rows.mapInArrow(_keyed, "key long, value double"))


def with_suffix(at: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(s, x, n, n_s, par) of grams_of() with n_s and root: par is ln P(x | longest retained suffix). levels: as in suffix_factors(); joined where there is no lift."""
    par = F.col("root")
    if "lift" in at.columns:
        par = par + F.col("lift")
    else:
        for j, (kept_contexts, kept_symbols) in enumerate(levels, 1):
            at = at.join(small(kept_contexts.select(F.col("s").alias(f"p{j}"), F.col("log_b").alias(f"b{j}"))), f"p{j}", "left")
            at = at.join(small(kept_symbols.select(F.col("s").alias(f"p{j}"), "x", F.col("more").alias(f"m{j}"))), [f"p{j}", "x"], "left")
            par = par + F.coalesce(f"b{j}", F.lit(0.0)) + F.coalesce(f"m{j}", F.lit(0.0))
    return at.select("s", "x", "n", "n_s", par.alias("par"))


def fit_tree(train: DataFrame, words: DataFrame, tokens: int, kinds: int, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN, least_symbol_gain: float = LEAST_SYMBOL_GAIN) -> DataFrame:
    """The tree over train(text) as rows (s, x, value, n): log10 b(c) of retained contexts (x = 0) and the factors of their kept symbols.

    words(key, n), tokens and kinds: the counts of all symbols, of which the root is made. Without training rows, there are no rows.
    """
    last, share = int(END.view(np.int64)), train.sparkSession.sparkContext.broadcast
    alphabet = materialise(words.where((F.col("key") == last) | (F.col("n") >= least_count)).select(F.col("key").alias("s"), F.col("n").alias("n_s")), "alphabet")
    root = alphabet.select(F.col("s").alias("x"), F.log((F.col("n_s") + 1) / F.lit(float(tokens + kinds + 1))).alias("root"))
    context, tables = alphabet, [sent(alphabet)]
    levels: list[tuple[DataFrame, DataFrame]] = []
    for d in range(1, depth + 1):
        held, factors = share(tables), suffix_factors(levels)
        factors = None if factors is None else share(factors)
        grams = grams_of(train, d, held, factors, tokens)
        at = with_suffix(grams.join(small(context), "s").join(small(root), "x"), levels)
        tells = F.col("n") * (F.log(F.col("n") / F.col("n_s")) - F.col("par")) >= least_symbol_gain
        grams = materialise(at.where(tells | (F.col("n") >= least_count) if d < depth else tells), f"grams-{d}")  # what symbols and longer contexts come from
        for b in (held, factors):
            if b is not None:
                b.destroy()
        told = grams.where(tells)
        sums = materialise(told.groupBy("s").agg(F.sum(F.col("n") - 1).alias("mass")), f"sums-{d}")
        both = told.join(small(sums), "s").withColumn("log_b", F.log(1 - F.col("mass") / F.col("n_s")))
        both = both.withColumn("more", F.log1p((F.col("n") - 1) / F.col("n_s") * F.exp(-F.col("par") - F.col("log_b"))))
        gain = both.groupBy("s").agg(F.first("n_s").alias("n_s"), F.first("log_b").alias("log_b"), (F.sum(F.col("n") * F.col("more")) + F.first("n_s") * F.first("log_b")).alias("gain"))
        kept_contexts = materialise(gain.where(F.col("gain") >= least_gain).select("s", "log_b", F.col("n_s").alias("n")), f"retained-{d}")
        kept_symbols = materialise(both.join(small(kept_contexts.select("s")), "s", "left_semi").select("s", "x", "more", "n"), f"symbols-{d}")
        levels.append((kept_contexts, kept_symbols))
        if d == depth:
            break
        context = grams.where((F.col("n") >= least_count) & (F.col("x") != last)).select("s", "x", "n").mapInArrow(_longer, "s long, n_s long")
        context = materialise(context, f"contexts-{d + 1}")
        tables.append(sent(context))
    tree = None
    for kept_contexts, kept_symbols in levels:
        part = kept_contexts.select("s", F.lit(0).cast("long").alias("x"), (F.col("log_b") / math.log(10)).alias("value"), "n")
        part = part.unionByName(kept_symbols.select("s", "x", (F.col("more") / math.log(10)).alias("value"), "n"))
        tree = part if tree is None else tree.unionByName(part)
    return tree


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, x, value) of the tree by the key of the context or of the gram."""
    for b in batches:
        s, x = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("s", "x"))
        yield pa.RecordBatch.from_arrays([_signed(np.where(x == 0, s ^ _CONTEXT, extended(s, x))), b.column("value")], ["key", "value"])


def frequent(rows: DataFrame, tokens: int) -> tuple[DataFrame, bool]:
    """Of materialised rows(..., n) at most SCORE_CACHE for each level of n, and whether these are all: otherwise those that make up 1 / SCORE_CACHE of the tokens each."""
    if rows.count() <= SCORE_CACHE:
        return rows, True
    return rows.where(F.col("n") * F.lit(SCORE_CACHE) >= F.lit(int(tokens))), False


def looked_up(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) columns of a bounded table in the order of the keys, to be broadcast: workers use them as they are."""
    got = keyed.toArrow()
    keys, values = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    del got
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys)
    return keys[order], values[order]


class Scorer:
    """Look-ups of words and of the tree's factors.

    Of a table that isn't held whole there is a bit_table() of all its keys: what is neither held nor among those bits is absent, and known to be; what is
    among them is given back as missing. Contexts that aren't retained, most of all, are so settled where they stand.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray], word_bits: np.ndarray | None, factors: tuple[np.ndarray, np.ndarray], factor_bits: np.ndarray | None, unknown: float, depth: int):
        self.words, self.factors = Keys(*words, ordered=True), Keys(*factors, ordered=True)
        self.word_bits, self.factor_bits, self.unknown, self.depth = word_bits, factor_bits, unknown, depth

    def _factors(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, has = np.zeros(len(keys)), np.zeros(len(keys), bool)
        at, to = self.factors.find(keys)
        value[at], has[at] = self.factors.values[to], True
        return value, has

    def score(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, known, base, more) of each text, and the missing (number of the text, s, x)."""
        w, place, ends = laid_out(texts)
        begins = ends - np.diff(ends, prepend=-1) + 1
        rows = np.repeat(np.arange(len(texts)), ends - begins + 1)
        base, known = np.full(len(w), self.unknown), np.zeros(len(w), np.int64)
        at, to = self.words.find(w)
        base[at], known[at] = self.words.values[to], 1
        lost: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.word_bits is not None:
            rare = np.flatnonzero(known == 0)
            rare = rare[may_hold(self.word_bits, w[rare])]
            base[rare] = 0
            lost.append((rows[rare], np.zeros(len(rare), np.uint64), w[rare]))
        more = np.zeros(len(w))
        for at, key in contexts(w, place, self.depth):
            value, retained = self._factors(key[at] ^ _CONTEXT)
            more[at] += value
            if self.factor_bits is not None:
                open_ = ~retained & may_hold(self.factor_bits, key[at] ^ _CONTEXT)
                lost.append((rows[at[open_]], key[at[open_]], np.zeros(int(open_.sum()), np.uint64)))
                retained |= open_
            at = at[retained]
            gram = extended(key[at], w[at])
            value, has = self._factors(gram)
            more[at] += value
            if self.factor_bits is not None:
                open_ = ~has & may_hold(self.factor_bits, gram)
                lost.append((rows[at[open_]], key[at[open_]], w[at[open_]]))
        missing = tuple(np.concatenate(x) for x in zip(*lost)) if lost else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        sums = [np.add.reduceat(x, begins) if len(begins) else x[:0] for x in (known, base, more)]
        return [ends - begins + 1, *sums], missing


def score_texts(docs: DataFrame, train_rows: Column, depth: int = DEPTH, **tests) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train_rows: which rows to learn from; null counts as false; held_out is its opposite. Tokens are the words between ASCII white space, A-Z
    lower-cased, and one end. base_score is the add-one unigram log10 probability, score the tree's (tests: see fit_tree()); both take what
    wasn't learnt for one unknown word. Null and empty texts are the end alone. Texts of any length are scored whole. Without training rows,
    counts are 0 and both scores 0. Repeated rows each come out. Other columns are ignored. Empty input gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _scored(docs, train_rows, depth, **tests)


def _scored(docs: DataFrame, train_rows: Column, depth: int, **tests) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", F.coalesce(train_rows, F.lit(False)).alias("learn"))
    words = materialise(d.where("learn").select("text").mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, kinds = (int(v) for v in words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    bottom = float(tokens + kinds + 1)
    tree = materialise(fit_tree(d.where("learn"), words, tokens, kinds, depth, **tests), "tree")
    unknown = -math.log10(bottom)
    known, all_words = frequent(words, tokens)
    factors, all_factors = frequent(tree, tokens)
    share = spark.sparkContext.broadcast
    held_words = share(looked_up(known.select("key", F.log10((F.col("n") + 1) / F.lit(bottom)))))
    held_factors = share(looked_up(factors.select("s", "x", F.col("value").cast("float")).mapInArrow(_keyed, "key long, value float")))
    word_bits = share(None if all_words else bit_table(words.select(F.col("key").alias("h"))))
    factor_bits = share(None if all_factors else bit_table(tree.select("s", "x", "value").mapInArrow(_keyed, "key long, value double").select(F.col("key").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held_words.value, word_bits.value, held_factors.value, factor_bits.value, unknown, depth)
        for b in slices(batches, SLICE):
            (n, known, base, more), (row, s, x) = scorer.score(texts_of(b, "text"))
            ids = b.column("row_key").to_numpy()
            order = np.lexsort((x, s, row))
            row, s, x = row[order], s[order], x[order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1])))) if len(row) else row
            times = np.diff(np.append(new, len(row)))
            k, none = b.num_rows, lambda kind: pa.nulls(len(new), kind)
            columns = [
                pa.concat_arrays([pa.array(ids), pa.array(ids[row[new]])]), pa.concat_arrays([b.column("doc_id"), none(pa.int64())]), pa.concat_arrays([b.column("learn"), none(pa.bool_())]),
                pa.concat_arrays([pa.array(n, pa.int64()), none(pa.int64())]), pa.concat_arrays([pa.array(known, pa.int64()), none(pa.int64())]), pa.concat_arrays([pa.array(base), none(pa.float64())]), pa.concat_arrays([pa.array(more), none(pa.float64())]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), _signed(s[new])]), pa.concat_arrays([pa.nulls(k, pa.int64()), _signed(x[new])]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(times, pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "learn", "n_tokens", "known", "base", "more", "s", "x", "times"])

    # Rows are told apart by a number; texts and what they miss are written in one pass, so the numbers agree.
    d = d.withColumn("row_key", F.monotonically_increasing_id())
    scored = d.mapInArrow(run, "row_key long, doc_id long, learn boolean, n_tokens long, known long, base double, more double, s long, x long, times long")
    result = ["doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("more")).alias("score")]
    every = all_words and all_factors
    scored = materialise(scored.select(*result) if every else scored, "scores")
    for b in (held_words, held_factors, word_bits, factor_bits):
        b.destroy()
    if every:
        return scored
    heads, rare = scored.where("times is null"), scored.where("times is not null").select("row_key", "s", "x", "times")
    table = words.select(F.lit(0).cast("long").alias("s"), F.col("key").alias("x"), F.log10((F.col("n") + 1) / F.lit(bottom)).alias("value")).unionByName(tree.select("s", "x", "value"))
    looked = rare.join(table, ["s", "x"], "left")
    word = F.col("s") == 0
    parts = looked.groupBy("row_key").agg(
        F.sum(F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.when(word, F.col("times") * F.coalesce("value", F.lit(unknown))).otherwise(0.0)).alias("r_base"),
        F.sum(F.when(~word, F.col("times") * F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("r_more"),
    )
    whole = heads.join(parts, "row_key", "left")
    part = lambda c: F.coalesce(f"r_{c}", F.lit(0.0))
    whole = whole.select("doc_id", "learn", "n_tokens", (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("known"), (F.col("base") + part("base")).alias("base"), (F.col("more") + part("more")).alias("more"))
    return whole.select(*result)

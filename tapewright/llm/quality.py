"""Supervised subword embeddings for document quality, trained by numpy stochastic gradient descent.

Features of a text are hashed into a fixed table: its words, its word pairs, its character n-grams, and two repetition marks
(a word equal to the one before it; a word pair seen earlier in the text). Each feature has a learned vector; a document
is the average of its features' vectors and a softmax over that average gives the class. Training takes a bounded
sample of labelled rows, the same number of each class at most, and the class shares of all labelled rows then set the bias. Executors
turn the sample's texts into features and one task trains on them; the driver receives the weights alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mix, slices, texts_of

BUCKETS = 1 << 17
DIM = 8
CHAR_GRAMS = (3, 4)
#: Labelled rows of each class that training takes at most, in the order of a hash of the id.
SAMPLE_PER_CLASS = 2000
EPOCHS = 6
RATE = 0.5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.cumprod(np.full(4096, np.uint64(0x100000001B3)), dtype=np.uint64)
_GRAM, _PAIR = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
#: Documents are hashed in pieces of this many bytes, one text or several, so memory doesn't follow the batch or the text.
PIECE = 1_000_000
_LAST_WORD, _SEEN_PAIR = np.uint64(11), np.uint64(13)


def _buckets(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind << 56)) % np.uint64(BUCKETS)).astype(np.int32)


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _gram_hashes(wide: np.ndarray, n: int) -> np.ndarray:
    g = np.zeros(max(0, len(wide) - n + 1), np.uint64)
    for k in range(n):
        g = g * _GRAM + wide[k : len(wide) - n + 1 + k]
    return g


def _gaps(codes: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(codes, 255)] & (codes < 255)


def _words(wide: np.ndarray, space: np.ndarray, opened: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum over letters, length, first place) of each run between gaps; the first run, if it begins at 0, goes on from a word of `opened` letters."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    first, after = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first, first
    at = np.arange(len(wide)) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(wide)]))))
    if opened and first[0] == 0:
        at[: after[0]] += opened
    weighted = np.where(space, np.uint64(0), (wide + np.uint64(1)) * _POWERS[np.minimum(at, len(_POWERS) - 1)])
    return np.add.reduceat(weighted, first), after - first, first


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document number) of every feature of the texts, taken together: for texts of some PIECE bytes in all."""
    parts = [_codes(t + b"\n") for t in texts]
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    ends = np.cumsum([len(c) for c in parts])
    doc_at = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in parts])
    hashed, docs = [], []

    def put(h: np.ndarray, doc: np.ndarray, kind: int) -> None:
        hashed.append(_buckets(h, kind))
        docs.append(doc)

    wide = codes.astype(np.uint64)
    for n in CHAR_GRAMS:
        g = _gram_hashes(wide, n)
        if len(g):
            ok = n - 1 < ends[doc_at[: len(g)]] - np.arange(len(g))  # a line feed ends each text
            put(g[ok], doc_at[: len(g)][ok], n)
    w, length, first = _words(wide, _gaps(codes))
    if len(first):
        w, d = w + length.astype(np.uint64), doc_at[first]
        put(w, d, 1)
        same = d[1:] == d[:-1]
        pair = (w[:-1] * _PAIR + w[1:])[same]
        put(pair, d[1:][same], 2)
        again = d[1:][same & (w[1:] == w[:-1])]
        put(np.full(len(again), _LAST_WORD), again, 7)
        key = mix(pair) ^ mix(d[1:][same].astype(np.uint64) + np.uint64(1))
        _, once = np.unique(key, return_index=True)
        seen = np.ones(len(key), bool)
        seen[once] = False
        put(np.full(int(seen.sum()), _SEEN_PAIR), d[1:][same][seen], 7)
    return np.concatenate(hashed) if hashed else np.empty(0, np.int32), np.concatenate(docs) if docs else np.empty(0, np.int32)


def long_counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the features() of one text, taken in pieces: the letters before a cut, the word that it parts, the last word
    and the pairs seen go on to the next piece."""
    counts = np.zeros(BUCKETS, np.int64)
    tail, known = np.empty(0, np.uint64), np.empty(0, np.uint64)
    part, letters, last, at = np.uint64(0), 0, None, 0

    def put(h: np.ndarray, kind: int) -> None:
        np.add.at(counts, _buckets(h, kind), 1)

    while at <= len(text):
        to = at + PIECE
        while at < to < len(text) and text[to] & 0xC0 == 0x80:  # not within a letter
            to -= 1
        final = to >= len(text)
        codes = _codes(text[at:to] + (b"\n" if final else b""))
        wide = np.concatenate((tail, codes.astype(np.uint64)))
        for n in CHAR_GRAMS:
            put(_gram_hashes(wide, n)[max(0, len(tail) - n + 1) :], n)
        space = _gaps(codes)
        w, length, first = _words(wide[len(tail) :], space, letters)
        length = length.astype(np.uint64)
        tail = wide[max(0, len(wide) - max(CHAR_GRAMS) + 1) :]
        if letters and (not len(first) or first[0]):  # the word before the cut has ended there
            w, length = np.concatenate(([part], w)), np.concatenate(([np.uint64(letters)], length))
        elif letters:
            w[0] += part
            length[0] += np.uint64(letters)
        part, letters = np.uint64(0), 0
        if len(codes) and not space[-1] and len(w):
            part, letters = w[-1], int(length[-1])
            w, length = w[:-1], length[:-1]
        w = w + length
        put(w, 1)
        run = w if last is None else np.concatenate(([last], w))
        if len(run) > 1:
            pair = run[:-1] * _PAIR + run[1:]
            put(pair, 2)
            new, once = np.unique(pair, return_index=True)
            old = np.ones(len(pair), bool)
            old[once] = False
            if len(known):
                at_known = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                old |= known[at_known] == pair
            put(np.full(int(old.sum()), _SEEN_PAIR), 7)
            put(np.full(int((run[1:] == run[:-1]).sum()), _LAST_WORD), 7)
            known = np.union1d(known, new)
        last = run[-1] if len(run) else None
        at = to
        if final:
            break
    return counts


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, their shares) of a text's features; at most BUCKETS however long the text."""
    if len(text) > PIECE:
        n = long_counts(text)
        idx = np.flatnonzero(n).astype(np.int32)
        n = n[idx]
    else:
        idx, n = np.unique(features([text])[0], return_counts=True)
    return idx, (n / max(1, n.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float, seed: int = 7, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weight of each bucket in the log-odds of class 1, bias). rows: shares() of texts; share: class 1 among all labelled rows.

    With two classes, softmax over (W0, W1) depends on W1 - W0 alone, so the learned vectors fold into one weight a bucket
    once training is over. Without rows of both classes, all weights are 0 and the bias gives the share.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    emb = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            idx, part = rows[i]
            v = emb[idx]
            hidden = part @ v
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            emb[idx] = v - (rate * len(idx) ** 0.5) * part[:, None] * back[None, :]
    had = y.mean()
    moved = np.log(share / (1 - share)) - np.log(had / (1 - had))
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + moved)


def scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1, text by text; an empty text has the bias alone."""
    z, at = np.full(len(texts), bias), 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PIECE):
            size += len(texts[upto])
            upto += 1
        if len(texts[at]) > PIECE:
            n = long_counts(texts[at])
            z[at] += n @ weights / max(1, n.sum())
            at += 1
            continue
        idx, doc = features(texts[at:upto])
        n = np.bincount(doc, minlength=upto - at)
        z[at:upto] += np.bincount(doc, weights[idx], minlength=upto - at) / np.maximum(n, 1)
        at = upto
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 50):
        rows = [shares(t or b"") for t in texts_of(b, "text")]
        idx, part = pa.array([x for x, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("quality", "first", "doc_id", "last")], idx, part], ["quality", "first", "doc_id", "last", "idx", "part"])


def _train(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for b in batches:
            for y, idx, part in zip(b.column("quality").to_pylist(), b.column("idx"), b.column("part")):
                rows.append((idx.values.to_numpy(), part.values.to_numpy()))
                labels.append(y)
        weights, bias = train(rows, labels, share)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows=None, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on docs(doc_id, text) labelled by labels(doc_id, quality): see train().

    train_rows: a condition on doc_id that training rows meet. per_class bounds the labelled ids of each class that the training task
    holds, and 4 * per_class its rows. Rows with a null id or a label other than 0 and 1 are left out; an id labelled twice counts once, with
    its smallest label; a null text is empty; texts of any length are read whole; of repeated rows each counts. Without labelled rows, all weights are 0.
    """
    lab = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    if train_rows is not None:
        lab = lab.where(train_rows)
    counts = {r[0]: r[1] for r in lab.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = lab.where("quality = 0").orderBy(*order).limit(per_class).union(lab.where("quality = 1").orderBy(*order).limit(per_class))
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    keys = [F.xxhash64("doc_id").alias("first"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("last")]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", *keys, "text")
    rows = rows.mapInArrow(_shares, "quality int, first long, doc_id long, last string, idx array<int>, part array<float>").orderBy("first", "doc_id", "last").limit(4 * per_class)
    got = rows.mapInArrow(_train(share), "weights binary, bias double").first()
    return train([], [], share) if got is None else (np.frombuffer(got["weights"], np.float32), got["bias"])


def with_quality(docs: DataFrame, model: tuple[np.ndarray, float], score: str) -> DataFrame:
    """docs with one more column `score`, the probability of class 1 by the text alone.

    Null and empty texts have the bias alone; texts of any length are scored whole, so texts that are equal tie, and repeated rows each
    come out. Columns of docs stay; `score` must be none of them. Empty input gives no rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for b in slices(batches):
            texts = [t or b"" for t in b.column(text_at).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(texts, weights, bias))], [*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, train_rows=None, least: float = 0.7) -> DataFrame:
    """docs whose score reaches `least` (a tie with it stays), with their columns as they were, whatever their names.

    Rows with a null or empty text are judged by the bias, rows with a null id by their text; texts of any length are read whole; of repeated
    rows all stay or none. Empty input gives no rows; without usable labels every row has one and the same score, the share of label 1 or 0.5.
    """
    score = fresh(docs, "quality_score")
    return with_quality(docs, fit_quality(docs, labels, train_rows), score).where(F.col(score) >= least).drop(score)

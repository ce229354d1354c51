"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that reveal them.

With document counts over the whole corpus of N documents, the information of an entity e is IC(e) = ln(N / n(e)), and a term t that stands
within WINDOW words of e tells PMI(e; t) = ln(N * n(e, t) / (n(e) * n(t))) of it. PMI / IC is the share of e's information that t
discloses: 1 for a term that never occurs without e. Every pair is scored, those seen in a single document too: what stands beside an address
seen once identifies it most. Terms that disclose at least GENERALISE_AT are generalised where they stand near e; from REMOVE_AT on
they are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WordHashes, materialise, slices, small, texts_of

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
WINDOW = 8
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Terms whose counts may be looked up through a broadcast; with more, all terms are counted and joined.
BROADCAST_TERMS = 2_000_000
#: Distinct terms a task holds before it hands its counts on.
TALLY = 1_000_000
#: Rounds in which documents are counted: up to which 64th of all.
ROUNDS = (0, 1, 8, 64)

_LOCAL = frozenset(UPPER + LOWER + "0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts where its digits start, so nothing is lost
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOW = str.maketrans(UPPER, LOWER)
_LOW_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def entity(kind: int, value: str) -> int:
    """Hash of an entity: letters lower-cased; of cards and phones, the digits."""
    value = "".join(_DIGIT.findall(value)) if kind > 1 else value.translate(_LOW)
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def terms_near(text: str, spans: list[tuple[int, int, int]], window: int, hashes: WordHashes) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end) of terms within `window` words of a span; words that touch any span are no terms."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    ends = np.array([b for _, b in words])
    first = [int(np.searchsorted(ends, a, side="right")) for _, a, _ in spans]  # words that touch a span: first to last
    last = [int(np.searchsorted(starts, b)) for _, _, b in spans]
    touched = np.zeros(len(words), bool)
    for a, b in zip(first, last):
        touched[a:b] = True
    out = set()
    for (kind, a, b), lo, hi in zip(spans, first, last):
        e = entity(kind, text[a:b])
        for k in (*range(max(0, lo - window), lo), *range(hi, min(len(words), hi + window))):
            if not touched[k]:
                x, y = words[k]
                w = text[x:y]
                left = len(w) - len(w.lstrip(_PUNCT))
                w = w.strip(_PUNCT)
                if w:
                    out.add((e, hashes[w.translate(_LOW).encode("utf-8", "surrogatepass")] - (1 << 63), x + left, x + left + len(w)))
    return sorted(out)


def _scan(window: int):
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("h"),
                    pa.array([[dict(kind=k, start=x, end=y) for k, x, y in s] for s in spans], shape),
                    pa.array([sorted({entity(k, t[x:y]) for k, x, y in s}) for t, s in zip(texts, spans)], pa.list_(pa.int64())),
                    pa.array([[dict(e=e, t=w, start=x, end=y) for e, w, x, y in terms_near(t, s, window, hashes)] for t, s in zip(texts, spans)], near),
                ],
                ["doc_id", "h", "base", "entities", "near"],
            )

    return run


def _term_counts(held):
    """Documents that have each term, by task; with `held`, of its terms only."""
    strip = _PUNCT.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = held.value if held is not None else None
        hashes, seen, size = WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["t", "n"])

        for b in slices(batches):
            for text in texts_of(b, "text"):
                if not text:
                    continue
                words = {w.strip(strip) for w in set(text.translate(_LOW_BYTES).split())}
                words.discard(b"")
                t = (hashes.of(list(words)) ^ np.uint64(1 << 63)).view(np.int64)
                if only is not None:
                    t = t[only[np.minimum(np.searchsorted(only, t), len(only) - 1)] == t] if len(only) else t[:0]
                seen.append(t)
                size += len(t)
                if size > TALLY:
                    yield out()
                    seen, size = [], 0
        yield out()

    return run


def counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n_t) of those terms(t, most) that at most `most` of docs(doc_id, text) have, n_t the documents in all.

    Documents are counted in rounds, each in exactly one. What has passed its bound by then needs no further count, so a frequent term isn't
    reported by every task again; the first rounds' documents are gathered, for fewer tasks to report.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1]))
    terms = materialise(terms.select("t", "most", F.lit(0).cast("long").alias("n_t")), "terms")
    for low, high in zip(ROUNDS, ROUNDS[1:]):
        share = docs.where((place >= low) & (place < high)).select("text")
        share = share if high == ROUNDS[-1] else share.hint("rebalance")
        held = None
        if terms.count() <= BROADCAST_TERMS:
            held = docs.sparkSession.sparkContext.broadcast(np.sort(terms.select("t").toArrow().column(0).to_numpy()))
        n = share.mapInArrow(_term_counts(held), "t long, n long").join(small(terms.select("t")), "t", "left_semi")
        both = terms.unionByName(n.select("t", F.lit(None).cast("double").alias("most"), F.col("n").alias("n_t")))
        both = both.groupBy("t").agg(F.max("most").alias("most"), F.sum("n_t").alias("n_t"))
        terms = materialise(both.where(F.col("n_t") <= F.col("most")), "terms")
        if held is not None:
            held.destroy()
    return terms.select("t", "n_t")


def disclosing(found: DataFrame, docs: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """(e, t, action) of terms that disclose an entity: action 4 generalises, 5 removes."""
    total = found.count()
    n_e = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    together = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["e"].alias("e"), x["t"].alias("t"))))).alias("p")).groupBy("p.e", "p.t").agg(F.count("*").alias("n_et"))
    near = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["t"]))).alias("t")).groupBy("t").agg(F.count("*").alias("n_near"))
    # A term has at least the documents in which it stands near an entity; when these alone bring its share below the threshold, it needs no count.
    most = F.col("n_et") * F.pow(F.lit(float(max(total, 1))) / F.col("n_e"), F.lit(1 - generalise_at)) * 1.000001
    n_et = materialise(together.join(n_e, "e").join(near, "t").where(F.col("n_near") <= most).select("e", "t", "n_et", "n_e"), "together")
    n_t = counted(docs, n_et.groupBy("t").agg(F.max(most).alias("most")))
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_e"))
    pmi = F.log(F.col("n_et") * F.lit(float(max(total, 1))) / (F.col("n_e") * F.col("n_t")))
    told = n_et.join(n_t, "t").where(ic > 0).withColumn("told", pmi / ic)
    return told.where(F.col("told") >= generalise_at).select("e", "t", F.when(F.col("told") >= remove_at, 5).otherwise(4).alias("action"))


def find_personal_data(docs: DataFrame, window: int = WINDOW, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, h (a hash of the text), spans array<struct<kind:string,start:int,end:int>>.

    Spans stand by kind as in KINDS, then start, in code points, the end exclusive. Base kinds are matches of their patterns that pass their checks;
    a failing match is dropped without another try inside it; kinds may overlap each other. Added spans are terms, never overlapping a base span;
    a term that several entities call for is removed if any removes it. Null and empty texts have no spans but count as documents.
    Repeated rows count as documents each and carry the same spans. Rows with a null doc_id come out as they are. Texts of any length are
    searched whole; a term that ties with a threshold reaches it. Other columns are ignored. Empty input gives no rows.
    """
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    scan = "doc_id long, h long, base array<struct<kind:int,start:int,end:int>>, entities array<long>, near array<struct<e:long,t:long,start:int,end:int>>"
    found = materialise(d.mapInArrow(_scan(window), scan), "entities")
    flagged = materialise(disclosing(found, docs, generalise_at, remove_at), "disclosing")
    near = found.where(F.size("near") > 0).select("doc_id", "h", F.explode("near").alias("x")).select("doc_id", "h", "x.*").distinct()
    hits = near.join(small(flagged), ["e", "t"]).groupBy("doc_id", "h", "start", "end").agg(F.max("action").alias("kind"))
    added = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    added = materialise(added.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "more"), "added")
    all_spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))))
    label = F.array(*[F.lit(k) for k in KINDS])
    out = found.join(small(added), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return out.select("doc_id", "h", F.transform(all_spans, lambda s: F.struct(F.get(label, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with its spans replaced: entities by their kind, generalised terms by their shape, removed terms by nothing."""

    def one(t: str | None, found) -> str | None:
        if t is None or found is None or not len(found):
            return t
        out, done = [], 0
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if s["start"] < done:
                continue
            body = t[s["start"] : s["end"]]
            tag = {"remove": "", "generalise": "[NUMBER]" if body.isdigit() else "[NAME]" if body[:1].isupper() else "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]")
            out += [t[done : s["start"]], tag]
            done = s["end"]
        return "".join([*out, t[done:]])

    @F.pandas_udf("string")
    def apply(ts: pd.Series, ss: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) for t, s in zip(ts, ss)], dtype=object)

    return apply(text, spans)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with `text` sanitised by find_personal_data(docs, **options); rows and other columns stay."""
    spans = find_personal_data(docs, **options).groupBy("doc_id", "h").agg(F.first("spans").alias("s")).select(F.col("doc_id").alias("pii_d"), F.col("h").alias("pii_h"), F.col("s").alias("pii_s"))
    both = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("pii_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("pii_h")), "left")
    return both.select(*[redacted(F.col("text"), F.col("pii_s")).alias("text") if c == "text" else F.col(c) for c in docs.columns])

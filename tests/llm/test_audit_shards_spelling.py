import os
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.llm import filter_audit, queries, spelling
from tapewright.llm.audit_sql import ORACLE
from tapewright.llm.filter_audit import audit, failures, membership, possible_repeats, with_failures, with_repeats
from tapewright.llm.sharding import jump, moving, numbered, shard_table, with_shard, write_shards
from tapewright.llm.spelling import count_words, letters, near_pairs, near_words, points, roots, run_counts, spelling_variants, touched

from .helpers import empty_docs, odd_docs, odd_rows, text_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = c.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# ---- shards


def plain_jump(key: int, shards: int) -> int:
    last, at = -1, 0
    while at < shards:
        last = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((last + 1) * (2**31 / ((key >> 33) + 1)))
    return last


def test_jump_moves_rows_into_new_shards_only():
    keys = np.random.default_rng(3).integers(0, 2**64, 20_000, dtype=np.uint64)
    before = jump(keys, 1)
    assert not before.any() and [plain_jump(int(k), 16) for k in keys[:300]] == list(jump(keys[:300], 16))
    for n in range(2, 40):
        now = jump(keys, n)
        moved = now != before
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        before = now
    assert np.bincount(jump(keys, 16)).min() > 1000 and len(jump(keys[:0], 16)) == 0


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark).withColumn("slot", F.lit("x"))
    rows = shard_table(docs, 16).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and {r.law for r in rows} == {"key"}
    assert shard_table(empty_docs(spark), 16).count() == 0
    with pytest.raises(ValueError):
        shard_table(docs, 0)


def test_numbers_have_no_gaps_when_one_row_is_a_third(spark):
    rows = spark.range(6000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("o"))
    got = numbered(rows, "g", ["o"]).orderBy("g", "slot").collect()
    for g in (None, 0, 1):
        part = [r for r in got if r.g == g]
        assert [r.slot for r in part] == list(range(2000)) and [r.o for r in part] == sorted(r.o for r in part)


def test_shards_are_written_and_grown(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    write_shards(docs, f"file://{tmp_path}/s", "doc_id", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(os.listdir(tmp_path / "s"))[-4:] == [f"shard={k}" for k in range(4)]
    assert back.count() == 3000 and back.join(with_shard(docs, "doc_id", 4), ["doc_id", "text", "shard"]).count() == 3000
    move = moving(docs, "doc_id", 4, 5).select("shard", "grown_shard").collect()
    assert 450 < len(move) < 750 and {r.grown_shard for r in move} == {4}
    with pytest.raises(ValueError):
        write_shards(back, f"file://{tmp_path}/t", "doc_id", 4)


# ---- filters


def plain_failures(t: str) -> int:
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    a, b = len(words) < 100, 100 * len(set(words)) < 80 * len(words)
    return a | b << 1 | (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) << 2 | any(c in t for c in "#$%&*|") << 3


def test_failures_equal_a_plain_version(monkeypatch):
    texts = ["", " \n", "ÄÖÜ é", "A b", "x|y", text_of(1, 120), text_of(2, 99) + " ", "word " * 300, " ".join("ab" * 3), text_of(4, 4000) + " Ünï #"] + [text_of(k, 90 + k) + "ABC" * k for k in range(30)]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        assert [failures(t.encode()) for t in texts] == [plain_failures(t) for t in texts]


def simulate(rows: list[tuple], good: set, toxic: set) -> dict:
    """rows of (id, text, part): the five filters applied one by one in every order."""
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    masks = [(p or "", plain_failures(t or "") | (i is not None and i > least[t or ""]) << 4, i) for i, t, p in rows]
    out = {}
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        gone = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                drop, keep = [m for m in left if m[1] & bit], [m for m in left if not m[1] & bit]
                gone[x] += len(drop)
                fails = sum(1 for m in here if m[1] & bit)
                out[part, "".join(order), step] = [len(keep), len(drop), fails - len(drop), sum(m[1] == bit for m in here), sum(m[2] in good for m in drop), sum(m[2] in toxic for m in drop)]
                left = keep
        for (p, order, step), v in out.items():
            if p == part:
                v.append(gone[order[step - 1]])
    return out


def test_audit_equals_a_simulation(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark, [(k, text_of(k % 7, 60 + 9 * (k % 7)) + ("#" if k % 5 == 0 else ""), "en" if k % 2 else "fr", None, None) for k in range(20, 80)]))
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 70, 2)] + [(21, 1, 1), (21, 0, 0), (None, 1, 1), (22, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    marked = [tuple(r) for r in labels.collect() if r.doc_id is not None]
    want = simulate(rows, {i for i, q, _ in marked if q == 1}, {i for i, _, t in marked if t == 1})
    got = audit(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert list(r)[3:] == want[r.part, r.filter_order, r.step], r
    assert audit(empty_docs(spark), labels).count() == 0 and audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_sketch_loses_no_repeat_and_clears_most_others(spark):
    keys = spark.range(40_000, numPartitions=5).select(F.xxhash64(F.when(F.col("id") < 13_000, F.lit(-1)).when(F.col("id") < 14_000, F.col("id") % 500).otherwise(F.col("id"))).alias("h"))
    many = {r.h for r in keys.groupBy("h").count().where("count > 1").collect()}
    for block in (1 << 17, 1000):
        maybe = {r.h for r in possible_repeats(keys, block).collect()}
        assert many <= maybe and len(maybe - many) < 0.02 * 26_000
    for most in (1 << 31, 1 << 10):
        has = membership(possible_repeats(keys), most)
        passed = {r.h for r in keys.where(has("h")).collect()}
        assert many <= passed and (most < 1 << 20 or len(passed - many) < 0.1 * 26_000)
    assert possible_repeats(keys.limit(0)).count() == 0


def test_repeats_are_held_by_their_whole_text(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: (F.length(c[0]) % 3).cast("long"))  # hashes that say next to nothing
    rows = spark.createDataFrame([(k, "p", "same" if k in (3, 7, 9) else f"t{k}") for k in range(12)] + [(None, "p", "same")], "doc_id long, part string, text string")
    got = {r.doc_id for r in with_repeats(rows, with_failures(rows)).where("mask >= 16").collect()}
    assert got == {7, 9}


# ---- spelling


def edits(w: str) -> set[str]:
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def plain_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return (a in edits(b)) if len(b) == len(a) + 1 else (b in edits(a)) if len(a) == len(b) + 1 else False


def some_words(n: int, seed: int = 1) -> list[str]:
    r = np.random.default_rng(seed)
    base = ["".join(r.choice(list("abcdeé"), r.integers(5, 9))) for _ in range(n)]
    return sorted(set(base) | {w[:2] + "z" + w[2:] for w in base[::3]} | {w[1:] + w[0] for w in base[::4]})


@pytest.mark.parametrize("cell", [8192, 60])
def test_near_words_equal_brute_force(spark, cell, monkeypatch):
    words = some_words(700)
    counts = {w: 1 + zlib.crc32(w.encode()) % 50 for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near_n, r.near) for r in near_words(frame, cell).collect()}
    for w in words:
        near = [x for x in words if plain_near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        assert got.get(w, (0, None, None)) == (len(near), counts.get(best), best), w
    monkeypatch.setattr(spelling, "SAMPLE", 40)  # most lengths and cells are not in the sample
    again = {r.word: (r.n_near, r.near_n, r.near) for r in near_words(frame, cell).collect()}
    assert again == got


def test_words_of_equal_letters_are_matched_by_masks(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", 4)
    every = sorted({"".join(p) for p in permutations("abcdeff")})[::3]
    more = sorted({w[:3] + "x" + w[4:] for w in every[::5]} | {w[:2] + "y" + w[2:] for w in every[::5]} | {w[1:] for w in every[::5]})
    for n in (6, 7, 8):
        asked = [w for w in every + more if len(w) == n]
        home = every
        got = sorted((asked[i], home[j]) for x, y in near_pairs(letters(home), letters(asked)) for i, j in zip(x, y))
        assert got == sorted((a, h) for a in asked for h in home if plain_near(a, h)) and (n == 7 or got)


def test_no_cell_within_reach_is_left_out():
    words = [w for w in some_words(900, 5) if len(w) == 8]
    p = points(letters(words))
    tree, cells = spelling._tree(p, 10, 0)
    home = np.empty(len(p), np.int64)
    for c, rows in touched(tree, p, 0):
        home[rows] = c
    for radius in (1, 2):
        sent = {(int(k), c) for c, rows in touched(tree, p, radius) for k in rows}
        assert len(sent) < len(p) * cells / 2
        for k in range(0, len(p), 7):
            for j in np.flatnonzero(np.abs(p - p[k]).sum(axis=1) <= radius):
                assert (k, home[j]) in sent


def test_words_are_counted_whole(spark, monkeypatch):
    text = "Variant VARIANT variant×x ÀÉÎÕÜßÿ naïve_façade 12abcdefg3 " * 40 + "q" * 5000 + " " + "q" * 5000
    want = Counter(run_counts(text))
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert run_counts(text) == want and want["variant"] == 80 and want["variant×x"] == 40 and want["ÀÉÎÕÜßÿ"] == 40 and want["q" * 5000] == 2
    docs = odd_docs(spark, [(k, text, None, None, None) for k in (1, 1, 2)] + [(None, text, None, None, None), (5, None, None, None, None), (6, "", None, None, None)])
    plain: Counter = Counter()
    for doc in ("1", "1", "2", ""):
        for w, n in want.items():
            h = zlib.crc32(f"{doc}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            plain[w] += n
    assert {r.word: r.n for r in count_words(docs).collect()} == {w: n for w, n in plain.items() if len(w) >= 7 and n >= 2}


def test_forms_and_roots(spark):
    text = "variants " * 300 + "variant " * 20 + "varian " * 2 + "varxant " * 2 + "zebracrossing " * 3 + "colours " * 20 + "colouxs " * 2 + "coloums " * 20
    doc = next(k for k in range(999) if all(spelling.damaged(str(k), w) == w for w in set(text.split())))
    out = {r.word: r for r in spelling_variants(odd_docs(spark, [(doc, text, None, None, None)])).collect()}
    hop = out["varxant"]
    assert (hop.form, hop.root, hop.form_n) == ("variant", "variants", 20) and out["variant"].root == "variants" and out["variants"].form is None
    assert (out["zebracrossing"].form, out["zebracrossing"].root, out["zebracrossing"].n_near) == (None, "zebracrossing", 0)
    assert out["colouxs"].form == "coloums" and out["colouxs"].n_near == 2  # ties go to the first in code-point order
    assert out["coloums"].form is None  # equally frequent near words are no forms
    assert spelling_variants(empty_docs(spark)).count() == 0 and spelling_variants(odd_docs(spark, [(1, "too short", None, None, None)])).count() == 0
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(11)], "word string, form string")
    assert {r.root for r in roots(chain).collect()} == {"11"}

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm.decontam import contaminated, drop_contaminated, local_score, plain

from .helpers import empty_docs, odd_docs, text_of


def plain_score(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_alignment_equals_textbook(a, b):
    assert local_score(np.array(a, np.int64), np.array(b, np.int64))[0] == plain_score(a, b)


def words_of(text):
    return plain(text.encode()).split()


def seed_pairs(w):
    return [(i, (w[i], w[i + d])) for i in range(len(w)) for d in (1, 2) if i + d < len(w)]


def brute(docs, items, cover=0.2):
    """Pairs by the statement: rare seeds by counting, whole-text alignment."""
    count = Counter(p for _, t in docs for _, p in seed_pairs(words_of(t)))
    out = {}
    for j, t in items:
        w = words_of(t)
        first = {}
        for i, p in seed_pairs(w):
            first.setdefault(p, i)
        by = sorted(first, key=lambda p: (count[p], first[p]))
        at_edge = len({count[p] for p in by[(len(by) + 1) // 2 - 1 : (len(by) + 1) // 2 + 1]}) == 1  # ties may fall to either of two seeds of one place
        rare = set(by[: (len(by) + 1) // 2])
        for k, d in docs:
            dw = words_of(d)
            has = len(rare & {p for _, p in seed_pairs(dw)})
            if has >= max(1, math.ceil(cover * len(rare))) - at_edge:
                number = {x: n for n, x in enumerate({*w, *dw})}
                s = local_score(np.array([number[x] for x in w]), np.array([number[x] for x in dw]))[0] / (2 * len(w))
                if s >= 0.5:
                    out[k, j] = s
    return out


def test_equals_brute_force(spark, sf):
    """Every pair with a score of 0.5 and enough rare seeds is found, with that score; nothing else is."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, items).collect()}
    assert got == want and len(got) >= 3
    assert {(r.doc_id, r.item_id): r.score for r in contaminated(docs, items, block_words=300).collect()} == got


@pytest.mark.parametrize("n", [12, 25, 60])
def test_recall_of_edited_copies(spark, n):
    """Of copies with 10 to 30 % of their words changed, dropped or followed by another that an unseeded alignment scores 0.5, at least 0.97 are found."""
    rng = random.Random(n)
    common = [f"c{k}" for k in range(12)]
    item = [[rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(n)] for _ in range(10)]
    rows, want = [], set()
    for k in range(600):
        j, rate, out = rng.randrange(10), rng.choice([0.1, 0.2, 0.3]), []
        for w in item[j]:
            if rng.random() < rate:
                out += rng.choice([[f"e{rng.randrange(10**6)}"], [], [w, f"e{rng.randrange(10**6)}"]])
            else:
                out.append(w)
        around = [[rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(40)] for _ in range(2)]
        text = [*around[0], *out, *around[1]]
        number = {x: i for i, x in enumerate({*text, *item[j]})}
        if local_score(np.array([number[x] for x in item[j]]), np.array([number[x] for x in text]))[0] >= n:
            want.add((k, j))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(item)], "item_id long, text string")).collect()}
    assert len(want) > 400 and len(want & got) >= 0.97 * len(want)


def test_every_fourth_word_changed_and_long_insertions(spark):
    item = [f"w{k}" for k in range(40)]
    fourth = ["x%d" % k if k % 4 == 3 else w for k, w in enumerate(item)]
    gap = [*item[:20], *[f"y{k}" for k in range(35)], *item[20:]]
    apart = [y for k, w in enumerate(item) for y in (w, f"z{k}")]
    docs = spark.createDataFrame([(1, " ".join(fourth)), (2, " ".join(["a b c", *gap, "d e"])), (3, " ".join(apart)), (4, "w1 w2 and other words")], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.start_word, r.end_word) for r in contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (0.6375, 0, 39), 2: (45 / 80, 3, 78), 3: (41 / 80, 0, 79)}


def test_edited_copy_and_hot_item(spark):
    item = text_of(7, 40)
    w = item.split()
    edited = " ".join(["other" if k % 7 == 3 else x for k, x in enumerate(w)])
    rows = [(k, f"{text_of(500 + k, 60)} {item} {text_of(900 + k, 20)}", "en", "s", 0) for k in range(30)] + [(100, f"{text_of(3, 50)} {edited}", "en", "s", 0), (101, text_of(5, 90), "en", "s", 0)]
    docs = odd_docs(spark, rows)
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x y z"), (3, ""), (4, "two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert found == {(k, 1) for k in range(30)} | {(100, 1)}
    assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [101]
    spans = contaminated(docs, bench).where("doc_id = 3").first()
    assert (spans.start_word, spans.end_word) == (60, 100)


def test_odd_rows(spark):
    docs, bench = odd_docs(spark), spark.createDataFrame([(1, text_of(1, 80))], "item_id long, text string")
    assert {r.doc_id for r in contaminated(docs, bench).collect()} == {1, None}
    assert drop_contaminated(docs, bench).columns == docs.columns
    assert drop_contaminated(docs, bench).count() == docs.count() - 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and drop_contaminated(docs, none).count() == docs.count()
    assert contaminated(empty_docs(spark), bench).count() == 0

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import line_dedup
from tapewright.llm.line_dedup import LEAST_PAGES, RATIO, dedup_lines, html_lines
from tapewright.llm.mixing import mix_to_weights
from tapewright.llm.queries import LEVELS

from .helpers import empty_docs, odd_docs


def test_lines_by_hand(spark):
    rows = [(k, "a", f"menu\nbody {k}\n\n menu ") for k in range(4)] + [(9, "b", "menu\nother")] + [(10 + k, None, "foot\nx%d" % k) for k in range(3)] + [(20, "a", None)]
    out = {r.id: (r.text, r.gone) for r in dedup_lines(spark.createDataFrame(rows, "id long, host string, text string"), "host", ratio=0.5, least=3, dropped="gone").collect()}
    assert out[0] == ("body 0\n", 2) and out[9] == ("menu\nother", 0) and out[11] == ("x1", 1) and out[20] == (None, 0)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_equal_brute_force(spark, monkeypatch, limit):
    """Hosts of 5, 15, 30 and 400 pages, one with most of them; without a broadcast, pages are joined by host and salt."""
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", limit)
    rng = random.Random(4)
    rows = []
    for host, n in (("a", 5), ("b", 15), ("c", 30), (None, 12), ("hot", 400), ("one", 1)):
        for _ in range(n):
            lines = [f"{host} head"] * (rng.random() < 0.9) + [f" body {rng.randrange(10**9)}", "", f"rare {rng.randrange(12)}"] + ["foot\t"] * rng.randrange(3)
            rows.append((len(rows), host, "\n".join(lines) if rng.random() < 0.97 else None))
    pages = defaultdict(list)
    for _, h, t in rows:
        pages[h].append({x.strip() for x in (t or "").split("\n")} - {""})
    bad = {h: {x for x, n in Counter(x for p in ps for x in p).items() if n >= LEAST_PAGES and n > RATIO * len(ps)} for h, ps in pages.items()}
    want = [(i, h, None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad[h]), 0 if t is None else sum(x.strip() in bad[h] for x in t.split("\n"))) for i, h, t in rows]
    out = dedup_lines(spark.createDataFrame(rows, "id long, host string, text string"), "host", dropped="gone")
    assert sorted(tuple(r) for r in out.collect()) == want and {h for h in bad if bad[h]} == {"a", "b", "c", None, "hot"}


def test_lines_odd_rows(spark):
    docs = odd_docs(spark)
    out = dedup_lines(docs, "source", ratio=0.1, least=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("source = 'src2'").collect()} == {"   \n\t ", ""}
    assert dedup_lines(empty_docs(spark), "source").count() == 0


def brute_mix(rows, weights, percent, epochs, seed):
    """rows: (doc_id, path, tokens); the tree by recursion, the prefix by sorting each leaf."""
    tokens = defaultdict(int)
    for _, p, n in rows:
        tokens[p] += n
    budget = {}

    def give(path, depth, amount):
        if depth == 3:
            budget[path] = amount
            return
        kids = sorted({p[: depth + 1] for p in tokens if p[:depth] == path}, key=repr)
        cap = {k: epochs * sum(n for p, n in tokens.items() if p[: depth + 1] == k) for k in kids}
        w = {k: weights.get(("domain", "lang", "source")[depth], {}).get(k[-1], 1) for k in kids}
        full = set()
        while True:  # fill whoever can't take its share, then share again
            left, rest = amount - sum(cap[k] for k in full), sum(w[k] for k in kids if k not in full)
            more = {k for k in kids if k not in full and cap[k] * rest <= left * w[k]}
            if not more:
                break
            full |= more
        for k in kids:
            give(k, depth + 1, cap[k] if k in full else left * w[k] // rest)

    give((), 0, sum(tokens.values()) * percent // 100)
    out = []
    for p in tokens:
        whole, rest = divmod(budget[p], tokens[p]) if tokens[p] else (0, 0)
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
        mine = sorted(((key(d), n, d) for d, q, n in rows if q == p), key=lambda x: x[0])
        upto = defaultdict(int)
        for k, n, _ in mine:
            upto[k] += n
        total, ok = 0, set()
        for k in sorted(upto):
            total += upto[k]
            if rest and total <= rest:
                ok.add(k)
        out += [(d, whole + (k in ok)) for k, _, d in mine if whole + (k in ok)]
    return sorted(out, key=repr)


def test_mixture_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    weights = {"domain": {"d0": 7, "d2": 3}, "lang": {"en": 1, "de": 5}}
    lv = LEVELS()
    rows = [(r[0], (r[1], r[2], r[3]), len((r[4] or "").encode().split())) for r in docs.select("doc_id", lv["domain"], lv["lang"], lv["source"], "text").collect()]
    for percent, epochs in ((60, 2), (10, 1), (180, 2)):
        got = sorted([(r.doc_id, r.copies) for r in mix_to_weights(docs, lv, weights, percent, epochs).collect()], key=repr)
        assert got == brute_mix(rows, weights, percent, epochs, 17)


def test_mixture_odd_rows(spark):
    docs = odd_docs(spark)
    out = mix_to_weights(docs, LEVELS(), {}, 100, 1)
    assert out.columns == [c for c in docs.columns if c != "copies"] + ["copies"]
    assert out.agg(F.max("copies")).first()[0] == 1
    assert mix_to_weights(empty_docs(spark), LEVELS(), {}).count() == 0


def plain_lines(t):
    """The statement of html_lines(), pattern by pattern."""
    t = re.sub(r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "", t or "")
    t = re.sub(r"</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|br|nav|article|header|footer|section|title|head|body|html|pre|blockquote)\b[^>]*>", "\n", t)
    return re.sub(r"(?<![ \t\r])[ \t\r]*\n[ \t\r\n]*", "\n", re.sub(r"<[^>]*>", "", t))


def test_lines_of_pages_equal_their_statement(spark):
    rng = np.random.default_rng(5)
    bits = ["<!--", "-->", "--", ">", "<", "!", "<script", "<script>", "</script>", "<scripty", "<style ", "</style>", "<p", "<p>", "</p >", "<br/>", "<b>", "x", " ", "\n", "\x01", "\x01b", "a", "é", "<!-->", "-"]
    pages = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)] + [None, ""]
    got = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").select("k", html_lines(F.col("html")).alias("x")).collect()
    for r in got:
        assert r.x == plain_lines(pages[r.k]), pages[r.k]


@pytest.mark.parametrize("unit", ["<!--", "<script ", "<style", "<p ", "<x ", "<", "<!-- --", "-->", "<script></scrip", " \t", "<b <p>"])
def test_open_tags_cost_no_more_than_closed_ones(spark, unit):
    page = unit * (1_000_000 // len(unit)) + "<p>end"
    begun = time.perf_counter()
    out = spark.createDataFrame([(page,)], "html string").select(html_lines(F.col("html"))).first()[0]
    assert out.endswith("end") and time.perf_counter() - begun < 5

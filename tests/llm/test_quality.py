import os
import pathlib
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import quality
from tapewright.llm.common import fold_of, table
from tapewright.llm.queries import op9_quality
from tapewright.llm.quality import BUCKETS, DIM, RATE, features, fit_quality, keep_quality, scores, shares, train, with_quality

from .helpers import empty_docs, odd_docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op9_quality(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert len(out) > 60 and ((out["predicted"] == out["quality"]).mean()) > 0.93
    assert out["score"].between(0, 1).all()


def test_features_stay_within_their_text():
    both, doc = features([b"ab cd", b"xy zz zz"])
    for k, t in enumerate([b"ab cd", b"xy zz zz"]):
        assert sorted(both[doc == k]) == sorted(features([t])[0])
    assert len(features([b""])[0]) == 0


M = 2**64


def plain_mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % M
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 % M
    return x ^ (x >> 32)


def plain_features(t):
    """Buckets of one text, feature by feature: character n-grams (a line feed ends the text), words, word pairs, a word said twice, a pair said before."""
    line = t.decode() + "\n"
    out = [(sum(ord(x) * pow(0x9E3779B1, n - 1 - k, M) for k, x in enumerate(line[i : i + n])) % M, n) for n in (3, 4) for i in range(len(line) - n + 1)]
    words = [(sum((ord(x) + 1) * pow(0x100000001B3, min(k, 4095) + 1, M) for k, x in enumerate(w.decode())) + len(w.decode())) % M for w in t.split()]
    out += [(w, 1) for w in words]
    before = []
    for a, b in zip(words, words[1:]):
        p = (a * 0x9E3779B97F4A7C15 + b) % M
        out += [(p, 2)] + [(11, 7)] * (a == b) + [(13, 7)] * (p in before)
        before.append(p)
    return sorted(plain_mix((h + (kind << 56)) % M) % BUCKETS for h, kind in out)


def test_features_equal_their_statement():
    for t in (b"", b"a", b"the cat the cat the cat sat sat", "ünï 42 ünï\n\tx".encode(), b" lead and trail "):
        assert sorted(features([t])[0].tolist()) == plain_features(t)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    texts = [b"", b"the cat the cat the cat sat sat " * 9, "ünï 42 ünï\n\tx ".encode() * 7, b" lead and trail ", b"x" * 57, "日本語 ".encode() * 20 + b"y" * 40 + b" z"]
    want = [np.bincount(features([t])[0], minlength=BUCKETS) for t in texts]
    weights = np.random.default_rng(1).random(BUCKETS).astype(np.float32)
    plain = scores(texts, weights, 0.5)
    for piece in (7, 10, 16, 23, 1000):
        monkeypatch.setattr(quality, "PIECE", piece)
        for t, n in zip(texts, want):
            assert (quality.long_counts(t) == n).all(), (piece, t)
            idx, part = shares(t)
            assert (idx == np.flatnonzero(n)).all() and abs(part.sum() - (n.sum() > 0)) < 1e-5
        assert np.abs(scores(texts, weights, 0.5) - plain).max() < 1e-6


def test_a_text_of_100_mb_takes_little_memory():
    """In a process of its own, so that its peak is this text's."""
    code = """
import resource, sys
import numpy as np
from tapewright.llm.quality import BUCKETS, scores
text = b" ".join(b"w%d" % (k * 7919 % 300_007) for k in range(1_000_000)) * 13
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
p = scores([text], np.zeros(BUCKETS, np.float32), 0.0)
print(len(text), p[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(pathlib.Path(quality.__file__).parents[2])})
    size, p, mb = out.stdout.split()
    assert int(size) > 80_000_000 and float(p) == 0.5 and int(mb) < 500


def test_steps_equal_the_gradient():
    """Stochastic gradient steps against the loss's numeric gradient, through the folded weights."""
    rows, y = [shares(b"good words here"), shares(b"bad bad words"), shares(b"")], [1, 0, 1]
    rng = np.random.default_rng(7)
    emb, out, bias = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32).astype(float), np.zeros((DIM, 2)), np.zeros(2)

    def loss(v, part, o, c, label):
        z = (part[:, None] * v).sum(0) @ o + c
        return np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]

    def slope(f, x):
        g = np.zeros_like(x)
        for i in np.ndindex(*x.shape):
            d = np.zeros_like(x)
            d[i] = 1e-5
            g[i] = (f(x + d) - f(x - d)) / 2e-5
        return g

    done = 0
    for _ in range(2):
        for i in rng.permutation(3):
            (idx, part), rate = rows[i], RATE * (1 - done / 6)
            v, part = emb[idx], part.astype(float)
            dv, do, dc = slope(lambda x: loss(x, part, out, bias, y[i]), v), slope(lambda x: loss(v, part, x, bias, y[i]), out), slope(lambda x: loss(v, part, out, x, y[i]), bias)  # noqa: B023
            out, bias = out - rate * do, bias - rate * dc
            emb[idx] = v - rate * len(idx) ** 0.5 * dv
            done += 1
    weights, b = train(rows, y, 2 / 3, epochs=2)
    assert np.allclose(weights, emb @ (out[:, 1] - out[:, 0]), atol=1e-5) and np.isclose(b, bias[1] - bias[0], atol=1e-5)


def test_scores_equal_their_statement():
    w = np.random.default_rng(3).normal(size=BUCKETS).astype(np.float32)
    for t in (b"the cat the cat", b"", "é é é".encode()):
        f = plain_features(t)
        assert np.isclose(scores([t], w, -0.2)[0], 1 / (1 + np.exp(0.2 - sum(float(w[x]) for x in f) / max(1, len(f)))))


def test_scores_ignore_the_batch():
    w = np.random.default_rng(1).normal(size=1 << 17).astype(np.float32)
    texts = [b"one two three", b"", b"x" * 50]
    assert np.allclose(scores(texts, w, 0.3), [scores([t], w, 0.3)[0] for t in texts])
    assert np.isclose(scores([b""], w, 0.3)[0], 1 / (1 + np.exp(-0.3)))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (6, 1), (None, 1), (2, None), (1, 0)], "doc_id long, quality int")
    docs = odd_docs(spark)
    model = fit_quality(docs, labels, fold_of("doc_id", 4) != 9)
    out = with_quality(docs, model, "s")
    assert out.count() == docs.count() and out.where("s is null").count() == 0
    assert keep_quality(docs, labels, None, 0.0).columns == docs.columns
    same = out.where("text is null or text = ''").select(F.round("s", 12)).distinct().count()
    assert same == 1


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert keep_quality(empty_docs(spark), labels).count() == 0
    model = fit_quality(odd_docs(spark), labels)
    assert with_quality(odd_docs(spark), model, "s").where("s between 0 and 1").count() == odd_docs(spark).count()

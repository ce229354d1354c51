import random

from tapewright.llm.near_dedup import drop_near_duplicates, near_duplicates

from .helpers import empty_docs, odd_docs, text_of


def brute(rows, percent):
    """Components over exact word shingle sets, by all pairs."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").translate(up).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None] if sets[k] else [i]
        c = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng, rows = random.Random(5), []
    shared = text_of(1000, 55)
    for k in range(60):
        base = (shared + " " if k % 3 == 0 else "") + text_of(k, rng.choice([4, 8, 30, 60, 250, 700]))
        rows.append((len(rows), base))
        for _ in range(rng.choice([0, 1, 4])):
            w = base.split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        got = sorted([tuple(r) for r in near_duplicates(docs, percent).collect()], key=repr)
        assert got == brute(rows, percent)


def test_sets_about_as_large_as_a_sketch(spark):
    """Copies with few edits, whose unions lie on both sides of k: none may be lost to the bound on shared values."""
    rng, rows = random.Random(9), []
    for n in range(125, 171):
        for edits in range(5):
            base = [f"w{n}e{edits}p{p}" for p in range(n)]
            copy = base[: n - rng.randrange(1, 12)] if edits == 4 else list(base)
            for e in range(edits % 4):
                copy[n // 2 if e == 0 else rng.randrange(n)] = f"edit{rng.randrange(10**9)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        got = sorted([tuple(r) for r in near_duplicates(docs, percent).collect()], key=repr)
        want = brute(rows, percent)
        assert [g for g, w in zip(got, want) if g != w] == []


def test_odd_rows(spark):
    got = sorted([tuple(r) for r in near_duplicates(odd_docs(spark), 80).collect()], key=repr)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs(spark).collect()], 80)
    kept = drop_near_duplicates(odd_docs(spark), 80)
    assert kept.columns == odd_docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == [1, 2, 3, 4, 5, 6]


def test_empty(spark):
    assert near_duplicates(empty_docs(spark)).count() == 0
    assert drop_near_duplicates(empty_docs(spark)).count() == 0

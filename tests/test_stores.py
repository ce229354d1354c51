"""Look-ups by ranges of keys, and what was known on a day."""

import datetime as dt
import os
import pathlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapewright.operators import as_of as T
from tapewright.operators import ledger as G
from tapewright.operators import lookup as L
from tapewright.operators import phrases as P
from tapewright.operators import sinks as K
from tapewright.plans import screens as Q

day = dt.date


def test_a_look_up_opens_one_file_and_few_row_groups(spark, tmp_path):
    path = f"{tmp_path}/facts"
    df = spark.range(400_000).select((F.xxhash64("id") % 5000).alias("cik"), F.md5(F.col("id").cast("string")).alias("v")).withColumn("cik", F.when(F.col("cik") % 501 == 0, None).otherwise(F.abs("cik")))
    L.publish_clustered(df, path, ["cik"], 8, group_bytes=1 << 18)
    ranges = L.key_ranges(spark, path).collect()
    want = df.where("cik = 1234").count()
    for held in (None, ranges):
        got = L.look_up(spark, path, "cik", [1234], held)
        assert got.count() == want > 0 and len(got.inputFiles()) == 1
        assert "EqualTo(cik" in (plan := got._jdf.queryExecution().toString()) or "In(cik" in plan
    file = pathlib.Path(got.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(file).metadata
    stats = [meta.row_group(k).column(0).statistics for k in range(meta.num_row_groups)]
    assert len(stats) >= 4 and sum(s.min <= 1234 <= s.max for s in stats) <= 2
    assert sum(r["n"] for r in ranges) == 400_000
    two = L.look_up(spark, path, "cik", [1, 4999, None, 7_000])
    assert two.count() == df.where("cik in (1, 4999)").count() and len(two.inputFiles()) == 2
    assert L.look_up(spark, path, "cik", [-5]).count() == 0 and L.look_up(spark, path, "cik", []).count() == 0
    L.publish_clustered(df.where("cik <> 1234"), path, ["cik"], 3)
    assert L.look_up(spark, path, "cik", [1234]).count() == 0
    with pytest.raises(FileNotFoundError):
        L.look_up(spark, f"{tmp_path}/none", "cik", [1])
    K.publish(spark.range(3), f"{tmp_path}/plain")
    assert K.published(spark, f"{tmp_path}/plain").count() == 3


def test_facts_as_of_equal_a_filter_for_each_day(spark):
    rows = []
    for k in range(400):
        cik, concept, end = k % 7, f"C{k % 3}", day(2020, 3, 31) if k % 2 else day(2020, 12, 31)
        rows.append((cik, "t", concept, "USD", None, end, float(k), day(2020, 1, 1) + dt.timedelta((k * 37) % 900), "10-K", f"a{k % 50}"))
    rows += [rows[3], (*rows[5][:6], 1e9, rows[5][7], "10-K", "a99"), (1, "t", "C", "USD", None, None, 1.0, None, "10-K", "x")]
    facts = spark.createDataFrame(rows, "cik int, taxonomy string, concept string, unit string, period_start date, period_end date, val double, filed date, form string, accn string")
    dates = [day(2019, 12, 31), day(2020, 1, 1), *[day(2020, 1, 31) + dt.timedelta(53 * k) for k in range(16)], day(2022, 6, 19), day(2030, 1, 1)]
    days = spark.createDataFrame([(d,) for d in [*dates, dates[3], None]], "as_of date")
    got = sorted(tuple(map(str, r)) for r in T.facts_as_of(facts, days).select("as_of", *facts.columns).collect())
    want = []
    for d in dates:
        cur = Q.current_facts(facts.where(F.col("filed") <= F.lit(d)))
        want += [(str(d), *map(str, r)) for r in cur.select(*facts.columns).collect()]
    assert got == sorted(want) and len(got) > 300
    assert T.facts_as_of(facts, days.limit(0)).count() == 0 and T.facts_as_of(facts.limit(0), days).count() == 0


def test_phrases_equal_a_search_of_the_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "AT&T", "beta.", "Ünï", "x", "alphabet", "gamma,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))).replace(" x ", rng.choice([" ", "\n\t", "  "])) for _ in range(300)] + [None, "", "  "]
    docs = spark.createDataFrame([(k, t, f"s{k % 4}", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    path, phrases = f"{tmp_path}/ix", ["alpha beta", "AT & t", "beta . x", "ünï", "alpha alpha", "gamma, AT&T beta", "bet", "", "no such"]
    P.publish_index(docs, path, partitions=6)
    found = P.search(spark, path, phrases)
    got = {(r.phrase, r.doc_id): list(r.at) for r in found.collect()}
    split = lambda t: re.findall(r"[^\W_]+|[^\w\s]|_", (t or "").lower())
    want = {}
    for p in phrases:
        q = split(p)
        for k, t in enumerate(texts):
            ts = split(t)
            at = [i for i in range(len(ts) - len(q) + 1) if q and ts[i : i + len(q)] == q]
            if at:
                want[p, k] = at
    assert got == want and len({p for p, _ in want}) == 6
    spelt = {k for k, t in enumerate(texts) if re.search(r"(?<![^\W_])alpha\s+beta(?![^\W_])", (t or "").lower())}
    assert {k for p, k in got if p == "alpha beta"} == spelt
    top = {r.source: (r.matches, r.newest, r.total) for r in P.by_entity(found, docs).where("phrase = 'alpha beta'").collect()}
    assert sum(m for m, _, _ in top.values()) == len(spelt) and top["s1"][1] == max(k for k in spelt if k % 4 == 1)
    one = P.search(spark, path, ["alpha"])
    assert len({f for f in one.inputFiles()}) <= 3 and all("/ix/" in f for f in one.inputFiles())  # the files of the word, no text


def test_ledger_reads_changed_files_alone(spark, tmp_path, monkeypatch):
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    body = b"".join(b"%d %d\r\n" % (k, k * k) for k in range(60_000))
    for name, data in (("a b[1].csv", body), ("c%20.bin", bytes(range(256)) * 50), ("e", b""), ("g", b"gone\n"), ("h", b"one\ntwo")):
        put(name, data)
    monkeypatch.setattr(G, "RANGE", 100_000)  # several tasks for one file
    save = lambda df: spark.createDataFrame(df.collect(), df.schema)
    first = save(G.file_ledger(spark, f"{tmp_path}/*", None))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in first.collect()}
    assert {r.status for r in rows.values()} == {"new"} and rows["a b[1].csv"].size == len(body) and len({r.sha256 for r in rows.values()}) == 4
    read = []
    real = G.digests
    monkeypatch.setattr(G, "digests", lambda s, urls: (read.extend(urls), real(s, urls))[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # what the session says doesn't matter
    try:
        (tmp_path / "g").unlink()
        os.utime(tmp_path / "c%20.bin", (1, 1))  # touched, not changed
        put("h", b"one\ntwo\n")  # the last line's end alone
        put("a b[1].csv", body[:-4] + b"7" + body[-3:])
        put("n", b"new")
        second = save(G.file_ledger(spark, f"{tmp_path}/*", first))
        got = {r.path.rsplit("/", 1)[-1]: r.status for r in second.collect()}
        assert got == {"a b[1].csv": "changed", "c%20.bin": "same", "g": "gone", "h": "changed", "n": "new"}
        assert sorted(u.rsplit("/", 1)[-1] for u in read) == ["a%20b%5B1%5D.csv", "c%2520.bin", "h", "n"]
        read.clear()
        put("g", b"back")
        third = {r.path.rsplit("/", 1)[-1]: r.status for r in G.file_ledger(spark, f"{tmp_path}/*", second).collect()}
        assert third["g"] == "new" and len(third) == 5 and set(third.values()) == {"same", "new"} and len(read) == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_the_ledgers_query_have_their_lines_in_order(spark, tmp_path, monkeypatch):
    from tapewright.plans import archive_queries as Y

    spark.range(0, 4_000, 1, 5).selectExpr("3999 - id as event_id", "id % 7 as user_id").write.parquet(f"{tmp_path}/events.parquet")  # five files, the last events first
    made, real = [], Y.scratch
    monkeypatch.setattr(Y, "scratch", lambda s, name: (made.append(real(s, name)), made[-1])[1])
    got = {r.path: r.status for r in Y.file_ledger(spark, str(tmp_path)).collect()}
    assert got == {f"d{k:02}": {3: "gone", 4: "changed", 5: "new"}.get(k, "same") for k in range(8)}
    for root in made[:2]:
        files = list(pathlib.Path(root.removeprefix("file://")).glob("*/*.csv"))
        assert len(files) == 7
        for f in files:
            ids = [int(x.split(",")[0]) for x in f.read_text().split()]
            assert len(ids) == 500 and ids == sorted(ids)

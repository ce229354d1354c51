"""Hand-made fixtures for the traps of market data, readers, stores and streams."""

import datetime as dt
import gzip
import io
import os
import pathlib
import random
import struct
import subprocess
import sys
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright.operators import archives as A
from tapewright.operators import day_store as B
from tapewright.operators import derive as D
from tapewright.operators import ledger as G
from tapewright.operators import sinks as K
from tapewright.operators import views as V
from tapewright.plans import queries as N
from tapewright.plans import screens as Q
from tapewright.sources import archive_ranges as Z
from tapewright.sources import documents as X
from tapewright.sources import readers as R
from tapewright.sources import rejects as C
from tapewright.sources.headers import headers
from tapewright.streaming import feeds as J

day = dt.date


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, as_of date, open double, high double, low double, close double, volume double")


def test_split_adjustment_and_year_of_records(spark):
    d0 = day(2020, 1, 1)
    rows = [("A", d0 + dt.timedelta(k), p, p + 1, p - 1, p, 10.0) for k in range(300) for p in [100.0 if k < 280 else 10.5]]
    sp = spark.createDataFrame([("A", d0 + dt.timedelta(280), 0.1, "confirmed"), ("A", d0 + dt.timedelta(280), 0.1, "confirmed"), ("A", d0 + dt.timedelta(5), 9.0, "no_price_match")], "symbol string, effective_date date, ratio double, confidence string")
    daily = V.split_adjusted(bars(spark, rows), V.confirmed_splits(sp))
    assert daily.count() == 300
    got = {r.as_of: r for r in daily.collect()}
    assert got[d0].adj_close == pytest.approx(10.0) and got[d0 + dt.timedelta(280)].adj_close == 10.5 and got[d0 + dt.timedelta(280)].split_ratio == 0.1
    s = V.adjusted_sessions(daily, 4)
    assert s.agg(F.max("sessions_seen")).first()[0] == 252
    assert s.where(F.col("as_of") == d0 + dt.timedelta(280)).first().pct_change == 5.0
    assert [tuple(r)[:2] for r in Q.us_records(s, 15, True).collect()] == [("A", 15)]


def test_series_segments(spark):
    rows = [("A", day(2020, 1, 1), 1, 1, 1, 1, 10.0), ("A", day(2020, 3, 1), 1, 1, 1, 1, 500000.0), ("A", day(2020, 6, 1), 1, 1, 1, 1, 600000.0), ("B", day(2020, 1, 1), 1, 1, 1, 1, 5.0), ("B", day(2020, 9, 1), 1, 1, 1, 1, 90.0)]
    out = {(r.symbol, r.as_of): (r.series_id, r.series_symbol) for r in D.segment_series(bars(spark, [tuple(map(lambda v: float(v) if isinstance(v, int) else v, r)) for r in rows])).collect()}
    assert out["A", day(2020, 3, 1)] == (2, "A#2") and out["A", day(2020, 6, 1)] == (2, "A#2") and out["B", day(2020, 9, 1)] == (1, "B")


def test_plan_flags_and_implausible_values(spark):
    subs = spark.createDataFrame([(str(k), "02-JAN-2024", "4", "I", " abc ", f) for k, f in enumerate(["1", "0", "true", "FALSE", " "])], "accession_number string, filing_date string, document_type string, issuername string, issuertradingsymbol string, aff10b5one string")
    got = {r.accession: r for r in V.submissions(subs).collect()}
    assert [got[str(k)].plan_10b5_1 for k in range(5)] == [True, False, True, False, None] and got["0"].symbol == "ABC" and got["0"].filing_date == day(2024, 1, 2)
    trans = spark.createDataFrame([("0", "02-OCT-0024", "P", "A", "10", "5"), ("1", "03-JAN-2024", "S", "D", "2", "1.63e9"), ("2", "03-JAN-2024", "P", "A", "3", "7")], "accession_number string, trans_date string, trans_code string, trans_acquired_disp_cd string, trans_shares string, trans_pricepershare string")
    own = spark.createDataFrame([("2", "X", ""), ("2", "Y", "Director")], "accession_number string, rptownername string, rptowner_relationship string")
    t = V.insider_transactions(trans, V.submissions(subs), own)
    assert t.count() == 4
    r = {x.accession: x for x in t.collect()}
    assert r["0"].trans_date is None and r["0"].value_usd == 50 and r["1"].value_usd is None and r["1"].shares == 2
    roster = spark.createDataFrame([("ABC", "Abc", "S")], "symbol string, company_name string, sector string")
    net = Q.us_insider_net(t, roster, 30).first()
    assert (net.buys, net.sells, net.buy_usd, net.insiders) == (1, 1, 21.0, 2)


def test_new_york_close(spark):
    rows = [("2024-07-01 19:59:00", 1), ("2024-07-01 20:00:00", 2), ("2024-01-05 20:59:00", 5), ("2024-01-05 21:00:00", 6), (None, 1)]
    df = spark.createDataFrame(rows, "a string, d int").select(F.to_timestamp("a").alias("a"), F.coalesce(F.to_date("a"), F.lit("2024-07-01").cast("date")).alias("f"), "d")
    assert all(r[0].day == r[1] for r in df.select(Q.tradable_from(F.col("f"), F.col("a")), "d").collect())


def test_annual_ladder_and_vintages(spark):
    f = lambda c, s, e, v, filed, a, u="USD": (7, "t", c, u, s, e, v, filed, a)
    y0, y1 = day(2020, 1, 1), day(2020, 12, 31)
    facts = V.typed_facts(spark.createDataFrame([
        f("Rev", y0, y1, 10.0, day(2021, 2, 1), "a"), f("Rev", y0, y1, 11.0, day(2022, 2, 1), "b"), f("Rev", y0, y1, 99.0, day(2023, 1, 1), "z", "EUR"), f("Rev", day(2020, 10, 1), y1, 3.0, day(2021, 2, 1), "a"),
        f("Alt", day(2019, 1, 1), day(2019, 12, 31), 5.0, day(2020, 2, 1), "c"), f("Cash", None, y1, 4.0, day(2021, 2, 1), "a"), f("Rev", day(2018, 1, 1), day(2019, 1, 7), 1.0, day(2019, 2, 1), "d"),
    ], "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, val double, filed date, accn string").withColumn("form", F.lit("10-K")))
    got = {r.fiscal_year_end: (r.revenue, r.cash) for r in Q.annual(facts, ["USD"], {"revenue": ["Rev", "Alt"]}, {"cash": ["Cash"]}, "Rev").collect()}
    assert {r.accn for r in Q.annual(facts, ["USD"], {"revenue": ["Rev", "Alt"]}, {"cash": ["Cash"]}, "Rev").collect()} == {"b", None, "d"}
    assert got == {y1: (11.0, 4.0), day(2019, 12, 31): (5.0, None), day(2019, 1, 7): (1.0, None)}
    v = {r.accn: r.vintage for r in Q.fact_vintages(facts).where("unit = 'USD' and period_days = 365").collect()}
    assert v == {"b": 1, "a": 2}


def test_actions_by_ordered_rules(spark):
    texts = ["Interest and Dividend", "DIV - RS 2", "FVSPLT frm 10", "Bonus 1:1", "Rights", "Buy Back", "AGM", "Scheme of arrangement", "other", " "]
    df = spark.createDataFrame([(" A ", "EQ", "2024-01-01", "", t) for t in texts + texts[:1]] + [("B", "BE", "", "", "Bonus")], "symbol string, series string, ex_dt string, record_dt string, purpose string")
    got = {r.purpose: r.category for r in V.corporate_actions(df).collect()}
    assert [got[t] for t in texts[:-1]] == ["Interest", "Dividend", "Split", "Bonus", "Rights", "Buyback", "Meeting", "Restructuring", "Other"] and V.corporate_actions(df).count() == 9


def test_short_sentinel_and_board_sums(spark, sf):
    from tapewright.plans import queries as market_queries  # noqa: F401  they register themselves
    from tapewright.plans.registry import queries

    si = spark.createDataFrame([(999.99,), (998.82,), (None,)], "days_to_cover double")
    assert [r[0] for r in V.short_interest_view(si).collect()] == [None, 998.82, None]
    b = queries()["convergence_board"](spark, sf)
    fam = [c for c in b.columns if c.startswith("pts_")]
    assert b.where(" + ".join(fam) + " <> score").count() == 0 and b.where(" + ".join(f"cast({c} > 0 as int)" for c in fam) + " <> signals").count() == 0


def test_name_resolution(spark):
    m = spark.createDataFrame([("Acme Industries (India) Limited", "ACME", "EQ", day(2024, 1, 1)), ("Acme Industries Limited", "ACMEX", "BE", day(2024, 1, 2)), ("Globalsteelworks Pvt Ltd", "GSW", "EQ", day(2024, 1, 1))], "name string, symbol string, series string, folder date")
    ins = spark.createDataFrame([("Globalsteelworks", "OTHER"), ("Tea & Coffee Co", "TEA")], "company string, symbol string")
    br = D.symbol_bridge(m, ins)
    assert {r.key: r.symbol for r in br.collect()} == {"ACMEINDUSTRIES": "ACME", "GLOBALSTEELWORKS": "GSW", "TEAANDCOFFEECO": "TEA"}
    out = D.resolve_names(spark.createDataFrame([("Globalsteelworks Overseas",), ("Tea & Coffee Company",), ("Tea & Coffee Shops",), (None,)], "name string"), br)
    assert {r.name: r.symbol for r in out.collect()} == {"Globalsteelworks Overseas": "GSW", "Tea & Coffee Company": "TEA", "Tea & Coffee Shops": None, None: None}


def test_tags_need_capitals(spark):
    names = spark.createDataFrame([
        ("P", "EQ", "Page Industries Ltd"), ("M", "EQ", "M & M Motors"), ("Q", "EQ", "Page Turner"), ("AT", "EQ", "AT&T Telecom"), ("N", "EQ", "India Cements"), ("Z", "EQ", "Zomato"), ("ZB", "BE", "Zebra"), ("1X", "EQ", "Digit Co"), ("XNSETEST", "EQ", "Tester Co"),
        ("S", "EQ", "3M India"), ("U", "EQ", "Éclair Foods"),
    ], "symbol string, series string, company_name string")
    al = Q.brand_index(names)
    assert {(r.alias, r.symbol) for r in al.collect()} == {
        ("PAGE INDUSTRIES", "P"), ("M &", "M"), ("PAGE TURNER", "Q"), ("AT&T TELECOM", "AT"), ("AT&T", "AT"), ("INDIA CEMENTS", "N"), ("ZOMATO", "Z"), ("3M INDIA", "S"), ("CLAIR FOODS", "U"), ("CLAIR", "U"),
    }
    t = spark.createDataFrame([
        (1, "front page industries news"), (2, "Page Industries rallies"), (3, "homepage industries"), (4, "why AT&T's bid and 3M India's plan"), (5, "zomato, then Zomato-backed"), (6, "Page. Industries"), (7, "Page\t Industries"), (8, "zomato only"), (9, None),
    ], "doc_id long, title string")
    assert sorted(tuple(r) for r in Q.tag_headlines(t, al).collect()) == [(2, "P"), (4, "AT"), (4, "S"), (5, "Z"), (7, "P")]
    news = spark.createDataFrame([("l1", "Deal (NYSE: ABC)", "also (NASDAQ: X.Y)", "2024-01-02"), ("l1", "Old", "(NYSE: ABC)", "2024-01-01"), (None, "T (NYSE: NOPE)", "", None)], "link string, title string, description string, published string")
    known = spark.createDataFrame([("ABC",), ("X-Y",)], "symbol string")
    assert [r.symbol for r in Q.news_tickers(news, known).collect()] == ["ABC", "X-Y"]


def test_readers(spark, tmp_path):
    for d, text in (("20240101", "Symbol,Security,52 Week High\nA,x,1\n"), ("20240102", "Security,Symbol,Extra Col\ny,B,9\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f20231231.csv").write_text(text)
        (tmp_path / d / "hl.csv").write_text('"disclaimer"\n"more, text"\nSYMBOL,SERIES,P\nA,EQ,1\n')
    t = R.scan_csv_glob(spark, f"{tmp_path}/*/f*.csv")
    got = {r.symbol: r for r in t.withColumn("as_of", R.folder_date("file_path")).collect()}
    assert got["B"]._security == "y" and got["A"]._52_week_high == "1" and got["B"]._52_week_high is None and got["B"].as_of == day(2024, 1, 2)
    hl = R.scan_csv_skip(spark, f"{tmp_path}/*/hl.csv", ["symbol", "series", "p"], "trim(series) = 'EQ'")
    assert hl.count() == 2
    assert R.optional_source(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "sv.txt").write_text("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240103|A|1.5|0|3|Q\n1|||\n")
    assert [tuple(r) for r in R.scan_short_volume(spark, f"{tmp_path}/sv.txt").collect()] == [(day(2024, 1, 3), "A", 1.5, 0.0, 3.0, "Q")]
    (tmp_path / "si.csv").write_text("symbolCode|settlementDate\nA|2024-01-01\n")
    df, missing = R.scan_short_interest(spark, f"{tmp_path}/si.csv")
    assert df.first().symbol == "A" and "issueName" in missing and df.first().issue_name is None
    raw = spark.createDataFrame([("A", "2024-01-02T00:00:00Z", "1500000000", "1", "1", "2000000000", "7", "3")], "symbol string, ts_event string, open string, high string, low string, close string, volume string, instrument_id string")
    b = R.normalise_bars(raw, "d", "j", True).first()
    assert (b.as_of, b.open, b.close) == (day(2024, 1, 2), 1.5, 2.0)
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0, None, None)], "d string, A_open double, A_close double, B_open double, B_close double")
    assert [tuple(r) for r in R.wide_to_long(wide, "d", ["open", "close"]).collect()] == [("2024-01-01", "A", 1.0, 2.0)]
    (tmp_path / "ix1.csv").write_text('"SYMBOL \n","COMPANY\nNAME","XBRL\nLINK"\nA,Acme,u1.xml\nB,Beta,u2.pdf\n')
    ix = R.scan_index_csv(spark, f"{tmp_path}/ix*.csv", {"symbol": "symbol", "company": "company", "url": "xbrl"})
    assert [tuple(r) for r in ix.collect()] == [("A", "Acme", "u1.xml")]
    (tmp_path / "a.json").write_text('{"stock_data": [{"fincode": 1}]}')
    (tmp_path / "b.json").write_text("{broken")
    assert R.scan_json_docs(spark, f"{tmp_path}/*.json", "struct<stock_data: array<struct<fincode: int>>>").count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/CIK1.json", "{}")
        z.writestr("readme.txt", "no")
    inner, text = io.BytesIO(), gzip.compress(b"deep")
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b/deep.txt.gz", text)
        z.writestr("c.txt", "flat")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("x/inner.zip", inner.getvalue())
        z.writestr("broken.zip", b"PK no")
    (tmp_path / "w.zip").write_bytes(b"no archive")
    members = R.scan_zip_members(spark, f"{tmp_path}/[wy].zip")
    assert sorted(r.member for r in members.collect()) == ["broken.zip", "x/inner.zip"]
    assert {r.member: bytes(r.content) for r in R.unzipped(members).collect()} == {"x/inner.zip!b/deep.txt": b"deep", "x/inner.zip!c.txt": b"flat"}
    assert [r.member for r in R.scan_zip_members(spark, f"{tmp_path}/z.zip", r".*\.json").collect()] == ["x/CIK1.json"]
    assert R.optional_source(spark, f"{tmp_path}/none", "a int, b string").count() == 0


def test_columns_are_bound_by_each_files_own_header(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("v [1].txt", "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240102|A|1.5|0|3|Q\n1|||\n")
    put("v%202.txt", "Symbol|ShortVolume|Date|TotalVolume\r\n b |2|20240103|4\r\n")
    got = sorted(tuple(r) for r in R.scan_short_volume(spark, f"{tmp_path}/v*.txt").collect())
    assert got == [(day(2024, 1, 2), "A", 1.5, 0.0, 3.0, "Q"), (day(2024, 1, 3), "B", 2.0, None, 4.0, None)]
    put("s1.csv", "symbolCode|settlementDate\na|2024-01-01\n")
    put("s2.csv", "settlementDate|issueName|symbolCode\n2024-01-15|Acme|B\n")
    df, missing = R.scan_short_interest(spark, f"{tmp_path}/s?.csv")
    assert sorted((r.symbol, r.settlement_date, r.issue_name) for r in df.collect()) == [("A", "2024-01-01", None), ("B", "2024-01-15", "Acme")] and "issueName" not in missing
    put("i1.csv", '"SYMBOL \n","COMPANY\nNAME","XBRL\nLINK"\nA,"Ac\nme",u1.xml\nB,Beta,u2.pdf\nZ,Zeta,u1.xml\n')
    put("i2.csv", '\ufeff"COMPANY\nNAME","XBRL\nLINK",SYMBOL\nBeta,u3.xml,BBB\n')
    put("i3.csv", "\n\nSYMBOL,LINK\nA,u9.xml\n")
    put("i4.csv", "")
    ix = R.scan_index_csv(spark, f"{tmp_path}/i*.csv", {"symbol": "symbol", "company": "company", "url": "xbrl"})
    assert sorted(tuple(r) for r in ix.collect()) == [("BBB", "Beta", "u3.xml"), ("Z", "Zeta", "u1.xml")]
    heads = {r.path.rsplit("/", 1)[-1]: r.header for r in headers(spark, f"{tmp_path}/i*.csv").collect()}
    assert heads == {"i1.csv": ["SYMBOL \n", "COMPANY\nNAME", "XBRL\nLINK"], "i2.csv": ["COMPANY\nNAME", "XBRL\nLINK", "SYMBOL"], "i3.csv": ["SYMBOL", "LINK"]}
    put("d1.csv", "a,a,,a_1\n1,2,3,4\n")
    assert R.scan_csv_glob(spark, f"{tmp_path}/d*.csv", with_path=False).columns == ["a", "a_1", "column2", "a_1_1"]
    with pytest.raises(FileNotFoundError):
        R.scan_csv_glob(spark, f"{tmp_path}/i4*.csv")


def test_headers_when_tasks_hold_many_files(spark, tmp_path, monkeypatch):
    """Where the session's settings are held fast, a task goes on to its next file."""
    for k in range(40):
        (tmp_path / f"f{k}.csv").write_text(f"h{k % 3},x\n" + "1,2\n" * 500)
    monkeypatch.setattr(type(spark.conf), "set", lambda self, *a: None)
    got = {r.path.rsplit("/", 1)[-1]: r.header for r in headers(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {f"f{k}.csv": [f"h{k % 3}", "x"] for k in range(40)}


def test_archives_are_read_by_byte_ranges(spark, tmp_path):
    """Tasks of 60 KB each: members cross splits and blocks; stored, deflated, empty and damaged ones; something before an archive."""
    r, want = random.Random(1), {}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"z {k}.zip", "w") as z:
            for j in range(40):
                body = bytes(r.randrange(256) for _ in range(r.choice([0, 10, 3000, 20000]))) if j else b"\n" * 100_000
                z.writestr(f"m/{j}.bin", body, compress_type=r.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
                want[k, f"m/{j}.bin"] = body
            z.writestr("d/", "")
    (tmp_path / "z 1.zip").write_bytes(b"before\n\n" + (tmp_path / "z 1.zip").read_bytes() + b"\n")
    (tmp_path / "no.zip").write_bytes(b"no archive")
    (tmp_path / "none.zip").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        blocks = Z.byte_blocks(spark, f"{tmp_path}/*.zip")
        index = Z.member_index(blocks)
        assert blocks.select("at", "path").distinct().count() > 8 and index.count() == 120
        got = Z.read_ranges(blocks, index).collect()
        assert {(int(x.zip[-5]), x.member): bytes(x.content) for x in got} == want and {x.problem for x in got} == {None}
        wrong = Z.read_ranges(blocks, index.where("member in ('m/0.bin', 'm/1.bin', 'm/2.bin')").withColumns({"crc": F.when(F.col("member") == "m/0.bin", F.lit(1)).otherwise(F.col("crc")), "flags": F.when(F.col("member") == "m/1.bin", F.lit(1)).otherwise(F.col("flags")), "method": F.when(F.col("member") == "m/2.bin", F.lit(12)).otherwise(F.col("method"))}))
        assert {(x.member, x.problem, x.content) for x in wrong.collect()} == {("m/0.bin", "damaged", None), ("m/1.bin", "encrypted", None), ("m/2.bin", "method 12", None)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_directories_of_large_archives():
    """Sizes and places beyond four bytes stand in an extra field, and the directory's in a record of its own."""
    wide = struct.pack("<HHQQQ", 1, 24, 5 << 32, 3 << 32, 7 << 32)
    entry = Z._ENTRY + struct.pack("<HHHHHHLLLHHHHHLL", 45, 45, 0x800, 8, 0, 0, 77, 0xFFFFFFFF, 0xFFFFFFFF, 3, len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + "é1".encode() + wide
    assert Z.entries(entry, 0) == [("é1", 7 << 32, 3 << 32, 5 << 32, 8, 77, 0x800)]
    end64 = Z._END64 + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 9 << 32)
    tail = entry + end64 + Z._LOCATOR64 + struct.pack("<LQL", 0, (9 << 32) + len(entry), 1) + Z._END + struct.pack("<HHHHLLH", 0, 0, 1, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert Z.directory_range(tail, 9 << 32) == (9 << 32, len(entry), 0)
    assert Z.directory_range(b"nothing", 0) is None


@pytest.mark.parametrize("text, symbols", [
    ("(TSX: ABC) (OTCQB: ABCD) (NASDAQ ABCD) (Nasdaq: ABCD)", ["ABC", "ABCD"]), ("(NYSE Arca: SPY) ( NYSE : X )", ["SPY", "X"]), ("(nyse american: brk.b) (NYSEAMERICAN:UUU)", ["BRK-B", "UUU"]),
    ("(CEO: ABC) NYSE: ABC (NYSE: ABCDEF) (XTSX: A) (NYSE: A, B)", []), ("(OTC. AB-C)(OTCQX AB)(TSXV:Z)(BATS: Q)(CBOE: R)(AMEX: T)", ["AB", "AB-C", "Q", "R", "T", "Z"]),
])
def test_ticker_mentions(spark, text, symbols):
    news = spark.createDataFrame([("l", text, "", "2024-01-01")], "link string, title string, description string, published string")
    known = spark.createDataFrame([(x,) for x in "ABC ABCD SPY X BRK-B UUU ABCDEF A B AB AB-C Q R T Z".split()], "symbol string")
    assert [r.symbol for r in Q.news_tickers(news, known).collect()] == symbols


def test_rows_and_rejects_are_the_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3\n"q,r",5\n6,7,8\n,\n')
    (tmp_path / "b.csv").write_text("y,z,x\n1,2,3\n\n4,5\n")
    rows, bad = C.csv_checked(spark, f"{tmp_path}/*.csv")
    assert sorted((r.x or "", r.y or "", r.z or "") for r in rows.collect()) == [("", "", ""), ("1", "2", ""), ("3", "1", "2"), ("q,r", "5", "")]
    assert sorted((r.file[-5:], r.record, r.reason, r.raw) for r in bad.collect()) == [("a.csv", "3", "not 2 fields", "3"), ("a.csv", "6", "not 2 fields", "6,7,8"), ("b.csv", "4", "not 3 fields", "4,5")]
    for name, text in (("a", '{"n": 1}'), ("b", "{broken"), ("c", "[1, 2]"), ("d", '{"other": 1}'), ("e", "null")):
        (tmp_path / f"{name}.json").write_text(text)
    rows, bad = C.json_checked(spark, f"{tmp_path}/*.json", "n int")
    assert sorted((r.file_path[-6:], r.n) for r in rows.collect()) == [("a.json", 1), ("d.json", None)]
    assert sorted((r.record, r.reason, r.raw) for r in bad.collect()) == [("b.json", "not JSON", "{broken"), ("c.json", "no object", "[1, 2]"), ("e.json", "no object", "null")]
    xml = "<x><context id='c'><instant>2024-01-01</instant></context><A contextRef='c'>1</A></x>"
    docs = spark.createDataFrame([("u1", xml), ("u2", "<x><A contextRef='c'>1</A>"), ("u3", "<x/>"), ("u5", "")], "xbrl_url string, xml string")
    jobs = spark.createDataFrame([("t", "S", "C", f"u{k}") for k in range(1, 6)], "filing_type string, source_symbol string, source_company string, xbrl_url string")
    facts, bad = A.filing_facts(jobs, docs)
    assert [(r.xbrl_url, r.value) for r in facts.collect()] == [("u1", "1")]
    got = {r.file: (r.reason.split(":")[0], r.raw) for r in bad.collect()}
    assert got == {"u2": ("not XML", "<x><A contextRef='c'>1</A>"), "u3": ("no facts", "<x/>"), "u4": ("no document", ""), "u5": ("not XML", "")}


def test_large_documents_are_read_in_parts():
    """100 MB of facts, and of news, in a process of its own: elements don't pile up. Contexts may follow their facts."""
    code = """
import resource
from tapewright.sources.documents import news_items, xbrl_rows
fact = "<Shares contextRef='c' unitRef='u' decimals='0'>12345</Shares>" * 10
xml = "<x><unit id='u'><measure>m</measure></unit>" + fact * 160_000 + "<context id='c'><instant>2024-01-01</instant></context></x>"
item = "<item><title>T</title><link>https://n.org/a/b</link><image><url>i</url></image></item>"
news = "<rss><channel>" + item * 500_000 + "</channel></rss>"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(r["period_instant"] == "2024-01-01" and r["unit"] == "m" for r in xbrl_rows(xml))
m = sum(r["link"] == "https://n.org/a/b" for r in news_items(news))
print(len(xml), n, m, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(pathlib.Path(X.__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    size, n, m, mb = map(int, out.stdout.split())
    assert size > 95_000_000 and (n, m) == (1_600_000, 500_000) and mb < 100


def test_prices_from_text(spark):
    rows = [(" A ", " EQ ", " 02-Jan-2024", " 100 ", " 101.5 ", "10", "x"), ("B", "BE", "2024-01-02", "1", "2", "3", "4"), ("C", "EQ", "2024-01-03", "0", "5", "-", "1"), ("D", "EQ", "3 Jan", "-", "7", "1", "1"), ("E", "EQ", "03-Jan-2024", "3", None, "1", "1")]
    got = {r.symbol: tuple(r) for r in V.prices(spark.createDataFrame(rows, "symbol string, series string, date1 string, prev_close string, close_price string, ttl_trd_qnty string, turnover_lacs string")).collect()}
    assert got == {"A": (day(2024, 1, 2), "A", "EQ", 100.0, 101.5, 10.0, None, 1.5), "C": (day(2024, 1, 3), "C", "EQ", 0.0, 5.0, None, 1.0, None), "D": (None, "D", "EQ", None, 7.0, 1.0, 1.0, None), "E": (day(2024, 1, 3), "E", "EQ", 3.0, None, 1.0, 1.0, None)}


def test_documents(spark, sf):
    main = '{"filings": {"recent": {"accessionNumber": ["1", "2"], "filingDate": ["2024-01-01", ""], "items": ["1.01,9.01"]}}}'
    over = '{"accessionNumber": ["3"], "form": ["8-K"]}'
    got = {r.accessionNumber: r for r in X.shred_columnar(spark.createDataFrame([(1, main), (1, over)], "cik long, json string")).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].filingDate is None and got["2"]["items"] is None and got["3"].form == "8-K"
    facts = '{"facts": {"us-gaap": {"Rev": {"label": "Revenue", "units": {"USD": [{"start": "2020-01-01", "end": "2020-12-31", "val": 5, "accn": "a", "filed": "2021-01-01"}, {"end": "2020-12-31", "val": "n/a", "accn": "b", "filed": "2021-01-01"}]}}}}}'
    f = X.shred_facts(spark.createDataFrame([(1, facts)], "cik long, json string"))
    assert f.count() == 2 and X.bad_values(f).first()[0] == 1 and X.concepts(f).first().label == "Revenue" and f.where("val = 5").count() == 1
    xml = """<x xmlns:d="u"><context id="c1"><period><instant>2024-01-01</instant></period></context><context id="c2"><entity><explicitMember dimension="ax">mem</explicitMember></entity><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period></context>
    <unit id="u"><measure>INR</measure><measure>shares</measure></unit><d:A contextRef="c1" unitRef="u" decimals="2">5</d:A><d:B contextRef="c2">t</d:B><d:C contextRef="c2"> </d:C></x>"""
    rows = {r.tag: r for r in X.shred_xbrl(spark.createDataFrame([("t", "S", "C", "u", xml), ("t", "S", "C", "v", "<broken")], "filing_type string, source_symbol string, source_company string, xbrl_url string, xml string")).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].unit == "INR/shares" and rows["A"].period_instant == "2024-01-01" and rows["B"].dims == '{"ax": "mem"}' and rows["B"].period_end == "2023-12-31"
    page = """<html><title>T</title><h1>Acme</h1><ul id="top-ratios"><li><span class="name">Market Cap</span><span class="value">₹ <span class=number>1,721</span> Cr.</span><li><span class=name>Current Price</span><span class=value>₹ 99.5</span><li><span class=name>Stock P/E</span><span class=value>9.9</span><li><span class=name>High / Low</span><span class=value>₹ 120 / 80</span></ul>
    <section id=analysis><p>Makes &amp; sells<a href="https://a.org">l</a><a href="/x">m</a><div class=pros><ul><li>good<li> <li>cheap</ul></div><div class=cons><ul><li>debt</ul></div></section>
    <section id=shareholding><table><thead><tr><th><th>Mar 2023<th>Jun 2023<th>Sep 2023</tr></thead><tbody><tr><td>Promoters +<td>50%<td>52%<td>51.5%</tr><tr><td>FIIs<td>1%<td>x</tr></tbody></table><table><tr><td>a<td>b<td>c</table></section><table><tr><td>not<td>a ratio</table></html>"""
    docs = X.parse_dossiers(spark.createDataFrame([("A", "u", page), ("B", "v", None)], "id string, url string, html string"))
    got = {r.id: r for r in docs.collect()}
    d = got["A"]
    assert (d.name, d.about, d.links, d.pros, d.cons, d.ratios["Market Cap"]) == ("Acme", "Makes & sells l m", ["https://a.org"], ["good", "cheap"], ["debt"], "1721 Cr.")
    assert [(c.section, c.item, c.period, c.value) for c in d.cells][:3] == [("shareholding", "Promoters", p, v) for p, v in (("Mar 2023", "50%"), ("Jun 2023", "52%"), ("Sep 2023", "51.5%"))]
    assert got["B"].name == "B" and got["B"].cells == [] and got["B"].ratios == {}
    x = {r.symbol: r for r in X.dossier_drilldown(docs).collect()}
    assert (x["A"].market_cap, x["A"].high, x["A"].low, x["A"].eps, x["A"].promoter_pct, x["A"].promoter_change, x["A"].promoter_change_3yr, x["A"].fii_change, x["A"].as_of, x["A"].since) == ("1721 Cr.", 120.0, 80.0, 10.1, 51.5, -0.5, 1.5, None, "Sep 2023", "Mar 2023")
    assert x["B"].eps is None and x["B"].as_of is None and x["B"].market_cap is None
    grid = "<table>" + "".join(f"<tr><td>K{k}<td>{k}" for k in range(14)) + "</table><table><tr><td>news<td>headline</table><table><tr><th>Insider Trading<th>Relationship<th>Date<th>Transaction<th>Cost<th>#Shares<th>Value ($)<th>#Shares Total<tr><td>Ann<td>CEO<td>Jul 01<td>Proposed Sale<td>2.5<td>1,000<td>2,500<td>9</table>"
    one = spark.createDataFrame([("A", grid), ("B", None)], "symbol string, html string")
    assert {r.key for r in X.ratio_grid(one).collect()} == {f"K{k}" for k in range(14)}
    live = V.live_insiders(X.insider_grid(one)).collect()
    assert [(r.owner_name, r.shares, r.value_usd, r.is_proposed) for r in live] == [("Ann", 1000.0, 2500.0, True)]
    out = X.page_outline(spark.read.parquet(f"{sf}/pages.parquet"))
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and out.where("paragraphs > 0").count() > 0
    news = "<rss><channel><item><title>A &amp;amp; B</title><link>https://n.com/mkt/sub/story-12345678.html</link><pubDate>x</pubDate></item></channel></rss>"
    a = X.parse_news(spark.createDataFrame([("f", news), ("g", "<bad")], "file string, xml string")).collect()
    assert len(a) == 1 and (a[0].title, a[0].section, a[0].subsection, a[0].story_id, a[0].published) == ("A & B", "mkt", "sub", "12345678", None)
    site = '<u xmlns:n="news" xmlns:i="http://x/sitemap-image" xmlns:x="xhtml"><url><loc>https://n.com/a/b.html</loc><x:link rel="amphtml" href="https://n.com/amp"/><lastmod>2024-01-02T10:00:00+05:30</lastmod><n:news><n:publication><n:language>en</n:language></n:publication><n:title>T</n:title><n:keywords>k, l</n:keywords></n:news><i:image><i:loc>https://i.com/1</i:loc></i:image></url></u>'
    rss = "<rss><item><title>B</title><link>https://n.com/x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;c&lt;/b&gt; d</description></item></rss>"
    n = {r.title: r for r in X.parse_news(spark.createDataFrame([("s", site), ("r", rss)], "file string, xml string")).selectExpr("*", "unix_timestamp(lastmod) as m", "unix_timestamp(published) as p").collect()}
    assert (n["T"].language, n["T"].keywords, n["T"].image_url, n["T"].amp_url, n["T"].section, n["T"].link, n["T"].m) == ("en", "k, l", "https://i.com/1", "https://n.com/amp", "a", "https://n.com/a/b.html", 1704169800)
    assert (n["B"].p, n["B"].description, n["B"].section) == (1704189600, "c d", None)
    trades = "<div id='trades-insider-trades'><table><tr><th>P<th>Q<th>A<th>V<tr><td>Jan 2024</td></tr><tr><td>Ann <span>Promoter</span></td><td>-1,000</td><td>5.5</td><td>1</td></tr><tr><td>soon<tr><td>Bob</td><td></td><td>6</td><td>x</td></tr></table></div><table><tr><td>a<td>1<td>2<td>3</table>"
    t = X.trade_rows(spark.createDataFrame([("A", trades), ("B", None)], "symbol string, html string")).orderBy("at").collect()
    assert [tuple(r)[2:] for r in t] == [(day(2024, 1, 1), "Ann", "Promoter", "Sell", -1000.0, 5.5, 1.0), (None, "Bob", None, None, None, 6.0, None)]


def test_stores(spark, tmp_path):
    p = f"{tmp_path}/store"
    new = lambda rows: spark.createDataFrame(rows, "as_of date, symbol string, v double")
    first = [(day(2024, 1, 1), "A", 1.0), (day(2024, 1, 1), "A", 3.0)]
    for _ in range(2):  # again changes nothing
        K.accrue(spark, p, new(first), ["as_of", "symbol"], "v")
    assert [tuple(r) for r in K.published(spark, p).collect()] == [(day(2024, 1, 1), "A", 3.0)]
    K.accrue(spark, p, new([(day(2024, 1, 1), "B", 9.0), (day(2024, 1, 2), "B", 9.0)]), ["as_of", "symbol"], "v", "as_of")
    assert K.published(spark, p).count() == 2
    assert K.union_never_shrink(spark, p, new([(day(2024, 1, 1), "A", 3.0)])) == 2
    rows = spark.createDataFrame([("01-Jan-2024", "u1"), ("01-Jan-2024", "u1"), ("bad", "u2"), ("02-Jan-2024", ""), ("02-Jan-2024", "")], "d string, url string")
    bad = B.split_by_day(rows, f"{tmp_path}/days", F.try_to_date("d", "dd-MMM-yyyy"), "url").first()[0]
    assert bad == 1 and B.stored_days(spark, f"{tmp_path}/days").count() == 2
    more = spark.createDataFrame([("02-Jan-2024", ""), ("02-Jan-2024", "u3"), ("03-Jan-2024", "u3")], "d string, url string")
    B.split_by_day(more, f"{tmp_path}/days", F.try_to_date("d", "dd-MMM-yyyy"), "url")
    assert sorted((r.d, r.url) for r in B.stored_days(spark, f"{tmp_path}/days").collect()) == [("01-Jan-2024", "u1"), ("02-Jan-2024", ""), ("02-Jan-2024", "u3"), ("03-Jan-2024", "u3")]
    d = f"{tmp_path}/by-day"
    for rows in (first, [(day(2024, 1, 1), "A", 2.0), (day(2024, 1, 2), "A", 5.0)], [(day(2024, 1, 2), "A", 7.0)]):
        B.accrue_days(spark, d, new(rows), ["as_of", "symbol"], "v", "as_of")
    assert sorted((r.as_of, r.v) for r in B.stored_days(spark, d).collect()) == [(day(2024, 1, 1), 3.0), (day(2024, 1, 2), 7.0)]
    K.write_clustered(spark.range(100).withColumn("k", F.col("id") % 7), f"{tmp_path}/c", ["k"], 3)
    assert spark.read.parquet(f"{tmp_path}/c").count() == 100
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_text("1")
    (tmp_path / "f/b").write_text("2")
    led = spark.createDataFrame(G.file_ledger(spark, f"{tmp_path}/f", None).toPandas())
    (tmp_path / "f/a").write_text("changed")
    (tmp_path / "f/c").write_text("3")
    assert {r.path[-1]: r.status for r in G.file_ledger(spark, f"{tmp_path}/f", led).collect()} == {"a": "changed", "b": "same", "c": "new"}
    m = spark.createDataFrame([("x/f01022024.csv", bytearray(b"1")), ("y/f01022024.csv", bytearray(b"1")), ("__MACOSX/._f", bytearray(b"z"))], "member string, content binary")
    assert [(r.as_of, r.name) for r in K.member_days(m).collect()] == [(day(2024, 2, 1), "f01022024.csv")]
    root = f"{tmp_path}/snap"
    for k in (1, 2):
        assert set(K.snapshot_publish(spark, root, {"t": spark.range(k), "bad": spark.range(1).selectExpr("raise_error('no') as x")}, f"s{k}")) == {"bad"}
    assert K.snapshot_read(spark, root, "t").count() == 2 and K.snapshot_read(spark, root, "t", 1).count() == 1
    with pytest.raises(FileNotFoundError):
        K.snapshot_read(spark, root, "t", 0)


def test_stores_survive_a_crash(spark, tmp_path, monkeypatch):
    """A writer that dies before its last step changes nothing for readers, and the next one goes on."""
    p, root = f"{tmp_path}/store", f"{tmp_path}/snap"
    K.publish(spark.range(3), p)
    monkeypatch.setattr(K, "_fs", lambda *_: (_ for _ in ()).throw(OSError("dead")))
    with pytest.raises(OSError):
        K.publish(spark.range(9), p)
    monkeypatch.undo()
    spark.range(9).write.parquet(f"{p}/state-orphan")
    assert K.published(spark, p).count() == 3
    for n in (4, 5, 6):
        K.publish(spark.range(n), p)
    assert K.published(spark, p).count() == 6 and len([x for x in (tmp_path / "store").iterdir() if x.name.startswith("state-")]) <= 3
    assert K.published(spark, f"{tmp_path}/none") is None
    K.snapshot_publish(spark, root, {"t": spark.range(1)}, "a")
    spark.range(7).write.parquet(f"{root}/t/v-orphan")
    assert K.snapshot_publish(spark, root, {"t": spark.range(2)}, "b") == {} and K.snapshot_read(spark, root, "t").count() == 2


def test_merge_ties(spark):
    """Rows that tie by the metric fall to their content, whichever came first."""
    rows = [("k", 1.0, "a"), ("k", 1.0, "b"), ("k", None, "c")]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "k string, v double, w string").repartition(3)
        assert [x.w for x in K.merged(None, df, ["k"], [F.col("v").desc_nulls_last()]).collect()] == ["b"]


def test_histories(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [("u", t("2024-01-01T10:00:00"), t("2024-01-01T11:00:00"), "old", day(2024, 1, 1), "today", None), ("u", t("2024-01-01T09:00:00"), t("2024-01-02T11:00:00"), "new", day(2024, 1, 2), "yesterday", "mkt")]
    h = D.news_history(spark.createDataFrame(rows, "url string, published timestamp, lastmod timestamp, title string, snap date, shard string, section string")).first()
    assert (h.title, h.revisions, h.shard, h.section, h.first_seen) == ("new", 2, "yesterday", "mkt", day(2024, 1, 1)) and h.published == t("2024-01-01T09:00:00")
    rows = [("Acme Ltd", "31-Mar-2024", "bad", "1,000.5", "b"), (" Acme LIMTED", "2024-03-31", "05-Apr-2024 10:00", "-", "a"), ("", "31-Mar-2024", "", "1", "c"), ("X", "?", "", "1", "d")]
    index = A.shareholding_index(spark.createDataFrame(rows, "`COMPANY NAME` string, `AS ON DATE` string, `SUBMISSION DATE` string, `PROMOTER & PROMOTER GROUP (A)` string, file_path string"))
    assert sorted((r.company, r.promoter_pct) for r in index.collect()) == [("Acme LIMTED", None), ("Acme Ltd", 1000.5)]
    best = A.shareholding_store(index, spark.createDataFrame([("ACME", "AC")], "key string, symbol string")).collect()
    assert [(r.symbol, r.company, r.submission_date) for r in best] == [("AC", "Acme LIMTED", day(2024, 4, 5))]


def _feed(spark, folder, batches, schema):
    """One file a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in pathlib.Path(folder).glob("*.parquet"):
            if not f.name.startswith("b"):
                f.rename(f.with_name(f"b{k}.parquet"))
                os.utime(f.with_name(f"b{k}.parquet"), (1_600_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _t(text):
    return dt.datetime.fromisoformat(text)


def test_sessions_are_appended_when_their_day_has_passed(spark, tmp_path):
    """A late row is dropped, closed days leave the state, and what comes out equals the batch query up to the watermark."""
    days = [[(_t(f"2024-01-{3 * k + j:02}T{h:02}:00:00"), e) for j in (1, 2, 3) for h in (3, 20) for e in ("a", "b")] for k in range(4)]
    days[2].append((_t("2024-01-01T05:00:00"), "a"))  # its day has closed
    src = _feed(spark, f"{tmp_path}/in", days, "ts timestamp, event_type string")
    q = J.append_to(J.session_counts(src), f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    ev = spark.read.parquet(f"{tmp_path}/in").where("ts <> '2024-01-01 05:00:00'")
    batch = ev.groupBy(F.to_date("ts").alias("as_of"), "event_type").agg(F.count("*").alias("n")).where("as_of + interval 1 day <= timestamp'2024-01-12 19:00:00'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 22
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(x["numRowsTotal"] for x in state) <= 8 and state[-1]["numRowsTotal"] == 2 and sum(x["numRowsDroppedByWatermark"] for x in state) == 1


def test_session_counts_leave_no_row_out(spark, tmp_path):
    """Late rows, days still open and rows without a time are counted, over several batches and by the query."""
    days = [[(_t("2024-01-05T10:00:00"), "a")] * 3, [(_t("2024-01-09T23:30:00"), "b")], [(_t("2024-01-05T23:59:59"), "a"), (_t("2024-01-01T00:00:00"), "c"), (None, "a"), (_t("2024-01-09T01:00:00"), None)]]
    src = _feed(spark, f"{tmp_path}/events.parquet", days, "ts timestamp, event_type string")
    J.publish_states(J.session_counts(src, late=None), f"{tmp_path}/store", f"{tmp_path}/c").awaitTermination()
    want = [("2024-01-01", "c", 1), ("2024-01-05", "a", 4), ("2024-01-09", "None", 1), ("2024-01-09", "b", 1), ("None", "a", 1)]
    for got in (K.published(spark, f"{tmp_path}/store"), N.session_counts(spark, str(tmp_path))):
        assert sorted((str(r.as_of), str(r.event_type), r.n) for r in got.collect()) == want


def test_stories_are_forgotten_after_their_watermark(spark, tmp_path):
    link = lambda k, *days: [(f"l{k}", _t(f"2024-01-{x:02}T00:00:00")) for x in days]
    batches = [link(0, 1) + link(1, 2, 2), link(0, 2) + link(2, 9), link(3, 14), link(0, 20) + link(1, 5) + link(2, 13)]
    src = _feed(spark, f"{tmp_path}/in", batches, "link string, published timestamp")
    q = J.append_to(J.dedup_news(src, late="2 days"), f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination()
    got = sorted((r.link, r.published.day) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # l0 comes again after it was forgotten; l1 of the 5th and l2 of the 13th lie before or within what is known
    assert got[:2] == [("l0", 1), ("l0", 20)] and [x for x in got if x[0] in ("l1", "l3")] == [("l1", 2), ("l3", 14)]
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(state) <= 4 and state[-1] <= 2


def test_batches_go_into_a_day_store_once(spark, tmp_path, monkeypatch):
    """A crash between the days and the list leaves the old store; the batch runs again; days that it doesn't touch keep their files."""
    rows = [[(k, "2024-01-01", 1.0), (k, "2024-01-02", 2.0 + k)] for k in range(2)] + [[(0, "2024-01-02", 9.0), (7, "2024-01-03", 1.0), (8, None, 3.0)]]
    src = _feed(spark, f"{tmp_path}/in", rows, "k int, as_of string, v double")
    run = lambda: J.accrue_stream(src, f"{tmp_path}/store", f"{tmp_path}/c", ["k"], "v", "as_of").awaitTermination()
    real, calls = K.publish, []

    def dies(df, path, keep=2):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("dead")
        return real(df, path, keep)

    monkeypatch.setattr(K, "publish", dies)
    with pytest.raises(Exception, match="dead"):
        run()
    files = lambda d: {p.name for p in pathlib.Path(tmp_path / "store").glob(f"load=*/as_of={d}/*.parquet")}
    stored = lambda: sorted((r.k, r.as_of or "", r.v) for r in B.stored_days(spark, f"{tmp_path}/store").collect())
    assert stored() == [(0, "2024-01-01", 1.0), (0, "2024-01-02", 2.0), (1, "2024-01-01", 1.0), (1, "2024-01-02", 3.0)]
    first = {r["at"] for r in B.listed(spark, f"{tmp_path}/store") if r["name"] == "as_of=2024-01-01"}
    run()
    want = [(0, "2024-01-01", 1.0), (0, "2024-01-02", 9.0), (1, "2024-01-01", 1.0), (1, "2024-01-02", 3.0), (7, "2024-01-03", 1.0), (8, "", 3.0)]
    assert stored() == want and first == {r["at"] for r in B.listed(spark, f"{tmp_path}/store") if r["name"] == "as_of=2024-01-01"}
    count = len(calls)
    run()  # nothing new
    assert stored() == want and len(calls) == count and len(files("2024-01-03")) == 1
    df = spark.createDataFrame([(5, "2024-01-03", 1.0)], "k int, as_of string, v double")
    batch = next((r["name"], r["n"]) for r in B.listed(spark, f"{tmp_path}/store") if r["kind"] == "batch")
    assert not B.accrue_days(spark, f"{tmp_path}/store", df, ["k"], "v", "as_of", batch) and stored() == want
    assert B.accrue_days(spark, f"{tmp_path}/store", df.limit(0), ["k"], "v", "as_of", (batch[0], batch[1] + 1)) and stored() == want
    assert B.stored_days(spark, f"{tmp_path}/none") is None


def test_outlines_keep_references_without_their_end(spark):
    from tapewright.plans.registry import oracle_sql

    cut = "<html><title>A &amp; b&&&amp</title><svg><title>icon</title></svg><h1>x &lt;y&gt;&amp</h1><a href='?p=1&amp=2&copy=3'>z</a><p>&ampere &amp</p></html>"
    pages = [(1, "u", cut), (2, "v", "<title>&quot;q&quot; &lt</title><p>&amp;amp; &#65"), (3, "w", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in X.page_outline(df).collect())
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", pages)
    assert got == sorted(c.execute(oracle_sql()["page_outline"]).fetchall()) and got[0][2:] == ("A & b&&&amp", "x <y>&amp", 1, 1)


def test_days_to_cover_above_the_sentinel_are_measurements(spark):
    days = [999.98, 999.99, 1000.0, 4500.0, 0.0, None, float("nan"), float("inf")]
    si = spark.createDataFrame([(x,) for x in days], "days_to_cover double")
    assert [r[0] for r in V.short_interest_view(si).collect()] == [999.98, None, 1000.0, 4500.0, 0.0, None, None, None]


@pytest.mark.parametrize("name", ["short_interest", "us_finra_short_interest"])
def test_months_of_a_thousand_orders_have_days_to_cover(spark, tmp_path, name):
    from tapewright.plans.registry import oracle_sql, queries

    spark.range(3).selectExpr("id as c_custkey", "cast(id as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    month = "timestamp'2024-01-05' + make_dt_interval(31 * cast(id % 2 as int))"  # 1,500 orders each, 2,100 (300 sevens) of the third nation
    n = {0: 3_000, 1: 1_998, 2: 4_200}
    orders = [f"select id as o_orderkey, {k}L as o_custkey, 10.5D as o_totalprice, {month} as o_orderdate from range({m})" for k, m in n.items()]
    spark.sql(" union all ".join(orders)).write.parquet(f"{tmp_path}/orders.parquet")
    df = queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = c.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(x.isoformat() if hasattr(x, "isoformat") else x for x in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(x.isoformat() if hasattr(x, "isoformat") else x for x in r) for r in df.select(*cols).collect()), key=repr) == want
    assert sorted(r[0] or 0 for r in df.select("days_to_cover").collect()) == [0, 0, 999, 999, 1500, 1500]


@pytest.mark.parametrize("name", ["shareholding_quarters", "promoter_history"])
def test_holdings_of_companies_with_six_digits(spark, tmp_path, name):
    from tapewright.plans import archive_queries  # noqa: F401  they register themselves
    from tapewright.plans.registry import oracle_sql, queries

    keys = "explode(array(10000L, 10001L, 12345L, 12346L, 100002L, 100003L, 100008L, 100010L, 123456L, 123457L, 1234563L))"  # 100002 begins with 10000, which has a symbol
    spark.sql(f"select {keys} as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    dates = "timestamp'2024-01-05' + make_dt_interval(40 * k)"
    spark.sql(f"select row_number() over (order by o_custkey, k) as o_orderkey, *, substring('OFP', 1 + k % 3, 1) as o_orderstatus, {dates} as o_orderdate from (select {keys} as o_custkey, k from (select explode(sequence(0, 5)) as k))").write.parquet(f"{tmp_path}/orders.parquet")
    df = queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = c.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(x.isoformat()[:10] if hasattr(x, "isoformat") else x for x in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(x.isoformat()[:10] if hasattr(x, "isoformat") else x for x in r) for r in df.select(*cols).collect()), key=repr)
    assert got == want and {r[0] for r in got} - {None} == {f"S{k}" for k in (10000, 10001, 12346, 100003, 100010, 123457)}


def test_a_name_known_without_a_symbol_has_none(spark):
    bridge = spark.createDataFrame([("GLOBALSTEELWORKS", "GSW"), ("GLOBALSTEELWORKSOLD", None)], "key string, symbol string")
    names = spark.createDataFrame([("Globalsteelworks Old Ltd",), ("Globalsteelworks Older",), ("Globalsteelworks",)], "name string")
    assert {r.name: r.symbol for r in D.resolve_names(names, bridge).collect()} == {"Globalsteelworks Old Ltd": None, "Globalsteelworks Older": "GSW", "Globalsteelworks": "GSW"}


def test_rows_of_large_pages_are_handed_on_as_they_end(monkeypatch):
    import tracemalloc

    n = 30_000
    trades = "<table><tr><td>o</table><div id='trades-insider-trades'><table>" + "".join(f"<tr><td>P{k} <span>c</span></td><td>{k}</td><td>1</td><td>2</td></tr>" for k in range(n)) + "</table></div>"
    grid = "<table><tr><td>news</table><table><tr><th>Insider Trading<th>Cost" + "".join(f"<tr><td>P{k}<td>{k:,}" for k in range(n)) + "</table>"
    named = X._Named("trades-insider-trades")
    assert X._which(named, trades) == 1 and X._which(X._Headed("Insider Trading"), grid) == 1
    monkeypatch.setattr(X, "_PART", 1 << 15)
    for rows in (X.table_rows(trades, 1), X.insider_rows(grid)):
        tracemalloc.start()
        count, last = 0, None
        for last in rows:
            count += 1
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n and peak < 12e6  # the whole tree takes more than 50 MB
    assert last == {"insider_trading": f"P{n - 1}", "cost": str(n - 1)}


def test_rows_in_parts_equal_those_of_the_tree(monkeypatch):
    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>Insider Trading<th>Date", "x y", " a < b ", "&amp", "<br>", "<span>s</span>", "<div id='i'>", "</div>", "<tbody>", "<script>'<tr>'</script>", "<!-- <td> -->", '<td title="a<b>c">', "<p>", "<tr/>", "<", "<td title = 'q", "<!--"]
    monkeypatch.setattr(X, "_PART", 5)
    shown = lambda rows: [[(c.tag, c.text(), c.text("span")) for c in r] for r in rows]
    for _ in range(1_500):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        tables = list(X.parse_page(page).all("table"))
        assert [shown(X.table_rows(page, k)) for k in range(len(tables))] == [shown(X.grid(t)) for t in tables]
        inside, headed = [k for k, t in enumerate(tables) if t.inside(id_="i")], [k for k, t in enumerate(tables) if any(c.text() == "Insider Trading" for c in next(iter(X.grid(t)), []))]
        assert (X._which(X._Named("i"), page), X._which(X._Headed("Insider Trading"), page)) == (next(iter(inside), None), next(iter(headed), None))


@pytest.mark.parametrize("name", ["trade_page_rows", "insider_grid"])
def test_pages_do_not_grow_with_events(spark, tmp_path, monkeypatch, name):
    from tapewright.plans import archive_queries as Y

    spark.range(60_000).selectExpr("id as event_id", "timestamp'2024-01-05' as ts", "7L as user_id", "'click' as event_type", "1.5D as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    seen, op = [], {"trade_page_rows": "trade_rows", "insider_grid": "insider_grid"}[name]
    real = getattr(X, op)
    monkeypatch.setattr(Y.X, op, lambda pages: (seen.append(pages), real(pages))[1])
    assert getattr(Y, name)(spark, str(tmp_path)).count() == 60_000
    assert seen[0].count() == 6 and seen[0].agg(F.max(F.length("html"))).first()[0] < 2_500_000

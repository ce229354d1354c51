"""Registered queries over files of many shapes: headers in several orders, archives read by byte ranges. Files are written from the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import archives as A
from ..operators import sinks as K
from ..operators import views as V
from ..sources import archive_ranges as Z
from ..sources import headers as H
from ..sources import readers as R
from ..sources import rejects as C
from ..sources import standins as S
from .archive_queries import _HAS_MAIN, _joined, _submission_docs, _xbrl
from .registry import query


def _lines(df: DataFrame, path: str, head: list[str], sep: str = ",", key: str | None = None) -> None:
    """df as separated lines under path, every file headed by the lines `head`; with `key`, one file for each of its values."""
    cols = [c for c in df.columns if c != key]
    body = df.select(F.col(key).alias("k") if key else F.spark_partition_id().alias("k"), F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value"))
    body = body.groupBy("k").agg(F.concat_ws("\n", F.array_append(F.array(*[F.lit(h) for h in head]), F.array_join(F.sort_array(F.collect_list("value")), "\n"))).alias("value"))
    body.repartition("k").write.partitionBy("k").text(path)


@query("select case when user_id % 3 = 0 then 'User ID|Type' when user_id % 3 = 1 then 'Type|User ID' else 'USER' || chr(10) || 'ID|Type' end as header, count(distinct ts::date) as files from events group by all")
def header_catalogue(s, d):
    """Files of three shapes a day: two orders, one with a byte order mark, and a header that goes on over lines after a blank one."""
    root = scratch(s, "headers")
    e = S.table(s, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    _lines(e.where("user_id % 3 = 0").select("user_id", "event_type", "day"), f"{root}/a", ["﻿User ID,Type"], key="day")
    _lines(e.where("user_id % 3 = 1").select("event_type", "user_id", "day"), f"{root}/b", ["Type,User ID"], key="day")
    _lines(e.where("user_id % 3 = 2").select("user_id", "event_type", "day"), f"{root}/c", ["", '"USER\nID",Type'], key="day")
    return H.headers(s, f"{root}/*/*/*.txt").groupBy(F.array_join("header", "|").alias("header")).agg(F.count("*").alias("files"))


@query("select as_of, symbol, short_volume, total_volume, case when day(as_of) % 2 = 0 then 'Q' end as markets from sv")
def scan_short_volume(s, d):
    """Days of two shapes: columns in another order, one less, symbols in lower case with spaces; each day ends with a summary line."""
    root = scratch(s, "short-volume")
    v = S.short_volume(s, d).withColumn("day", F.date_format("as_of", "yyyyMMdd"))
    symbol, sv, total = F.upper("symbol").alias("symbol"), F.col("short_volume").cast("string"), F.col("total_volume").cast("string")
    summary = v.select("day").distinct()
    even = v.where("day(as_of) % 2 = 0").select(F.col("day").alias("Date"), symbol, sv, F.lit("0").alias("exempt"), total, F.lit("Q").alias("m"), "day")
    odd = v.where("day(as_of) % 2 = 1").select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"), total, F.col("day").alias("Date"), sv, F.lit("0").alias("exempt"), "day")
    end = summary.where("day % 2 = 0").select(F.lit("9"), F.lit(""), F.lit(""), F.lit(""), F.lit("12"), F.lit(""), "day")
    _lines(even.union(end), f"{root}/even", ["Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market"], "|", "day")
    _lines(odd, f"{root}/odd", ["Symbol|TotalVolume|Date|ShortVolume|ShortExemptVolume"], "|", "day")
    t = R.scan_short_volume(s, f"{root}/*/*/*.txt").select("as_of", "symbol", "short_volume", "total_volume", "markets")
    return t.withColumn("symbol", F.initcap("symbol"))


@query("select symbol, settlement_date::varchar as settlement_date, short_interest from si where short_interest is not null")
def scan_short_interest(s, d):
    """Of a feed that lacks most columns, those it has, from files of two shapes."""
    root = scratch(s, "short-interest")
    si = S.short_interest(s, d).where("short_interest is not null")
    symbol, day, held = F.col("symbol").alias("symbolCode"), F.col("settlement_date").alias("settlementDate"), F.col("short_interest").cast("decimal(20,2)").cast("string").alias("currentShortPositionQuantity")
    si.where("day(settlement_date) > 15").select(symbol, day, held).write.option("header", True).option("sep", "|").csv(f"{root}/a")
    si.where("day(settlement_date) <= 15").select(day, F.lit("x").alias("issueName"), held, symbol).write.option("header", True).option("sep", "|").csv(f"{root}/b")
    df, missing = R.scan_short_interest(s, f"{root}/*/*.csv")
    held = df.select(F.initcap("symbol").alias("symbol"), "settlement_date", F.col("short_interest").cast("double").alias("short_interest"))
    return held if "issueName" not in missing and "marketClassCode" in missing else held.limit(0)


@query("""select 'Brand#' || (user_id % 25 + 1)::varchar as symbol, 'Company ' || user_id::varchar as company, 'u' || event_id::varchar || '.xml' as url from events where event_id % 3 > 0""")
def scan_index_csv(s, d):
    """Indexes of two shapes whose headers hold line feeds, and one without a column for documents; rows without an XML document go."""
    root, e = scratch(s, "index"), S.table(s, d, "events")
    url = _joined("u", F.col("event_id"), F.when(F.col("event_id") % 3 > 0, ".xml").otherwise(".pdf"))
    symbol, company = _joined("Brand#", F.col("user_id") % 25 + 1), _joined("Company ", F.col("user_id"))
    put = lambda df, at: df.write.option("header", True).option("quoteAll", True).csv(f"{root}/{at}")
    put(e.where("user_id % 2 = 0").select(symbol.alias("SYMBOL \n"), company.alias("COMPANY\nNAME"), url.alias("XBRL\nLINK")), "a")
    put(e.where("user_id % 2 = 1").select(company.alias("﻿NAME OF\nCOMPANY"), F.lit("x").alias("DATE"), url.alias("** XBRL"), symbol.alias("Symbol")), "b")
    put(e.limit(5).select(symbol.alias("SYMBOL")), "c")
    return R.scan_index_csv(s, f"{root}/*/*.csv", {"symbol": "symbol", "company": "company", "url": "xbrl"}).select("symbol", "company", "url")


def _archives(rows: DataFrame, path: str, inner: str | None = None) -> None:
    """rows(archive, member, body) as one zip archive for each value of archive under path, members of the kind `inner` gzipped."""
    import gzip

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, body in sorted(zip(t["member"], t["body"])):
                data = body.encode()
                z.writestr(m, gzip.compress(data) if inner and m.endswith(inner) else data)
        return pd.DataFrame({"name": [str(t["archive"].iloc[0])], "content": [out.getvalue()]})

    Z.write_files(rows.groupBy("archive").applyInPandas(pack, "name string, content binary"), path)


@query("select 'a' || (o_custkey // 100)::varchar as archive, 'x/CIK' || o_custkey::varchar || '.txt' as member, length(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as bytes, md5(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as md5 from orders group by o_custkey")
def scan_zip_members(s, d):
    """Archives of a hundred filers each, with members that aren't asked for, read by the byte ranges of their directories."""
    root = scratch(s, "archives")
    per = S.table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("body"))
    archive = _joined("a", F.expr("o_custkey div 100"))
    rows = per.select(archive.alias("archive"), _joined("x/CIK", F.col("o_custkey"), ".txt").alias("member"), "body")
    _archives(rows.unionByName(rows.select("archive", F.concat(F.lit("y/"), "member").alias("member"), F.lit("not asked for").alias("body"))), root)
    t = R.scan_zip_members(s, f"{root}/*/*.txt", r"x/.*\.txt")
    return t.select(F.regexp_extract("zip", "name=([^/]+)/", 1).alias("archive"), "member", F.length("content").cast("long").alias("bytes"), F.md5("content").alias("md5"))


@query(f"select o_custkey::varchar as cik, o_orderkey::varchar as accn, case when o_orderstatus = 'F' then '8-K' else '10-Q' end as form, o_orderdate::date as filed from orders where {_HAS_MAIN}")
def submissions_archive(s, d):
    """F6 from its archives: main and overflow documents are members, found by directory and read in place."""
    root = scratch(s, "submissions")
    docs = _submission_docs(s, d)
    archive = F.substring(F.regexp_extract("member", "CIK([0-9]+)", 1), 1, 8)  # a hundred filers
    _archives(docs.select(archive.alias("archive"), "member", F.col("json").alias("body")), root)
    t = R.scan_zip_members(s, f"{root}/*/*.txt", r".*\.json").select("member", F.col("content").cast("string").alias("json"))
    return V.filing_list(A.submissions_tables(t)[1]).select("cik", "accn", "form", "filed")


@query("select day as as_of, count(*) as members, sum(length(event_type) + 1)::bigint as bytes from (select distinct ts::date as day, event_type from events) group by day")
def archive_members(s, d):
    """Members by the day in their name, through archives in archives and gzip: sidecar files go, repeats count once."""
    root = scratch(s, "day-archives")
    e = S.table(s, d, "events").select(F.date_format("ts", "ddMMyyyy").alias("day"), "event_type").distinct()
    name, body, month = _joined("f", F.col("day"), F.col("event_type"), ".csv"), _joined("x", F.col("event_type")), F.substring("day", 3, 6)
    rows = e.select(month.alias("archive"), _joined("a/", name, ".gz").alias("member"), body.alias("body"))
    for folder in ("b/", "__MACOSX/._"):
        rows = rows.unionByName(e.select(month.alias("archive"), _joined(folder, name, ".gz" if folder == "b/" else "").alias("member"), body.alias("body")))
    _archives(rows, root, ".gz")
    members = R.unzipped(R.scan_zip_members(s, f"{root}/*/*.txt"))
    return K.member_days(members).groupBy("as_of").agg(F.count("*").alias("members"), F.sum(F.length("content")).alias("bytes"))


@query("""select 'csv' as kind, case when event_id % 5 = 0 then 'not 3 fields' when event_id % 7 = 0 then 'not 3 fields' else 'none' end as reason, count(*) as records from events group by all
union all select 'json', case when n_nationkey % 4 = 0 then 'not JSON' when n_nationkey % 4 = 1 then 'no object' else 'none' end, count(*) from nation group by all
union all select 'xml', case when event_id % 11 = 0 then 'no document' when event_id % 9 = 0 then 'not XML' else 'none' end, count(*) from events group by all""")
def rejected_records(s, d):
    """Records taken and rejected, by reason, of lines, documents and filings: together as many as went in."""
    root, e = scratch(s, "checked"), S.table(s, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, _joined(F.col("event_id"), ",short")).when(F.col("event_id") % 7 == 0, _joined(F.col("event_id"), ",too,many,fields"))
    _lines(e.select(F.coalesce(line, _joined(F.col("event_id"), ",", F.col("event_type"), ",x")).alias("line"), F.date_format("ts", "yyyyMM").alias("m")), f"{root}/csv", ["id,type,more"], key="m")
    n = S.table(s, d, "nation")
    body = F.when(n["n_nationkey"] % 4 == 0, F.lit('{"name": ')).when(n["n_nationkey"] % 4 == 1, F.lit("[1]")).otherwise(F.to_json(F.struct(F.col("n_name").alias("name"))))
    n.select(F.col("n_nationkey").alias("k"), body.alias("value")).repartition("k").write.partitionBy("k").text(f"{root}/json")
    index, docs = _xbrl(s, d)
    rows, bad = C.csv_checked(s, f"{root}/csv/*/*.txt")
    docs_in, docs_bad = C.json_checked(s, f"{root}/json/*/*.txt", "name string")
    facts, filings_bad = A.filing_facts(A.filing_jobs(index), docs)
    told = lambda kind, ok, rejected: ok.agg(F.lit("none").alias("reason"), F.count("*").alias("records")).unionByName(rejected.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("records"))).select(F.lit(kind).alias("kind"), "reason", "records")
    return told("csv", rows, bad).unionByName(told("json", docs_in.where("name is not null"), docs_bad)).unionByName(told("xml", facts.select("filing_type", "xbrl_url").distinct(), filings_bad))

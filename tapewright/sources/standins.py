"""Market inputs derived from the star-schema tables, so that every operator runs over data that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import scratch

PURPOSES = [
    "DIVIDEND - RS 2 PER SHARE", "INTEREST PAYMENT", "FACE VALUE SPLIT FROM RS 10 TO RS 2", "BONUS 1:1", "RIGHTS 3:10", "BUYBACK",
    "ANNUAL GENERAL MEETING", "SCHEME OF ARRANGEMENT", "BUY BACK OF SHARES", "SPDV - RS 4", "RECORD DATE", "INTDIV - RS 1",
]
ITEM_CODES = ["1.01", "2.02", "5.02", "7.01", "8.01", "9.01", "4.02", "2.05", "3.99"]
PLAN_TEXTS = ["1", "0", "true", "false", ""]
DIMS = ["promoter", "fii", "dii"]
CONCEPTS = [
    "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "EarningsPerShareDiluted",
    "EarningsPerShareBasicAndDiluted", "NetCashProvidedByUsedInOperatingActivities", "Assets", "Liabilities", "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, as_of, open, high, low, close, volume: trades are line items, a symbol is a brand."""
    li = table(spark, sf, "lineitem").where("l_quantity > 0")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    t = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("as_of"), px.alias("px"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )
    return t.groupBy("symbol", "as_of").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume")
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    brands = table(spark, sf, "part").select("p_brand", k.alias("k")).distinct()
    return brands.select(F.col("p_brand").alias("symbol"), F.expr("date_add(date'1998-01-01', 30 * k)").alias("effective_date"), (F.lit(1.0) / (1 + F.col("k") % 4)).alias("ratio"), F.lit("confirmed").alias("confidence"))


def masters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_brand").alias("symbol"),
        _pick(["EQ", "SM", "ST", "BE", "GB"], (F.col("p_partkey") % 5).cast("int")).alias("series"),
        F.when(F.col("p_partkey") % 7 == 0, "Y").otherwise("N").alias("delflg"),
        F.expr("date_add(date'2024-01-01', cast(p_partkey % 3 as int))").alias("folder"), F.concat(F.lit("IN"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("isin"),
    )


def bars_once(spark: SparkSession, sf: str) -> DataFrame:
    """bars(), written for queries that read them several times."""
    path = scratch(spark, "bars")
    b = bars(spark, sf)
    b.write.parquet(path)
    return spark.read.schema(b.schema).parquet(path)


def extremes(spark: SparkSession, sf: str, high: bool, b: DataFrame | None = None) -> DataFrame:
    """symbol, series, event_date, price, folder: running 252-session records of bars, listed again with a restated price up to two days later."""
    b = bars(spark, sf) if b is None else b
    w = W.partitionBy("symbol").orderBy("as_of").rowsBetween(-251, 0)
    side, best = ("high", F.max("high")) if high else ("low", F.min("low"))
    ev = b.withColumn("best", best.over(w)).where(F.col(side) == F.col("best"))
    lists = F.sequence(F.lit(0), F.dayofmonth("as_of") % 3)
    ev = ev.select("symbol", F.lit("EQ").alias("series"), F.col("as_of").alias("event_date"), F.col(side).alias("p"), F.explode(lists).alias("k"))
    return ev.select("symbol", "series", "event_date", (F.col("p") - F.col("k")).alias("price"), F.expr("date_add(event_date, k)").alias("folder"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    codes = lambda m: _pick(ITEM_CODES, (F.col("o_orderkey") % m % len(ITEM_CODES)).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("accn"), (F.col("o_custkey") % 25).alias("cik"), F.when(F.col("o_orderstatus") == "F", "8-K").otherwise("10-Q").alias("form"), day.alias("filed"),
        F.expr("timestampadd(SECOND, cast(o_orderkey * 37 % 86400 as int), cast(to_date(o_orderdate) as timestamp))").alias("accepted"), F.date_sub(day, 3).alias("period"),
        F.concat(codes(9), F.lit(","), codes(7)).alias("items"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("document"),
    )


def cik_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Filers with comma lists of tickers; the filer of brand k is k mod 25, plus a class line for some."""
    k = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long")
    b = table(spark, sf, "part").select("p_brand").distinct().withColumn("k", k)
    return b.select((F.col("k") % 25).alias("cik"), F.concat(F.lit("Filer "), "p_brand").alias("name"), F.when(F.col("k") % 3 == 0, F.concat_ws(",", F.concat("p_brand", F.lit(".B")), "p_brand")).otherwise(F.col("p_brand")).alias("tickers"), F.lit("Nasdaq").alias("exchanges"), F.concat(F.lit("Sector "), (F.col("k") % 4).cast("string")).alias("sic_description"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter facts of every order, and a year-long twin for every third; equal keys are restatements."""
    o = table(spark, sf, "orders").where("o_totalprice is not null")
    q = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    y = F.to_date(F.date_trunc("year", "o_orderdate"))
    base = [F.col("o_custkey").alias("cik"), F.lit("us-gaap").alias("taxonomy"), _pick(CONCEPTS, (F.floor(F.col("o_orderkey") / 4) % len(CONCEPTS)).cast("int")).alias("concept"), F.when(F.col("o_orderkey") % 11 == 0, "EUR").otherwise("USD").alias("unit")]
    rest = [F.col("o_totalprice").alias("val"), F.to_date("o_orderdate").alias("filed"), F.lit("10-K").alias("form"), F.col("o_orderkey").cast("string").alias("accn")]
    quarter = o.select(*base, q.alias("period_start"), F.date_sub(F.add_months(q, 3), 1).alias("period_end"), *rest)
    year = o.where("o_orderkey % 3 = 0").select(*base, y.alias("period_start"), F.date_sub(F.add_months(y, 12), 1).alias("period_end"), *rest)
    instant = o.where("o_orderkey % 3 = 1").select(*base, F.lit(None).cast("date").alias("period_start"), F.date_sub(F.add_months(y, 12), 1).alias("period_end"), *rest)
    return quarter.unionByName(year).unionByName(instant)


def eav(spark: SparkSession, sf: str) -> DataFrame:
    """Filing facts as rows (xbrl_url, source_symbol, source_company, context_ref, tag, value)."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    url, sym = F.concat(F.lit("u"), (F.col("event_id") - F.col("event_id") % 2).cast("string")), F.concat(F.lit("Brand#"), (F.floor(F.col("event_id") / 2) % 25 + 1).cast("string"))
    ctx = F.concat(F.lit("Disclosure"), (F.col("event_id") % 2 + 1).cast("string"))
    main = e.where("event_id % 2 = 0").select(url.alias("xbrl_url"), sym.alias("source_symbol"), F.concat(sym, F.lit(" Ltd")).alias("source_company"), F.lit("MainI").alias("context_ref"), F.lit("DateOfFiling").alias("tag"), F.date_format("ts", "yyyy-MM-dd").alias("value"))
    pairs = [
        ("NameOfThePerson", F.when(F.col("user_id") % 9 > 0, F.concat(F.lit("Person "), F.col("user_id").cast("string")))), ("CategoryOfPerson", F.when(F.col("user_id") % 2 == 0, "Promoter").otherwise("Director")),
        ("SecuritiesAcquiredOrDisposedTransactionType", F.when(F.col("event_type").isin("purchase", "click"), "Buy").otherwise("Sell")),
        ("SecuritiesAcquiredOrDisposedNumberOfSecurity", F.floor("value").cast("string")), ("SecuritiesAcquiredOrDisposedValueOfSecurity", F.floor(F.col("value") * 10).cast("string")),
        ("ModeOfAcquisitionOrDisposal", F.when(F.col("event_type") == "purchase", "Market Purchase").otherwise("Off Market")),
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), v.cast("string").alias("value")) for t, v in pairs])
    disc = e.select(url.alias("xbrl_url"), sym.alias("source_symbol"), F.concat(sym, F.lit(" Ltd")).alias("source_company"), ctx.alias("context_ref"), F.inline(rows))
    return main.unionByName(disc.where("value is not null"))


def shareholding(spark: SparkSession, sf: str) -> DataFrame:
    """Shareholding facts: symbol, report_date, category, pct; a nation's order value by priority and quarter."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("report_date"), (F.substring("o_orderpriority", 1, 1).cast("int") % 3).alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    s = j.groupBy("symbol", "report_date").agg(F.sum("v").alias("all"), *[F.sum(F.when(F.col("k") == i, F.col("v"))).alias(n) for i, n in enumerate(DIMS)])
    each = F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("v")) for n in DIMS])
    return s.select("symbol", "report_date", "all", F.inline(each)).where("v is not null").select("symbol", "report_date", "category", (F.col("v").cast("double") / F.col("all").cast("double") * 100).alias("pct"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select(
        F.col("event_id").cast("string").alias("accession_number"), F.date_format("ts", "dd-MMM-yyyy").alias("trans_date"), F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "S").when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "F").otherwise("M").alias("trans_code"),
        F.when(F.col("event_type") == "error", "D").otherwise("A").alias("trans_acquired_disp_cd"), F.col("value").cast("string").alias("trans_shares"), F.when(F.col("event_id") % 97 == 0, F.lit(1.63e9)).otherwise(k).cast("string").alias("trans_pricepershare"),
    )


def trade_submissions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("accession_number"), F.date_format("ts", "dd-MMM-yyyy").alias("filing_date"), F.lit("4").alias("document_type"), F.concat(F.lit("Issuer "), (F.col("user_id") % 25 + 1).cast("string")).alias("issuername"), F.concat(F.lit(" brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("issuertradingsymbol"), _pick(PLAN_TEXTS, (F.col("event_id") % 5).cast("int")).alias("aff10b5one"))


def trade_owners(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 2).cast("int"))).alias("k"))
    return e.select(F.col("event_id").cast("string").alias("accession_number"), F.concat(F.lit("Owner "), (F.col("user_id") + F.col("k") * 1000).cast("string")).alias("rptownername"), F.when(F.col("k") == 0, "Director").otherwise("").alias("rptowner_relationship"))


def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Four brands in five, by number."""
    k = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    b = table(spark, sf, "part").select("p_brand").distinct().where(k % 5 > 0)
    return b.select(F.upper("p_brand").alias("symbol"), F.concat(F.lit("Company "), "p_brand").alias("security"), F.concat(F.lit("Sector "), (k % 4).cast("string")).alias("gics_sector"))


def short_volume(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    v = F.col("value").cast("decimal(18,2)")
    return e.groupBy(F.to_date("ts").alias("as_of"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol")).agg(
        F.coalesce(F.sum(F.when(F.col("event_type").isin("error", "click"), v)), F.lit(0)).cast("double").alias("short_volume"), F.sum(v).cast("double").alias("total_volume")
    )


def short_interest(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("settlement_date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("short_interest"), F.count("*").alias("n"))
    prev = F.lag("short_interest").over(W.partitionBy("symbol").orderBy("settlement_date"))
    m = m.withColumn("short_interest_prev", prev)
    return m.select("symbol", "settlement_date", "short_interest", "short_interest_prev", (F.col("short_interest") - F.col("short_interest_prev")).alias("change_shares"), half_change().alias("change_pct"), F.when(F.col("n") % 7 == 0, F.lit(999.99)).otherwise(F.col("n").cast("double")).alias("days_to_cover"))


def half_change():
    return F.floor(F.try_divide(F.col("short_interest") - F.col("short_interest_prev"), F.col("short_interest_prev")) * 10000 + 0.5) / 100.0


def actions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"), F.when(F.col("event_id") % 10 == 0, "BE").otherwise("EQ").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("ex_dt"), F.lit("").alias("record_dt"), _pick(PURPOSES, (F.col("event_id") % 12).cast("int")).alias("purpose"))


def funds(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings: manager code and name spelling, house, scheme, stock."""
    li, s, n = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return j.select((F.col("l_suppkey") % 40).alias("code"), F.when(F.col("l_linenumber") % 4 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("manager"), F.col("n_name").alias("house"), F.col("l_suppkey").alias("scheme"), F.col("l_partkey").alias("stock"))


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole first line of each document is a title."""
    return table(spark, sf, "documents").select("doc_id", F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("title")).where("title <> ''")


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """A master of names that headlines may mention, (symbol, series, company_name): the texts of test items; one in six is no equity."""
    k = F.col("item_id")
    return table(spark, sf, "benchmark").select(F.concat(F.lit("B"), k.cast("string")).alias("symbol"), F.when(k % 6 == 0, "BE").otherwise("EQ").alias("series"), F.coalesce("text", F.lit("")).alias("company_name"))

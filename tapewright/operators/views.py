"""Conforming views: typing, deduplication by listing, identity, split adjustment. Each takes frames and returns a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import half_up, latest_per, text_date

EQUITY_SERIES = ["EQ", "SM", "ST", "SL", "SQ"]


def prices(raw: DataFrame) -> DataFrame:
    """symbol, series, date1, prev_close, close_price, ttl_trd_qnty, turnover_lacs as text -> typed EQ sessions."""
    num = lambda c: F.trim(c).try_cast("double")
    t = raw.where(F.trim("series") == "EQ").select(
        text_date(F.trim("date1"), "d-MMM-yyyy", "yyyy-MM-dd").alias("as_of"), F.trim("symbol").alias("symbol"), F.trim("series").alias("series"), num("prev_close").alias("prev_close"),
        num("close_price").alias("close"), num("ttl_trd_qnty").alias("qty"), num("turnover_lacs").alias("turnover_lacs"),
    )
    return t.withColumn("pct_change", half_up(F.try_divide(F.col("close") - F.col("prev_close"), F.nullif("prev_close", F.lit(0.0))) * 100, 2))


def session_prices(bars: DataFrame) -> DataFrame:
    """Typed bars as sessions: the previous close is the bar before."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("as_of"))
    t = bars.select("as_of", "symbol", F.lit("EQ").alias("series"), prev.alias("prev_close"), "close", F.col("volume").alias("qty"), (F.col("close") * F.col("volume")).alias("turnover_lacs"))
    return t.withColumn("pct_change", half_up((F.col("close") - F.col("prev_close")) / F.nullif("prev_close", F.lit(0.0)) * 100, 2))


def record_events(listed: DataFrame) -> DataFrame:
    """52-week records: of repeated listings of (symbol, event_date), the latest folder's value."""
    return latest_per(listed.where("trim(series) = 'EQ'"), ["symbol", "event_date"], [F.col("folder").desc(), F.col("price").desc()]).select("symbol", "series", "event_date", "price")


def security(masters: DataFrame) -> DataFrame:
    """symbol -> company_name of the latest file, any series."""
    best = F.max_by("name", F.struct("folder", "name"))
    return masters.groupBy("symbol").agg(best.alias("company_name"))


def security_master(masters: DataFrame) -> DataFrame:
    newest = masters.agg(F.max("folder").alias("newest"))
    return masters.join(F.broadcast(newest), F.col("folder") == F.col("newest")).select("symbol", "series", F.col("name").alias("company_name"), "isin").distinct()


def symbol_of_name(masters: DataFrame) -> DataFrame:
    """Upper-cased name -> symbol: live rows of equity series; EQ first, then the shortest symbol, then by alphabet."""
    live = masters.where((F.col("delflg") == "N") & F.col("series").isin(EQUITY_SERIES)).withColumn("key", F.upper(F.trim("name")))
    return latest_per(live, ["key"], [(F.col("series") == "EQ").desc(), F.length("symbol"), F.col("symbol")]).select("key", "symbol")


def gainloss(raw: DataFrame, bridge: DataFrame) -> DataFrame:
    """Official gain and loss rows (gain_loss, security, as_of, pct) with their symbol; unbridged rows keep a null symbol."""
    t = raw.where("as_of is not null and pct is not null").withColumn("key", F.upper(F.trim("security")))
    return t.join(bridge, "key", "left").select("as_of", "symbol", F.col("security").alias("company_name"), F.col("gain_loss").alias("direction"), F.col("pct").alias("pct_change"))


def circuit(raw: DataFrame) -> DataFrame:
    return raw.where("trim(series) = 'EQ'").select("as_of", F.trim("symbol").alias("symbol"), F.trim("series").alias("series"), F.trim("highlow").alias("highlow"))


def latest_listing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of (symbol, folder) listings the newest folder's columns: market capitalisation, price-earnings and the like."""
    return latest_per(df, ["symbol"], [F.col("folder").desc(), *[F.col(c).desc_nulls_last() for c in columns]]).select("symbol", *columns)


#: Purpose keywords by category, in order; the first that matches counts. Fixed values of the feed.
ACTION_RULES = [
    ("Interest", ["%INTEREST%"]), ("Dividend", ["DIV%", "%DIVIDEND%", "INTDIV%", "%SPDV%"]), ("Split", ["%FVSPLT%", "%SPLIT%", "%SUB-DIV%"]), ("Bonus", ["%BONUS%"]), ("Rights", ["%RIGHT%"]),
    ("Buyback", ["%BUY%BACK%"]), ("Meeting", ["%AGM%", "%EGM%", "%MEETING%"]), ("Restructuring", ["%AMALGAMAT%", "%MERGER%", "%SCHEME%", "%ARRANGEMENT%"]),
]


def corporate_actions(raw: DataFrame) -> DataFrame:
    """Distinct EQ actions with a category by ordered keyword rules."""
    up, category = F.upper("purpose"), F.lit("Other")
    for name, patterns in reversed(ACTION_RULES):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | up.like(p)
        category = F.when(hit, name).otherwise(category)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    t = raw.where((F.trim("series") == "EQ") & blank("purpose").isNotNull())
    return t.select(F.trim("symbol").alias("symbol"), F.trim("series").alias("series"), blank("ex_dt").alias("ex_date"), blank("record_dt").alias("record_date"), category.alias("category"), F.trim("purpose").alias("purpose")).distinct()


def roster_view(raw: DataFrame) -> DataFrame:
    return raw.select(F.replace(F.trim("symbol"), F.lit("."), F.lit("-")).alias("symbol"), F.col("security").alias("company_name"), F.col("gics_sector").alias("sector"))


def confirmed_splits(raw: DataFrame) -> DataFrame:
    """One ratio for each (symbol, date), so a split listed twice counts once."""
    return raw.where("confidence = 'confirmed'").groupBy("symbol", "effective_date").agg(F.max("ratio").alias("ratio"))


def split_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with adj_open ... adj_close: prices times the product of the ratios that become effective after the bar.

    A symbol's splits travel as one small array, so bars are joined once on the symbol and never multiply.
    """
    b = bars if "series_id" in bars.columns else bars.withColumn("series_id", F.lit(1).cast("long"))
    per = splits.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("effective_date", "ratio"))).alias("sp"))
    later = F.filter("sp", lambda s: s["effective_date"] > F.col("as_of"))
    factor = F.when(F.col("sp").isNull(), F.lit(1.0)).otherwise(F.aggregate(later, F.lit(1.0), lambda a, s: a * s["ratio"]))
    own = F.get(F.filter("sp", lambda s: s["effective_date"] == F.col("as_of")), F.lit(0))["ratio"]
    out = b.join(per, "symbol", "left").withColumn("cum_factor", factor).withColumn("split_ratio", own)
    return out.select("symbol", "series_id", "as_of", "open", "high", "low", "close", "volume", "split_ratio", "cum_factor", *[(F.col(c) * F.col("cum_factor")).alias(f"adj_{c}") for c in ("open", "high", "low", "close")])


def adjusted_sessions(daily: DataFrame, digits: int, high: str = "hi_52w", low: str = "lo_52w") -> DataFrame:
    """Adds prev_close, pct_change and the records over 252 sessions of each series; one window, one sort."""
    w = W.partitionBy("symbol", "series_id").orderBy("as_of")
    year = w.rowsBetween(-251, 0)
    t = daily.withColumns({"prev_close": F.lag("adj_close").over(w), high: F.max("adj_high").over(year), low: F.min("adj_low").over(year), "sessions_seen": F.count("*").over(year)})
    up = F.when(F.col("prev_close") > 0, half_up((F.col("adj_close") - F.col("prev_close")) / F.col("prev_close") * 100, digits))
    return t.withColumn("pct_change", up)


def session_ranks(us_prices: DataFrame) -> DataFrame:
    """gain_rank and lose_rank in each session, ties by symbol; direction G from zero on."""
    rank = lambda c: F.row_number().over(W.partitionBy("as_of").orderBy(c, "symbol", "series_id"))
    t = us_prices.where("pct_change is not null")
    return t.select("as_of", "symbol", "pct_change", F.when(F.col("pct_change") >= 0, "G").otherwise("L").alias("direction"), rank(F.col("pct_change").desc()).alias("gain_rank"), rank(F.col("pct_change").asc()).alias("lose_rank"))


def submissions(raw: DataFrame) -> DataFrame:
    """Typed filings; the plan flag comes in five encodings, blank stays unknown."""
    flag = F.lower(F.trim("aff10b5one"))
    plan = F.when(flag.isin("1", "true"), True).when(flag.isin("0", "false"), False)
    return raw.select(F.trim("accession_number").alias("accession"), text_date("filing_date", "d-MMM-yyyy").alias("filing_date"), F.trim("document_type").alias("form_type"), F.trim("issuername").alias("issuer_name"), F.upper(F.trim("issuertradingsymbol")).alias("symbol"), plan.alias("plan_10b5_1"))


def insider_transactions(trans: DataFrame, subs: DataFrame, owners: DataFrame, latest: str = "current_date()") -> DataFrame:
    """Transactions with filing and owner; implausible dates and prices become null, the rows stay. One row for each owner."""
    day = text_date("trans_date", "d-MMM-yyyy")
    price, shares = F.trim("trans_pricepershare").try_cast("double"), F.trim("trans_shares").try_cast("double")
    o = owners.select(F.trim("accession_number").alias("accession"), F.trim("rptownername").alias("owner_name"), F.nullif(F.trim("rptowner_relationship"), F.lit("")).alias("relationship"))
    t = trans.select(
        F.trim("accession_number").alias("accession"), F.when(day.between(F.lit("2006-01-01").cast("date"), F.expr(latest)), day).alias("trans_date"), F.trim("trans_code").alias("trans_code"),
        F.trim("trans_acquired_disp_cd").alias("acquired_disposed"), shares.alias("shares"), price.alias("price_per_share"), F.when(price.between(0, 100000), shares * price).alias("value_usd"), F.trim("trans_code").isin("P", "S").alias("is_open_market"),
    )
    return t.join(subs, "accession").join(o, "accession", "left")


def filer_symbols(filers: DataFrame) -> DataFrame:
    one = F.explode(F.split("tickers", ","))
    t = filers.select("cik", "name", "exchanges", "sic_description", one.alias("s"))
    return t.select("cik", F.replace(F.upper(F.trim("s")), F.lit("."), F.lit("-")).alias("symbol"), "name", "exchanges", "sic_description").where("symbol <> ''")


def typed_facts(raw: DataFrame) -> DataFrame:
    return raw.withColumn("period_days", F.datediff("period_end", "period_start"))


def short_ratios(raw: DataFrame) -> DataFrame:
    return raw.withColumn("short_ratio", F.when(F.col("total_volume") > 0, F.col("short_volume") / F.col("total_volume")))


def short_baseline(volume: DataFrame, floor: float = 100_000.0) -> DataFrame:
    """Each symbol's exact median ratio over sessions above a volume floor."""
    return volume.where(F.col("total_volume") > floor).groupBy("symbol").agg(F.median("short_ratio").alias("baseline_ratio"), F.count("*").alias("sessions"))


def short_interest_view(raw: DataFrame) -> DataFrame:
    """The sentinel 999.99 in days_to_cover means unknown, as what isn't finite does; numbers above it are measurements."""
    days = F.col("days_to_cover")
    return raw.withColumn("days_to_cover", F.when((days < float("inf")) & (days != 999.99), days))


def keyed_values(raw: DataFrame, source: str) -> DataFrame:
    """A scraped long table (symbol, key, value) with its source: fundamentals, or the fallback's information. Keys are whatever the page had."""
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.trim("key").alias("key"), F.trim("value").alias("value"), F.lit(source).alias("source"))


def live_insiders(raw: DataFrame) -> DataFrame:
    """Trades scraped beside the fundamentals, as text or numbers; intents filed before a trade are flagged, not dropped."""
    num = lambda c: F.col(c).try_cast("double")
    return raw.select(
        F.upper(F.trim("symbol")).alias("symbol"), F.trim("insider_trading").alias("owner_name"), F.trim("relationship").alias("relationship"), F.trim("date").alias("trans_date"), F.trim("transaction").alias("transaction"),
        num("cost").alias("price_per_share"), num("num_shares").alias("shares"), num("value_usd").alias("value_usd"), num("num_shares_total").alias("shares_after"), (F.trim("transaction") == "Proposed Sale").alias("is_proposed"),
    )


def owners(raw: DataFrame) -> DataFrame:
    """Reporting owners of filings; a blank relationship is unknown."""
    return raw.select(F.trim("accession_number").alias("accession"), F.trim("rptownername").alias("owner_name"), F.nullif(F.trim("rptowner_relationship"), F.lit("")).alias("relationship"))


def filing_list(raw: DataFrame) -> DataFrame:
    """Filings as shredded, all text (accessionNumber, filingDate, ...) -> typed: accn, cik, form, filed, accepted, period, items, document."""
    stamp = F.coalesce(F.try_to_timestamp("acceptanceDateTime", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.try_to_timestamp("acceptanceDateTime"))
    return raw.select(
        F.trim("accessionNumber").alias("accn"), "cik", F.trim("form").alias("form"), text_date("filingDate", "yyyy-MM-dd").alias("filed"), stamp.alias("accepted"), text_date("reportDate", "yyyy-MM-dd").alias("period"),
        F.nullif(F.trim("items"), F.lit("")).alias("items"), F.trim("primaryDocument").alias("document"),
    )


def insider_facts(raw: DataFrame) -> DataFrame:
    """Insider facts of shredded filings, as filed; rows of other filings go where the kind is told."""
    return raw.where("filing_type = 'insider'").drop("filing_type") if "filing_type" in raw.columns else raw


def holding_facts(raw: DataFrame) -> DataFrame:
    """Shareholding facts of shredded filings, as filed; rows without a value go, and what several days' files repeat counts once."""
    return raw.where("value is not null and filing_type = 'shareholding'").drop("filing_type").distinct()


def promoter_history(store: DataFrame) -> DataFrame:
    """Promoters' and public shares by quarter of the companies that have a symbol."""
    return store.where("symbol is not null").select("symbol", "company", "as_on_date", "promoter_pct", "public_pct", "employee_trust_pct", "status", "submission_date")

"""Screens and boards over the conformed views; each returns rows in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import anchored, exact, half_up, latest_per, on_newest

TOP = 20
#: Keyword buckets of headlines, strongest first. Fixed values.
NEWS_BUCKETS = [(3, r"(?i)\b(demand|capex|approval|trigger|growth|results?|orderbook)\w*"), (2, r"(?i)\b(supply|constraint|budget|manufactur|qip)\w*"), (1, r"(?i)\b(valuation|moat)\w*")]
#: Item code, label, category, priority of current reports. Fixed values.
ITEMS = [
    ("1.03", "Bankruptcy or receivership", "Distress", 1), ("4.02", "Non-reliance on prior financials", "Distress", 2), ("3.01", "Delisting notice", "Distress", 3), ("2.06", "Material impairment", "Distress", 4),
    ("2.05", "Exit or disposal costs", "Distress", 5), ("4.01", "Change of auditor", "Distress", 6), ("5.01", "Change in control", "Leadership", 7), ("2.01", "Completed acquisition or disposal", "Deal", 8),
    ("1.01", "Material definitive agreement", "Deal", 9), ("1.02", "Terminated material agreement", "Deal", 10), ("5.02", "Director or officer change", "Leadership", 11), ("2.02", "Results of operations", "Results", 12),
    ("3.02", "Unregistered equity sale", "Financing", 13), ("2.03", "Direct financial obligation created", "Financing", 14), ("2.04", "Obligation acceleration triggered", "Financing", 15), ("3.03", "Modified security-holder rights", "Governance", 16),
    ("5.03", "Charter or bylaw amendment", "Governance", 17), ("5.07", "Shareholder vote", "Governance", 18), ("5.08", "Shareholder director nominations", "Governance", 19), ("5.06", "Shell company status change", "Governance", 20),
    ("5.05", "Code of ethics amendment", "Governance", 21), ("5.04", "Trading suspension, benefit plans", "Governance", 22), ("1.04", "Mine safety", "Other", 23), ("7.01", "Regulation FD disclosure", "Disclosure", 24), ("8.01", "Other events", "Disclosure", 25),
]

#: Registered kinds of firms by their short code, and words of a name that tell nothing about the firm. Fixed values.
FIRM_TYPES = {"portfolio-managers": "pms", "aif": "aif", "mutual-funds": "amc", "investment-advisers": "ria"}
FIRM_WORDS = (
    "INVESTMENT", "INVESTMENTS", "CONSULTANCY", "ADVISORS", "ADVISERS", "ADVISORY", "CAPITAL", "PARTNERS", "MANAGEMENT", "MANAGERS", "MANAGER", "ASSET", "ASSETS", "FUND", "FUNDS", "FINANCIAL",
    "FINANCE", "SERVICES", "WEALTH", "PORTFOLIO", "SECURITIES", "PRIVATE", "PVT", "LIMITED", "LTD", "LLP", "INDIA", "CO", "COMPANY", "TRUST", "TRUSTEE", "TRUSTEES", "AMC", "MUTUAL", "BROKING",
    "BROKERS", "HOLDINGS", "HOLDING", "GLOBAL", "ALTERNATES", "ALTERNATE", "ALTERNATIVE", "AIF", "AND", "&",
)


# ---- India


def records_last(events: DataFrame, security: DataFrame) -> DataFrame:
    """Rows of the newest record date, with the company's name."""
    return on_newest(events, "event_date").join(security, "symbol", "left").select("event_date", "symbol", "company_name", "series", "price").orderBy("symbol")


def record_counts(events: DataFrame, days: int) -> DataFrame:
    return anchored(events, "event_date", days).groupBy("symbol").agg(F.countDistinct("event_date").alias("events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event")).orderBy(F.col("events").desc(), "symbol")


def movers(gainloss: DataFrame, direction: str, top: int) -> DataFrame:
    """The newest session's first `top` names by change."""
    last = on_newest(gainloss.where((F.col("direction") == direction) & F.col("symbol").isNotNull()), "as_of")
    by = F.col("pct_change").desc() if direction == "G" else F.col("pct_change").asc()
    return last.select("as_of", "symbol", "company_name", "pct_change").distinct().orderBy(by, "symbol", "company_name").limit(top)


def recurrence(rows: DataFrame, security: DataFrame | None, days: int, top: int, gainers: bool, count: str = "times_in_top") -> DataFrame:
    """How often a symbol was among a session's first `top`; rows are (as_of, symbol, pct_change), each distinct one counts."""
    w = W.partitionBy("as_of").orderBy(F.col("pct_change").desc() if gainers else F.col("pct_change").asc(), "symbol")
    ranked = anchored(rows.where("symbol is not null and pct_change is not null").select("as_of", "symbol", "pct_change"), "as_of", days).distinct().withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= top)
    out = tally(ranked, count)
    out = out.join(security, "symbol", "left") if security is not None else out
    return out.orderBy(F.col(count).desc(), F.col("avg_pct").desc() if gainers else F.col("avg_pct").asc(), "symbol")


def tally(ranked: DataFrame, count: str) -> DataFrame:
    """Sessions, mean change (summed as decimals, so in any order), first and last session of each symbol."""
    mean = F.sum(exact("pct_change", 12, 4)).cast("double") / F.count("*")
    return ranked.groupBy("symbol").agg(F.count("*").alias(count), half_up(mean, 2).alias("avg_pct"), F.min("as_of").alias("first_seen"), F.max("as_of").alias("last_seen"))


def records_combined(events: DataFrame, prices: DataFrame, security: DataFrame, days: int, high: bool) -> DataFrame:
    """Newest and previous record of each symbol in the window, how many there were, and the latest close."""
    win = anchored(events, "event_date", days).select("symbol", "series", "event_date", "price").distinct()
    w = W.partitionBy("symbol").orderBy(F.col("event_date").desc(), F.col("price").desc() if high else F.col("price").asc())
    ranked = win.withColumns({"rn": F.row_number().over(w), "last_record": F.lead("price").over(w)}).where("rn = 1")
    agg = win.groupBy("symbol").agg(F.countDistinct("event_date").alias("events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"))
    px = on_newest(prices, "as_of").groupBy("symbol").agg(F.max("close").alias("close"))
    out = ranked.join(agg, "symbol").join(security, "symbol", "left").join(px, "symbol", "left")
    return out.select("event_date", "symbol", "company_name", "series", F.col("close").alias("price"), F.col("price").alias("record"), "last_record", "events", "first_event", "last_event").orderBy(F.col("last_event").desc(), "symbol")


def band_hits(circuit: DataFrame, security: DataFrame, side: str) -> DataFrame:
    """Names at their upper (H) or lower (L) price band in the newest session."""
    return on_newest(circuit, "as_of").where(F.col("highlow") == side).join(security, "symbol", "left").select("as_of", "symbol", "company_name").orderBy("symbol")


def series_list(masters: DataFrame) -> DataFrame:
    return masters.select("series").distinct().orderBy(F.col("series").rlike("^[A-Za-z]").desc(), "series")


def company_search(masters: DataFrame, q: str, series: str = "ALL", limit: int = 20) -> DataFrame:
    """Names or symbols that contain q, whatever the case; symbols that begin with it first."""
    t = masters if series == "ALL" else masters.where(F.col("series") == series)
    hit = F.contains(F.lower("symbol"), F.lit(q.lower())) | F.contains(F.lower("name"), F.lit(q.lower()))
    return t.where(hit).select("symbol", "series", F.col("name").alias("company_name")).distinct().orderBy(F.startswith(F.lower("symbol"), F.lit(q.lower())).desc(), "symbol", "series", "company_name").limit(limit)


def insider_disclosures(facts: DataFrame) -> DataFrame:
    """Filing facts as rows: one for each disclosure of a filing; all symbols at once."""
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    main = facts.where("context_ref = 'MainI'").groupBy("xbrl_url", F.col("source_symbol").alias("symbol"), F.col("source_company").alias("company")).agg(value("DateOfFiling").alias("filing_date"))
    disc = facts.where("context_ref like 'Disclosure%'").groupBy("xbrl_url", "context_ref").agg(
        value("NameOfThePerson").alias("person"), value("CategoryOfPerson").alias("category"), value("SecuritiesAcquiredOrDisposedTransactionType").alias("txn_type"),
        value("SecuritiesAcquiredOrDisposedNumberOfSecurity").alias("qty"), value("SecuritiesAcquiredOrDisposedValueOfSecurity").alias("value"), value("ModeOfAcquisitionOrDisposal").alias("mode"),
    )
    return main.join(disc, "xbrl_url")


def insider_recent(facts: DataFrame, days: int) -> DataFrame:
    d = insider_disclosures(facts).withColumn("day", F.col("filing_date").try_cast("date"))
    out = anchored(d, "day", days, inclusive=True).where("person is not null")
    return out.select("filing_date", "symbol", "company", "context_ref", "person", "category", "txn_type", F.col("qty").try_cast("double").alias("qty"), F.col("value").try_cast("double").alias("value"), "mode").orderBy(F.col("filing_date").desc(), "symbol", "context_ref")


def insider_by_symbol(facts: DataFrame, symbol: str | None = None) -> DataFrame:
    d = insider_disclosures(facts)
    d = d if symbol is None else d.where(F.col("symbol") == symbol)
    return d.select("symbol", "xbrl_url", "context_ref", "filing_date", "person", "category", "txn_type", F.col("qty").try_cast("double").alias("qty"), F.col("value").try_cast("double").alias("value")).orderBy("symbol", F.col("filing_date").desc())


def shareholding_changes(rows: DataFrame) -> DataFrame:
    """(symbol, category, report_date, pct) -> latest share of each category and its change against the report before; all symbols."""
    w = W.partitionBy("symbol", "category").orderBy(F.col("report_date").desc())
    r = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    at = lambda c, n: F.max(F.when((F.col("category") == c) & (F.col("rn") == n), F.col("pct")))
    cols = [F.max(F.when(F.col("rn") == 1, F.col("report_date"))).alias("report_date"), F.max(F.when(F.col("rn") == 2, F.col("report_date"))).alias("prior_report_date")]
    for c in ("promoter", "fii", "dii"):
        cols += [half_up(at(c, 1), 2).alias(f"{c}_pct"), half_up(at(c, 1) - at(c, 2), 2).alias(f"{c}_change")]
    return r.groupBy("symbol").agg(*cols)


def drilldown(security: DataFrame, mcap: DataFrame, pe: DataFrame, changes: DataFrame) -> DataFrame:
    """Market value, price, earnings and shareholding changes of every symbol."""
    out = security.join(mcap, "symbol", "left").join(pe, "symbol", "left").join(changes, "symbol", "left")
    eps = F.when(F.col("symbol_pe") > 0, half_up(F.col("close_price") / F.col("symbol_pe"), 2))
    return out.withColumn("eps", eps)


def shareholding_history(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol", "category").orderBy("report_date")
    return rows.withColumn("change", half_up(F.col("pct") - F.lag("pct").over(w), 2)).withColumn("pct", half_up("pct", 2)).orderBy("symbol", "category", F.col("report_date").desc())


def actions_board(actions: DataFrame, security: DataFrame) -> DataFrame:
    return actions.join(security, "symbol", "left").orderBy(F.col("ex_date").desc_nulls_last(), "symbol", "purpose")


def firms(raw: DataFrame) -> DataFrame:
    """Registered firms (name, sebi_type, ...) of a known kind with their search term: the first words up to a generic one, three at most."""
    kind = F.lit(None).cast("string")
    for name, code in FIRM_TYPES.items():
        kind = F.when(F.col("sebi_type") == name, code).otherwise(kind)
    t = raw.withColumns({"name": F.trim("name"), "type": kind}).where("name <> '' and type is not null")
    t = t.withColumn("_w", F.filter(F.split("name", r"\s+"), lambda x: x != ""))
    plain = F.transform(F.slice(F.col("_w"), 2, 3), lambda x: F.upper(F.regexp_replace(x, "[.,]", "")).isin(*FIRM_WORDS))
    first = F.array_position(plain, True)  # of the second to fourth word; 0 when none is generic
    take = F.least(F.lit(3), F.when(first > 0, first).otherwise(F.size("_w"))).cast("int")
    return t.withColumn("search_term", F.array_join(F.slice(F.col("_w"), F.lit(1), take), " ")).drop("_w", "sebi_type").orderBy(F.lower("name"), "name")


def promoter_pivot(rows: DataFrame, quarters: list[str], keys: tuple[str, ...] = ("symbol", "category")) -> DataFrame:
    """Holder by quarter; the quarters are stated, so the plan needs no extra pass over the data. keys: what a row stands for, the year too if wanted."""
    return rows.groupBy(*keys).pivot("quarter", quarters).agg(F.max("pct"))


def filings_of(filings: DataFrame, form: str | None = None) -> DataFrame:
    """Filings of a form, or all, newest first for each filer."""
    t = filings if form is None else filings.where(F.upper("form") == form.upper())
    return t.select("cik", "filed", "form", "period", "items", "accn", "document").orderBy("cik", F.col("filed").desc_nulls_last(), "accn")


def phrase_search(docs: DataFrame, phrase: str, entity: str = "source", order: str = "doc_id") -> DataFrame:
    """Documents that contain the phrase, by entity: how many, the newest of them with its kind and a snippet, and how many match in all.

    docs: the entity's column, the order's, text and, where they have one, lang as the kind of document. Rows of a null entity are one entity.
    """
    low = F.lower("text")
    hit = docs.where(F.contains(low, F.lit(phrase.lower()))).withColumn("at", F.locate(phrase.lower(), low))
    snippet = F.substring(F.col("text"), F.greatest(F.col("at") - 20, F.lit(1)), F.lit(len(phrase) + 40))
    kind = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    per = hit.groupBy(entity).agg(F.count("*").alias("matches"), F.max(order).alias("newest"), F.max_by(kind, order).alias("kind"), F.max_by(snippet, order).alias("snippet"))
    total = hit.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).orderBy(F.col("matches").desc(), entity)  # the total is one row


#: Words that are no brand when they stand alone: generic business words, places, months, surnames, common and ambiguous words. Fixed values.
STOP_GENERIC = (
    "LIMITED", "LTD", "PVT", "PRIVATE", "CORPORATION", "CORP", "COMPANY", "CO", "INDIA", "INDIAN", "THE", "AND", "OF", "GROUP", "HOLDINGS", "HOLDING", "ENTERPRISES", "ENTERPRISE", "INDUSTRIES", "INDUSTRY", "INDUSTRIAL",
    "PROJECTS", "PRODUCTS", "SERVICES", "SERVICE", "SYSTEMS", "SYSTEM", "TECHNOLOGIES", "TECHNOLOGY", "INFRASTRUCTURE", "INFRA", "FINANCE", "FINANCIAL", "INVESTMENTS", "INVESTMENT", "INTERNATIONAL", "GLOBAL", "VENTURES", "MILLS",
    "LABORATORIES", "LABS", "PHARMA", "PHARMACEUTICALS", "CHEMICALS", "ENGINEERING", "CAPITAL", "SOLUTIONS", "RESOURCES",
)
STOP_PLACES = ("ANDHRA", "GUJARAT", "KERALA", "PUNJAB", "BENGAL", "SOUTH", "NORTH", "EAST", "WEST", "EASTERN", "WESTERN", "CENTRAL", "BOMBAY", "MADRAS", "DELHI", "MUMBAI", "MYSORE", "BANGALORE")
STOP_MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
STOP_SURNAMES = ("SHARMA", "KUMAR", "SINGH", "PATEL", "SHAH", "GUPTA", "MEHTA", "VERMA", "RAO", "REDDY", "NAIR", "IYER", "KHAN", "JAIN", "AGARWAL", "MODI", "ROY", "BOSE")
STOP_COMMON = (
    "ORIENT", "ORIENTAL", "NATIONAL", "STATE", "UNITED", "MODERN", "STANDARD", "PREMIER", "UNIVERSAL", "GENERAL", "FUTURE", "APPLE", "PARAMOUNT", "ENGINEERS", "POWER", "ENERGY", "STEEL", "CEMENT", "BANK", "HEALTH", "MOTORS", "PAPER",
    "SUGAR", "TEXTILES", "METALS", "METAL", "MINING", "AUTO", "FOODS", "SECURITIES", "ELECTRONICS", "ELECTRONIC", "DIGITAL", "SMART", "METRO", "INDIGO", "MANIPAL", "PRIME", "ROYAL", "SUPER", "STAR", "SUPREME", "NEW", "INDO",
)
STOP = (*STOP_GENERIC, *STOP_PLACES, *STOP_MONTHS, *STOP_SURNAMES, *STOP_COMMON)


def brand_index(master: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(symbol, alias) of master(symbol, series, company_name): the first two words of a name, and the first alone if it has four characters and is no stop word.

    Names are upper-cased and keep A-Z, 0-9 and &. Only equity rows of plain symbols count, no test symbols. Aliases of one word with several symbols and
    aliases with more than three go.
    """
    sound = (F.col("series") == "EQ") & (F.col("company_name") != "") & F.col("symbol").rlike("^[A-Z0-9]+$") & ~F.col("symbol").rlike("^[0-9]") & ~F.upper("symbol").contains("NSETEST")
    w = F.filter(F.split(F.regexp_replace(F.upper("company_name"), "[^A-Z0-9& ]+", " "), " "), lambda x: x != "")
    first = F.get("w", F.lit(0))
    two = F.when(F.size("w") >= 2, F.concat_ws(" ", first, F.get("w", F.lit(1))))
    one = F.when((F.length(first) >= 4) & ~first.isin(*stop), first)
    a = master.where(sound).withColumn("w", w).select("symbol", F.explode(F.array_compact(F.array(two, one))).alias("alias")).distinct()
    n = a.groupBy("alias").agg(F.countDistinct("symbol").alias("n")).where("n <= case when alias like '% %' then 3 else 1 end")
    return a.join(n.select("alias"), "alias")


def tag_headlines(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, symbol) when an alias stands in the title between word boundaries and some occurrence has every word begin with a capital, digit or &.

    Words of an alias are parted by white space alone. Each title's single words and pairs meet the aliases by equality; a word with an & is tried whole
    and by its parts.
    """
    find = lambda pattern: F.regexp_extract_all("title", F.lit(pattern), F.lit(1))
    word = {"&": (r"[A-Z0-9&][A-Za-z0-9_&]*", r"(?<![A-Za-z0-9_&])"), "": (r"[A-Z0-9][A-Za-z0-9_]*", r"(?<![A-Za-z0-9_])")}
    # Capitals are asked for in the patterns, so that of most words no string is made. A look ahead lets pairs overlap.
    found = [find(f"{before}({w})") for w, before in word.values()] + [find(rf"(?={before}({a}\s+{b}))") for a, before in word.values() for b, _ in word.values()]
    x = F.transform(F.concat(*found), lambda k: F.upper(F.regexp_replace(k, r"\s+", " ")))
    s = titles.select("doc_id", F.explode(F.array_distinct(x)).alias("alias"))
    return s.join(aliases, "alias").select("doc_id", "symbol").distinct()


def news_points(titles: DataFrame, tags: DataFrame) -> DataFrame:
    """Points of each symbol: a distinct title scores its strongest keyword bucket once for each symbol it names."""
    pts = F.lit(0)
    for p, pattern in reversed(NEWS_BUCKETS):
        pts = F.when(F.col("title").rlike(pattern), p).otherwise(pts)
    key = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    scored = titles.withColumns({"pts": pts, "key": key}).where("pts > 0").join(tags, "doc_id")
    first = scored.groupBy("key").agg(F.min("doc_id").alias("first"))
    return scored.join(first, "key").where("doc_id = first").groupBy("symbol").agg(F.sum("pts").alias("pts_news"))


def board(hi: DataFrame, lo: DataFrame, prices: DataFrame, insiders: DataFrame, actions: DataFrame, security: DataFrame, news: DataFrame, sessions: int, bounded: bool = False) -> DataFrame:
    """Points by signal family and their sum over about so many sessions, five to seven days. All dates count back from the newest session; actions only when `bounded`.

    insiders: insider_disclosures(). One buy for each (symbol, person, value, quantity). The window's first day is read once, so that it prunes
    every scan; without prices no dated signal counts.
    """
    newest = prices.agg(F.max("as_of")).first()[0]
    edge = F.date_sub(F.lit(newest).cast("date"), -(-sessions * 7 // 5))
    since = lambda df, c: df.where(F.col(c) >= edge)
    rec = lambda df, n: since(df, "event_date").groupBy("symbol").agg(F.countDistinct("event_date").alias(n))
    win = since(prices.where("pct_change is not null").select("as_of", "symbol", "pct_change"), "as_of").distinct()

    def among(order, name: str) -> DataFrame:
        w = W.partitionBy("as_of").orderBy(order, "symbol")
        return win.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= TOP).groupBy("symbol").agg(F.count("*").alias(name))

    buys = since(insiders.withColumn("day", F.col("filing_date").try_cast("date")), "day").where("txn_type = 'Buy' and mode in ('Market Purchase', 'Block Deal')")
    buys = buys.select("symbol", "person", "value", "qty").distinct().groupBy("symbol").agg(F.count("*").alias("buys"))
    ca = actions.where("category in ('Rights', 'Bonus', 'Split', 'Buyback')")
    ca = since(ca.withColumn("day", F.col("ex_date").try_cast("date")), "day") if bounded else ca
    ca = ca.groupBy("symbol").agg(F.sum(F.when(F.col("category") == "Rights", 2).otherwise(1)).alias("ca"))
    parts = [rec(hi, "h"), rec(lo, "l"), among(F.col("pct_change").desc(), "g"), among(F.col("pct_change").asc(), "s"), buys, ca, news.select("symbol", F.col("pts_news").alias("nw"))]
    names = ["h", "l", "g", "s", "buys", "ca", "nw"]
    # One row for each symbol and signal, then one aggregation: symbols with any signal, without a join for each family.
    rows = None
    for part, n in zip(parts, names):
        one = part.select("symbol", *[(F.col(n) if n == m else F.lit(None)).cast("long").alias(m) for m in names])
        rows = one if rows is None else rows.unionByName(one)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = rows.where("symbol is not null and symbol <> ''").groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])
    s = s.select("symbol", (z("buys") * 5).alias("pts_insider"), F.when(z("h") + z("l") > 0, 4 + z("h") + z("l")).otherwise(0).cast("long").alias("pts_52w"), z("g").alias("pts_gainers"), z("s").alias("pts_losers"), z("ca").alias("pts_corp_actions"), z("nw").alias("pts_news"))
    fam = ["pts_insider", "pts_52w", "pts_gainers", "pts_losers", "pts_corp_actions", "pts_news"]
    total, fired = sum((F.col(c) for c in fam[1:]), F.col(fam[0])), sum(((F.col(c) > 0).cast("long") for c in fam[1:]), (F.col(fam[0]) > 0).cast("long"))
    return s.withColumns({"score": total, "signals": fired}).join(security, "symbol", "left").orderBy(F.col("score").desc(), F.col("signals").desc(), "symbol")


# ---- US


def us_records(p: DataFrame, days: int, high: bool) -> DataFrame:
    """Sessions that set a record of the adjusted series over a full year of sessions."""
    win = anchored(p, "as_of", days).where("sessions_seen >= 252").where("adj_high >= hi_52w" if high else "adj_low <= lo_52w")
    level = F.max("hi_52w") if high else F.min("lo_52w")
    return win.groupBy("symbol").agg(F.countDistinct("as_of").alias("events"), F.min("as_of").alias("first_event"), F.max("as_of").alias("last_event"), half_up(level, 2).alias("level")).orderBy(F.col("events").desc(), "symbol")


def us_recurrence(ranks: DataFrame, days: int, top: int, gainers: bool) -> DataFrame:
    name = "times_in_top" if gainers else "times_in_bottom"
    out = tally(anchored(ranks, "as_of", days).where(F.col("gain_rank" if gainers else "lose_rank") <= top), name)
    return out.orderBy(F.col(name).desc(), F.col("avg_pct").desc() if gainers else F.col("avg_pct").asc(), "symbol")


def us_insider_recent(trans: DataFrame, roster: DataFrame, days: int, open_only: bool = True, limit: int = 500) -> DataFrame:
    t = anchored(trans.where("trans_date is not null"), "trans_date", days).join(roster, "symbol")
    t = t.where("is_open_market") if open_only else t
    return t.orderBy(F.col("trans_date").desc(), F.col("value_usd").desc_nulls_last(), "symbol", "accession", "owner_name").limit(limit)


def us_insider_net(trans: DataFrame, roster: DataFrame, days: int) -> DataFrame:
    """Buying against selling in the open market. Co-owners of a filing are one trade: rows collapse by accession first."""
    t = anchored(trans.where("trans_date is not null"), "trans_date", days).where("is_open_market")
    one = t.groupBy("accession", "symbol", "trans_code", "trans_date", "value_usd", "plan_10b5_1").agg(F.collect_set("owner_name").alias("owners"))
    usd = lambda code: F.sum(F.when(F.col("trans_code") == code, exact("value_usd", 24, 2))).cast("double")
    j = one.join(roster, "symbol")
    n = j.groupBy("symbol", "company_name", "sector").agg(
        F.count_if(F.col("trans_code") == "P").alias("buys"), F.count_if(F.col("trans_code") == "S").alias("sells"), half_up(usd("P"), 0).alias("buy_usd"), half_up(usd("S"), 0).alias("sell_usd"),
        F.count_if((F.col("trans_code") == "S") & ~F.col("plan_10b5_1").eqNullSafe(F.lit(True))).alias("sells_discretionary"), F.max("trans_date").alias("last_trade"),
    )
    who = j.select("symbol", F.explode("owners").alias("o")).groupBy("symbol").agg(F.countDistinct("o").alias("insiders"))
    return n.join(who, "symbol", "left").withColumn("insiders", F.coalesce("insiders", F.lit(0))).orderBy(F.col("buys").desc(), F.col("buy_usd").desc_nulls_last(), "symbol")


def prefer_first(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """primary, and of secondary the keys that primary lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))


def coverage(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Records and newest date of each source."""
    out = None
    for name, (df, day) in sources.items():
        one = df.agg(F.count("*").alias("records"), F.max(day).cast("string").alias("as_of")).select(F.lit(name).alias("source"), "records", "as_of")
        out = one if out is None else out.unionByName(one)
    return out


def current_facts(facts: DataFrame, units: list[str] | None = None) -> DataFrame:
    """The newest filed value of each fact, whole market; restatements are superseded."""
    f = facts if units is None else facts.where(F.col("unit").isin(units))
    return latest_per(f, ["cik", "taxonomy", "concept", "unit", "period_start", "period_end"], [F.col("filed").desc(), F.col("accn").desc(), F.col("val").desc()])


#: Measures of a fiscal year as ladders of concepts, the first that a filer reports counts: over the year, and at its end. Fixed values.
YEAR_MEASURES = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "eps_diluted": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"],
    "cash_from_ops": ["NetCashProvidedByUsedInOperatingActivities"],
}
END_MEASURES = {"assets": ["Assets"], "liabilities": ["Liabilities"], "equity": ["StockholdersEquity"], "cash": ["CashAndCashEquivalentsAtCarryingValue"]}


def annual(facts: DataFrame, units: list[str], durations: dict[str, list[str]] = YEAR_MEASURES, instants: dict[str, list[str]] = END_MEASURES, source: str = "NetIncomeLoss") -> DataFrame:
    """One row for each (cik, fiscal year end): durations of 340 to 380 days and instants, each a ladder of concepts, pivoted in one pass.

    form, filed and accn tell which filings the concept `source` comes from. Years are the ends of durations; restated facts are superseded.
    """
    return year_table(current_facts(facts, units), ["cik"], durations, instants, source)


def year_table(current: DataFrame, keys: list[str], durations: dict[str, list[str]] = YEAR_MEASURES, instants: dict[str, list[str]] = END_MEASURES, source: str = "NetIncomeLoss") -> DataFrame:
    """annual() of facts of which each has one value for each of the keys, such as those that stood on a day."""
    year, point = F.col("period_days").between(340, 380), F.col("period_days").isNull()
    best = lambda c, cond, value="val": F.max(F.when((F.col("concept") == c) & cond, F.col(value)))
    cols = [F.coalesce(*[best(c, cond) for c in v]).alias(k) for group, cond in ((durations, year), (instants, point)) for k, v in group.items()]
    cols += [best(source, year, c).alias(c) for c in ("form", "filed", "accn")]
    return current.where(year | point).groupBy(*keys, F.col("period_end").alias("fiscal_year_end")).agg(F.max(F.when(year, 1)).alias("_y"), *cols).where("_y = 1").drop("_y")


def fact_vintages(facts: DataFrame) -> DataFrame:
    """Every filed value of a fact, numbered from the current one."""
    w = W.partitionBy("cik", "taxonomy", "concept", "unit", "period_start", "period_end").orderBy(F.col("filed").desc(), F.col("accn").desc(), F.col("val").desc())
    return facts.withColumn("vintage", F.row_number().over(w))


def short_volume_screen(volume: DataFrame, baseline: DataFrame, days: int) -> DataFrame:
    v = anchored(volume, "as_of", days).join(baseline, "symbol", "left")
    r = {"short_ratio": half_up("short_ratio", 4), "vs_baseline": half_up(F.col("short_ratio") - F.col("baseline_ratio"), 4), "baseline_ratio": half_up("baseline_ratio", 4)}
    return v.select("as_of", "symbol", "short_volume", "total_volume", *[c.alias(n) for n, c in r.items()], F.col("sessions").alias("baseline_sessions")).orderBy("symbol", F.col("as_of").desc())


def short_outliers(volume: DataFrame, baseline: DataFrame, least_volume: float, least_sessions: int, limit: int) -> DataFrame:
    v = on_newest(volume, "as_of").join(baseline, "symbol").where((F.col("total_volume") >= least_volume) & (F.col("sessions") >= least_sessions) & F.col("short_ratio").isNotNull())
    off = F.col("short_ratio") - F.col("baseline_ratio")
    out = v.select("symbol", "as_of", "total_volume", half_up("short_ratio", 4).alias("short_ratio"), half_up("baseline_ratio", 4).alias("baseline_ratio"), half_up(off, 4).alias("vs_baseline"), F.col("sessions").alias("baseline_sessions"), F.abs(off).alias("_off"))
    return out.orderBy(F.col("_off").desc(), "symbol").limit(limit).drop("_off")


def short_movers(interest: DataFrame, least: float, limit: int) -> DataFrame:
    return on_newest(interest, "settlement_date").where(F.col("short_interest") >= least).orderBy(F.abs("change_pct").desc_nulls_last(), "symbol").limit(limit)


def one_symbol(filer_symbols: DataFrame) -> DataFrame:
    """A filer's shortest symbol, then by alphabet."""
    return latest_per(filer_symbols, ["cik"], [F.length("symbol"), F.col("symbol")])


def tradable_from(filed, accepted):
    """The day after filing when it was accepted from 16:00 New York time on."""
    late = F.hour(F.from_utc_timestamp(accepted, "America/New_York")) >= 16
    return F.when(accepted.isNotNull() & late, F.date_add(filed, 1)).otherwise(filed)


def announcements(filings: DataFrame, symbols: DataFrame, bars: DataFrame, days: int, limit: int | None = None) -> DataFrame:
    """Current reports with their items and the first bar within ten days on or after they could be traded."""
    one = one_symbol(symbols)
    k = filings.where("form = '8-K' and items is not null and items <> ''")
    f = anchored(k, "filed", days).withColumn("tradable", tradable_from(F.col("filed"), F.col("accepted"))).join(one, "cik")
    # A filing meets the ten-day buckets that its window touches by equality, so neither side multiplies.
    probe = f.select("accn", "symbol", "tradable", F.explode(F.array_distinct(F.array(F.floor(F.datediff("tradable", F.lit("1970-01-01")) / 10), F.floor((F.datediff("tradable", F.lit("1970-01-01")) + 10) / 10)))).alias("b"))
    bar = bars.select(F.col("symbol").alias("bs"), "as_of", F.col("adj_close").alias("close"), "pct_change", F.floor(F.datediff("as_of", F.lit("1970-01-01")) / 10).alias("bb"))
    hit = probe.join(bar, (F.col("symbol") == F.col("bs")) & (F.col("b") == F.col("bb")) & F.col("as_of").between(F.col("tradable"), F.date_add("tradable", 10)))
    first = F.min(F.struct("as_of", "close", "pct_change")).alias("r")
    react = hit.groupBy("accn").agg(first).select("accn", F.col("r.as_of").alias("react_date"), F.col("r.close").alias("react_close"), F.col("r.pct_change").alias("react_pct"))
    ex = f.select("accn", F.explode(F.split("items", ",")).alias("i")).select("accn", F.trim("i").alias("item")).where("item <> '' and item <> '9.01'").distinct()
    lookup = F.broadcast(filings.sparkSession.createDataFrame(ITEMS, "item string, label string, category string, priority int"))
    lab = ex.join(lookup, "item", "left").select("accn", "item", F.coalesce("label", F.concat(F.lit("Item "), "item")).alias("label"), F.coalesce("category", F.lit("Other")).alias("category"), F.coalesce("priority", F.lit(99)).alias("priority"))
    top = F.struct("priority", "item")
    rows = F.sort_array(F.collect_list(F.struct("item", "label")))
    agg = lab.groupBy("accn").agg(F.min_by("label", top).alias("headline"), F.min_by("category", top).alias("category"), rows.alias("xs"), F.count("*").alias("item_count"))
    agg = agg.select("accn", "headline", "category", F.array_join(F.transform("xs", lambda x: x["item"]), ", ").alias("item_codes"), F.array_join(F.transform("xs", lambda x: F.concat(x["item"], F.lit("  "), x["label"])), " | ").alias("items_detail"), "item_count")
    out = latest_per(f, ["accn"], [F.length("symbol"), F.col("symbol"), F.col("cik")]).join(agg, "accn").join(react, "accn", "left")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"), F.replace("accn", F.lit("-"), F.lit("")), F.lit("/"), "document")
    out = out.select("accn", "symbol", F.col("name").alias("company"), "headline", "category", "item_codes", "items_detail", "item_count", "filed", F.col("period").alias("event_date"), "accepted", "react_date", "react_close", "react_pct", url.alias("url"))
    out = out.orderBy(F.col("accepted").desc_nulls_last(), "symbol", "accn")
    return out if limit is None else out.limit(limit)


#: Venues whose name before a ticker makes it a listing. Fixed values.
VENUES = ["NASDAQ", "NYSE", "NYSE American", "NYSE Arca", "NYSEAMERICAN", "AMEX", "OTCQB", "OTCQX", "OTC", "CBOE", "BATS", "TSX", "TSXV"]


def ticker_mention() -> str:
    """Pattern of '(VENUE: SYM)' in any case, colon or full stop or neither between them; group 1 is the symbol, with a class of one letter."""
    space = r"[\s\u00a0]"
    venue = "|".join(v.replace(" ", space + "+") for v in sorted(VENUES, key=len, reverse=True))
    return rf"(?i)\({space}*(?:{venue}){space}*[:.]?{space}*([A-Z]{{1,5}}(?:[.-][A-Z])?){space}*\)"


def news_tickers(items: DataFrame, known: DataFrame) -> DataFrame:
    """(link, symbol) of explicit '(VENUE: SYM)' mentions that are known symbols; of repeated links or titles the newest."""
    key = F.coalesce("link", "title")
    newest = latest_per(items.withColumn("k", key), ["k"], [F.col("published").desc_nulls_last(), F.col("title")])
    found = F.regexp_extract_all(F.concat_ws(" ", "title", "description"), F.lit(ticker_mention()), F.lit(1))
    symbols = F.array_distinct(F.transform(found, lambda x: F.replace(F.upper(x), F.lit("."), F.lit("-"))))
    t = newest.select("k", "title", "published", F.explode(symbols).alias("symbol"))
    return t.join(known.select("symbol").distinct(), "symbol", "left_semi").select(F.col("k").alias("link"), "title", "published", "symbol").orderBy(F.col("published").desc_nulls_last(), "link", "symbol")

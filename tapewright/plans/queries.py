"""Registered market queries: each applies a library operator to stand-in inputs, with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import half_up
from ..functions.scratch import scratch
from ..operators import day_store as B
from ..operators import derive as D
from ..operators import sinks as K
from ..operators import views as V
from ..sources import documents as X
from ..sources import readers as R
from ..sources import standins as S
from ..streaming import feeds as J
from . import screens as Q
from .oracle import ITEM_ROWS, r, window
from .registry import query


# ---- views over stand-ins


def _hi(s, d, b=None):
    return V.record_events(S.extremes(s, d, True, b))


def _lo(s, d, b=None):
    return V.record_events(S.extremes(s, d, False, b))


def _px(s, d, b=None):
    return V.session_prices(S.bars(s, d) if b is None else b)


@query("""select as_of, symbol, 'EQ' as series, case when k % 10 = 0 then null else open end as prev_close, close, floor(volume)::double as qty, floor(close * volume)::double as turnover_lacs,
  case when k % 10 > 0 and k % 11 > 0 and open <> 0 then floor((close - open) / open * 100 * 100 + 0.5) / 100 end as pct_change from (select * exclude (open), open * (k % 11 > 0)::int as open from (select *, (dayofyear(as_of) + length(symbol)) as k from bars)) where k % 7 > 0""")
def typed_prices(s, d):
    """C1 from day files: text with spaces, dates in two forms, a dash for what is unknown, nought closes, and other series than equity."""
    root, k = scratch(s, "bhav"), F.dayofyear("as_of") + F.length("symbol")
    b = S.bars(s, d).withColumn("k", k).withColumn("open", F.col("open") * (F.col("k") % 11 > 0).cast("int"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    day = F.when(F.col("k") % 2 == 0, F.date_format("as_of", "dd-MMM-yyyy")).otherwise(F.date_format("as_of", "yyyy-MM-dd"))
    out = b.select(
        pad(F.col("symbol")).alias("SYMBOL"), F.when(F.col("k") % 7 == 0, " BE").otherwise(" EQ").alias(" SERIES"), pad(day).alias(" DATE1"), pad(F.when(F.col("k") % 10 == 0, "-").otherwise(F.col("open").cast("string"))).alias(" PREV_CLOSE"),
        pad(F.col("close").cast("string")).alias(" CLOSE_PRICE"), pad(F.floor("volume").cast("string")).alias(" TTL_TRD_QNTY"), pad(F.floor(F.col("close") * F.col("volume")).cast("string")).alias(" TURNOVER_LACS"),
    )
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    return V.prices(R.scan_csv_glob(s, f"{root}/*.csv"))


def _sec(s, d):
    return V.security(S.masters(s, d))


def _gl_raw(s, d):
    names = S.masters(s, d).groupBy("symbol").agg(F.min("name").alias("security"))
    return _px(s, d).join(names, "symbol").select(F.when(F.col("pct_change") >= 0, "G").otherwise("L").alias("gain_loss"), "security", "as_of", F.col("pct_change").alias("pct"))


def _gl(s, d):
    return V.gainloss(_gl_raw(s, d), V.symbol_of_name(S.masters(s, d)))


def _circuit(s, d):
    hit = F.when((F.col("close") == F.col("high")) & (F.col("close") > F.col("open")), "H").when((F.col("close") == F.col("low")) & (F.col("close") < F.col("open")), "L")
    return V.circuit(S.bars(s, d).select("as_of", "symbol", F.lit("EQ").alias("series"), hit.alias("highlow")).where("highlow is not null"))


def _mcap(s, d):
    b = S.bars(s, d).select("symbol", F.col("as_of").alias("folder"), (F.col("close") * F.col("volume")).alias("market_cap"), F.col("close").alias("close_price"), F.lit(10.0).alias("face_value"))
    return V.latest_listing(b, ["market_cap", "close_price", "face_value"])


def _pe(s, d):
    b = S.bars(s, d).select("symbol", F.col("as_of").alias("folder"), F.col("volume").alias("symbol_pe"), (F.col("volume") / 2).alias("adjusted_pe"))
    return V.latest_listing(b, ["symbol_pe", "adjusted_pe"])


def _daily(s, d):
    return V.split_adjusted(S.bars(s, d), V.confirmed_splits(S.splits(s, d)))


def _us(s, d):
    return V.adjusted_sessions(_daily(s, d), 4)


def _trans(s, d):
    return V.insider_transactions(S.trades(s, d), V.submissions(S.trade_submissions(s, d)), S.trade_owners(s, d))


def _roster(s, d):
    return V.roster_view(S.roster(s, d))


def _sv(s, d):
    return V.short_ratios(S.short_volume(s, d))


def _si(s, d):
    return V.short_interest_view(S.short_interest(s, d))


# ---- C: conforming views


@query("select as_of, symbol, series, prev_close, close, qty, turnover_lacs, pct_change from prices")
def prices(s, d):
    return _px(s, d)


@query("select * from hi52")
def hi52(s, d):
    return _hi(s, d)


@query("select * from lo52")
def lo52(s, d):
    return _lo(s, d)


@query("select * from security")
def security(s, d):
    return _sec(s, d)


@query("select distinct symbol, series, name as company_name, isin from masters where folder = (select max(folder) from masters)")
def security_master(s, d):
    return V.security_master(S.masters(s, d))


@query("select * from bridge")
def gl_symbol(s, d):
    return V.symbol_of_name(S.masters(s, d))


@query("select as_of, symbol, company_name, direction, pct_change from gainloss")
def gainloss(s, d):
    return _gl(s, d)


@query("select * from circuit")
def circuit(s, d):
    return _circuit(s, d)


@query("select * from eav")
def insider_facts(s, d):
    return V.insider_facts(S.eav(s, d))


@query("select * from mcap")
def mcap_latest(s, d):
    return _mcap(s, d)


@query("select * from pe")
def pe_latest(s, d):
    return _pe(s, d)


@query("select symbol, series, ex_date, record_date, category, purpose from actions")
def corp_actions(s, d):
    return V.corporate_actions(S.actions(s, d))


@query("select symbol, company_name, sector from roster")
def us_roster(s, d):
    return _roster(s, d)


@query("select symbol, effective_date, ratio from splits")
def us_stock_splits(s, d):
    return V.confirmed_splits(S.splits(s, d))


@query("select * from adjusted")
def us_daily(s, d):
    return _daily(s, d)


@query("select * from us_prices")
def us_prices(s, d):
    return _us(s, d)


@query("select as_of, symbol, pct_change, direction, gain_rank, lose_rank from ranks")
def us_gainloss(s, d):
    return V.session_ranks(_us(s, d))


@query("select * from dbn")
def us_dbn_prices(s, d):
    return V.adjusted_sessions(_daily(s, d), 2, "hi_252d", "lo_252d")


@query("select distinct accession, filing_date, form_type, issuer_name, symbol, plan_10b5_1 from trans")
def sec_submission(s, d):
    return V.submissions(S.trade_submissions(s, d))


@query("select accession, owner_name, relationship from trans")
def sec_owner(s, d):
    return V.owners(S.trade_owners(s, d))


_TRANS = ["accession", "trans_date", "trans_code", "acquired_disposed", "shares", "price_per_share", "value_usd", "is_open_market", "filing_date", "form_type", "issuer_name", "symbol", "plan_10b5_1", "owner_name", "relationship"]


@query(f"select {', '.join(_TRANS)} from trans")
def sec_insider_trans(s, d):
    return _trans(s, d).select(*_TRANS)


@query("select cik, symbol, name, exchanges, sic_description from filer_symbols")
def us_sec_symbol(s, d):
    return V.filer_symbols(S.cik_symbols(s, d))


@query("select accn, cik, form, filed, accepted, period, items, document from filings")
def us_sec_filings(s, d):
    return S.filings(s, d)


@query("select * from facts")
def us_sec_facts(s, d):
    return V.typed_facts(S.facts(s, d))




@query("select as_of, symbol, short_volume, total_volume, short_ratio from sv")
def us_finra_short_volume(s, d):
    return _sv(s, d)


@query(f"select symbol, {r('baseline_ratio', 8)} as baseline_ratio, sessions from base")
def us_finra_short_baseline(s, d):
    return V.short_baseline(_sv(s, d), 20.0).withColumn("baseline_ratio", half_up("baseline_ratio", 8))


@query("select symbol, settlement_date, short_interest, short_interest_prev, change_shares, change_pct, days_to_cover from si")
def us_finra_short_interest(s, d):
    return _si(s, d)


# ---- D: India


def _last(t):
    return f"select event_date, e.symbol, company_name, series, price from {t} e left join security s on e.symbol = s.symbol where event_date = (select max(event_date) from {t})"


def _events(t, n):
    return f"select symbol, count(distinct event_date) as events, min(event_date) as first_event, max(event_date) as last_event from {t} where {window(t, 'event_date', n)} group by symbol"


@query(_last("hi52"))
def high52_last(s, d):
    return Q.records_last(_hi(s, d), _sec(s, d))


@query(_events("hi52", 365))
def high52_events(s, d):
    return Q.record_counts(_hi(s, d), 365)


@query(_last("lo52"))
def low52_last(s, d):
    return Q.records_last(_lo(s, d), _sec(s, d))


@query(_events("lo52", 365))
def low52_events(s, d):
    return Q.record_counts(_lo(s, d), 365)


def _movers(g, o):
    return f"select distinct as_of, symbol, company_name, pct_change from gainloss where direction = '{g}' and symbol is not null and as_of = (select max(as_of) from gainloss where direction = '{g}' and symbol is not null) order by pct_change {o}, symbol, company_name limit 20"


@query(_movers("G", "desc"))
def top_gainers(s, d):
    return Q.movers(_gl(s, d), "G", 20)


@query(_movers("L", "asc"))
def top_losers(s, d):
    return Q.movers(_gl(s, d), "L", 20)


def _recur(table, cond, order, days, top, name="times_in_top", sec=True):
    rows = f"(select distinct as_of, symbol, pct_change from {table} where symbol is not null and pct_change is not null and {cond} and as_of > (select max(as_of) from {table} where symbol is not null and pct_change is not null and {cond}) - {days})"
    join = " left join security s on x.symbol = s.symbol" if sec else ""
    return f"select x.*{', company_name' if sec else ''} from (select symbol, count(*) as {name}, {r('sum(pct_change::decimal(12,4))::double / count(*)', 2)} as avg_pct, min(as_of) as first_seen, max(as_of) as last_seen from (select *, row_number() over (partition by as_of order by pct_change {order}, symbol) as rnk from {rows}) where rnk <= {top} group by symbol) x{join}"


@query(_recur("gainloss", "direction = 'G'", "desc", 60, 5))
def gainers_recurrence(s, d):
    return Q.recurrence(_gl(s, d).where("direction = 'G'"), _sec(s, d), 60, 5, True)


@query(_recur("gainloss", "direction = 'L'", "asc", 60, 5))
def losers_recurrence(s, d):
    return Q.recurrence(_gl(s, d).where("direction = 'L'"), _sec(s, d), 60, 5, False)


@query(_recur("prices", "true", "desc", 60, 5))
def gainers_recurrence_px(s, d):
    return Q.recurrence(_px(s, d), _sec(s, d), 60, 5, True)


def _combined(t, o):
    return f"""select e.event_date, e.symbol, company_name, e.series, close as price, e.price as record, last_record, events, first_event, last_event from (
  select *, row_number() over w as rn, lead(price) over w as last_record from (select distinct * from {t} where {window(t, 'event_date', 365)}) window w as (partition by symbol order by event_date desc, price {o})) e
  join ({_events(t, 365)}) a on e.symbol = a.symbol left join security s on e.symbol = s.symbol left join (select symbol, max(close) as close from prices where as_of = (select max(as_of) from prices) group by symbol) p on e.symbol = p.symbol where rn = 1"""


@query(_combined("hi52", "desc"))
def high52_combined(s, d):
    b = S.bars_once(s, d)
    return Q.records_combined(_hi(s, d, b), _px(s, d, b), _sec(s, d), 365, True)


@query(_combined("lo52", "asc"))
def low52_combined(s, d):
    b = S.bars_once(s, d)
    return Q.records_combined(_lo(s, d, b), _px(s, d, b), _sec(s, d), 365, False)


def _band(x):
    return f"select as_of, c.symbol, company_name from circuit c left join security s on c.symbol = s.symbol where as_of = (select max(as_of) from circuit) and highlow = '{x}'"


@query(_band("H"))
def upper_circuit(s, d):
    return Q.band_hits(_circuit(s, d), _sec(s, d), "H")


@query(_band("L"))
def lower_circuit(s, d):
    return Q.band_hits(_circuit(s, d), _sec(s, d), "L")


@query("select distinct series from masters")
def series_list(s, d):
    return Q.series_list(S.masters(s, d))


@query("select distinct symbol, series, name as company_name, from (select * from masters) where contains(lower(symbol), 'brand#1') or contains(lower(name), 'brand#1') order by starts_with(lower(symbol), 'brand#1') desc, symbol, series, company_name limit 20".replace("company_name, from", "company_name from"))
def company_search(s, d):
    return Q.company_search(S.masters(s, d), "Brand#1")


@query("select symbol, xbrl_url, context_ref, filing_date, person, category, txn_type, try_cast(qty as double) as qty, try_cast(value as double) as value from disclosures")
def insider_for_symbol(s, d):
    return Q.insider_by_symbol(S.eav(s, d))


@query("select filing_date, symbol, company, context_ref, person, category, txn_type, try_cast(qty as double) as qty, try_cast(value as double) as value, mode from disclosures where filing_date::date >= (select max(filing_date::date) from disclosures) - 7 and person is not null")
def insider_recent(s, d):
    return Q.insider_recent(S.eav(s, d), 7)


_CHANGES = "select symbol, max(report_date) filter (where rn = 1) as report_date, max(report_date) filter (where rn = 2) as prior_report_date, " + ", ".join(
    f"{r(f'''max(pct) filter (where category = '{c}' and rn = 1)''', 2)} as {c}_pct, {r(f'''max(pct) filter (where category = '{c}' and rn = 1) - max(pct) filter (where category = '{c}' and rn = 2)''', 2)} as {c}_change" for c in ("promoter", "fii", "dii")
) + " from (select *, row_number() over (partition by symbol, category order by report_date desc) as rn from shp) group by symbol"


@query(f"select s.symbol, company_name, market_cap, close_price, face_value, symbol_pe, adjusted_pe, case when symbol_pe > 0 then {r('close_price / symbol_pe', 2)} end as eps, c.* exclude (symbol) from security s left join mcap m on s.symbol = m.symbol left join pe p on s.symbol = p.symbol left join ({_CHANGES}) c on s.symbol = c.symbol")
def drilldown(s, d):
    return Q.drilldown(_sec(s, d), _mcap(s, d), _pe(s, d), Q.shareholding_changes(S.shareholding(s, d)))


@query(f"select symbol, report_date, category, {r('pct', 2)} as pct, {r('pct - lag(pct) over (partition by symbol, category order by report_date)', 2)} as change from shp")
def shareholding_history(s, d):
    return Q.shareholding_history(S.shareholding(s, d))


@query("select a.*, company_name from actions a left join security s on a.symbol = s.symbol")
def corporate_actions_board(s, d):
    return Q.actions_board(V.corporate_actions(S.actions(s, d)), _sec(s, d))


@query("select symbol, category, y as year, max(p) filter (where q = 1) as \"Q1\", max(p) filter (where q = 2) as \"Q2\", max(p) filter (where q = 3) as \"Q3\", max(p) filter (where q = 4) as \"Q4\" from (select symbol, category, year(report_date)::integer as y, quarter(report_date) as q, floor(pct * 100 + 0.5) / 100 as p from shp) group by all")
def promoter_pivot(s, d):
    rows = S.shareholding(s, d).select("symbol", "category", F.year("report_date").alias("year"), F.concat(F.lit("Q"), F.quarter("report_date")).alias("quarter"), half_up("pct", 2).alias("pct"))
    return Q.promoter_pivot(rows, ["Q1", "Q2", "Q3", "Q4"], ("symbol", "category", "year"))


@query("select *, sum(matches) over ()::bigint as total from (select source, count(*) as matches, max(doc_id) as newest, arg_max(lang, doc_id) as kind, arg_max(substring(text, greatest(instr(lower(text), 'the in') - 20, 1), 46), doc_id) as snippet from documents where contains(lower(text), 'the in') group by source)")
def phrase_search(s, d):
    return Q.phrase_search(S.table(s, d, "documents"), "the in")


@query("select symbol, alias from alias")
def news_brand_index(s, d):
    return Q.brand_index(S.brands(s, d))


@query("select doc_id, symbol from tags")
def news_tag(s, d):
    return Q.tag_headlines(S.headlines(s, d), Q.brand_index(S.brands(s, d)))


def _news(s, d):
    t = S.headlines(s, d)
    return Q.news_points(t, Q.tag_headlines(t, Q.brand_index(S.brands(s, d))))


@query("select symbol, pts_news from news")
def news_points(s, d):
    return _news(s, d)


def _edge(n):
    return f"(select max(as_of) from prices) - {n}"


_BOARD = f"""select s.*, company_name from (select *, pts_insider + pts_52w + pts_gainers + pts_losers + pts_corp_actions + pts_news as score,
  (pts_insider > 0)::bigint + (pts_52w > 0)::bigint + (pts_gainers > 0)::bigint + (pts_losers > 0)::bigint + (pts_corp_actions > 0)::bigint + (pts_news > 0)::bigint as signals from (
  select symbol, coalesce(sum(buys), 0)::bigint * 5 as pts_insider, (case when coalesce(sum(h), 0) + coalesce(sum(l), 0) > 0 then 4 + coalesce(sum(h), 0) + coalesce(sum(l), 0) else 0 end)::bigint as pts_52w, coalesce(sum(g), 0)::bigint as pts_gainers, coalesce(sum(z), 0)::bigint as pts_losers, coalesce(sum(ca), 0)::bigint as pts_corp_actions, coalesce(sum(nw), 0)::bigint as pts_news from (
    select symbol, count(distinct event_date) as h, null as l, null as g, null as z, null as buys, null as ca, null as nw from hi52 where event_date >= {_edge(364)} group by symbol
    union all select symbol, null, count(distinct event_date), null, null, null, null, null from lo52 where event_date >= {_edge(364)} group by symbol
    union all select symbol, null, null, count(*), null, null, null, null from (select symbol, row_number() over (partition by as_of order by pct_change desc, symbol) as k from (select distinct as_of, symbol, pct_change from prices where pct_change is not null and as_of >= {_edge(364)})) where k <= 20 group by symbol
    union all select symbol, null, null, null, count(*), null, null, null from (select symbol, row_number() over (partition by as_of order by pct_change, symbol) as k from (select distinct as_of, symbol, pct_change from prices where pct_change is not null and as_of >= {_edge(364)})) where k <= 20 group by symbol
    union all select symbol, null, null, null, null, count(*), null, null from (select distinct symbol, person, value, qty from disclosures where filing_date::date >= {_edge(364)} and txn_type = 'Buy' and mode in ('Market Purchase', 'Block Deal')) group by symbol
    union all select symbol, null, null, null, null, null, sum(case when category = 'Rights' then 2 else 1 end), null from actions where category in ('Rights', 'Bonus', 'Split', 'Buyback') group by symbol
    union all select symbol, null, null, null, null, null, null, pts_news from news) group by symbol)) s left join security c on s.symbol = c.symbol"""


@query(_BOARD)
def convergence_board(s, d):
    b = S.bars_once(s, d)
    return Q.board(_hi(s, d, b), _lo(s, d, b), _px(s, d, b), Q.insider_disclosures(S.eav(s, d)), V.corporate_actions(S.actions(s, d)), _sec(s, d), _news(s, d), 260)


@query("select code, manager as name, count(*) as holdings from funds group by all")
def fund_managers(s, d):
    return D.fund_managers(S.funds(s, d))


_FIRM_NAME = "p_name || case p_partkey % 4 when 0 then ' Capital Advisors Pvt. Ltd' when 1 then ' and Partners LLP' when 2 then ' Global' else ' Sea View Hill Trust' end"
_FIRM_KIND = "case p_partkey % 5 when 0 then 'portfolio-managers' when 1 then 'aif' when 2 then 'mutual-funds' when 3 then 'investment-advisers' else 'unknown' end"


@query(f"""select name, type, array_to_string(w[1:least(3, case when g > 0 then g else len(w) end)], ' ') as search_term from (select *, coalesce(list_position(list_transform(w[2:4], lambda x: upper(regexp_replace(x, '[.,]', '', 'g')) in ({', '.join(repr(x) for x in Q.FIRM_WORDS)})), true), 0) as g from (
  select n as name, case k when 'portfolio-managers' then 'pms' when 'aif' then 'aif' when 'mutual-funds' then 'amc' when 'investment-advisers' then 'ria' end as type, list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '') as w from (select distinct trim({_FIRM_NAME}) as n, {_FIRM_KIND} as k from part)) where type is not null)""")
def firms(s, d):
    raw = S.table(s, d, "part").select(F.expr(_FIRM_NAME).alias("name"), F.expr(_FIRM_KIND).alias("sebi_type")).distinct()
    return Q.firms(raw)


_FORMS = ["(NYSE: {})", "(NASDAQ: {})", "(TSX: {})", "(OTCQB: {})", "(OTCQX:{})", "(OTC: {})", "(NASDAQ {})", "(Nasdaq. {})", "(NYSE Arca: {})", "(nyse  american: {})", "( NYSE : {} )", "(NYSEAMERICAN:{})", "(TSXV: {}.A)", "(CBOE: {}-A)", "(BATS: {})", "(AMEX: {})", "(LSE: {})", "NYSE: {}", "(TSX: {}{}{})", "({})", "(NYSE: {}, NASDAQ: {})"]


@query(r"""select distinct link, link as title, ts as published, s as symbol from (select *, 'e' || event_id::varchar || ' ' || replace(['(NYSE: {})', '(NASDAQ: {})', '(TSX: {})', '(OTCQB: {})', '(OTCQX:{})', '(OTC: {})', '(NASDAQ {})', '(Nasdaq. {})', '(NYSE Arca: {})', '(nyse  american: {})', '( NYSE : {} )', '(NYSEAMERICAN:{})', '(TSXV: {}.A)', '(CBOE: {}-A)', '(BATS: {})', '(AMEX: {})', '(LSE: {})', 'NYSE: {}', '(TSX: {}{}{})', '({})', '(NYSE: {}, NASDAQ: {})'][event_id % 21 + 1], '{}', b) as link,
    case when event_id % 21 in (12, 13) then upper(b) || '-A' when event_id % 21 < 16 then upper(b) end as s from (select event_id, ts, user_id, case when user_id % 2 = 0 then 'AB' else 'aB' end || chr((65 + user_id % 26)::int) as b from events where event_type = 'view')) where s is not null and user_id % 26 < 13""")
def news_tickers(s, d):
    """Mentions in every form and case, and what is none: no venue that counts, no brackets, too long, two in one pair of brackets."""
    e = S.table(s, d, "events").where("event_type = 'view'")
    body = F.concat(F.when(F.col("user_id") % 2 == 0, "AB").otherwise("aB"), F.char(65 + F.col("user_id") % 26))
    t = F.concat(F.lit("e"), "event_id", F.lit(" "), F.replace(F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("event_id") % 21 + 1).cast("int")), F.lit("{}"), body))
    known = s.range(13).select(F.concat(F.lit("AB"), F.char(65 + F.col("id"))).alias("symbol"))
    known = known.unionByName(known.select(F.concat("symbol", F.lit("-A")).alias("symbol")))
    return Q.news_tickers(e.select(t.alias("link"), t.alias("title"), F.lit("").alias("description"), F.col("ts").alias("published")), known)


# ---- E: US


def _rec(cond, level):
    return f"select symbol, count(distinct as_of) as events, min(as_of) as first_event, max(as_of) as last_event, {r(level, 2)} as level from us_prices where {window('us_prices', 'as_of', 365)} and sessions_seen >= 252 and {cond} group by symbol"


@query(_rec("adj_high >= hi_52w", "max(hi_52w)"))
def us_high52(s, d):
    return Q.us_records(_us(s, d), 365, True)


@query(_rec("adj_low <= lo_52w", "min(lo_52w)"))
def us_low52(s, d):
    return Q.us_records(_us(s, d), 365, False)


def _usrec(rank, name):
    return f"select symbol, count(*) as {name}, {r('sum(pct_change::decimal(12,4))::double / count(*)', 2)} as avg_pct, min(as_of) as first_seen, max(as_of) as last_seen from ranks where {window('ranks', 'as_of', 60)} and {rank} <= 5 group by symbol"


@query(_usrec("gain_rank", "times_in_top"))
def us_gainers_recurrence(s, d):
    return Q.us_recurrence(V.session_ranks(_us(s, d)), 60, 5, True)


@query(_usrec("lose_rank", "times_in_bottom"))
def us_losers_recurrence(s, d):
    return Q.us_recurrence(V.session_ranks(_us(s, d)), 60, 5, False)


@query(f"select t.*, company_name, sector from (select * from trans) t join roster r on t.symbol = r.symbol where {window('trans', 'trans_date', 7)} and is_open_market order by trans_date desc, value_usd desc nulls last, t.symbol, accession, owner_name limit 500")
def us_insider_recent(s, d):
    return Q.us_insider_recent(_trans(s, d), _roster(s, d), 7)


_NET = f"""select x.*, coalesce(insiders, 0) as insiders from (select t.symbol, company_name, sector, count(*) filter (where trans_code = 'P') as buys, count(*) filter (where trans_code = 'S') as sells,
  {r("(sum(value_usd::decimal(24,2)) filter (where trans_code = 'P'))::double", 0)} as buy_usd, {r("(sum(value_usd::decimal(24,2)) filter (where trans_code = 'S'))::double", 0)} as sell_usd, count(*) filter (where trans_code = 'S' and plan_10b5_1 is not true) as sells_discretionary, max(trans_date) as last_trade
  from (select distinct accession, symbol, trans_code, trans_date, value_usd, plan_10b5_1 from trans where is_open_market and {window('trans', 'trans_date', 14)}) t join roster r on t.symbol = r.symbol group by all) x
  left join (select symbol, count(distinct owner_name) as insiders from trans where is_open_market and {window('trans', 'trans_date', 14)} group by symbol) w on x.symbol = w.symbol"""


@query(_NET)
def us_insider_net(s, d):
    return Q.us_insider_net(_trans(s, d), _roster(s, d), 14)


@query("select symbol, trans_date, accession, owner_name, trans_code, shares, price_per_share, value_usd from trans")
def us_insider_symbol(s, d):
    return _trans(s, d).select("symbol", "trans_date", "accession", "owner_name", "trans_code", "shares", "price_per_share", "value_usd").orderBy("symbol", F.col("trans_date").desc_nulls_last())








@query("select 'facts' as source, count(*) as records, max(filed)::varchar as as_of from facts union all select 'filings', count(*), max(filed)::varchar from filings union all select 'bars', count(*), max(as_of)::varchar from bars")
def sec_coverage(s, d):
    return Q.coverage({"facts": (S.facts(s, d), "filed"), "filings": (S.filings(s, d), "filed"), "bars": (S.bars(s, d), "as_of")})


@query("select 'short-interest' as source, count(*) as records, max(settlement_date)::varchar as as_of from si union all select 'short-volume', count(*), max(as_of)::varchar from sv")
def finra_coverage(s, d):
    return Q.coverage({"short-interest": (_si(s, d), "settlement_date"), "short-volume": (_sv(s, d), "as_of")})




@query("select symbol, cik, name, exchanges, sic_description from filer_symbols")
def sec_profile(s, d):
    return V.filer_symbols(S.cik_symbols(s, d)).select("symbol", "cik", "name", "exchanges", "sic_description")


_CUR = "(select * from facts where unit = 'USD' qualify row_number() over (partition by cik, taxonomy, concept, unit, period_start, period_end order by filed desc, accn desc, val desc) = 1)"
_YEAR = "period_days between 340 and 380"


_LADDER = lambda names, cond: "coalesce(" + ", ".join(f"max(val) filter (where concept = '{n}' and {cond})" for n in names) + ")"
_MEASURES = ", ".join(
    f"{_LADDER(names, cond)} as {k}" for cond, group in (
        (_YEAR, {"revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"], "gross_profit": ["GrossProfit"], "operating_income": ["OperatingIncomeLoss"], "net_income": ["NetIncomeLoss"],
                 "eps_diluted": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"], "cash_from_ops": ["NetCashProvidedByUsedInOperatingActivities"]}),
        ("period_days is null", {"assets": ["Assets"], "liabilities": ["Liabilities"], "equity": ["StockholdersEquity"], "cash": ["CashAndCashEquivalentsAtCarryingValue"]}),
    ) for k, names in group.items()
)
_SOURCE = ", ".join(f"max({c}) filter (where concept = 'NetIncomeLoss' and {_YEAR}) as {c}" for c in ("form", "filed", "accn"))


@query(f"select cik, period_end as fiscal_year_end, {_MEASURES}, {_SOURCE} from {_CUR} where {_YEAR} or period_days is null group by all having count(*) filter (where {_YEAR}) > 0")
def sec_annual(s, d):
    return Q.annual(V.typed_facts(S.facts(s, d)), ["USD"])


@query("select cik, concept, unit, period_start, period_end, val, filed, accn, row_number() over (partition by cik, taxonomy, concept, unit, period_start, period_end order by filed desc, accn desc, val desc) as vintage from facts")
def sec_fact_vintages(s, d):
    return Q.fact_vintages(V.typed_facts(S.facts(s, d))).select("cik", "concept", "unit", "period_start", "period_end", "val", "filed", "accn", "vintage")


@query("select cik, filed, form, period, items, accn, document from filings")
def sec_filings(s, d):
    return Q.filings_of(S.filings(s, d))


@query("select symbol, case when sid = 1 then symbol else symbol || '#' || sid::varchar end as series_symbol, sid::bigint as series_id, as_of, open, high, low, close, volume from segments")
def sec_bars(s, d):
    return D.segment_series(S.bars(s, d), 10, 1, 0).select("symbol", "series_symbol", "series_id", "as_of", "open", "high", "low", "close", "volume")


@query("select symbol, settlement_date, short_interest, days_to_cover from si")
def short_interest(s, d):
    return _si(s, d).select("symbol", "settlement_date", "short_interest", "days_to_cover").orderBy("symbol", F.col("settlement_date").desc())


@query(f"select as_of, v.symbol, short_volume, total_volume, {r('short_ratio', 4)} as short_ratio, {r('short_ratio - baseline_ratio', 4)} as vs_baseline, {r('baseline_ratio', 4)} as baseline_ratio, sessions as baseline_sessions from sv v left join base b on v.symbol = b.symbol where {window('sv', 'as_of', 14)}")
def short_volume(s, d):
    return Q.short_volume_screen(_sv(s, d), V.short_baseline(_sv(s, d), 20.0), 14)


@query(f"select v.symbol, as_of, total_volume, {r('short_ratio', 4)} as short_ratio, {r('baseline_ratio', 4)} as baseline_ratio, {r('short_ratio - baseline_ratio', 4)} as vs_baseline, sessions as baseline_sessions from sv v join base b on v.symbol = b.symbol where as_of = (select max(as_of) from sv) and total_volume >= 20 and sessions >= 5 and short_ratio is not null order by abs(short_ratio - baseline_ratio) desc, v.symbol limit 50")
def short_outliers(s, d):
    return Q.short_outliers(_sv(s, d), V.short_baseline(_sv(s, d), 20.0), 20, 5, 50)


@query("select symbol, settlement_date, short_interest, short_interest_prev, change_shares, change_pct, days_to_cover from si where settlement_date = (select max(settlement_date) from si) and short_interest >= 1000 order by abs(change_pct) desc nulls last, symbol limit 50")
def short_movers(s, d):
    return Q.short_movers(_si(s, d), 1000, 50)


_ANN = f"""select f.accn, f.symbol, f.name as company, headline, g.category, item_codes, items_detail, item_count, f.filed, f.period as event_date, f.accepted, react_date, react_close, react_pct, 'https://www.sec.gov/Archives/edgar/data/' || f.cik || '/' || replace(f.accn, '-', '') || '/' || f.document as url
from (select *, case when hour(timezone('America/New_York', timezone('UTC', accepted))) >= 16 then filed + 1 else filed end as tradable from (select * from filings where form = '8-K' and items <> '' and filed > (select max(filed) from filings where form = '8-K' and items <> '') - 365) k
  join (select cik as c, symbol, name from filer_symbols qualify row_number() over (partition by cik order by length(symbol), symbol) = 1) o on k.cik = o.c) f
join (select accn, arg_min(label, (priority, item)) as headline, arg_min(category, (priority, item)) as category, string_agg(item, ', ' order by item) as item_codes, string_agg(item || '  ' || label, ' | ' order by item) as items_detail, count(*) as item_count from (
  select distinct accn, x.item, coalesce(label, 'Item ' || x.item) as label, coalesce(category, 'Other') as category, coalesce(priority, 99) as priority from (select accn, trim(unnest(string_split(items, ','))) as item from filings where form = '8-K') x left join {ITEM_ROWS} on x.item = i.item where x.item <> '' and x.item <> '9.01') group by accn) g on f.accn = g.accn
left join lateral (select as_of as react_date, adj_close as react_close, pct_change as react_pct from dbn p where p.symbol = f.symbol and p.as_of between f.tradable and f.tradable + 10 order by as_of limit 1) r on true"""


@query(_ANN)
def announcements(s, d):
    return Q.announcements(S.filings(s, d), V.filer_symbols(S.cik_symbols(s, d)), V.adjusted_sessions(_daily(s, d), 2), 365)


# ---- F: derivations


@query("select symbol, as_of, 'x' as dataset, max(job) as job, arg_max(close, job) as close from (select symbol, as_of, close, 'j' || k::varchar as job from bars, unnest([1, 2]) t(k)) group by all".replace("bars, unnest([1, 2]) t(k)", "bars cross join (values (1), (2)) t(k)"))
def bars_dedup(s, d):
    b = S.bars(s, d).select("symbol", "as_of", "close", F.lit("x").alias("dataset"), F.explode(F.array(F.lit("j1"), F.lit("j2"))).alias("job"))
    return D.dedup_bars(b).select("symbol", "as_of", "dataset", "job", "close")


@query("select symbol, as_of, gap, seam, sid::bigint as series_id from segments")
def series_segment(s, d):
    return D.segment_series(S.bars(s, d), 10, 1, 0).select("symbol", "as_of", "gap", "seam", "series_id")


def _counts(s, d):
    sp = S.splits(s, d).withColumn("k", F.regexp_extract("symbol", "([0-9]+)$", 1).cast("long"))
    q = S.bars(s, d).select(F.col("symbol").alias("bs"), F.to_date(F.add_months(F.date_trunc("quarter", "as_of"), 3)).alias("end")).distinct()
    val = F.when(F.col("end") > F.col("effective_date"), 1000 * (1 + F.col("k") % 4)).otherwise(1000).cast("double")
    return sp.join(q, F.col("symbol") == F.col("bs")).select((F.col("k") % 25).alias("cik"), "end", val.alias("val")).distinct()


@query("select cik, window_start, window_end, shares_ratio, clean from candidates")
def split_candidates(s, d):
    return D.split_candidates(_counts(s, d))


@query("""select c.cik, b.symbol, c.window_start, c.window_end, c.shares_ratio, c.clean as nearest_clean_ratio, effective_date, case when b.symbol is not null then 1 / c.clean end as ratio,
  case when b.symbol is not null then 'confirmed' when n.cik is null then 'no_symbol' else 'no_price_match' end as confidence from candidates c
  left join (select cik, window_end, symbol, as_of as effective_date from (select *, open / pc as ratio from (select c.cik, c.window_end, c.shares_ratio, b.symbol, b.as_of, b.open, lag(b.close) over (partition by c.cik, c.window_end, b.symbol order by b.as_of) as pc
    from candidates c join filer_symbols f on c.cik = f.cik join (select upper(symbol) as symbol, as_of, open, close from bars_split) b on b.symbol = f.symbol and b.as_of between c.window_start and c.window_end)
    where pc > 0 and abs(open / pc * shares_ratio - 1) < 0.15) qualify row_number() over (partition by cik, window_end order by abs(ratio * shares_ratio - 1), as_of) = 1) b on c.cik = b.cik and c.window_end = b.window_end
  left join (select distinct cik from filer_symbols) n on c.cik = n.cik""".replace("window_end, symbol, as_of as effective_date from (select *,", "window_end, symbol, as_of as effective_date, ratio, shares_ratio from (select *,"))
def split_confirm(s, d):
    b = S.bars(s, d).join(S.splits(s, d).select("symbol", "effective_date", "ratio"), "symbol", "left")
    f = F.when(F.col("as_of") >= F.col("effective_date"), F.col("ratio")).otherwise(1.0)
    b = b.select(F.upper("symbol").alias("symbol"), "as_of", (F.col("open") * f).alias("open"), (F.col("close") * f).alias("close"))
    return D.confirm_splits(D.split_candidates(_counts(s, d)), V.filer_symbols(S.cik_symbols(s, d)), b)




#: The key in SQL, with a suffix list of its own.
_KEY = r"regexp_replace(regexp_replace(replace(regexp_replace(upper(coalesce({0}, '')), '\(.*?\)', ' ', 'g'), '&', ' AND '), '\b(LIMITED|LIMTED|LTD|LIM|LT|PRIVATE|PVT|CORPORATION|CORP)\b', ' ', 'g'), '[^A-Z0-9]', '', 'g')"
_NAMES = r"(select distinct c_name || case c_custkey % 7 when 0 then ' (India) Ltd.' when 1 then ' Co & Sons Pvt LIMTED' when 2 then ' Company Inc' when 3 then ' India Lim' when 4 then ' The Corp' when 5 then ' LT' else ' Ltdx' end as name from customer)"


@query(f"select name, {_KEY.format('name')} as key from {_NAMES}")
def name_key(s, d):
    ends = F.array(*[F.lit(x) for x in (" (India) Ltd.", " Co & Sons Pvt LIMTED", " Company Inc", " India Lim", " The Corp", " LT", " Ltdx")])
    names = S.table(s, d, "customer").select(F.concat("c_name", F.get(ends, (F.col("c_custkey") % 7).cast("int"))).alias("name")).distinct()
    return names.select("name", D.name_key(F.col("name")).alias("key"))


_BRIDGE = f"""(select key, symbol from (select {_KEY.format('name')} as key, symbol, series, folder from masters) where key <> '' qualify row_number() over (partition by key order by (series = 'EQ')::int desc, folder desc, symbol) = 1
  union all select key, min(symbol) from (select {_KEY.format('source_company')} as key, source_symbol as symbol from eav) where key <> '' and key not in (select {_KEY.format('name')} from masters) group by key)"""


def _bridge(s, d):
    return D.symbol_bridge(S.masters(s, d), S.eav(s, d).select(F.col("source_company").alias("company"), F.col("source_symbol").alias("symbol")))


@query(f"select key, symbol from {_BRIDGE} b")
def symbol_bridge(s, d):
    return _bridge(s, d)


@query(f"""select n.name, n.key, symbol from (select distinct name || ' holdings' as name, {_KEY.format("name || ' holdings'")} as key from masters) n left join (select name, symbol from (select n.name, b.symbol, n.key = b.key as same, length(b.key) as len from
  (select distinct name || ' holdings' as name, {_KEY.format("name || ' holdings'")} as key from masters) n join {_BRIDGE} b on n.key = b.key or length(b.key) >= 12 and starts_with(n.key, b.key)) qualify row_number() over (partition by name order by same desc, len desc) = 1) h on n.name = h.name""")
def resolve_prefix(s, d):
    return D.resolve_names(S.masters(s, d).select(F.concat("name", F.lit(" holdings")).alias("name")), _bridge(s, d))




@query("""select url, min(p) as published, max(m) as lastmod, arg_max(t, (m, d)) as title, greatest(count(distinct m), 1) as revisions, min(d) as first_seen, max(d) as last_seen, max(s) as shard, 'views' as section from (
  select 'u' || user_id::varchar as url, ts as p, date_trunc('hour', ts) as m, ts::date as d, 't' || hour(ts)::varchar as t, case when event_id % 50 = 0 then 'yesterday' else 'today' end as s from events where event_type = 'view') group by url""")
def news_history(s, d):
    e = S.table(s, d, "events").where("event_type = 'view'")
    snaps = e.select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").alias("published"), F.date_trunc("hour", "ts").alias("lastmod"), F.to_date("ts").alias("snap"), F.concat(F.lit("t"), F.hour("ts")).alias("title"), F.when(F.col("event_id") % 50 == 0, "yesterday").otherwise("today").alias("shard"), F.lit("views").alias("section"))
    return D.news_history(snaps)


@query("select p_partkey as fincode, p_name as name, p_brand as bse, p_type as nse from part where p_partkey % 10 > 0")
def fincode_index(s, d):
    p = S.table(s, d, "part").select(F.col("p_partkey").alias("fincode"), F.when(F.col("p_partkey") % 10 > 0, F.concat_ws(" | ", "p_name", "p_brand", "p_type")).otherwise(F.col("p_name")).alias("stock_search"))
    return D.code_index(p)


@query("select code, name, houses, schemes, stocks from (select code, (select manager from funds g where g.code = f.code group by manager order by count(*) desc, manager limit 1) as name, string_agg(distinct house, ', ' order by house) as houses, count(distinct scheme) as schemes, count(distinct stock) as stocks from funds f group by code)")
def fund_manager_index(s, d):
    return D.manager_index(S.funds(s, d))


# ---- A, B, J: readers, stores and streams over data derived from the tables


@query("select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus, o_orderdate::date as as_of from orders")
def scan_csv_glob(s, d):
    """Orders written as CSV files under day folders, half of them with other column orders, and read back by name."""
    root = scratch(s, "csv")
    o = S.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyyMMdd").alias("folder"))
    for k, cols in enumerate((["o_orderkey", "o_custkey", "o_orderstatus", "folder"], ["o_orderstatus", "folder", "o_orderkey", "o_custkey"])):
        o.where(F.col("o_orderkey") % 2 == k).select(*cols).write.option("header", True).csv(f"{root}/2024010{k + 1}")
    t = R.scan_csv_glob(s, f"{root}/*/*.csv")
    return t.where(R.folder_date("file_path").isNotNull()).select("o_orderkey", "o_custkey", "o_orderstatus", F.try_to_date("folder", "yyyyMMdd").alias("as_of"))


@query("select symbol, as_of, close from bars")
def write_clustered(s, d):
    path = scratch(s, "clustered")
    K.write_clustered(S.bars(s, d).select("symbol", "as_of", "close"), path, ["symbol", "as_of"])
    return s.read.parquet(path)


@query("select as_of, symbol, short_volume, total_volume from sv")
def accrue_dedup(s, d):
    """Days accrue in two overlapping loads; the largest total of a day and symbol stays."""
    path, sv = scratch(s, "accrued"), S.short_volume(s, d)
    K.accrue(s, path, sv.where("day(as_of) <= 20").withColumn("total_volume", F.col("total_volume") - 1), ["as_of", "symbol"], "total_volume")
    K.accrue(s, path, sv, ["as_of", "symbol"], "total_volume")
    return K.published(s, path).select("as_of", "symbol", "short_volume", "total_volume")


@query("select as_of, symbol, short_volume, total_volume from sv")
def accrue_days(s, d):
    """The same in a store by day, of which the second load rewrites the days it touches."""
    path, sv = scratch(s, "accrued-days"), S.short_volume(s, d).select("symbol", "short_volume", "total_volume", "as_of")
    B.accrue_days(s, path, sv.where("day(as_of) <= 20").withColumn("total_volume", F.col("total_volume") - 1), ["symbol"], "total_volume", "as_of")
    B.accrue_days(s, path, sv.where("day(as_of) > 10"), ["symbol"], "total_volume", "as_of")
    B.accrue_days(s, path, sv.where("day(as_of) <= 10"), ["symbol"], "total_volume", "as_of")
    return B.stored_days(s, path).select("as_of", "symbol", "short_volume", "total_volume")


@query("select as_of, symbol, short_volume from sv where day(as_of) > 3")
def publish_atomic(s, d):
    """Two states published after each other; readers see the second."""
    path, sv = scratch(s, "published"), S.short_volume(s, d).select("as_of", "symbol", "short_volume")
    K.publish(sv.where("day(as_of) <= 3"), path)
    K.publish(sv.where("day(as_of) > 3"), path)
    return K.published(s, path)


@query("select distinct event_id, user_id, event_type, ts::date as as_of from events")
def split_by_day(s, d):
    e = S.table(s, d, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "dd-MMM-yyyy").alias("day"))
    path = scratch(s, "days")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 or event_id % 3 = 0")):  # days of the first load stay
        B.split_by_day(part.unionByName(part.where("event_id % 3 = 0")), path, F.try_to_date("day", "dd-MMM-yyyy"), None).collect()
    return B.stored_days(s, path).select("event_id", "user_id", "event_type", "as_of")


@query("select distinct xbrl_url, context_ref, tag, value from eav")
def union_never_shrink(s, d):
    path, e = scratch(s, "facts"), S.eav(s, d).select("xbrl_url", "context_ref", "tag", "value")
    K.union_never_shrink(s, path, e.where("context_ref = 'MainI'"))
    K.union_never_shrink(s, path, e)
    return K.published(s, path)


@query("select symbol, company_name from security")
def snapshot_read(s, d):
    """The first version of a table that was published twice."""
    root = scratch(s, "snapshots")
    for k in range(2):
        K.snapshot_publish(s, root, {"security": _sec(s, d).withColumn("company_name", F.col("company_name") if k == 0 else F.lit("later"))}, f"sync {k}")
    return K.snapshot_read(s, root, "security", 1)


_TEXT = lambda x: f"trim(regexp_replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(rf"""select page_id, url, {_TEXT("regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")} as title,
  coalesce({_TEXT("array_to_string(list_transform(regexp_extract_all(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')), ' ')")}, '') as h1,
  len(regexp_extract_all(h, '(?i)<a[\s>]'))::bigint as links, len(regexp_extract_all(h, '(?i)<p[\s>]'))::bigint as paragraphs
  from (select page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') as h from pages)""")
def page_outline(s, d):
    return X.page_outline(S.table(s, d, "pages"))


@query("select ts::date as as_of, event_type, count(*) as n from events group by all")
def session_counts(s, d):
    """The stream's counts by day, in complete mode over all files there are, late rows and open days too; each state is published to a store."""
    store, schema = scratch(s, "session-store"), S.table(s, d, "events").schema
    src = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    J.publish_states(J.session_counts(src, late=None), store, scratch(s, "sessions")).awaitTermination()
    found = K.published(s, store)
    return s.createDataFrame([], "as_of date, event_type string, n long") if found is None else found


@query("select user_id, event_type, ts::date as as_of, max(value) as value from events group by all")
def accrue_stream(s, d):
    """A stream into a store by day, run a second time from its checkpoint and once more over the same rows from another."""
    e = S.table(s, d, "events")
    store, first, again = (scratch(s, x) for x in ("stream-store", "stream-checkpoint", "stream-checkpoint"))
    for checkpoint in (first, first, again):
        src = s.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").select("user_id", "event_type", "value", F.to_date("ts").alias("as_of"))
        J.accrue_stream(src, store, checkpoint, ["user_id", "event_type"], "value", "as_of").awaitTermination()
    return B.stored_days(s, store).select("user_id", "event_type", "as_of", "value")

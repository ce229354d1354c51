"""DuckDB SQL of the stand-in inputs and views, as named common table expressions, and of each registered query."""

from __future__ import annotations

import re

from ..operators.views import ACTION_RULES
from ..sources.standins import CONCEPTS, DIMS, ITEM_CODES, PLAN_TEXTS, PURPOSES
from .screens import ITEMS, NEWS_BUCKETS, STOP


def r(x: str, d: int) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sym(expr: str) -> str:
    return f"'Brand#' || ({expr})::varchar"


_BRAND_NO = "regexp_extract(p_brand, '([0-9]+)$', 1)::bigint"
_ORDER = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_LATEST = "row_number() over (partition by {0} order by {1}) = 1"


def _extremes(side: str, fn: str) -> str:
    return f"""select symbol, 'EQ' as series, as_of as event_date, {side} - k as price, as_of + k::integer as folder from (
  select *, unnest(range(0, day(as_of) % 3 + 1)) as k from (select *, {fn}({side}) over (partition by symbol order by as_of rows between 251 preceding and current row) as best from bars) where {side} = best)"""


def _pivot(tag: str) -> str:
    return f"max(value) filter (where tag = '{tag}')"


_CONCEPT = f"{_list(CONCEPTS)}[(o_orderkey // 4 % {len(CONCEPTS)} + 1)::integer]"
#: The category of a purpose, from the rules in their order.
CATEGORY = "case " + " ".join(f"when {' or '.join(f'upper(purpose) like {p!r}' for p in patterns)} then '{name}'" for name, patterns in ACTION_RULES) + " else 'Other' end"

CTE = {
    "bars": f"select p_brand as symbol, l_shipdate::date as as_of, first(px order by k) as open, max(px) as high, min(px) as low, last(px order by k) as close, sum(l_quantity) as volume from (select *, l_extendedprice / l_quantity as px, {_ORDER} as k from lineitem where l_quantity > 0) join part on l_partkey = p_partkey group by all",
    "splits": f"select p_brand as symbol, (date '1998-01-01' + (30 * {_BRAND_NO})::integer) as effective_date, 1.0::double / (1 + {_BRAND_NO} % 4) as ratio from (select distinct p_brand from part)",
    "masters": "select p_name || ' ' || p_brand as name, p_brand as symbol, ['EQ','SM','ST','BE','GB'][(p_partkey % 5 + 1)::integer] as series, case when p_partkey % 7 = 0 then 'Y' else 'N' end as delflg, date '2024-01-01' + (p_partkey % 3)::integer as folder, 'IN' || lpad(p_partkey::varchar, 8, '0') as isin from part",
    "highs": _extremes("high", "max"),
    "lows": _extremes("low", "min"),
    "hi52": f"select symbol, series, event_date, price from highs qualify {_LATEST.format('symbol, event_date', 'folder desc, price desc')}",
    "lo52": f"select symbol, series, event_date, price from lows qualify {_LATEST.format('symbol, event_date', 'folder desc, price desc')}",
    "prices": f"select as_of, symbol, 'EQ' as series, prev_close, close, volume as qty, close * volume as turnover_lacs, {r('(close - prev_close) / nullif(prev_close, 0) * 100', 2)} as pct_change from (select *, lag(close) over (partition by symbol order by as_of) as prev_close from bars)",
    "security": "select symbol, arg_max(name, (folder, name)) as company_name from masters group by symbol",
    "bridge": f"select upper(trim(name)) as key, symbol from masters where delflg = 'N' and series in ('EQ','SM','ST','SL','SQ') qualify {_LATEST.format('upper(trim(name))', '(series = $$EQ$$)::int desc, length(symbol), symbol')}",
    "glraw": "select case when pct_change >= 0 then 'G' else 'L' end as gain_loss, n.name as security, as_of, pct_change as pct from prices p join (select symbol, min(name) as name from masters group by symbol) n on p.symbol = n.symbol",
    "gainloss": "select as_of, b.symbol, security as company_name, gain_loss as direction, pct as pct_change from glraw g left join bridge b on upper(trim(g.security)) = b.key where as_of is not null and pct is not null",
    "circuit": "select as_of, symbol, 'EQ' as series, case when close = high and close > open then 'H' when close = low and close < open then 'L' end as highlow from bars where close = high and close > open or close = low and close < open",
    "mcap": f"select symbol, market_cap, close_price, face_value from (select symbol, as_of as folder, close * volume as market_cap, close as close_price, 10.0::double as face_value from bars) qualify {_LATEST.format('symbol', 'folder desc')}",
    "pe": f"select symbol, symbol_pe, adjusted_pe from (select symbol, as_of as folder, volume as symbol_pe, volume / 2 as adjusted_pe from bars) qualify {_LATEST.format('symbol', 'folder desc')}",
    "actraw": f"select {sym('user_id % 25 + 1')} as symbol, case when event_id % 10 = 0 then 'BE' else 'EQ' end as series, strftime(ts, '%Y-%m-%d') as ex_dt, '' as record_dt, {_list(PURPOSES)}[(event_id % 12 + 1)::integer] as purpose from events",
    "actions": f"select distinct symbol, series, nullif(ex_dt, '') as ex_date, nullif(record_dt, '') as record_date, {CATEGORY} as category, trim(purpose) as purpose from actraw where series = 'EQ' and nullif(trim(purpose), '') is not null",
    "daily": "select b.*, 1::bigint as series_id, (select max(ratio) from splits s where s.symbol = b.symbol and s.effective_date = b.as_of) as split_ratio, coalesce((select product(ratio) from splits s where s.symbol = b.symbol and s.effective_date > b.as_of), 1.0) as cum_factor from bars b",
    "adjusted": "select symbol, series_id, as_of, open, high, low, close, volume, split_ratio, cum_factor, open * cum_factor as adj_open, high * cum_factor as adj_high, low * cum_factor as adj_low, close * cum_factor as adj_close from daily",
    "sessions": "select *, lag(adj_close) over w as prev_close, max(adj_high) over y as hi, min(adj_low) over y as lo, count(*) over y as sessions_seen from adjusted window w as (partition by symbol, series_id order by as_of), y as (partition by symbol, series_id order by as_of rows between 251 preceding and current row)",
    "us_prices": f"select * exclude (hi, lo), hi as hi_52w, lo as lo_52w, case when prev_close > 0 then {r('(adj_close - prev_close) / prev_close * 100', 4)} end as pct_change from sessions",
    "dbn": f"select * exclude (hi, lo), hi as hi_252d, lo as lo_252d, case when prev_close > 0 then {r('(adj_close - prev_close) / prev_close * 100', 2)} end as pct_change from sessions",
    "ranks": "select as_of, symbol, pct_change, case when pct_change >= 0 then 'G' else 'L' end as direction, row_number() over (partition by as_of order by pct_change desc, symbol, series_id) as gain_rank, row_number() over (partition by as_of order by pct_change, symbol, series_id) as lose_rank from us_prices where pct_change is not null",
    "filings": f"select o_orderkey::varchar as accn, o_custkey % 25 as cik, case when o_orderstatus = 'F' then '8-K' else '10-Q' end as form, o_orderdate::date as filed, o_orderdate::date::timestamp + to_seconds(o_orderkey * 37 % 86400) as accepted, o_orderdate::date - 3 as period, {_list(ITEM_CODES)}[(o_orderkey % 9 % {len(ITEM_CODES)} + 1)::integer] || ',' || {_list(ITEM_CODES)}[(o_orderkey % 7 % {len(ITEM_CODES)} + 1)::integer] as items, 'd' || o_orderkey::varchar || '.htm' as document from orders",
    "filers": f"select k % 25 as cik, 'Filer ' || p_brand as name, case when k % 3 = 0 then p_brand || '.B,' || p_brand else p_brand end as tickers, 'Nasdaq' as exchanges, 'Sector ' || (k % 4)::varchar as sic_description from (select distinct p_brand, {_BRAND_NO} as k from part)",
    "filer_symbols": "select cik, replace(upper(trim(s)), '.', '-') as symbol, name, exchanges, sic_description from (select *, unnest(string_split(tickers, ',')) as s from filers) where trim(s) <> ''",
    "facts": f"""select *, datediff('day', period_start, period_end) as period_days from (
  select o_custkey as cik, 'us-gaap' as taxonomy, {_CONCEPT} as concept, case when o_orderkey % 11 = 0 then 'EUR' else 'USD' end as unit, q as period_start, (q + interval 3 month)::date - 1 as period_end, o_totalprice as val, o_orderdate::date as filed, '10-K' as form, o_orderkey::varchar as accn from o
  union all select o_custkey, 'us-gaap', {_CONCEPT}, case when o_orderkey % 11 = 0 then 'EUR' else 'USD' end, y, (y + interval 12 month)::date - 1, o_totalprice, o_orderdate::date, '10-K', o_orderkey::varchar from o where o_orderkey % 3 = 0
  union all select o_custkey, 'us-gaap', {_CONCEPT}, case when o_orderkey % 11 = 0 then 'EUR' else 'USD' end, null, (y + interval 12 month)::date - 1, o_totalprice, o_orderdate::date, '10-K', o_orderkey::varchar from o where o_orderkey % 3 = 1)""",
    "o": "select *, date_trunc('quarter', o_orderdate)::date as q, date_trunc('year', o_orderdate)::date as y from orders where o_totalprice is not null",
    "eav": f"""select 'u' || (event_id - event_id % 2)::varchar as xbrl_url, {sym('event_id // 2 % 25 + 1')} as source_symbol, {sym('event_id // 2 % 25 + 1')} || ' Ltd' as source_company, 'MainI' as context_ref, 'DateOfFiling' as tag, strftime(ts, '%Y-%m-%d') as value from events where event_id % 2 = 0
  union all select * from (select 'u' || (event_id - event_id % 2)::varchar, {sym('event_id // 2 % 25 + 1')}, {sym('event_id // 2 % 25 + 1')} || ' Ltd', 'Disclosure' || (event_id % 2 + 1)::varchar,
    unnest(['NameOfThePerson','CategoryOfPerson','SecuritiesAcquiredOrDisposedTransactionType','SecuritiesAcquiredOrDisposedNumberOfSecurity','SecuritiesAcquiredOrDisposedValueOfSecurity','ModeOfAcquisitionOrDisposal']),
    unnest([case when user_id % 9 > 0 then 'Person ' || user_id::varchar end, case when user_id % 2 = 0 then 'Promoter' else 'Director' end, case when event_type in ('purchase','click') then 'Buy' else 'Sell' end, floor(value)::bigint::varchar, floor(value * 10)::bigint::varchar, case when event_type = 'purchase' then 'Market Purchase' else 'Off Market' end]) as v from events) where v is not null""",
    "disclosures": f"""select m.xbrl_url, m.symbol, m.company, m.filing_date, d.* exclude (xbrl_url) from (select xbrl_url, source_symbol as symbol, source_company as company, {_pivot('DateOfFiling')} as filing_date from eav where context_ref = 'MainI' group by all) m
  join (select xbrl_url, context_ref, {_pivot('NameOfThePerson')} as person, {_pivot('CategoryOfPerson')} as category, {_pivot('SecuritiesAcquiredOrDisposedTransactionType')} as txn_type, {_pivot('SecuritiesAcquiredOrDisposedNumberOfSecurity')} as qty, {_pivot('SecuritiesAcquiredOrDisposedValueOfSecurity')} as value, {_pivot('ModeOfAcquisitionOrDisposal')} as mode from eav where context_ref like 'Disclosure%' group by xbrl_url, context_ref) d on m.xbrl_url = d.xbrl_url""",
    "shp": f"""select symbol, report_date, category, v::double / total::double * 100 as pct from (select symbol, report_date, category, v, sum(v) over (partition by symbol, report_date) as total from (
  select {sym('c_nationkey + 1')} as symbol, date_trunc('quarter', o_orderdate)::date as report_date, {_list(DIMS)}[left(o_orderpriority, 1)::integer % 3 + 1] as category, sum(o_totalprice::decimal(18,2)) as v from orders join customer on o_custkey = c_custkey group by all))""",
    "trans": f"""select e.event_id::varchar as accession, e.ts::date as trans_date, code as trans_code, case when event_type = 'error' then 'D' else 'A' end as acquired_disposed, value as shares, px as price_per_share, case when px between 0 and 100000 then value * px end as value_usd, code in ('P','S') as is_open_market, e.ts::date as filing_date, '4' as form_type, 'Issuer ' || (user_id % 25 + 1)::varchar as issuer_name, 'BRAND#' || (user_id % 25 + 1)::varchar as symbol,
    case lower({_list(PLAN_TEXTS)}[(event_id % 5 + 1)::integer]) when '1' then true when 'true' then true when '0' then false when 'false' then false end as plan_10b5_1, 'Owner ' || (user_id + k * 1000)::varchar as owner_name, case when k = 0 then 'Director' end as relationship
  from (select *, case event_type when 'purchase' then 'P' when 'error' then 'S' when 'click' then 'A' when 'view' then 'F' else 'M' end as code, case when event_id % 97 = 0 then 1.63e9 else try_cast(json_extract_string(props, '$.k') as double) end as px, unnest(range(0, event_id % 2 + 1)) as k from events) e""",
    "roster": f"select upper(p_brand) as symbol, 'Company ' || p_brand as company_name, 'Sector ' || ({_BRAND_NO} % 4)::varchar as sector from (select distinct p_brand from part) where {_BRAND_NO} % 5 > 0",
    "sv": f"select *, case when total_volume > 0 then short_volume / total_volume end as short_ratio from (select ts::date as as_of, {sym('user_id % 25 + 1')} as symbol, coalesce(sum(value::decimal(18,2)) filter (where event_type in ('error','click')), 0)::double as short_volume, sum(value::decimal(18,2))::double as total_volume from events group by all)",
    "base": "select symbol, median(short_ratio) as baseline_ratio, count(*) as sessions from sv where total_volume > 20 group by symbol",
    "si": f"""select symbol, settlement_date, short_interest, short_interest_prev, short_interest - short_interest_prev as change_shares, floor((short_interest - short_interest_prev) / nullif(short_interest_prev, 0) * 10000 + 0.5) / 100.0 as change_pct, case when n % 7 = 0 then null else n::double end as days_to_cover from (
  select *, lag(short_interest) over (partition by symbol order by settlement_date) as short_interest_prev from (select {sym('c_nationkey + 1')} as symbol, date_trunc('month', o_orderdate)::date as settlement_date, sum(o_totalprice::decimal(18,2))::double as short_interest, count(*) as n from orders join customer on o_custkey = c_custkey group by all))""",
    "funds": "select l_suppkey % 40 as code, case when l_linenumber % 4 = 0 then upper(s_name) else s_name end as manager, n_name as house, l_suppkey as scheme, l_partkey as stock from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey",
    "segments": "select *, 1 + sum(seam) over (partition by symbol order by as_of rows between unbounded preceding and current row) as sid from (select *, case when gap > 10 and volume >= 1 and volume >= 0 * greatest(prev_volume, 1) then 1 else 0 end as seam from (select *, datediff('day', lag(as_of) over w, as_of) as gap, lag(volume) over w as prev_volume from bars window w as (partition by symbol order by as_of)))",
    "counts": f"select distinct k % 25 as cik, q as \"end\", (case when q > effective_date then 1000 * (1 + k % 4) else 1000 end)::double as val from (select symbol, regexp_extract(symbol, '([0-9]+)$', 1)::bigint as k, effective_date from splits) s join (select distinct symbol as bs, (date_trunc('quarter', as_of) + interval 3 month)::date as q from bars) b on s.symbol = b.bs",
    "clean": "select unnest([2,3,4,5,6,7,8,10,15,20,25,30,50,1.5,4.0/3,2.5,1.25,100]::double[] || [1.0/2,1.0/3,1.0/4,1.0/5,1.0/6,1.0/7,1.0/8,1.0/10,1.0/15,1.0/20,1.0/25,1.0/30,1.0/50,2.0/3,3.0/4,2.0/5,4.0/5,1.0/100]::double[]) as c",
    "candidates": "select cik, ws as window_start, \"end\" as window_end, val / before as shares_ratio, c as clean from (select *, lag(\"end\") over w as ws, lag(val) over w as before from counts window w as (partition by cik order by \"end\", val)) join clean on abs(val / before / c - 1) < 0.03 where before > 0",
    "bars_split": "select b.symbol, as_of, open * f as open, close * f as close from (select b.*, case when s.effective_date is not null and b.as_of >= s.effective_date then s.ratio else 1.0 end as f from bars b left join splits s on b.symbol = s.symbol) b",
    "titles": "select doc_id, trim(string_split(coalesce(text, ''), chr(10))[1], ' ') as title from documents where trim(string_split(coalesce(text, ''), chr(10))[1], ' ') <> ''",
    "brands": r"select 'B' || item_id::varchar as symbol, list_filter(string_split(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z0-9& ]+', ' ', 'g'), ' '), lambda x: x <> '') as w from benchmark where item_id % 6 > 0 and coalesce(text, '') <> ''",
    "alias": f"""select symbol, alias from (select distinct symbol, alias from (select symbol, unnest([case when len(w) >= 2 then w[1] || ' ' || w[2] end, case when length(w[1]) >= 4 and w[1] not in ({', '.join(repr(x) for x in STOP)}) then w[1] end]) as alias from brands) where alias is not null)
  qualify count(*) over (partition by alias) <= case when alias like '% %' then 3 else 1 end""",
    # Each alias as a pattern: the first character of a word as it stands, the others in either case, white space between words.
    "patterns": r"""select symbol, alias, string_split(alias, ' ')[1] as head, '\b' || array_to_string(list_transform(string_split(alias, ' '), lambda t: left(t, 1) || case when length(t) > 1 then '(?i:' || t[2:] || ')' else '' end), '\s+') || '\b' as p from alias""",
    "near": "select doc_id, title, symbol, p from titles join patterns on contains(upper(title), head)",
    "tags": "select distinct doc_id, symbol from near where regexp_matches(title, p)",
    "news": "select symbol, sum(pts)::bigint as pts_news from (select *, min(doc_id) over (partition by key) as first from (select t.doc_id, symbol, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) as key, case "
    + " ".join(f"when regexp_matches(title, '{p}') then {n}" for n, p in NEWS_BUCKETS)
    + " end as pts from titles t join tags g on t.doc_id = g.doc_id) where pts is not null) where doc_id = first group by symbol",
}
#: What each expression needs, found by name.
_WORDS = {k: [n for n in CTE if n != k and re.search(rf"\b(from|join)\s+\(*{n}\b", v)] for k, v in CTE.items()}


def sql(select: str) -> str:
    """select with the expressions that it needs, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for n in _WORDS[name]:
                need(n)
            order.append(name)

    for n in CTE:
        if re.search(rf"\b(from|join)\s+\(*{n}\b", select):
            need(n)
    return ("with " + ",\n".join(f"{n} as ({CTE[n]})" for n in order) + "\n" if order else "") + select


def window(table: str, column: str, days: int, op: str = ">") -> str:
    return f"{column} {op} (select max({column}) from {table}) - {days}"


ITEM_ROWS = "(values " + ", ".join("('{}', '{}', '{}', {})".format(*i) for i in ITEMS) + ") i(item, label, category, priority)"

"""Registered queries over stores: look-ups of single companies, and facts as they stood on given days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import as_of as T
from ..operators import lookup as L
from ..operators import phrases as P
from ..operators import views as V
from ..sources import standins as S
from . import screens as Q
from .queries import _MEASURES, _SOURCE, _YEAR
from .registry import query


def _looked_up(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Rows of the least and the greatest key, and of one that isn't there, one look-up after the other."""
    s = rows.sparkSession
    L.publish_clustered(rows, path, [key], partitions=16)
    ranges = L.key_ranges(s, path).collect()
    ends = [min(r["least"] for r in ranges if r["least"] is not None), max(r["greatest"] for r in ranges if r["greatest"] is not None)]
    none = -1 if isinstance(ends[0], int) else "!"
    return L.look_up(s, path, key, [ends[0]], ranges).unionByName(L.look_up(s, path, key, [ends[1], none])).unionByName(L.look_up(s, path, key, [none], ranges))


@query("select cik, concept, unit, period_start, period_end, val, filed, accn, row_number() over (partition by cik, taxonomy, concept, unit, period_start, period_end order by filed desc, accn desc, val desc) as vintage from facts where cik in (select min(cik) from facts union all select max(cik) from facts)")
def facts_lookup(s, d):
    """E16 of single companies from a store clustered by company."""
    t = _looked_up(V.typed_facts(S.facts(s, d)), "cik", scratch(s, "facts-by-company"))
    return Q.fact_vintages(t).select("cik", "concept", "unit", "period_start", "period_end", "val", "filed", "accn", "vintage")


@query("select cik, filed, form, period, items, accn, document from filings where cik in (select min(cik) from filings union all select max(cik) from filings)")
def filings_lookup(s, d):
    """E17 of single companies."""
    return Q.filings_of(_looked_up(S.filings(s, d), "cik", scratch(s, "filings-by-company")))


@query("select symbol, as_of, close from bars where symbol in (select min(symbol) from bars union all select max(symbol) from bars)")
def bars_lookup(s, d):
    """E18 of single symbols."""
    return _looked_up(S.bars(s, d).select("symbol", "as_of", "close"), "symbol", scratch(s, "bars-by-symbol"))


_DAYS = "(select distinct (lo + ((k * (hi - lo)) // 19)::int)::date as as_of from (select min(filed) as lo, max(filed) as hi from facts), range(20) t(k))"
_STOOD = f"(select d.as_of, f.* from {_DAYS} d join facts f on f.filed <= d.as_of qualify row_number() over (partition by d.as_of, cik, taxonomy, concept, unit, period_start, period_end order by filed desc, accn desc, val desc) = 1)"


def _days(facts: DataFrame) -> DataFrame:
    """Twenty days from the first filing to the last."""
    ends = facts.agg(F.min("filed").alias("lo"), F.max("filed").alias("hi"))
    return ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.date_add("lo", F.floor(F.datediff("hi", "lo") * k / 19).cast("int")))).alias("as_of"))


@query(f"select as_of, cik, concept, unit, period_start, period_end, val, filed, accn from {_STOOD}")
def facts_as_of(s, d):
    """Every company's facts as they stood on twenty days."""
    f = V.typed_facts(S.facts(s, d))
    return T.facts_as_of(f, _days(f)).select("as_of", "cik", "concept", "unit", "period_start", "period_end", "val", "filed", "accn")


@query(f"select as_of, cik, period_end as fiscal_year_end, {_MEASURES}, {_SOURCE} from (select * from {_STOOD} where unit = 'USD') where {_YEAR} or period_days is null group by as_of, cik, period_end having count(*) filter (where {_YEAR}) > 0")
def annual_as_of(s, d):
    """E15 as it stood on twenty days."""
    f = V.typed_facts(S.facts(s, d)).where("unit = 'USD'")
    return Q.year_table(T.facts_as_of(f, _days(V.typed_facts(S.facts(s, d)))), ["as_of", "cik"])


_ASKED = ["the in", "and", "en der", "the , and", "die schen die", "zzz none", "th"]
_BOUND = r"(^|[^\p{L}\p{N}])", r"($|[^\p{L}\p{N}])"
_PATTERNS = ", ".join(f"('{p}', '{_BOUND[0]}{q}{_BOUND[1]}')" for p, q in [("the in", r"the\s+in"), ("and", "and"), ("en der", r"en\s+der"), ("the , and", r"the\s*,\s*and"), ("die schen die", r"die\s+schen\s+die"), ("zzz none", r"zzz\s+none"), ("th", "th")])


@query(f"select *, (sum(matches) over (partition by phrase))::bigint as total from (select phrase, source, count(*) as matches, max(doc_id) as newest, arg_max(lang, doc_id) as kind from documents, (values {_PATTERNS}) p(phrase, pattern) where regexp_matches(lower(text), pattern) group by phrase, source)")
def phrase_index(s, d):
    """D26 for several phrases at once, from an index of words' places instead of the texts."""
    docs, path = S.table(s, d, "documents"), scratch(s, "postings")
    P.publish_index(docs, path, partitions=16)
    return P.by_entity(P.search(s, path, _ASKED), docs)

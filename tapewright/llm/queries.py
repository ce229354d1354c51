"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit_sql, text_queries
from .common import fold_of, materialise, table
from .decontam import contaminated
from .filter_audit import audit
from .line_dedup import LEAST_PAGES, RATIO, dedup_lines, html_lines
from .mixing import mix_to_weights
from .near_dedup import near_duplicates
from .quality import fit_quality, with_quality
from .sharding import shard_table
from .spelling import spelling_variants

#: Target weights of the mixture, by level; values not named weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def LEVELS() -> dict[str, Column]:
    """Domain, language, source. The domain is the number at the end of the source's name modulo 4; none: d3."""
    number = F.try_to_number(F.nullif(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    return {"domain": F.concat(F.lit("d"), F.coalesce((number % 4).cast("int"), F.lit(3)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of pages, by host of the url."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    # Written once: lines are counted in one pass and taken out in another, and tags cost more than both.
    pages = materialise(table(spark, sf_dir, "pages").select("page_id", host.alias("host"), html_lines(F.col("html")).alias("text")), "page-lines")
    return dedup_lines(pages, "host", "text", dropped="lines_dropped").select("page_id", "host", "lines_dropped", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_to_weights(table(spark, sf_dir, "documents"), LEVELS(), WEIGHTS)
    return out.select("doc_id", "lang", "source", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    out = with_quality(docs, model, "score")
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"), 16)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | text_queries.queries() | {"pipeline": pipeline}


_WS = r"[ \t\n\x0B\f\r]"

ORACLE = {
    "op3_line_dedup": rf"""
with base as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
      '</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|br|nav|article|header|footer|section|title|head|body|html|pre|blockquote)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g') as text
  from pages),
numbered as (select row_number() over () as r, * from base),
lines as (select r, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from numbered),
normed as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as n from lines),
total as (select host, count(*) as pages from numbered group by host),
bad as (select c.host, c.n from (select host, n, count(distinct r) as k from normed where n <> '' group by host, n) c
  join total t on c.host is not distinct from t.host where k >= {LEAST_PAGES} and k > {RATIO} * pages),
kept as (select l.r, coalesce(string_agg(line, chr(10) order by pos) filter (where b.n is null), '') as text, count(*) filter (where b.n is not null) as gone
  from normed l left join bad b on l.host is not distinct from b.host and l.n = b.n group by l.r)
select page_id, host, gone::bigint as lines_dropped, md5(k.text) as text_md5, length(k.text)::bigint as n_chars
from numbered d join kept k on d.r = k.r""",
}


def _mixing_sql() -> str:
    weight = lambda level: "case " + " ".join(f"when {level} = '{v}' then {w}" for v, w in WEIGHTS[level].items()) + " else 1 end" if level in WEIGHTS else "1"
    sql = r"""
with docs as (
  select doc_id, lang, source, 'd' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as bigint) % 4, 3)::varchar as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::bigint as n from documents),
leaf as (select domain, lang, source, sum(n)::bigint as tokens from docs group by all),
b0 as (select (sum(tokens) * 60 // 100)::bigint as granted from leaf)"""
    levels, above = ["domain", "lang", "source"], []
    for k, level in enumerate(levels):
        keys = ", ".join(levels[: k + 1])
        up = "(select * from b0)" if not above else f"b{k}"
        on = "true" if not above else " and ".join(f"c.{c} is not distinct from u.{c}" for c in above)
        part = f"partition by {', '.join(above)}" if above else ""
        sql += f""",
n{k} as (select c.*, u.granted from (select {keys}, sum(tokens * 2)::hugeint as capacity, ({weight(level)})::hugeint as weight from leaf group by {keys}) c join {up} u on {on}),
s{k} as (select *, granted - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as rem,
  sum(weight) over ({part}) - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as wrest
  from n{k} window w as ({part} order by capacity::double / weight::double, {level} nulls first)),
f{k} as (select *, capacity * wrest <= rem * weight as full_up from s{k}),
b{k + 1} as (select {keys}, (case when full_up then capacity else (granted - coalesce(sum(case when full_up then capacity end) over ({part}), 0)) * weight
  // sum(case when not full_up then weight end) over ({part}) end)::bigint as granted from f{k})"""
        above = levels[: k + 1]
    return sql + """,
plan as (select l.*, case when tokens > 0 then granted // tokens else 0 end as whole, case when tokens > 0 then granted % tokens else 0 end as rest
  from leaf l join b3 b on l.domain = b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
ordered as (select d.*, p.whole, p.rest, md5('17:' || p.whole::varchar || ':' || coalesce(d.doc_id::varchar, '')) as k
  from docs d join plan p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
run as (select *, sum(n) over (partition by domain, lang, source order by k) as upto from ordered)
select doc_id, lang, source, (whole + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint as copies from run
where whole + case when rest > 0 and upto <= rest then 1 else 0 end > 0"""


ORACLE["op5_mixing"] = _mixing_sql()


def oracle_sql() -> dict[str, str]:
    return ORACLE | audit_sql.ORACLE | text_queries.oracle_sql()

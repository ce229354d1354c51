"""Registered queries of the operators on single texts and messages, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_digest import edited_pairs
from .chat_threads import INTRODUCTION, link_quotes
from .common import fold_of, table
from .pii import KINDS, find_personal_data
from .secret_scan import ALLOW, ASSIGN, CLASSES, WINDOW, bound, joined, scan_secrets, weight_table
from .suffix_lm import score_texts


def _of(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _count(spans: Column, kind: str) -> Column:
    return F.size(_of(spans, (kind,))).cast("long").alias(f"n_{kind}")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s, kinds = F.col("secret_spans"), ("assign", "access", "hex")
    return found.select("doc_id", *[_count(s, k) for k in kinds], F.sha2(joined(_of(s, kinds)), 256).alias("base_sha256"), joined(s).alias("spans"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    s, kinds = F.col("spans"), KINDS[:4]
    return found.select("doc_id", *[_count(s, k) for k in kinds], F.sha2(joined(_of(s, kinds)), 256).alias("base_sha256"), joined(s).alias("spans"))


def op7_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) != 2)


def op8_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, least: int, source: str = "documents", body: str = "m") -> str:
    """Rows (r, kind, s, e, body) of leftmost matches by adding up the lengths between and of them."""
    p = _q(pattern)
    return f"""select r, {kind} as kind, pre + gap as s, pre + gap + length(m) as e, {body} as body from (
  select *, coalesce(sum(gap + length(m)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pre from (
    select r, unnest(ms) as m, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) as gap, generate_subscripts(ms, 1) as i from (
      select r, regexp_extract_all(text, {p}) as ms, regexp_split_to_array(text, {p}) as gs from d where regexp_matches(text, {p}))))
  where length({body}) >= {least}"""


def _secrets_sql() -> str:
    table_ = "[" + ", ".join(map(str, weight_table())) + "]"
    allow = _q("|".join(f"(?:{a})" for a in ALLOW))
    parts = [_matches(0, ASSIGN, 8, body=f"regexp_extract(m, {_q(ASSIGN)}, 2)"), _matches(1, "AKIA[A-Z0-9]+", 16), _matches(2, "[0-9a-f]+", 32)]
    sql = "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),\nbase as (" + "\nunion all ".join(f"select r, kind, s, e from ({p})" for p in parts) + ")"
    more = []
    for i, c in enumerate(CLASSES):
        sql += f""",
c{i} as (select row_number() over () as c, r, s, body from ({_matches(3 + i, c.pattern + "{" + str(WINDOW) + ",}", WINDOW)}) where not regexp_matches(body, {allow})),
h{i} as (select distinct c, r, s + w - 1 as st from (select c, r, s, w, x, count(*) as k from (
  select c, r, s, w, unnest(string_split(body[w:w + {WINDOW - 1}], '')) as x from (select *, unnest(range(1, length(body) - {WINDOW - 2})) as w from c{i})) group by all)
  group by c, r, s, w having sum({table_}[k + 1]) <= {bound(c.threshold)}),
g{i} as (select *, sum(new) over (partition by r order by st rows between unbounded preceding and current row) as g from (
  select *, case when st - lag(st) over (partition by r order by st) <= {WINDOW} then 0 else 1 end as new from h{i})),
m{i} as (select r, {3 + i} as kind, min(st) as s, max(st) + {WINDOW} as e from g{i} group by r, g)"""
        more.append(f"select * from m{i}")
    kinds = "['assign','access','hex'," + ",".join(_q(c.name) for c in CLASSES) + "]"
    label = f"{kinds}[kind + 1] || ':' || s || ':' || e"
    return sql + f""",
more as (select * from ({' union all '.join(more)}) x where not exists (select 1 from base b where b.r = x.r and b.s <= x.s and b.e >= x.e)),
every as (select * from base union all select * from more),
per as (select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  coalesce(string_agg({label}, ',' order by s, kind, e) filter (where kind < 3), '') as b, string_agg({label}, ',' order by s, kind, e) as spans from every group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join per on d.r = per.r"""


_NORM = r"trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"

ORACLE = {
    "op2_secrets": _secrets_sql(),
    "op4_quotes": rf"""
with recursive m as (select row_number() over () as r, * from conversations),
l as (select r, conv_id, turn, pos, length(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')) as level, regexp_replace(x, '^([ \t]*>)+ ?', '') as line
  from (select r, conv_id, turn, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos from m)),
n as (select *, lead(level) over w as nxt, case when level is distinct from lag(level) over w then 1 else 0 end as new from l window w as (partition by r order by pos)),
p as (select *, sum(new) over (partition by r order by pos) as run from n),
own as (select * from p where level = 0 and not (regexp_matches(line, {_q(INTRODUCTION)}) and coalesce(nxt, 0) > 0)),
clean as (select r, string_agg(line, chr(10) order by pos) as body from own group by r),
wrote as (select conv_id, turn, {_NORM.format('line')} as t from own union all select conv_id, turn, {_NORM.format("string_agg(line, ' ' order by pos)")} from own group by r, conv_id, turn),
origin as (select conv_id, t, min(turn) as first from wrote where t <> '' and conv_id is not null and turn is not null group by all),
asked as (select r, conv_id, turn, run, level, 0 as k, {_NORM.format("string_agg(line, ' ' order by pos)")} as t from p where level > 0 group by r, conv_id, turn, run, level
  union all select r, conv_id, turn, run, level, 1, {_NORM.format('line')} from p where level > 0),
hit as (select a.*, o.first from asked a join origin o on a.conv_id = o.conv_id and a.t = o.t and o.first < a.turn),
links as (select r, conv_id, turn, coalesce(max(first) filter (where level = 1 and k = 0), max(first) filter (where level = 1)) as reply_to, min(first) as root from hit group by all),
step as (select conv_id, turn, min(root) as root from links group by all),
way as (select conv_id, turn, root from step union select w.conv_id, w.turn, s.root from way w join step s on s.conv_id = w.conv_id and s.turn = w.root),
far as (select conv_id, turn, min(root) as root from way group by all),
followed as (select l.r, l.reply_to, coalesce(f.root, l.root) as root from links l left join far f on f.conv_id = l.conv_id and f.turn = l.root),
q as (select r, count(distinct run) as n_quotes, max(level) as depth from p where level > 0 group by r)
select m.conv_id, m.turn, m.role, case when m.text is null then null else coalesce(regexp_replace(case when contains(m.text, '>') then coalesce(clean.body, '') else m.text end, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '') end as text,
  reply_to, coalesce(root, m.turn) as thread, coalesce(n_quotes, 0)::bigint as n_quotes, coalesce(depth, 0)::bigint as depth
from m left join clean using (r) left join followed using (r) left join q using (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

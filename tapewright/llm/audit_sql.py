"""DuckDB SQL of the filter audit, the shards and the spelling variants."""

from __future__ import annotations

from .common import LOWER, UPPER

_TABLE = "crc as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as steps)"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, over the table `steps`."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295)"


AUDIT = r"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select r, doc_id, part, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as ws from d),
named as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(w.doc_id > min(w.doc_id) over (partition by t), false)::int as mask
  from w left join named on w.doc_id = named.doc_id),
m as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
o as (select l1.x || l2.x || l3.x || l4.x || l5.x as filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] as bits from l l1 join l l2 on l1.x <> l2.x join l l3 on l3.x not in (l1.x, l2.x)
  join l l4 on l4.x not in (l1.x, l2.x, l3.x) join l l5 on l5.x not in (l1.x, l2.x, l3.x, l4.x)),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as prior from (select *, unnest(range(1, 6)) as step from o)),
r as (select part, filter_order, step::int as step, own,
    coalesce(sum(n) filter (where mask & own = 0 and mask & prior = 0), 0)::bigint as kept, coalesce(sum(n) filter (where mask & own <> 0 and mask & prior = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & own <> 0 and mask & prior <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & own <> 0 and mask & prior = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where mask & own <> 0 and mask & prior = 0), 0)::bigint as toxic_lost
  from m cross join s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""

# The state steps before each jump: a key's first place is 0, each next one follows from the place before.
SHARDS = rf"""
with recursive {_TABLE},
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, md5(coalesce(doc_id::varchar, '')) as m from documents),
jumps(r, key, place) as (select r, ('0x' || substr(m, 1, 16))::ubigint::hugeint, 0::double from d
  union all select r, next, floor((place + 1) * (2147483648 / ((next // 8589934592)::double + 1)))
  from (select r, place, (key * 2862933555777941757 + 1) % 18446744073709551616 as next from jumps where place < 17)),
placed as (select r, (max(place) filter (where place < 16))::int as shard, (max(place) filter (where place < 17))::int as grown_shard from jumps group by r),
sized as (select r, doc_id, m, strlen(t) + 1 as size, {_crc32("t")} as text_crc32 from d, crc)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
  (row_number() over (partition by shard order by m, doc_id nulls first, size, text_crc32) - 1)::bigint as slot, grown_shard from sized join placed using (r)"""

SPELLING = rf"""
with recursive {_TABLE},
runs as (select doc, run, count(*) as k from (
  select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents) group by all),
marked as (select run, k, {_crc32("doc || ':' || run")} as h from runs, crc),
words as (select word, sum(k)::bigint as n from (
  select k, case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from marked) where length(word) >= 7 group by word having sum(k) >= 2),
sites as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
masked as (select word, n, left(word, i::int - 1) || '_' || substr(word, i::int + 1) as mask from sites),
short as (select distinct word, left(word, i::int - 1) || substr(word, i::int + 1) as mask from sites),
links as (select a.word as a, b.word as b from masked a join masked b on a.mask = b.mask and a.word <> b.word
  union select s.word, w.word from short s join words w on s.mask = w.word union select w.word, s.word from short s join words w on s.mask = w.word),
best as (select a, count(*) as n_near, arg_min(b, row(-n, b)) as near, max(n) as near_n from links join words on b = word group by a),
forms as (select w.word, n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from words w left join best on w.word = a),
way(word, root, k) as (select word, word, 0 from forms union all select w.word, f.form, k + 1 from way w join forms f on w.root = f.word where f.form is not null),
ends as (select word, arg_max(root, k) as root from way group by word)
select word, form, root, n, n_near, form_n::bigint as form_n from forms join ends using (word)"""

ORACLE = {"op11_filter_audit": AUDIT, "op12_sharding": SHARDS, "op13_spelling": SPELLING}

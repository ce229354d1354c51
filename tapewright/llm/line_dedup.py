"""Site-relative line deduplication: lines that more than a share of a host's pages carry are boilerplate and go.

Everything is native: distinct lines are counted by (host, hash) with map-side combining, so a host with a third of all pages
spreads over its lines; each host's boilerplate hashes, at most mean distinct lines a page / ratio of them, then come back
to its pages. Their table is broadcast only after its size was counted; beyond that the pages are joined by host, and those of a host
with more than an even part of all pages are dealt over several tasks by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, let, materialise, small

#: A line goes when more than this share of its host's pages have it.
RATIO = 0.1
#: And at least so many pages: a line on one page repeats nothing, and one on two may be a pair of copies.
LEAST_PAGES = 3
#: Boilerplate hashes in all that may be broadcast.
BROADCAST_HASHES = 2_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def norm(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(host, bad): for each host that has any, the hashes of its boilerplate lines; and (host, pages). A null host is a host of its own."""
    rows = pages.select(F.col(host).alias("h"), F.array_distinct(F.transform(lines_of(F.col(text)), lambda x: F.xxhash64(norm(x)))).alias("ls"), F.lit(1).alias("p"))
    pages_of = materialise(rows.groupBy("h").agg(F.sum("p").alias("pages")), "host-pages")
    seen = rows.select("h", F.explode("ls").alias("l")).where(F.col("l") != F.xxhash64(F.lit(""))).groupBy("h", "l").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = seen.alias("s").join(small(pages_of).alias("p"), F.expr("s.h <=> p.h"))
    bad = n.where(F.col("s.n") > F.lit(ratio) * F.col("p.pages")).groupBy(F.col("s.h").alias("h")).agg(F.sort_array(F.collect_set("s.l")).alias("bad"))
    return materialise(bad, "boilerplate"), pages_of


def spark_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dedup_lines(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """pages with boilerplate lines taken out of `text`; other columns and the rows stay.

    A page is a row. A line is what stands between line feeds, compared without surrounding whitespace; blank lines always
    stay. A line that repeats within a page counts once for it; all its copies go. A null text stays null. A page
    that loses all its lines keeps an empty text. Repeated rows each count as a page. Empty input gives no rows. dropped: a column to add with the number
    of lines taken out.
    """
    bad, pages_of = boilerplate(pages, host, text, ratio, least)
    h, b, salt, parts = (fresh(pages, c) for c in ("host_key", "bad_lines", "host_salt", "host_parts"))
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_HASHES:
        bad = F.broadcast(bad.select(F.col("h").alias(h), F.col("bad").alias(b)))
        both = pages.join(bad, pages[host].eqNullSafe(F.col(h)), "left")
    else:
        # Hosts with more than an even part of the pages: no more of them than there are parts.
        even = spark_parts(pages)
        total = pages_of.agg(F.sum("pages")).first()[0]
        hot = materialise(pages_of.where(F.col("pages") * even > total).select(F.col("h").alias("hot"), F.ceil(F.col("pages") * even / total).cast("int").alias(parts)), "hot-hosts")
        bad = bad.join(F.broadcast(hot), F.col("h").eqNullSafe(F.col("hot")), "left")
        bad = bad.select(F.col("h").alias(h), F.col("bad").alias(b), F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)).alias(salt))
        dealt = pages.join(F.broadcast(hot), pages[host].eqNullSafe(F.col("hot")), "left")
        dealt = dealt.withColumn(parts, F.pmod(F.xxhash64(text), F.coalesce(parts, F.lit(1))).cast("int"))
        both = dealt.join(bad, dealt[host].eqNullSafe(bad[h]) & (F.col(parts) == F.col(salt)), "left")
    ls = F.split(F.col(text), "\n")
    # The page's own boilerplate is found by hashing, so no line is compared with the whole of its host's.
    kept = let(F.array_intersect(F.transform(ls, lambda x: F.xxhash64(norm(x))), F.col(b)), lambda own: F.filter(ls, lambda x: ~F.array_contains(own, F.xxhash64(norm(x)))))
    clean = F.when(F.col(b).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = [clean.alias(text) if c == text else F.col(c) for c in pages.columns]
    if dropped:
        out.append(F.when(F.col(b).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text), "\n")) - F.size(kept)).cast("long").alias(dropped))
    return both.select(*out)


#: Stands before a letter while tags are taken out: b for a < that opens nothing, a for itself.
_MARK = "\x01"


def _behind(x: Column, closer: str, opener: str, change, otherwise) -> Column:
    """Where `opener` stands behind the last `closer` of x: change(x up to there, the rest); else, as in most pages, otherwise(x)."""
    tail = lambda v: F.substring_index(v, closer, -1)  # noqa: E731  all of v when it has no closer
    split = lambda v, t: change(F.substr(v, F.lit(1), F.length(v) - F.length(t)), t)
    return let(x, lambda v: F.when(F.contains(tail(v), F.lit(opener)), let(tail(v), lambda t: split(v, t))).otherwise(otherwise(v)))


def _quiet(x: Column, opener: str, after: str, closer: str) -> Column:
    """x with the < of openers marked that no closer follows, so that none of them is looked for to the end of the page."""
    mark = lambda t: F.regexp_replace(t, f"<(?={opener[1:]}{after})", _MARK + "b")
    return _behind(x, closer, opener, lambda head, tail: F.concat(head, mark(tail)), lambda v: v)


def _closed(x: Column, pattern: str, by: str) -> Column:
    """x with matches of a pattern from < to > replaced; what follows the last > holds none and isn't searched."""
    replace = lambda v: F.regexp_replace(v, pattern, by)
    return _behind(x, ">", "<", lambda head, tail: F.concat(replace(head), tail), replace)


def html_lines(html: Column) -> Column:
    """Visible lines of an HTML page: scripts, styles, comments and tags go, block tags and <br> end a line. Linear in the page, whatever stands open."""
    x = F.replace(F.coalesce(html, F.lit("")), F.lit(_MARK), F.lit(_MARK + "a"))
    x = _quiet(x, "<!--", "", "-->")
    x = _quiet(x, "<script", r"\b", "</script>")
    x = _quiet(x, "<style", r"\b", "</style>")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    x = F.replace(F.replace(x, F.lit(_MARK + "b"), F.lit("<")), F.lit(_MARK + "a"), F.lit(_MARK))
    x = _closed(x, r"</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|br|nav|article|header|footer|section|title|head|body|html|pre|blockquote)\b[^>]*>", "\n")
    x = _closed(x, r"<[^>]*>", "")
    return F.regexp_replace(x, r"(?<![ \t\r])[ \t\r]*\n[ \t\r\n]*", "\n")

"""Batch derivations: bar deduplication, ticker-reuse segments, split detection, name bridges, holdings, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import latest_per

#: Split ratios that count as clean, larger over smaller; their inverses count too. Fixed values.
CLEAN = [(2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (10, 1), (15, 1), (20, 1), (25, 1), (30, 1), (50, 1), (3, 2), (4, 3), (5, 2), (5, 4), (100, 1)]
#: Suffixes and abbreviations on which full legal names and truncated master names differ. Fixed values.
SUFFIXES = ("LIMITED", "LIMTED", "LTD", "LIM", "LT", "PRIVATE", "PVT", "CORPORATION", "CORP")


def dedup_bars(bars: DataFrame) -> DataFrame:
    """One bar for each (symbol, as_of, dataset): that of the latest job."""
    return latest_per(bars, ["symbol", "as_of", "dataset"], [F.col("job").desc()])


def segment_series(bars: DataFrame, gap_days: int = 20, least_volume: float = 100_000, ratio: float = 20) -> DataFrame:
    """series_id = 1 + number of seams so far: a long gap after which volume is large, both absolutely and against the bar before."""
    w = W.partitionBy("symbol").orderBy("as_of")
    gap, prev = F.datediff("as_of", F.lag("as_of").over(w)), F.lag("volume").over(w)
    seam = F.when((F.col("gap") > gap_days) & (F.col("volume") >= least_volume) & (F.col("volume") >= ratio * F.greatest("prev_volume", F.lit(1))), 1).otherwise(0)
    t = bars.withColumns({"gap": gap, "prev_volume": prev}).withColumn("seam", seam)
    t = t.withColumn("series_id", (1 + F.sum("seam").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long"))
    return t.withColumn("series_symbol", F.when(F.col("series_id") == 1, F.col("symbol")).otherwise(F.concat_ws("#", "symbol", "series_id")))


def split_candidates(counts: DataFrame) -> DataFrame:
    """Of (cik, end, val) share counts, steps within 3 % of a clean ratio: cik, window_start, window_end, shares_ratio, clean."""
    w = W.partitionBy("cik").orderBy("end", "val")
    steps = counts.select("cik", "end", "val").distinct().withColumns({"window_start": F.lag("end").over(w), "before": F.lag("val").over(w)})
    steps = steps.where("before > 0").withColumn("shares_ratio", F.col("val") / F.col("before"))
    ratios = [a / b for a, b in CLEAN] + [b / a for a, b in CLEAN]
    clean = F.get(F.filter(F.array(*[F.lit(float(r)) for r in ratios]), lambda c: F.abs(F.col("shares_ratio") / c - 1) < 0.03), F.lit(0))
    return steps.withColumn("clean", clean).where("clean is not null").select("cik", "window_start", F.col("end").alias("window_end"), "shares_ratio", "clean")


def confirm_splits(candidates: DataFrame, symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates with the bar in their window whose open over the previous close is within 15 % of 1 / shares_ratio, the nearest one.

    The previous close is taken inside the window, so its first bar is never the day. Others come out unconfirmed, without a ratio.
    """
    c = candidates.join(symbols.select("cik", "symbol"), "cik", "left")
    b = bars.select(F.col("symbol").alias("bs"), "as_of", "open", "close")
    inside = c.join(b, (F.col("symbol") == F.col("bs")) & F.col("as_of").between(F.col("window_start"), F.col("window_end")))
    w = W.partitionBy("cik", "window_end", "symbol").orderBy("as_of")
    t = inside.withColumn("pc", F.lag("close").over(w)).where("pc > 0").withColumn("ratio", F.col("open") / F.col("pc"))
    t = t.withColumn("off", F.abs(F.col("ratio") * F.col("shares_ratio") - 1)).where("off < 0.15")
    best = latest_per(t, ["cik", "window_end"], [F.col("off"), F.col("as_of")]).select("cik", "window_end", F.col("symbol").alias("found"), F.col("as_of").alias("effective_date"), (1 / F.col("clean")).alias("ratio"))
    has = symbols.select("cik", F.lit(True).alias("named")).distinct()
    out = candidates.join(best, ["cik", "window_end"], "left").join(has, "cik", "left")
    state = F.when(F.col("ratio").isNotNull(), "confirmed").when(F.col("named").isNull(), "no_symbol").otherwise("no_price_match")
    return out.select("cik", F.col("found").alias("symbol"), "window_start", "window_end", "shares_ratio", F.col("clean").alias("nearest_clean_ratio"), "effective_date", "ratio", state.alias("confidence"))


def name_key(name: Column) -> Column:
    """Comparable company name: upper case, no brackets, & as AND, suffix words out, letters and digits only; null is ''."""
    x = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\(.*?\)", " ")
    x = F.regexp_replace(F.regexp_replace(x, "&", " AND "), r"\b(" + "|".join(SUFFIXES) + r")\b", " ")
    return F.regexp_replace(x, "[^A-Z0-9]", "")


def symbol_bridge(masters: DataFrame, insiders: DataFrame) -> DataFrame:
    """name key -> symbol: the latest master list first (EQ wins), the insider index only for keys it lacks."""
    m = masters.select(name_key(F.col("name")).alias("key"), "symbol", "series", "folder").where("key <> ''")
    first = latest_per(m, ["key"], [(F.col("series") == "EQ").desc(), F.col("folder").desc(), F.col("symbol")]).select("key", "symbol")
    rest = insiders.select(name_key(F.col("company")).alias("key"), "symbol").where("key <> ''").groupBy("key").agg(F.min("symbol").alias("symbol"))
    return first.unionByName(rest.join(first, "key", "left_anti"))


def resolve_names(names: DataFrame, bridge: DataFrame, least: int = 12) -> DataFrame:
    """name -> symbol: the exact key, else the longest bridge key of at least 12 characters that begins the name's key and has one symbol.

    A key whose symbols are null is known without one: the name that equals it has none; as a prefix of others it doesn't count.
    Each name tries its own prefixes by equality, at most its length of them, so no name meets every key.
    """
    n = names.select("name", name_key(F.col("name")).alias("key")).distinct()
    tries = F.array_union(F.array("key"), F.transform(F.sequence(F.lit(least), F.greatest(F.length("key"), F.lit(least))), lambda k: F.substring(F.col("key"), F.lit(1), k)))
    each = n.select("name", "key", F.explode(tries).alias("try")).where((F.col("try") == F.col("key")) | (F.length("try") >= least))
    known = bridge.groupBy(F.col("key").alias("try")).agg(F.min("symbol").alias("symbol"), F.countDistinct("symbol").alias("symbols"))
    hit = each.join(known, "try").where("symbols = 1 or try = key")
    best = latest_per(hit, ["name"], [(F.col("try") == F.col("key")).desc(), F.length("try").desc()]).select("name", "symbol")
    return n.select("name", "key").join(best, "name", "left")


def news_history(snaps: DataFrame) -> DataFrame:
    """Folds snapshots of stories by url: first publication, last change and its title, revisions, first and last seen."""
    newest = F.struct("lastmod", "snap")
    return snaps.groupBy("url").agg(
        F.min("published").alias("published"), F.max("lastmod").alias("lastmod"), F.max_by("title", newest).alias("title"), F.greatest(F.countDistinct("lastmod"), F.lit(1)).alias("revisions"),
        F.min("snap").alias("first_seen"), F.max("snap").alias("last_seen"), F.max(F.when(F.col("shard") == "yesterday", "yesterday").otherwise("today")).alias("shard"), F.min_by("section", F.when(F.col("section").isNotNull(), F.col("snap"))).alias("section"),
    )


def code_index(stocks: DataFrame) -> DataFrame:
    """'name | bse | nse' fields of exactly three parts."""
    p = F.transform(F.split("stock_search", r"\|"), lambda x: F.trim(x))
    return stocks.withColumn("p", p).where("size(p) = 3").select("fincode", F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("bse"), F.get("p", F.lit(2)).alias("nse"))


def manager_index(rows: DataFrame) -> DataFrame:
    """For each manager code: the commonest spelling, sorted houses, schemes and stocks."""
    spelt = latest_per(rows.groupBy("code", "manager").count(), ["code"], [F.col("count").desc(), F.col("manager")]).select("code", F.col("manager").alias("name"))
    per = rows.groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("house")), ", ").alias("houses"), F.countDistinct("scheme").alias("schemes"), F.countDistinct("stock").alias("stocks"))
    return per.join(spelt, "code")


def fund_managers(rows: DataFrame) -> DataFrame:
    """Every spelling of a manager's name under a code, with how many holdings carry it."""
    return rows.groupBy("code", F.col("manager").alias("name")).agg(F.count("*").alias("holdings"))

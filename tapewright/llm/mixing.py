"""Hierarchical budgeting of sources to target weights.

A tree of levels (domain, language, source) shares a token budget. Each node's capacity is its tokens times the epochs
allowed. From the root down, the children of a node share its budget by weight; a child whose share exceeds its
capacity is filled and its surplus goes to its siblings, again by weight; only what no sibling can take was never granted to
their parent, because the parent's share was bounded by the sum of its children's capacities. So shortages move among
siblings before they reach ancestors. Each leaf then takes whole seeded epochs of its documents and, of the next epoch, the
longest prefix in that epoch's seeded order that fits. All amounts are integers.

Prefixes are found without gathering a leaf: documents fall into 4096 hash ranges, range totals give the range in which
the prefix ends, and only that range's documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, small

WORD = r"[^ \t\n\x0B\f\r]+"


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Of nodes(*parent, name, weight, capacity, granted to the parent): the same with `budget`, the node's part.

    A child is filled when capacity * (weight left) <= (budget left) * weight in the order of capacity / weight; others
    get floor(left * weight / weight left). A weight of 0 gets nothing.
    """
    w = W.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), F.col(name).asc_nulls_first())
    before, whole = w.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parent)
    d = "decimal(38,0)"
    live = nodes.where("weight > 0")
    t = live.withColumn("left", F.col("granted") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    t = t.withColumn("full", F.col("capacity").cast(d) * F.col("rest").cast(d) <= F.col("left").cast(d) * F.col("weight").cast(d))
    t = t.withColumn("left", F.col("granted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)))
    t = t.withColumn("rest", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    share = F.expr("cast(left as decimal(38,0)) * weight div rest").cast("long")
    return t.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("left", "rest", "full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """leaves(*levels, tokens) with `budget`. percent: the budget as a share of all tokens.

    weights: for a level, the positive integer weight of each value by name; a value not named, or null, has weight 1.
    """
    caps = leaves.withColumn("capacity", F.col("tokens") * epochs)
    granted = caps.agg(F.expr(f"cast(sum(tokens) * {int(percent)} div 100 as long)").alias("granted"))
    out, above = None, ["top"]
    for depth, level in enumerate(levels):
        keys = levels[: depth + 1]
        nodes = caps.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        named = weights.get(level, {})
        pick = F.lit(1)
        for value, n in sorted(named.items()):
            pick = F.when(F.col(level) == value, F.lit(int(n))).otherwise(pick)
        nodes = nodes.withColumn("weight", pick.cast("long"))
        if out is None:
            nodes = nodes.crossJoin(F.broadcast(granted)).withColumn("top", F.lit(1))  # the budget is one row
        else:
            up = out.select(*[F.col(c).alias(f"up_{c}") for c in above], F.col("budget").alias("granted"))
            nodes = nodes.join(up, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in above]).drop(*[f"up_{c}" for c in above])
        out = share_out(nodes, above, level)
        above = keys
    last = out.select(*[F.col(c).alias(f"b_{c}") for c in levels], "budget")
    return leaves.join(last, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in levels], "left").select(*levels, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def mix_to_weights(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], percent: int = 60, epochs: int = 2, seed: int = 17) -> DataFrame:
    """Documents of docs(doc_id, text, ...) that the mixture takes, with all their columns and `copies`, how often each occurs.

    levels: the tree's levels from the root down, by name, as expressions over docs; weights goes by the same names. A document's tokens are its
    whitespace words. Order within an epoch: md5 of "seed:epoch:doc_id" (null id: empty); rows that tie there enter
    together. Documents without words cost nothing and enter with their order. Null level values are values of their own.
    Empty input gives no rows. A column of docs named copies is replaced.
    """
    names = [f"lv{k}" for k in range(len(levels))]
    weights = {n: weights.get(c, {}) for n, c in zip(names, levels)}
    levels = list(levels.values())
    keyed = [x.alias(n) for x, n in zip(levels, names)]
    rows = materialise(docs.select(F.col("doc_id"), *keyed, words_in(F.col("text")).alias("n")), "tokens")
    leaves = materialise(rows.groupBy(*names).agg(F.sum("n").alias("tokens")), "leaves")
    plan = budgets(leaves, names, weights, percent, epochs)
    plan = materialise(
        plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long")).withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).cast("long")), "plan"
    )
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("p.whole"), F.lit(":"), F.coalesce(F.col("r.doc_id").cast("string"), F.lit(""))))
    part = rows.alias("r").join(small(plan).alias("p"), same("r", "p")).where("p.rest > 0").select(*[F.col(f"r.{n}") for n in names], "p.rest", key.alias("k"), "r.n")
    part = part.withColumn("range", F.substring("k", 1, 3))
    upto = W.partitionBy(*names).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = part.groupBy(*names, "rest", "range").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = materialise(ranges.where("before <= rest and before + n > rest").select(*names, "range", "before"), "last-range")
    inside = part.alias("r").join(small(last).alias("l"), [*same("r", "l"), F.col("r.range") == F.col("l.range")])
    inside = inside.groupBy(*[F.col(f"r.{n}") for n in names], "r.rest", "l.before", "r.k").agg(F.sum("r.n").alias("n"))
    cum = F.col("before") + F.sum("n").over(W.partitionBy(*names).orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    fits = inside.withColumn("upto", cum).groupBy(*names).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("k"))).alias("cut"))
    cuts = materialise(
        plan.alias("p").join(last.alias("l"), same("p", "l"), "left").join(fits.alias("f"), same("p", "f"), "left")
        .select(*[F.col(f"p.{n}") for n in names], "whole", F.when(F.col("rest") == 0, F.lit("")).otherwise(F.coalesce("cut", "range", F.lit("~"))).alias("cut")),
        "cuts",
    )
    # A null cut inside the last range means that none of its documents fits: the prefix ends before the range.
    have = [c for c in docs.columns if c.lower() != "copies"]
    tmp = {n: fresh(docs, n) for n in [*names, "whole", "cut"]}
    cuts = cuts.select(*[F.col(n).alias(tmp[n]) for n in tmp])
    lv = {n: fresh(docs, f"my_{n}") for n in names}
    d = docs.select(*have, *[x.alias(lv[n]) for x, n in zip(levels, names)])
    d = d.join(small(cuts), [F.col(lv[n]).eqNullSafe(F.col(tmp[n])) for n in names])
    mine = F.md5(F.concat(F.lit(f"{seed}:"), F.col(tmp["whole"]), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    copies = F.col(tmp["whole"]) + (mine <= F.col(tmp["cut"])).cast("long")
    return d.select(*have, copies.alias("copies")).where("copies > 0")

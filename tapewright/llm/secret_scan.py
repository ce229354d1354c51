"""Secret scanning with DataFrame functions only: fixed patterns, and sliding-window entropy for the rest.

Base kinds come from patterns. The method adds spans: runs of one character class are candidates, candidates on the
allow-list go, and over each candidate a window slides whose character counts are kept incrementally (one character in, one
out); where its Shannon entropy reaches the class's threshold, the window is suspicious, and touching windows make a span.
Entropy is compared through integers: with S the sum of f(count) over the window's characters, f(c) = c*log2(c), H >= t
is S <= W*(log2(W) - t); f and the bound are scaled by 10^6 and rounded. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let

DIGITS = "0123456789"
WINDOW = 20
SCALE = 1_000_000
#: Window starts of one piece of a candidate, so that no step copies a long array.
STEP = 200

_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: name, pattern, group whose length counts, least length. Access keys are AKIA[A-Z0-9]+ of 16 characters, hex
#: runs [0-9a-f]+ of 32; with the length in the pattern the same matches remain, because a match ends where its run ends and a later
#: start in the run is shorter still.
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "(?<![0-9a-f])[0-9a-f]{32,}", 0, 32))


@dataclass(frozen=True)
class CharClass:
    """A character class: a window's entropy in bits from which on it is suspicious."""

    name: str
    pattern: str
    alphabet: str
    threshold: float


CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", DIGITS + "ABCDEFabcdef", 3.0),
    CharClass("entropy_b64", "[A-Za-z0-9+/=_-]", UPPER + LOWER + DIGITS + "+/=_-", 3.9),
)
#: Candidates that any of these matches are no secrets: joined words, numbers and dates, UUIDs, documented sample keys.
#: No pattern repeats a group without bound: the regex engine would recurse once a round and overflow its stack on a long text.
ALLOW = ("^[A-Za-z][A-Za-z_/=+-]*$", "^[0-9][0-9_/=+-]*$", "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "EXAMPLE")


def weight_table(window: int = WINDOW) -> list[int]:
    return [0] + [round(SCALE * c * math.log2(c)) for c in range(1, window + 1)]


def bound(threshold: float, window: int = WINDOW) -> int:
    return math.floor(SCALE * window * (math.log2(window) - threshold))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def before(lens: Column, block: int = 256) -> Column:
    """For each element, the sum of those before it; two levels of blocks keep it far from quadratic. lens: a lambda variable."""
    n = F.size(lens)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda c: _sum(F.slice(lens, c * block + 1, F.lit(block))))
    heads = lambda s: F.transform(s, lambda _, c: _sum(F.slice(s, F.lit(1), c)))
    at = lambda h: F.transform(lens, lambda _, i: F.get(h, F.floor(i / block).cast("int")) + _sum(F.slice(lens, (F.floor(i / block) * block + 1).cast("int"), i % block)))
    return let(sums, lambda s: let(heads(s), at))


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,kind,body>>, code points; shorter groups are dropped after matching."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.filter(F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("gap"), bodies.alias("body")), lambda z: z["m"].isNotNull())
    parts = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("len"), z["body"].alias("body")))

    def placed(m: Column) -> Column:
        at = let(F.transform(m, lambda x: x["gap"] + x["len"]), before)
        return F.transform(
            F.arrays_zip(m.alias("m"), at.alias("at")),
            lambda z: F.struct((z["at"] + z["m"]["gap"]).alias("start"), (z["at"] + z["m"]["gap"] + z["m"]["len"]).alias("end"), F.lit(kind).alias("kind"), z["m"]["body"].alias("body")),
        )

    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,body:string>>)")
    return F.when(text.rlike(pattern), F.filter(let(parts, placed), lambda s: F.length(s["body"]) >= least)).otherwise(empty)


def suspicious(piece: Column, cls: CharClass, window: int) -> Column:
    """Starts of the windows of struct(start, s) whose entropy reaches the threshold."""
    table = F.array(*[F.lit(x) for x in weight_table(window)])
    chars = F.filter(F.split(piece["s"], ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    shape = "struct<codes:array<int>,n:array<int>,s:int,hot:array<int>>"
    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(cls.alphabet)).alias("n"), F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("hot")).cast(shape)

    def step(acc: Column, i: Column) -> Column:
        come, full = F.get(acc["codes"], i), i >= window
        go = F.when(full, F.get(acc["codes"], i - window)).otherwise(-1)
        n_go = F.when(full, F.get(acc["n"], go)).otherwise(0)
        less = F.when(full, F.get(table, n_go - 1) - F.get(table, n_go)).otherwise(0)
        n_come = F.get(acc["n"], come) - (come == go).cast("int")
        s = acc["s"] + less + F.get(table, n_come + 1) - F.get(table, n_come)
        n = F.transform(acc["n"], lambda x, j: x + (j == come).cast("int") - (j == go).cast("int"))
        hot = F.when((i >= window - 1) & (s <= bound(cls.threshold, window)), F.concat(acc["hot"], F.array(piece["start"] + i - window + 1))).otherwise(acc["hot"])
        return F.struct(acc["codes"].alias("codes"), n.alias("n"), s.alias("s"), hot.alias("hot")).cast(shape)

    return F.aggregate(F.sequence(F.lit(0), F.length(piece["s"]) - 1), start, step, lambda acc: acc["hot"])


def entropy_hits(text: Column, cls: CharClass, kind: int, allow: tuple[str, ...], window: int) -> Column:
    """Starts of suspicious windows, ascending."""
    cands = F.filter(found(text, f"(?<!{cls.pattern}){cls.pattern}{{{window},}}", kind), lambda c: ~c["body"].rlike("|".join(f"(?:{a})" for a in allow)) if allow else F.lit(True))
    piece = lambda c, o: F.struct((c["start"] + o).alias("start"), F.substring(c["body"], o + 1, F.lit(STEP + window - 1)).alias("s"))
    pieces = F.flatten(F.transform(cands, lambda c: F.transform(F.sequence(F.lit(0), F.length(c["body"]) - window, F.lit(STEP)), lambda o: piece(c, o))))
    return F.flatten(F.transform(pieces, lambda p: suspicious(p, cls, window)))


def _spans_of(hot: Column, kind: int, window: int) -> Column:
    n = F.size(hot)
    first = F.filter(hot, lambda x, i: (i == 0) | (x - F.get(hot, i - 1) > window))
    last = F.filter(hot, lambda x, i: (i == n - 1) | (F.get(hot, i + 1) - x > window))
    return F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda z: F.struct(z["a"].alias("start"), (z["b"] + window).alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, window: int = WINDOW, out: str = "secret_spans") -> DataFrame:
    """docs with one more column `out`: array<struct<kind:string,start:int,end:int>> by start, then kind as listed.

    Offsets are code points, the end exclusive. Base kinds are assign, access and hex (BASE): a match that is too short is
    dropped without another try inside it. Entropy kinds are added, except spans within a base span. An empty allow-list suppresses
    nothing. Null and empty texts have no spans; texts of any length are scanned whole; ties and repeated rows need no rule,
    every row stands for itself; columns of docs stay, and one named like `out` is replaced. Empty input gives no rows.
    """
    names = [b[0] for b in BASE] + [c.name for c in classes]
    t = F.coalesce(F.col(text), F.lit(""))
    have = [c for c in docs.columns if c.lower() != out.lower()]
    pair = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = F.concat(*[F.transform(found(t, p, k, g, n), pair) for k, (_, p, g, n) in enumerate(BASE)])
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    added = lambda c, kind: let(entropy_hits(t, c, kind, allow, window), lambda hot: _spans_of(hot, kind, window))
    more = F.concat(empty, *[added(c, len(BASE) + i) for i, c in enumerate(classes)])
    outside = lambda b: F.filter(more, lambda s: ~F.exists(b, lambda x: (x["start"] <= s["start"]) & (x["end"] >= s["end"])))
    spans = let(base, lambda b: F.concat(b, outside(b)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"))))
    label = F.array(*[F.lit(n) for n in names])
    return docs.select(*have, F.transform(ordered, lambda s: F.struct(F.get(label, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Quotation linking of chat messages, with DataFrame functions only.

Lines that begin with '>' are quoted, one level for each '>'. Neighbouring lines of one level are a passage. Normalised quoted
passages, and their single lines, are hashed and joined to the first message of the conversation that wrote the same words
itself. The first author is a minimum by (conversation, hash), so the join meets one row for each passage however often it was
repeated. A message replies to the latest original among its first-level passages; its thread is the earliest original that it
reaches over its quotes and those of the messages that it reaches, by pointer doubling. Output is sorted by conversation, thread and turn over range
partitions: no conversation is gathered in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, let, materialise, small

#: A line that introduces a quotation; it goes when a quoted line follows.
INTRODUCTION = r"^(On .{0,200} wrote|Am .{0,200} schrieb.{0,100}|Le .{0,200} a écrit|El .{0,200} escribió) ?:[ \t\r]*$"
#: Without a repeated group, which would recurse once a mark and overflow the stack on a long line.
MARKS = r"^[ \t>]*>"


def norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), r"[ \t\n\x0B\f\r]+", " "))


def parse(text: Column) -> Column:
    """Lines as array<struct<level:int,line:string>>."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("line")),
    )


def _own(lines: Column) -> Column:
    """Lines of level 0, without introductions of quotations."""
    after = lambda i: F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0
    return F.transform(F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(INTRODUCTION) & after(i))), lambda x: x["line"])


def _passages(lines: Column) -> Column:
    """Quoted passages as array<struct<level:int,lines:array<string>>>."""
    n = F.size(lines)
    level = lambda i: F.get(lines, i)["level"]
    at = F.sequence(F.lit(0), n - 1)
    first = F.filter(at, lambda i: (i == 0) | (level(i) != level(i - 1)))
    last = F.filter(at, lambda i: (i == n - 1) | (level(i) != level(i + 1)))
    runs = F.filter(F.arrays_zip(first.alias("a"), last.alias("b")), lambda z: level(z["a"]) > 0)
    return F.transform(runs, lambda z: F.struct(level(z["a"]).alias("level"), F.transform(F.slice(lines, z["a"] + 1, z["b"] - z["a"] + 1), lambda x: x["line"]).alias("lines")))


def _hashes(lines: Column) -> Column:
    """Distinct hashes of the lines together and of each line; empty ones have none."""
    texts = F.array_distinct(F.filter(F.concat(F.array(norm(F.array_join(lines, " "))), F.transform(lines, norm)), lambda x: x != ""))
    return F.transform(texts, lambda x: F.xxhash64(x))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, id, root) of links, root followed to the end. A step doubles the length of the way; roots are earlier turns, so it ends."""
    at = links.groupBy("conv_id", "turn").agg(F.min("root").alias("root"))
    while True:
        on = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        step = at.join(on, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "roots")
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    end = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("end"))
    return links.join(end, ["conv_id", "root"], "left").select("conv_id", "turn", "id", F.coalesce("end", "root").alias("root"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) in reply order: conv_id, turn, role, text, reply_to, thread, n_quotes, depth.

    text loses its quoted lines and their introductions, and surrounding white space; null stays null. reply_to is the turn
    that a first-level passage quotes (the latest of several; passages matched whole go before those matched by a line),
    null without such; thread the earliest turn reached from
    message to message over quotes of any level (a turn of several rows goes on to the earliest of theirs), or the message's own turn. Only earlier turns of the same
    conversation count. n_quotes is the number of quoted passages, depth the deepest level. Rows with a null conv_id or
    turn come out with their quotes removed but unlinked. Repeated rows each come out, with one result. Ties in the order
    fall to the text. Texts and lines of any length are read whole. Other columns are ignored; empty input gives no rows.
    """
    m = messages.select("conv_id", "turn", "role", "text", F.col("text").contains(">").alias("may"))
    lines = parse(F.col("text"))
    quoted = m.where("may").select("conv_id", "turn", F.md5("text").alias("id"), lines.alias("lines"))
    quoted = quoted.select("conv_id", "turn", "id", let(F.col("lines"), _passages).alias("ps")).where(F.size("ps") > 0).distinct()
    asked = quoted.where("conv_id is not null and turn is not null").select("conv_id", "turn", "id", F.posexplode("ps").alias("p", "q"))
    asked = asked.select("conv_id", "turn", "id", "p", F.col("q.level").alias("level"), F.posexplode(_hashes(F.col("q.lines"))).alias("k", "h"))
    asked = materialise(asked, "quotes")
    wanted = small(materialise(asked.select("conv_id", "h").distinct(), "quoted-hashes"))
    own = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", let(lines, _own).alias("own"))
    wrote = own.select("conv_id", "turn", F.explode(_hashes(F.col("own"))).alias("h")).join(wanted, ["conv_id", "h"], "left_semi")
    origin = wrote.groupBy("conv_id", "h").agg(F.min("turn").alias("first"))
    hit = asked.join(origin, ["conv_id", "h"]).where("first < turn")
    whole, line = F.max(F.when((F.col("level") == 1) & (F.col("k") == 0), F.col("first"))), F.max(F.when(F.col("level") == 1, F.col("first")))
    links = materialise(hit.groupBy("conv_id", "turn", "id").agg(F.coalesce(whole, line).alias("reply_to"), F.min("first").alias("root")), "links")
    links = materialise(links.drop("root").join(roots(links), ["conv_id", "turn", "id"]), "threads")
    links = links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("id").alias("i"), "reply_to", "root")
    quotes = F.when(F.col("may"), let(lines, _passages))
    done = m.withColumn("ps", quotes).withColumn("own", F.when(F.col("may"), F.array_join(let(lines, _own), "\n")).otherwise(F.col("text")))
    done = done.join(small(links), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.md5("text") == F.col("i")), "left")
    done = done.select(
        "conv_id", "turn", "role", F.trim("own", F.lit(SPACES)).alias("text"), "reply_to", F.coalesce("root", "turn").alias("thread"),
        F.coalesce(F.size("ps"), F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("ps", lambda p: p["level"])), F.lit(0)).cast("long").alias("depth"),
    )
    done = done.withColumn("n_quotes", F.greatest("n_quotes", F.lit(0)))
    return done.orderBy("conv_id", "thread", "turn", "text")

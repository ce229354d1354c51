"""Phrases by a positional index: which documents have each word where, and phrases as meetings of shifted places.

Words are runs of letters and digits, in lower case; any other sign but white space is a token of its own. The index is published clustered by word, with
the ranges of words beside its files (see lookup.py), so a search opens the files of its words alone and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import look_up, publish_clustered

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(word, doc_id, at): the places, from 0, of each word in each of docs(doc_id, text). Rows of one id are one document's parts, places counted apart."""
    row = docs.select(F.col(doc).alias("doc_id"), F.posexplode(tokens(F.col("text"))).alias("p", "word"))
    return row.groupBy("word", "doc_id").agg(F.sort_array(F.collect_list("p")).alias("at"))  # one document's places of one word


def publish_index(docs: DataFrame, path: str, doc: str = "doc_id", partitions: int | None = None) -> None:
    """postings() as a store clustered by word; a word of very many documents is cut into ranges of documents."""
    publish_clustered(postings(docs, doc), path, ["word", "doc_id"], partitions)


def search(spark: SparkSession, path: str, phrases: list[str]) -> DataFrame:
    """(phrase, doc_id, at) of the documents that hold a phrase, for many phrases in one pass: at lists where it begins.

    A phrase is found where its tokens follow each other, whatever white space parts them. One without tokens is found nowhere. The documents of a
    phrase's words are brought together by phrase and document; phrases are few, documents and places any number.
    """
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(phrases)], "phrase string").withColumn("ts", tokens(F.col("phrase")))
    words = asked.select("phrase", F.size("ts").alias("n"), F.posexplode("ts").alias("k", "word"))
    held = sorted({r[0] for r in words.select("word").distinct().collect()})  # of the phrases, not of the texts
    found = look_up(spark, path, "word", held).join(F.broadcast(words), "word")
    begins = F.filter(F.transform("at", lambda p: p - F.col("k")), lambda p: p >= 0)
    per = found.select("phrase", "n", "doc_id", "k", begins.alias("b")).groupBy("phrase", "n", "doc_id").agg(F.collect_list("b").alias("bs"))  # as many as the phrase has tokens
    both = F.aggregate(F.slice("bs", F.lit(2), F.size("bs")), F.get("bs", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return per.where(F.size("bs") == F.col("n")).select("phrase", "doc_id", both.alias("at")).where(F.size("at") > 0)


def by_entity(found: DataFrame, docs: DataFrame, entity: str = "source", kind: str | None = "lang") -> DataFrame:
    """search() by entity: phrase, entity, how many documents, the newest (the greatest id), its kind, and how many in all. Of docs, ids, entities and kinds are read."""
    k = F.col(kind) if kind else F.lit(None).cast("string")
    named = found.select("phrase", "doc_id").join(docs.select("doc_id", F.col(entity).alias(entity), k.alias("kind")), "doc_id")
    per = named.groupBy("phrase", entity).agg(F.count("*").alias("matches"), F.max("doc_id").alias("newest"), F.max_by("kind", "doc_id").alias("kind"))
    total = per.groupBy("phrase").agg(F.sum("matches").alias("total"))  # a row a phrase
    return per.join(F.broadcast(total), "phrase")

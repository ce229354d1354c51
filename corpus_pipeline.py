"""From documents to a training mixture: quality, site boilerplate, near duplicates, benchmark leaks, source weights.

STAGES are applied in order; each reads what its predecessor wrote. All but the last return the columns of documents.
ORACLE_SQL is None: the classifier is trained, so SQL can't express the rows; tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.ship import shipped
from tapewright.llm.common import fold_of, materialise, table
from tapewright.llm.decontam import drop_contaminated
from tapewright.llm.line_dedup import dedup_lines
from tapewright.llm.mixing import mix_to_weights
from tapewright.llm.near_dedup import drop_near_duplicates
from tapewright.llm.quality import keep_quality
from tapewright.llm.queries import LEVELS, WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of this stage's own input, scores 0.7 or more.

    Null and empty texts are judged by the label shares alone; rows with a null id by their text; repeated rows stay or go together; texts of any
    length are read whole; a score of exactly 0.7 stays. An empty table stays empty.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source, taken for the host, repeats. n_chars, where it is there, follows the text.

    No row goes: a document that loses all lines keeps an empty text, a null text stays null. A null source is one host; repeated rows each count as a
    document; texts of any length are read whole. An empty table stays empty.
    """
    out = dedup_lines(docs, "source", "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; five words, similarity 0.8.

    Null and empty texts are no duplicates; rows with a null id stay; of repeated rows with one id one stays. Whole texts count. An empty table
    stays empty.
    """
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; whole texts are searched.

    Null and empty texts stay, as do rows with a null id; repeated rows stay or go together. Without documents or items nothing changes.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with `copies`, to the target weights of domain, language and source.

    Null languages and sources are values of their own; texts without words cost nothing; documents that tie in the seeded order, as repeated
    rows do, enter together. An empty table stays empty.
    """
    return mix_to_weights(docs, LEVELS(), WEIGHTS)


STAGES = [(f.__name__, shipped(f)) for f in (quality, lines, near_dedup, decontamination, mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs

"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is
written as Parquet to the shared folder and read again as the next one's docs. All but
the last return the columns of documents. In every stage null ids, texts and sources are
rows like others (a null text has no words), texts of any length are taken whole, ties go
to the smaller id, columns may have any names, and an empty table gives an empty one; what
repeated rows give is said with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import only, stored, table
from threadloom.llm.mixing import repeated
from threadloom.llm.near_copies import one_of_each_similar
from threadloom.llm.packing import pack
from threadloom.llm.quality import judge
from threadloom.llm.substrings import cut_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged bad or toxic go; repeated rows fare alike."""
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return only(docs, judged.filter("keep").select("_id", "_hash"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity 0.8 or more) stays, the one of the least id.

    Candidates meet under shared shingles, operator 7's fingerprints and pivot tables discard,
    and both texts verify. Repeated rows are copies: one stays.
    """
    return one_of_each_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier elsewhere are cut from the texts; every document stays, if with an empty text.

    Rows of one id are one document, so repeated rows are cut alike.
    """
    return cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix takes it, from never to three times; each repeated row counts."""
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences; repeated rows are packed each."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mix_to_weights),
    ("packing", packing),
]

#: SQL can't express these stages; tests hold each against what its operator must do to its own input, and run() on awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

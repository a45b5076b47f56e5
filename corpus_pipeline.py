"""Training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last returns token digests.  Stages
see a doc_id, text and any other columns; null and empty texts are kept until
the quality stage rejects them or not, by its prior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import bpe, decontaminate, jaccard, quality, suffixes
from logweave.llm.common import finished, read_table, shuffle_parts


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF doesn't reject; it is fitted on the labelled ones among them.

    Rows are judged by their own text; texts without words go by the prior, and
    without labels nothing is rejected.
    """
    return quality.good_documents(docs, quality.fitted(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose doc_id names the group.

    Groups share five-word shingles to 0.8 or more.  Rows are told apart by
    doc_id and text; of rows equal in both, one stays.  Texts without words are
    in no group and stay.
    """
    return jaccard.one_of_each(docs, shuffle_parts(spark), width=5, percent=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand at an earlier place.

    A row is cut by its own text's passages; rows of which nothing is left go,
    null and empty texts stay as they are.
    """
    return suffixes.without_repeats(docs, shuffle_parts(spark))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; a row goes by its own text, and null and empty texts stay."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row each; a null or empty text has no tokens."""
    return bpe.encode_documents(docs.select("doc_id", "text"), *bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None  # the classifier and the vocabulary are beyond SQL; tests/llm compares every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written before the next reads them; a stage's own tables are deleted when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = finished(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)

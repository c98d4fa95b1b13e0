"""A corpus pipeline: each stage reads what the one before has written.

Documents of low quality go, then all but one of each group of near-duplicates, then contaminated ones; what
is left is freed of personal data and encoded.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, decontaminate, neardup, pii, quality
from marginalia.llm.registry import TOKENIZER, table
from marginalia.llm.storage import saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the best grade is at least one half; the rated ones among docs are fitted."""
    return quality.selected(docs, quality.trained(docs, quality.ratings(table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are similar by 0.8 or more."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind of personal data in place of each span; n_chars follows the text."""
    return pii.redacted(docs, chars_col="n_chars")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text."""
    return bpe.round_trip_digests(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("bpe", bpe_encoding),
]

#: A fitted classifier and a tokenizer can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

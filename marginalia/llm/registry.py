"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from marginalia.sources.tables import spread

from . import alignment, bpe, decontaminate, license_scan, neardup, pii, prefix_trie, quality, rules, secret_scan, shards, token_files, unigram_counts

#: The tokenizer of the queries; the operators take any path of this format.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("matches")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_index(documents(spark, sf_dir), TOKENIZER, end_id=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(documents(spark, sf_dir), n_shards=24)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.graded(docs, quality.trained(docs, quality.ratings(table(spark, sf_dir, "labels"))))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), TOKENIZER)


def op10_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(documents(spark, sf_dir), PIECES)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_counts(documents(spark, sf_dir), TOKENIZER, PIECES)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spread(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_pii_spans": op2_pii_spans,
        "op3_token_files": op3_token_files,
        "op4_decontamination": op4_decontamination,
        "op5_virtual_slots": op5_virtual_slots,
        "op6_ordinal_quality": op6_ordinal_quality,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_rule_cascade": op8_rule_cascade,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_unigram_counts": op10_unigram_counts,
        "op11_secret_scan": op11_secret_scan,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle_sql(),
        "op4_decontamination": decontaminate.ORACLE_SQL,
        "op7_minhash_near_dedup": neardup.oracle_sql(2, 80),
        "op8_rule_cascade": rules.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }

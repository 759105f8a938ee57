"""One query for each operator of this package, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import byte_bpe, cover_tree_codes, cover_tree_sql, fingerprints, jaccard_join, lm_katz, mixing, quality_classifier, quality_rules
from lexispark.llm import rank_array_bpe, secret_scan, sharding, spelling_variants, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_scores(documents(spark, sf_dir), labels)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_katz.katz_scores(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_array_bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_byte_bpe,
        op3_quality_rules,
        op4_secret_scan,
        op5_token_counts,
        op6_katz_scores,
        op7_jaccard_join,
        op8_fingerprints,
        op9_mixing,
        op10_sharding,
        op11_rank_array_bpe,
        op12_vector_codes,
        op13_spelling_variants,
    )
}
ORACLE_SQL: dict[str, str] = {"op12_vector_codes": cover_tree_sql.vector_codes_sql()}

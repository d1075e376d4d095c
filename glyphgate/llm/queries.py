"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgate.llm import bytebpe, classifier, licenses, merkle, mixing, packing, phrases, quality, repair, secrets, sharding, simhash, topk
from glyphgate.llm.common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_grammar_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_feistel_sharding": op2_feistel_sharding,
        "op3_source_mixing": op3_source_mixing,
        "op4_pivot_top_k": op4_pivot_top_k,
        "op5_secret_ledger": op5_secret_ledger,
        "op6_license_templates": op6_license_templates,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_grammar_token_files": op10_grammar_token_files,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_curve_packing": op12_curve_packing,
        "op13_merkle_manifest": op13_merkle_manifest,
    }

"""The corpus pipeline: raw documents to token digests of a cleaned, deduplicated, redacted and mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Each is written as Parquet in the shared folder and read again by the next, so that a lost executor costs the tasks it
held and no earlier stage.

1. quality_rules: documents that the rules reject go; frequent lines of a host are cut from those that stay.
2. simhash_near_dedup: SimHash fingerprints of the sets of five-word shingles within 8 bits propose pairs; whole sets decide (a
   Jaccard similarity of 0.8 or more); pairs that fingerprints miss are found by common shingles; of each component the document
   with the smallest id stays.
3. secret_scan: every span found is replaced by a mark.
4. source_mixing: each document comes as often as the mix takes it, none for those it leaves out.
5. byte_bpe: each document of the mix is encoded and decoded; ids and bytes are returned as digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphgate.llm import bytebpe, mixing, quality, secrets, simhash
from glyphgate.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-level BPE; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

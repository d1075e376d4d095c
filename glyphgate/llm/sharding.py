"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n-1 in a fixed order. A keyed balanced Feistel network permutes the smallest even-bit domain that
holds n; a value outside 0 to n-1 is permuted again until it falls inside (cycle walking; the domain is under 4n, so
under four steps on average). The permuted number p gives shard p mod k and slot p div k: shard sizes differ by one at
most, slots have no gap, and both can be computed from a row number alone, in either direction, without any data.

The law is ``rows``. Equal texts are not held together: a group of copies may be a third of all rows, and counts that
differ by one at most leave no room for it in one shard.

Defined results. Null text: size 1 (0 bytes plus 1), crc32 of no bytes, which is 0. Order: doc_id with nulls first, then
size, then crc32; wholly equal rows may swap numbers. Empty table: no rows. Other columns are kept by ``shard``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map, number_rows

ROUNDS = 8
SEED = 20_240_229
SHARDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift-xor, twice."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(total: int) -> int:
    return max(1, -(-max(1, (total - 1).bit_length()) // 2))


def _round_keys(seed: int) -> list[np.uint64]:
    return list(_mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))


def _walk(x: np.ndarray, total: int, step) -> np.ndarray:
    out = step(x.astype(np.uint64))
    outside = np.flatnonzero(out >= total)
    while len(outside):
        out[outside] = step(out[outside])
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def permute(x: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """The permuted number of each row number below ``total``."""
    bits, keys = half_bits(total), _round_keys(seed)
    low, shift, cut = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(64 - bits)

    def step(v: np.ndarray) -> np.ndarray:
        a, b = v >> shift, v & low
        for key in keys:
            a, b = b, a ^ (_mix(b + key) >> cut)
        return a << shift | b

    return _walk(x, total, step)


def restore(x: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """The row number of each permuted number: the inverse of ``permute``."""
    bits, keys = half_bits(total), _round_keys(seed)
    low, shift, cut = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(64 - bits)

    def step(v: np.ndarray) -> np.ndarray:
        a, b = v >> shift, v & low
        for key in reversed(keys):
            a, b = b ^ (_mix(a + key) >> cut), a
        return a << shift | b

    return _walk(x, total, step)


def shard(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of ``df`` with ``row_no``, ``shard`` and ``slot``; clashing columns of ``df`` are replaced."""
    df = df.drop("row_no", "shard", "slot")
    numbered, total = number_rows(df, order, "row_no")
    names = numbered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column(names.index("row_no")).to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*names, "shard", "slot"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return arrow_map(numbered, run, f"{schema}, shard int, slot long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    return shard(measured(docs), order, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole documents under ``path``/shard=s, in slot order, in files that each hold a range of slots."""
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text").asc_nulls_first(), F.crc32(F.col("text").cast("binary")).asc_nulls_first()]
    shard(docs, order, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

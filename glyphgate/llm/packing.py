"""Packing documents into token sequences along a space-filling curve, so that a sequence holds documents that are alike.

1. Each document is encoded and gets an end id. Its ids are hashed into ``BUCKETS`` log counts, a vector of length one.
2. A fixed random matrix projects the vectors to ``AXES`` dimensions. Mean and deviation of each dimension over all
   documents spread them evenly over 2^``LEVELS`` steps, and the Hilbert curve through these cells gives each document a key.
3. Documents are range-partitioned and sorted by key, then row, so copies, which share a key, are spread over partitions
   like any others. Sums of the partitions' ids give each document its place on the curve.
4. The curve is cut every ``LENGTH`` ids; documents are cut where a sequence ends. The ids after the last whole sequence fill
   sequences of falling powers of two, so that nothing is padded.

Defined results. Null or empty text: the end id alone. Null and repeated ids, and repeated rows: each row is a document.
Texts of any length are cut into as many pieces as they need. Documents alike in key: in the order of their rows. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions.shipping import ship
from glyphgate.llm import repair
from glyphgate.llm.common import arrow_map, discard, materialize

LENGTH = 2048
BUCKETS, AXES, LEVELS = 256, 4, 12
SEED = 11
AT = [f"at{k}" for k in range(AXES)]


def _flat_ids(own: repair.Encoder, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, and how many each has."""
    counts = np.ones(len(texts), np.int64)
    if (pc.max(pc.binary_length(texts)).as_py() or 0) > repair.LONG:
        cut = [repair._chunks(x or "") for x in texts.to_pylist()]
        counts = np.array(list(map(len, cut)))
        texts = pa.array([c for parts in cut for c in parts], pa.string())
    ids, found = own.encode(texts)
    found = np.add.reduceat(found, np.cumsum(counts) - counts)
    return np.insert(ids, np.cumsum(found), np.uint32(end)), found + 1


def vectors(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log counts of hashed ids, each row of length one, projected to ``AXES`` dimensions."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
    counts = np.bincount(owner * BUCKETS + hashed, minlength=len(lengths) * BUCKETS).reshape(-1, BUCKETS)
    logs = np.log1p(counts)
    return logs / np.linalg.norm(logs, axis=1, keepdims=True) @ np.random.default_rng(SEED).standard_normal((BUCKETS, AXES))


def id_bytes(tokenizer: str) -> int:
    """Bytes of a stored id: two where all ids of the vocabulary fit, else four."""
    return 2 if len(repair.encoder(tokenizer).width) <= 1 << 16 else 4


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """row, doc_id, n, ids (little-endian) and the projected vector (at0, at1, ...) of each document."""
    names, kept = ["row", "doc_id", "n", "ids", *AT], id_bytes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = repair.encoder(tokenizer)
        for batch in batches:
            for rows in repair._slices(batch, repair.SLICE):
                ids, lengths = _flat_ids(own, rows.column(2), end)
                at = vectors(ids, lengths)
                ends = np.concatenate(([0], np.cumsum(lengths))) * kept
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(f"<u{kept}"))])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lengths), raw, *[pa.array(at[:, k]) for k in range(AXES)]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return arrow_map(numbered, run, f"row long, doc_id {kind}, n long, ids binary, {', '.join(f'{a} double' for a in AT)}")


def curve_keys(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of non-negative integers under 2^levels).

    From the coarsest level on, the bits of a cell that name its part of the space say how the finer bits are turned:
    where a bit is set the first axis is mirrored, else it changes places with the bit's axis. The bits in Gray code
    order are the digits of the key.
    """
    at, axes = cells.T.astype(np.int64).copy(), cells.shape[1]
    for level in range(levels - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(axes):
            is_set = (at[k] >> level & 1).astype(bool)
            swap = np.where(is_set, 0, (at[0] ^ at[k]) & low)
            at[0] = np.where(is_set, at[0] ^ low, at[0] ^ swap)
            at[k] ^= swap
    for k in range(1, axes):
        at[k] ^= at[k - 1]
    turned = np.zeros(at.shape[1], np.int64)
    for level in range(levels - 1, 0, -1):
        turned ^= np.where(at[-1] >> level & 1, (1 << level) - 1, 0)
    at ^= turned
    key = np.zeros(at.shape[1], np.int64)
    for level in range(levels - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (at[k] >> level & 1)
    return key


def on_curve(found: DataFrame) -> DataFrame:
    """Encoded documents with ``key`` instead of their vectors."""
    row = found.agg(*[f(a) for a in AT for f in (F.avg, F.stddev_pop)]).first()  # eight numbers
    spread = [(row[2 * k] or 0.0, row[2 * k + 1] or 1.0) for k in range(AXES)]
    # About the normal distribution, so that the steps of an axis hold about as many documents each.
    steps = [F.least(F.lit((1 << LEVELS) - 1), F.floor((1 << LEVELS) / (1 + F.exp(-1.702 * (F.col(a) - mean) / by)))).cast("long") for a, (mean, by) in zip(AT, spread)]
    return found.select("row", "doc_id", "n", "ids", _keys(*steps).alias("key"))


def _cell_keys(*axes: pa.Array) -> pa.Array:
    return pa.array(curve_keys(np.stack([a.to_numpy() for a in axes], 1)))


#: Only the cells go to Python; ids stay where they are.
_keys = F.arrow_udf(_cell_keys, T.LongType())


def _before(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    total = 0
    for n in batches:
        upto = total + np.cumsum(n.to_numpy(), dtype=np.int64)
        yield pa.array(upto - n.to_numpy())
        total = int(upto[-1]) if len(upto) else total


#: The sum of the earlier rows of a partition, in the order that it has.
before_in_partition = F.arrow_udf(_before, T.LongType()).asNondeterministic()


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the sequences after the last whole one begin, and the end: falling powers of two."""
    at, cuts = total - total % length, [total - total % length]
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - at) >> bit:
            at += 1 << bit
            cuts.append(at)
    return cuts


def pack(docs: DataFrame, tokenizer: str, end: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of each piece; the tokenizer file is on every machine.

    ``ids`` are little-endian numbers of ``id_bytes`` bytes each.
    """
    ship(docs.sparkSession)
    kept = id_bytes(tokenizer)
    rows = materialize(encoded(docs.select("doc_id", "text"), tokenizer, end), "encoded", "zstd")
    ordered = on_curve(rows).repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    placed = materialize(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids", before_in_partition("n").alias("at")), "curve", "zstd")
    discard(rows)
    # One row for each partition meets on the driver and is sent back; no document is.
    starts, total = [], 0
    for row in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((row["part"], total))
        total += row["n"]
    offsets = docs.sparkSession.createDataFrame(starts, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType())]))
    whole, cuts = total // length, tail_cuts(total, length)
    tail = F.array(*[F.lit(c).cast("long") for c in cuts])

    def sequence(at: Column) -> Column:
        late = whole + F.size(F.filter(tail, lambda c: c <= at)) - 1
        return F.when(at < cuts[0], F.floor(at / length)).otherwise(late).cast("long")

    def start(no: Column) -> Column:
        return F.when(no <= whole, no * length).otherwise(F.get(tail, (no - whole).cast("int")))

    def piece(no: Column) -> Column:
        low, high = F.greatest(F.col("begin"), start(no)), F.least(F.col("begin") + F.col("n"), start(no + 1))
        skip = low - F.col("begin")
        ids = F.substr(F.col("ids"), (kept * skip + 1).cast("int"), (kept * (high - low)).cast("int"))
        return F.struct(skip.alias("start"), (high - low).alias("length"), ids.alias("ids"), no.alias("sequence_id"), (low - start(no)).alias("offset"))

    met = placed.join(F.broadcast(offsets), "part").select("doc_id", "n", "ids", (F.col("part_start") + F.col("at")).alias("begin"))
    pieces = F.transform(F.sequence(sequence(F.col("begin")), sequence(F.col("begin") + F.col("n") - 1)), piece)
    found = met.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(pieces))
    return found.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids and doc_ids of each sequence; one holds at most ``LENGTH`` ids."""
    each = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    found = pieces.groupBy("sequence_id").agg(each.alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return found.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def _checksums(kept: int):
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{kept}").astype("<u4")) for x in ids], pa.int64())

    return F.arrow_udf(run, T.LongType())


def digests(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """The pieces with the checksums of their ids, as unsigned 32-bit numbers, instead of them."""
    crc = _checksums(id_bytes(tokenizer))(F.col("ids")).alias("ids_crc32")
    return pack(docs, tokenizer, end).select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")

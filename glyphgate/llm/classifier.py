"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

Features of a text: how often each of ``HASHED`` buckets of byte trigrams occurs (square roots, unit length), and which
power of two its length falls into. At most ``SAMPLE`` labelled texts of each label are chosen by a hash of their ids;
their features, a few MB, give the mean and the first ``LATENT`` principal directions (the latent-semantic space). Mean,
directions and the labelled latent vectors are sent to every task; their size has a fixed bound. Each document is
projected, its cosine with every labelled vector is computed exactly in blocks, and its ``NEIGHBOURS`` nearest vote for
their labels, weighted by the similarity to the power ``SHARPNESS``.

Neither labels, lang, source nor doc_id is an input of a score; doc_id only says which labelled rows may be used.

Similarities are compared to five decimal places, as sums in another order may differ beyond them.

Defined results. Null text: as an empty text, which has a length feature only. Several labels of one id: their mean,
rounded half up; null labels are left out, as are labels without a document. Several documents with one id: the
smallest text is used for fitting, and each row is scored. No usable label: score 0.5 for all. Ties of similarity: the
smaller labelled id. A null doc_id is not held out. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map

HASH_BITS = 10
HASHED = 1 << HASH_BITS
LENGTHS = 12
LATENT = 16
#: Labelled texts of each label that fit the space at most.
SAMPLE = 2_048
NEIGHBOURS = 5
SHARPNESS = 4
THRESHOLD = 0.3
DECIMALS = 5
FOLDS = 5
#: Documents whose cosines are computed at a time.
BLOCK = 256


def features(text: bytes | None) -> np.ndarray:
    raw = np.frombuffer(text or b"", np.uint8)
    out = np.zeros(HASHED + LENGTHS, np.float32)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts = np.sqrt(np.bincount(h >> np.uint32(32 - HASH_BITS), minlength=HASHED))
        out[:HASHED] = counts / np.linalg.norm(counts)
    out[HASHED + min(LENGTHS - 1, len(raw).bit_length() - (len(raw) > 0))] = 0.2
    return out


@dataclass(frozen=True)
class Space:
    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows - self.mean) @ self.directions
        return latent / (np.linalg.norm(latent, axis=1, keepdims=True) + 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        cosines = np.round(self.project(rows) @ self.vectors.T, DECIMALS)
        least = np.partition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        above, equal = cosines > least, cosines == least
        # Of the labelled texts that tie for the last places the first ones, which have the smaller ids, vote.
        near = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
        weights = np.where(near, np.maximum(cosines, 0).astype(np.float64) ** SHARPNESS + 1e-9, 0)
        return (weights * self.labels).sum(1) / weights.sum(1)


def fit_space(rows: np.ndarray, labels: np.ndarray) -> Space:
    if not len(labels):
        return Space(np.zeros(HASHED + LENGTHS, np.float32), np.zeros((HASHED + LENGTHS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    mean = rows.mean(0)
    centred = (rows - mean).astype(np.float64)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    bare = Space(mean, vectors[:, ::-1][:, :LATENT].astype(np.float32), np.zeros((0, 1), np.float32), labels)
    return Space(bare.mean, bare.directions, bare.project(rows).astype(np.float32), labels.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Space:
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [one.where(F.col("__label") == value).orderBy(*order).limit(sample) for value in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    # Twice ``sample`` rows at most, one for each id.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "row"])

    typed = texts.select("doc_id", "__label", F.col("text").cast("binary"))
    found = sorted(arrow_map(typed, run, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, row binary").collect(), key=lambda r: r["doc_id"])
    rows = np.array([np.frombuffer(r["row"], np.float32) for r in found]).reshape(len(found), HASHED + LENGTHS)
    return fit_space(rows, np.array([r["label"] for r in found]))


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text."""
    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = fitted.scores(np.array([features(t.as_py()) for t in part.column(2)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(narrow, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")

"""Exact top-k inner products by pivot-table elimination.

Vectors are made integer: floor(64 x) for each component x. For integer vectors q and c, q.c = (|q|^2 + |c|^2 - |q-c|^2) / 2,
so a lower bound on the distance |q-c| is an upper bound on the product; by the triangle inequality the largest
|d(q, p) - d(c, p)| over the pivots p is such a lower bound.

1. ``PIVOTS`` vectors far apart are chosen from a bounded sample, each the farthest from those before, and put in an
   order in which neighbours are near. Each vector's distances to all of them are computed once and stored with it:
   the pivot table.
2. Vectors are dealt by their nearest pivot, in that order, into blocks of about ``CANDIDATES`` rows (``QUERIES`` for
   queries). A block keeps, for each pivot, the smallest and largest distance of its rows.
3. Each query block meets the candidate block of its own surroundings. The k-th scores there are the queries' floors:
   no result can be below.
4. A pair of blocks is sent only if some query's bound for the whole candidate block reaches its floor.
5. Within a pair, queries whose bound for the block is below their floor drop out, then each query's candidates whose
   bound by its ``NEAREST`` nearest pivots and then by all pivots is below it. What is left is taken in the order of
   bounds, in growing steps, until the next bound is below the k-th score so far. Where the nearest pivots leave over a
   ``DENSE`` part of a pair's candidates, bounds of more pivots cost more than the products they could save, so one
   matrix product evaluates all of them, and the floor does the rest. ``evaluated`` counts what was evaluated.

Each pair gives k rows for each query at most, none below its floor, and a window over those ends the search. On vectors
without clusters in many dimensions distances to pivots are nearly equal and eliminate next to nothing; the README has
the shares.

Defined results. Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
filled up with zeros. A query's own row is excluded, other rows with its id are not. Ties of scores go to the smaller
vec_id, nulls first. A null vec_id is never a query. Fewer than k candidates: all of them. Scores beyond a long are cut
to its range. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphgate.llm.common import arrow_map, discard, materialize

SCALE = 64
TOP = 20
PIVOTS = 64
#: Rows that pivots are chosen from.
SAMPLE = 2_048
#: Pivots that a query tries first.
NEAREST = 8
#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8_192, 1_024
#: Candidates that a query takes first, in bound order; each step doubles.
STEP = 256
#: Share of a pair's candidates above which one product evaluates them.
DENSE = 0.25
#: Products are exact in single and double precision below these.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 53)
LEAST_LONG = -(1 << 63)


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of every usable row, with a row number ``uid``, written once."""
    x = F.transform(F.col(vector_column), lambda e: e.cast("double"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.select(F.col(id_column).alias("vec_id"), x.alias("v")).where(sound)
    rows = rows.withColumn("v", F.transform("v", lambda e: F.floor(e * SCALE).cast("double")))
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def _matrix(values: pa.ListArray, width: int) -> np.ndarray:
    sizes, flat = values.value_lengths().to_numpy(), values.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` rows far apart, in an order in which neighbours are near."""
    if not len(sample):
        return sample
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    between, order, left = _distances(sample[chosen], sample[chosen]), [0], set(range(1, len(chosen)))
    while left:
        order.append(min(left, key=lambda i: (between[order[-1], i], i)))
        left.remove(order[-1])
    return sample[chosen][order]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact whole-number products of all rows of ``q`` and ``c`` as longs."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if bound < EXACT:
        kind = np.float32 if bound < EXACT_SINGLE else np.float64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
    return np.array([[max(LEAST_LONG, min((1 << 63) - 1, x)) for x in row] for row in whole], dtype=np.int64).reshape(len(q), len(c))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, earlier ones first among equals."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores > cut)
        some = np.sort(np.concatenate((some, np.flatnonzero(scores == cut)[: k - len(some)])))
    else:
        some = np.arange(len(scores))
    # ~x falls as x grows and, unlike -x, has no overflow.
    return some[np.argsort(~scores[some], kind="stable")]


class Block:
    """Rows of one block in the order of their ids, with their part of the pivot table."""

    def __init__(self, packed: pa.StructScalar | pa.ListScalar, width: int) -> None:
        fields = packed.values
        ids = fields.field("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.uids = ids[order], fields.field("uid").to_numpy()[order]
        self.v = _matrix(fields.field("v"), width)[order]
        self.norms = (self.v**2).sum(1)
        self.far = np.frombuffer(b"".join(fields.field("far").to_pylist()), np.float32).reshape(len(ids), -1)[order]
        self.floors = fields.field("floor").to_numpy()[order] if "floor" in [f.name for f in fields.type] else np.full(len(ids), LEAST_LONG)


def _bound(norm, other, gap):
    """Upper bound of the product of vectors of these squared lengths whose stored distances to a pivot differ by ``gap``."""
    gap = np.maximum(gap - 1e-6 * (np.sqrt(norm) + np.sqrt(other)), 0)  # room for the rounding of distances
    return (norm + other - gap**2) / 2 + 1e-9 * (norm + other) + 1


def block_bounds(q: Block, low: np.ndarray, high: np.ndarray, most: float) -> np.ndarray:
    """For each query, an upper bound of its products with all rows of a block with these distances and largest norm."""
    gap = np.maximum(np.maximum(low[None, :] - q.far, q.far - high[None, :]), 0).max(1, initial=0).astype(np.float64)
    return _bound(q.norms, most, gap)


def _within(q: Block, i: int, c: Block, pivots: np.ndarray, floor: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (of ``some``, or all) whose bound by ``pivots`` reaches the floor, and their bounds."""
    far, norms = (c.far, c.norms) if some is None else (c.far[some], c.norms[some])
    gap = np.abs(far[:, pivots] - q.far[i, pivots]).max(1, initial=0)
    bounds = _bound(q.norms[i], norms, gap)
    stay = np.flatnonzero(bounds >= floor)
    return (stay if some is None else some[stay]), bounds[stay]


def search(q: Block, c: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, places, scores, evaluated) of the k best candidates of a block that reach the query's floor."""
    bounds = block_bounds(q, c.far.min(0), c.far.max(0), float(c.norms.max(initial=0)))
    alive = np.flatnonzero(bounds >= q.floors)
    near = np.argsort(q.far, axis=1)[:, :NEAREST]
    # What the nearest pivots leave of a few queries tells which way is shorter; either way is exact.
    tried = alive[:: max(1, len(alive) // 16)]
    left = sum(len(_within(q, i, c, near[i], q.floors[i])[0]) for i in tried)
    if left > DENSE * len(c.ids) * max(1, len(tried)):
        scores = _products(q.v[alive], c.v)
        for row, i in zip(scores, alive):
            some = np.flatnonzero((row >= q.floors[i]) & (c.uids != q.uids[i]))
            some = some[_best(row[some], k)]
            yield i, some, row[some], len(c.ids)
        return
    for i in alive:
        some, _ = _within(q, i, c, near[i], q.floors[i])
        some, bounds = _within(q, i, c, np.arange(q.far.shape[1]), q.floors[i], some)
        order = np.argsort(-bounds, kind="stable")
        some, bounds, floor, seen, step = some[order], bounds[order], q.floors[i], 0, STEP
        at, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while seen < len(some) and bounds[seen] >= floor:
            new = some[seen : seen + step]
            new, seen, step = new[c.uids[new] != q.uids[i]], seen + step, 2 * step
            at, scores = np.concatenate((at, new)), np.concatenate((scores, _products(q.v[i : i + 1], c.v[new])[0]))
            by_place = np.argsort(at)
            best = by_place[_best(scores[by_place], k)]
            at, scores = at[best], scores[best]
            if len(at) == k:
                floor = max(floor, scores[-1])
        reach = scores >= q.floors[i]
        yield i, at[reach], scores[reach], min(seen, len(some))


def _blocks(table: DataFrame, homes: dict[int, int], size: int, label: str) -> DataFrame:
    """(no, rows, low, high, most) of each block of ``table``: rows of neighbouring homes, a large home in several blocks."""
    starts, total = {}, 0
    for home in sorted(homes):
        starts[home] = total
        total += homes[home]
    first = F.element_at(F.create_map(*[F.lit(x) for h in starts for x in (h, float(starts[h]))]), F.col("home"))
    many = F.element_at(F.create_map(*[F.lit(x) for h in homes for x in (h, float(homes[h]))]), F.col("home"))
    part = F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) / float(1 << 40)
    columns = [c for c in ("uid", "id", "v", "far", "floor") if c in table.columns]
    dealt = table.withColumn("no", F.floor((first + part * many) / size).cast("int"))
    return materialize(dealt.groupBy("no").agg(F.collect_list(F.struct(*columns)).alias("rows")), label)


def pivot_table(vectors: DataFrame, is_query: Column, width: int) -> DataFrame:
    """uid, id (the vec_id, least long for null), asked, v, far (distances to all pivots) and home (the nearest) of each vector."""
    # A bounded number of vectors, spread by hash.
    chosen = vectors.orderBy(F.xxhash64("v", "uid")).limit(SAMPLE).select("v").collect()
    sample = np.zeros((len(chosen), width))
    for row, (v,) in zip(sample, chosen):
        row[: len(v)] = v
    pivots = choose_pivots(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_matrix(batch["v"], width), pivots).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(bytes, far), pa.binary()), pa.array(far.argmin(1).astype(np.int32))], ["uid", "id", "asked", "v", "far", "home"])

    named = vectors.select("uid", F.coalesce(F.col("vec_id"), F.lit(LEAST_LONG)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), "v")
    return materialize(arrow_map(named, run, "uid long, id long, asked boolean, v array<double>, far binary, home int"), "pivots")


def _searched(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """uid, query_id, id, score, evaluated of each pair's best candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packs in zip(batch["q"], batch["c"]):
                q, c = (Block(x, width) for x in packs)
                found = list(search(q, c, k))
                if found:
                    who = np.repeat([i for i, *_ in found], [len(at) for _, at, *_ in found])
                    at, scores = (np.concatenate(x) for x in list(zip(*found))[1:3])
                    rows = [q.uids[who], q.ids[who], c.ids[at], scores, np.zeros(len(at), np.int64)]
                    # One more row, without a candidate, tells what was evaluated.
                    last = [q.uids[:1], q.ids[:1], [None], [None], [sum(n for *_, n in found)]]
                    columns = [pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for x, y in zip(rows, last)]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "query_id", "id", "score", "evaluated"])

    return arrow_map(pairs, run, "uid long, query_id long, id long, score long, evaluated long")


def _reached(pairs: DataFrame, width: int) -> DataFrame:
    """The (qb, cb) pairs of which some query's bound reaches its floor; ``pairs`` has no candidate's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for pack, low, high, most in zip(batch["q"], batch["low"].to_pylist(), batch["high"].to_pylist(), batch["most"].to_pylist()):
                q = Block(pack, width)
                stay.append(bool((block_bounds(q, np.frombuffer(low, np.float32), np.frombuffer(high, np.float32), most) >= q.floors).any()))
            yield batch.select(["qb", "cb"]).filter(pa.array(stay, pa.bool_()))

    return arrow_map(pairs, run, "qb int, cb int")


def _summaries(blocks: DataFrame, width: int) -> DataFrame:
    """cb, low, high and most of each candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Block(x, width) for x in batch["rows"]]
            columns = [pa.array([x.far.min(0).tobytes() for x in found], pa.binary()), pa.array([x.far.max(0).tobytes() for x in found], pa.binary()), pa.array([float(x.norms.max()) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch["no"], *columns], ["cb", "low", "high", "most"])

    return materialize(arrow_map(blocks, run, "cb int, low binary, high binary, most double"), "summaries")


def found_pairs(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """uid, query_id, id, score and evaluated: candidates of each pair of blocks, among them each query's k best."""
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    table = pivot_table(vectors, is_query, width)
    queries = table.where("asked")
    homes = {r["home"]: r["n"] for r in table.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    asked = {r["home"]: r["n"] for r in queries.groupBy("home").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return table.limit(0).select("uid", F.col("id").alias("query_id"), "id", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("evaluated"))
    c_blocks = _blocks(table, homes, CANDIDATES, "candidates")
    numbers = max(1, -(-sum(homes.values()) // CANDIDATES)), max(1, -(-sum(asked.values()) // QUERIES))
    first = _blocks(queries, asked, QUERIES, "queries")
    # Any candidates give floors; those around the same pivots give high ones.
    own = first.select(F.col("no").alias("qb"), F.col("rows").alias("q"), F.floor(F.col("no") * (numbers[0] / numbers[1])).cast("int").alias("cb"))
    begun = _searched(own.join(c_blocks.select(F.col("no").alias("cb"), F.col("rows").alias("c")), "cb").repartition(min(2 * numbers[1], 10_000), "qb").select("q", "c"), width, k)
    floors = begun.where("score IS NOT NULL").groupBy("uid").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    floored = queries.join(materialize(floors, "floors"), "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST_LONG)))
    q_blocks = _blocks(floored, asked, QUERIES, "queries")
    discard(first)
    every = F.explode(F.sequence(F.lit(0), F.lit(numbers[1] - 1)))
    tried = _summaries(c_blocks, width).withColumn("qb", every).join(q_blocks.select(F.col("no").alias("qb"), F.col("rows").alias("q")), "qb")
    pairs = materialize(_reached(tried, width), "pairs")
    # Twice as many parts as pairs, as hashing is uneven; many pairs share parts.
    parts = min(2 * pairs.count() + 1, 10_000)
    sent = pairs.join(c_blocks.select(F.col("no").alias("cb"), F.col("rows").alias("c")), "cb").join(q_blocks.select(F.col("no").alias("qb"), F.col("rows").alias("q")), "qb")
    return _searched(sent.repartition(parts, "qb", "cb").select("q", "c"), width, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for every query row of ``integer_vectors``."""
    found = found_pairs(vectors, is_query, k).where("score IS NOT NULL")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id")))
    vec_id = F.when(F.col("id") != LEAST_LONG, F.col("id"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", vec_id.alias("vec_id"), "score")

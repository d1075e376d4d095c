"""Near-duplicate detection with 64-bit SimHash fingerprints and an exact tiled comparison.

1. ``fingerprints``: each text's words, ASCII-lower-cased, in 3-word shingles (repeats included); XXH64 with seed 42 of
   each; a bit is set if it is set in over half of the hashes.
2. Equal fingerprints form one class. A third of all rows with one text thus become one row, by a map-side combine.
3. Classes are dealt into tiles of one population count. Two fingerprints within a radius of r differ by r in their
   population counts at most, so only tiles whose counts are within r meet. Each such pair of tiles is one row of a
   shuffled table: numpy exclusive-or and bit counts compare it exactly. Within a pair, slices are skipped where the
   counts of the four 16-bit quarters already differ by more than r.
4. A tile pair returns a spanning forest of its links, not the links: thousands of texts that are all near each other
   give a few thousand rows and no square.
5. Components by alternating large-star and small-star steps; each step is a written table.

Defined results. Null text: as an empty text. Fewer than 3 words: the whole sequence is the one shingle. No words:
fingerprint 0, linked as any other. Ties and repeated rows: rows with one text share a class. Null doc_id: never the
smallest; a component with null ids only has a null id. An empty table gives an empty result. Other columns of the
input are ignored by ``near_duplicates`` and kept by ``deduplicate``.

``deduplicate``, the pipeline's stage, links by another rule: 5-word shingle sets with a Jaccard similarity of 0.8 or
more. SimHash proposes most of them: each set has a fingerprint as above, all fingerprints within ``COPY_RADIUS`` bits are
found by the same tiles (``near_fingerprints``), and each proposed pair is decided by its whole sets. The bits between
two such texts are not bounded, so no radius finds them all: what is not yet connected is found exactly (``similar``).

0. Fingerprints are those of the sets. What SimHash links needs no comparison in any bucket below.
1. Equal sets form one class. Any one order of all shingles will do: two sets of that similarity share a shingle among
   the first n - ceil(0.8 n) + 1 of each. The order is that of the hashes, with frequent shingles (estimated on the
   whole sets of an eighth of the texts, which changes the cost only) last, the more frequent the later.
2. In a bucket (classes that share such a shingle) of over ``CROWD`` classes, all are compared with one of them first.
   The components of these links need no comparison inside, so a group of near copies is no square.
3. In each bucket, classes outside its largest component meet all classes of other components, block by block, so a
   bucket of any size is spread over many tasks. Two sets differ in at least as many shingles as the bits in which
   their parity sketches differ: a pair that this, or their sizes, keeps below 0.8 is never made. The number of buckets
   that two classes share bounds their common shingles further, and what is left is decided by the whole sets.
Texts without words form one class; with fewer than 5 words, the whole sequence is the one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map, discard, materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
#: For ``deduplicate``: words of a shingle, classes that a bucket compares without a first round, frequent shingles put last.
COPY_SHINGLE = 5
#: Bits between fingerprints of sets that are compared: a similarity of 0.9 leaves about 6.6 bits, one of 0.8 about 9.7.
COPY_RADIUS = 8
CROWD = 64
LAST = 100_000
#: Rows of a bucket that meet in one task: at most ``BLOCK`` by ``BLOCK``. 64-bit words of a parity sketch.
BLOCK = 2_048
SKETCH = 8
#: Fingerprints in one tile; two of them take 1 MB.
TILE = 65_536
#: Rows and columns of one exclusive-or inside a pair of tiles.
SLICE = 1_024


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of each shingle, repeats included. ``bytes.lower`` and ``bytes.split`` know only ASCII, as wanted."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The SimHash of one UTF-8 text."""
    return majority(np.array(shingle_hashes(text, size), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, size: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` (``doc_id`` unless given) and ``fp``, the fingerprint as a signed long."""
    keep = keep or ["doc_id"]
    narrow = docs.select(*keep, F.col("text").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.int64())], [*keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    return arrow_map(narrow, run, f"{schema}, fp long")


def forest(u: np.ndarray, v: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For links between ``nodes`` numbered points: (point, smallest point reachable) for each point that is not it."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    at = np.flatnonzero(label != np.arange(nodes))
    return at, label[at]


def _quarters(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts."""
    return np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)


def tile_forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (or inside one) as two arrays of fingerprints."""
    qa, qb = _quarters(a), _quarters(b)
    ia, ib = np.lexsort(qa.T[::-1]), np.lexsort(qb.T[::-1])
    a, qa, b, qb = a[ia], qa[ia], b[ib], qb[ib]
    cuts_b = [(j, qb[j : j + SLICE].min(0), qb[j : j + SLICE].max(0)) for j in range(0, len(b), SLICE)]
    us, vs = [], []
    for i in range(0, len(a), SLICE):
        low, high = qa[i : i + SLICE].min(0), qa[i : i + SLICE].max(0)
        rows = a[i : i + SLICE]
        for j, low_b, high_b in cuts_b:
            if same and j < i or np.maximum(0, np.maximum(low - high_b, low_b - high)).sum() > radius:
                continue
            columns = b[j : j + SLICE]
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                both = np.concatenate((rows, columns))
                p, q = forest(x, y + len(rows), len(both))
                us.append(both[p])
                vs.append(both[q])
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    p, q = forest(at[: len(u)], at[len(u) :], len(names))
    return names[p], names[q]


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (u, v) of distinct fingerprints ``fp`` that connect exactly what links within ``radius`` connect."""
    counted = classes.select("fp", F.bit_count("fp").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles = {p: -(-n // tile) for p, n in sizes.items()}
    if not tiles:
        return classes.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    of = F.create_map(*[F.lit(x) for p in sorted(tiles) for x in (p, tiles[p])])
    dealt = counted.select("fp", "pop", F.pmod(F.xxhash64("fp"), F.element_at(of, F.col("pop"))).cast("int").alias("no"))
    packed = materialize(dealt.groupBy("pop", "no").agg(F.collect_list("fp").alias("fps")), "tiles")
    left = packed.select(F.col("pop").alias("p1"), F.col("no").alias("n1"), F.col("fps").alias("a"))
    # Each tile is sent to the tiles of the counts from its own to that plus the radius: an equi-join on (pop, no).
    to = F.explode(F.sequence(F.col("p1"), F.least(F.lit(64), F.col("p1") + radius)))
    left = left.withColumn("pop", to).where(F.col("pop").isin(*sorted(tiles)))
    left = left.withColumn("no", F.explode(F.sequence(F.lit(0), F.element_at(of, F.col("pop")) - 1)))
    left = left.where((F.col("pop") > F.col("p1")) | (F.col("no") >= F.col("n1")))
    pairs = left.join(packed, ["pop", "no"]).select("a", F.col("fps").alias("b"), ((F.col("pop") == F.col("p1")) & (F.col("no") == F.col("n1"))).alias("same"))
    meeting = sum(n * tiles.get(q, 0) for p, n in tiles.items() for q in range(p, p + radius + 1))
    pairs = pairs.repartition(min(meeting, 2_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(*batch.columns):
                u, v = tile_forest(*(x.values.to_numpy().view(np.uint64) for x in (a, b)), same.as_py(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    return arrow_map(pairs, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (u, v); root is the smallest node that it reaches.

    Large-star and small-star in turn until nothing changes; the rounds grow with the logarithm of the component.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = materialize(small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for used in (now, low, large, down):
            discard(used)
        now = after
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, radius: int = RADIUS) -> DataFrame:
    """``keep`` columns, ``fp``, ``root`` (the component's smallest fingerprint) and ``component_id`` for each row."""
    marked = materialize(fingerprints(docs, keep), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = components(links(classes, radius))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = materialize(rooted.join(materialize(named, "named"), "root").select("fp", "root", "component_id"), "members")
    return marked.join(members, "fp")


def hex_fingerprint(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, COPY_SHINGLE), dtype=np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles fall to i. Each shingle in which two sets differ changes one bit at most."""
    bits = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def ordered(shingles: np.ndarray, late: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sorted shingles with those of ``late`` (sorted, not empty) last, by their ``place``."""
    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
    return shingles[np.argsort(np.where(late[at] == shingles, place[at], -1), kind="stable")]


def shingled(docs: DataFrame, last: np.ndarray | None = None) -> DataFrame:
    """doc_id, __mark, node (a digest of the text's shingle set), n (its size), fp (its SimHash), prefix (its first shingles
    in order) and sketch. ``last`` holds frequent shingles, the most frequent first."""
    last = np.array([0], np.uint64) if last is None or not len(last) else last
    at = np.argsort(last)
    late, place = last[at], len(last) - at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            first = [ordered(x, late, place)[: len(x) - -(-4 * len(x) // 5) + 1] for x in sets]
            fps = np.array([majority(x) for x in sets], dtype=np.uint64).view(np.int64)
            columns = [*batch.columns[:2], pa.array(nodes), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), _lists(first), _lists([sketch(x) for x in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__mark", "node", "n", "fp", "prefix", "sketch"])

    narrow = docs.select("doc_id", "__mark", F.col("text").cast("binary").alias("__text"))
    return arrow_map(narrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __mark long, node long, n int, fp long, prefix array<long>, sketch array<long>")


def _keyed(df: DataFrame, at: str = "") -> DataFrame:
    """Columns that say the same as doc_id and __mark and are never null."""
    return df.withColumn("__none", F.col(f"{at}doc_id").isNull()).withColumn("__key", F.coalesce(F.xxhash64(f"{at}doc_id"), F.lit(0).cast("long"))).withColumn("__text_mark", F.col(f"{at}__mark"))


KEYS = ["__none", "__key", "__text_mark"]


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) for the (node, keeper) rows of ``wanted``, whose keeper names a row of ``docs`` that has the set."""
    held = _keyed(docs.select("doc_id", "__mark", "text")).join(_keyed(wanted, "keeper.").select("node", *KEYS), KEYS)
    return _sets(held.dropDuplicates(KEYS).select("node", "text"))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, tokens), the shingle set of each row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t.as_py()) for t in batch.column(1)])], ["node", "tokens"])

    return arrow_map(texts.select("node", F.col("text").cast("binary").alias("__text")), run, "node long, tokens array<long>")


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of the most texts, the most frequent first, by whole sets of an eighth of the distinct texts."""
    some = docs.where(F.pmod("__mark", F.lit(8)) == 0).select(F.col("__mark").alias("node"), "text").dropDuplicates(["node"])
    counted = _sets(some).select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > CROWD // 8)
    often = counted.orderBy(F.desc("count"), "token").limit(LAST).collect()  # LAST rows at most
    return np.array([r["token"] for r in often], np.int64).view(np.uint64)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets have a similarity of 0.8 or more."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", "keeper").join(ends, "node"), "wanted")
    sets = materialize(shingle_sets(docs, wanted), "sets")
    discard(wanted)
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    found = materialize(both.where(9 * common >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "similar")
    discard(sets)
    return found


def near_fingerprints(nodes: DataFrame, radius: int = COPY_RADIUS) -> DataFrame:
    """Rows (u, v) of ``nodes`` (node, fp), u > v, that connect exactly what fingerprints within ``radius`` bits connect."""
    classes = materialize(nodes.groupBy("fp").agg(F.min("node").alias("one")), "classes")
    found = links(classes, radius)
    for end in ("u", "v"):
        found = found.join(classes.select(F.col("fp").alias(end), F.col("one").alias(f"{end}_one")), end)
    same = nodes.join(classes, "fp").select(F.col("node").alias("u"), F.col("one").alias("v"))
    pairs = found.select(F.greatest("u_one", "v_one").alias("u"), F.least("u_one", "v_one").alias("v")).union(same).where("u > v")
    out = materialize(pairs.distinct(), "proposed")
    discard(classes)
    return out


def similar(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (u, v) of ``nodes`` that connect exactly what links of a similarity of 0.8 or more connect."""
    proposed = near_fingerprints(nodes)
    rows = nodes.select("node", "n", F.explode("prefix").alias("token"))
    shared = materialize(rows.groupBy("token").agg(F.min("node").alias("one"), F.count("*").alias("held")).where("held > 1"), "shared")
    held = materialize(rows.join(shared, "token"), "held")
    discard(shared)
    # Any true links do here, so only pairs that share much of their prefixes are tried.
    crowds = held.where((F.col("held") > CROWD) & (F.col("node") > F.col("one")))
    star = crowds.groupBy(F.col("node").alias("u"), F.col("one").alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    # Both kinds are decided together, so that a text moves once.
    star = materialize(star.where(20 * F.col("c") >= F.col("n")).select("u", "v").union(proposed).distinct(), "star")
    discard(proposed)
    near = star if star.isEmpty() else _verified(star, docs, nodes)
    parted = held.drop("one", "held").join(components(near).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parted = materialize(parted, "parted")
    discard(held)
    most = parted.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("token", F.col("m.part").alias("main"), F.col("all"), (F.col("all") - F.col("m.c")).alias("out"))
    mixed = materialize(parted.join(materialize(most, "most"), "token").join(nodes.select("node", "sketch"), "node"), "mixed")
    discard(parted)
    # Each row of a bucket has a block; blocks of rows outside its main component meet all blocks.
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    mine = lambda c: F.pmod(F.xxhash64("node"), blocks(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), blocks(c) - 1))
    side = lambda at: [F.col(c).alias(f"{at}_{c}") for c in ("node", "n", "part", "sketch")]
    x = mixed.where("part <> main").select("token", mine("out").alias("row"), every("all").alias("column"), *side("x"))
    y = mixed.select("token", every("out").alias("row"), mine("all").alias("column"), "main", *side("y"))
    once = (F.col("x_part") != F.col("y_part")) & ((F.col("y_part") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
    sizes = 5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n")
    differ = sum(F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("y_sketch")[i])) for i in range(SKETCH))
    # A similarity of 0.8 leaves at most a ninth of both sizes in one set only.
    alike = 9 * differ <= F.col("x_n") + F.col("y_n")
    meeting = (x["token"] == y["token"]) & (x["row"] == y["row"]) & (x["column"] == y["column"])
    met = x.join(y, meeting & once & sizes & alike).groupBy(F.greatest("x_node", "y_node").alias("u"), F.least("x_node", "y_node").alias("v"))
    met = met.agg(F.count("*").alias("c"), F.first(F.greatest("x_n", "y_n")).alias("large"), F.first(F.col("x_n") + F.col("y_n")).alias("both"))
    # What two sets share beyond their prefixes' common shingles lies behind one of the prefixes: ceil(0.8 n) - 1 at most.
    met = materialize(met.where(9 * (F.col("c") + F.ceil(4 * F.col("large") / 5) - 1) >= 4 * F.col("both")).select("u", "v"), "met")
    discard(mixed)
    return near.union(_verified(met, docs, nodes))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, __mark, root and component_id for each row of ``docs`` (doc_id, text, __mark)."""
    marked = materialize(shingled(docs, frequent(docs)), "shingled")
    nodes = materialize(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "__mark")).alias("keeper"), F.min("doc_id").alias("least_id")), "nodes")
    # Prefixes are needed once for each set; what follows needs to know only which rows have which set.
    places = materialize(marked.select("doc_id", "__mark", "node"), "places")
    discard(marked)
    found = components(similar(docs, nodes))
    rooted = materialize(nodes.select("node", "least_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    discard(nodes)
    named = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    members = materialize(rooted.join(named, "root").select("node", "root", "component_id"), "members")
    discard(named)
    discard(rooted)
    out = materialize(places.join(members, "node"), "copies")
    discard(places)
    discard(members)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: the row with its smallest doc_id, all columns kept.

    Rows that repeat an id within one component count as one document.
    """
    mark = F.xxhash64(F.col("text"))
    found = near_copies(docs.select("doc_id", "text", mark.alias("__mark")))
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "__mark")).alias("s")).select("s.doc_id", "s.__mark")
    stay = materialize(_keyed(stay).select(*KEYS), "stay")
    discard(found)
    return _keyed(docs.withColumn("__mark", mark)).join(stay, KEYS, "left_semi").dropDuplicates(KEYS).select(*docs.columns)

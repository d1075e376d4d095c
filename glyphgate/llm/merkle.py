"""A Merkle manifest of a dataset, with a proof for each row, kept as strings of concatenated digests.

A leaf is the SHA-256 of a row's fields. The leaves of a source form a tree of width 3 in the order of their ids, and the
roots of all sources form one more. Leaves are numbered within their source and cut into aligned blocks of 3^5. A block
keeps each of its levels as one string of hexadecimal digests side by side: the substring of 192 digits at a multiple of
192 is what a parent hashes, and the substrings to the left and right of a node within those 192 digits are its siblings.
Block roots are the nodes of the next round, in which they fall into blocks again, until one node is left for a source;
so no task ever holds more than 243 nodes of a tree. Going down again each block gets the siblings above it, once, and
gives its own rows theirs.

Defined results. A null field is ``-``; so a null doc_id is one more id, first in order, and is never tampered with. Null
source: a source of its own, first in order. Empty text: ``0:``. Repeated ids: in the order of their leaves, and equal
leaves are each a leaf. A source of one row: its leaf is its root. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import discard, materialize, number_within

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH, HEIGHT = 3, 5
BLOCK = WIDTH**HEIGHT
#: Hexadecimal digits of a digest, and of the children of one parent.
DIGEST = 64
RUN = WIDTH * DIGEST
_SEGMENT = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of them ``changed``."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves: the smallest d with 3^d of n or more."""
    total = F.lit(0)
    for level in range(39):
        total = total + (n > WIDTH**level).cast("int")
    return total


def _parents(level: Column) -> Column:
    """The level above, from the fixed-width substrings of a level."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def _own(at: Column, below: Column) -> Column:
    """The siblings of the block's node ``at``, from its own level up: what flanks it in each level's string."""
    segments = []
    for level in range(HEIGHT):
        node = F.floor(at / WIDTH**level).cast("int")
        place = node % WIDTH
        left = F.substr(F.col(f"level{level}"), (node - place) * DIGEST + 1, place * DIGEST)
        right = F.substr(F.col(f"level{level}"), (node + 1) * DIGEST + 1, (WIDTH - 1 - place) * DIGEST)
        segments.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*segments), F.lit(1), below)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, idx, depth, hash, row) as blocks with their levels; level 5 is the block's root."""
    member = F.struct("idx", "hash", "row")
    found = nodes.groupBy("tree", "depth", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    found = found.withColumn("below", F.least("depth", F.lit(HEIGHT))).withColumn("level0", F.array_join(F.col("members.hash"), ""))
    for level in range(HEIGHT):
        here = F.col(f"level{level}")
        found = found.withColumn(f"level{level + 1}", F.when(F.col("below") > level, _parents(here)).otherwise(here))
    return materialize(found, "blocks")


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over leaves (tree, idx, n, hash, row), and (tree, hash) of the trees' roots."""
    nodes = leaves.withColumn("depth", _depth(F.col("n"))).select("tree", "idx", "depth", "hash", "row")
    rounds = []
    while True:
        rounds.append(_blocks(nodes))
        above = F.col("depth") - F.col("below")
        nodes = rounds[-1].select("tree", F.col("block").alias("idx"), above.alias("depth"), F.col("level5").alias("hash"), F.lit(None).cast("string").alias("row"))
        if not rounds[-1].agg(F.max(above)).first()[0]:  # one number
            return rounds, nodes.select("tree", "hash")


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``row`` and ``hash`` of each leaf, its siblings from the leaf's level up (``path``), and the columns of ``tops``.

    ``tops`` holds, for each tree, the siblings above its root (``path``) and what else its leaves are to get.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    upper = tops.withColumn("idx", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        met = blocks.join(upper.withColumnRenamed("idx", "block"), ["tree", "block"])
        each = F.transform("members", lambda m, i: F.struct(m["idx"].alias("idx"), m["row"].alias("row"), m["hash"].alias("hash"), F.concat(_own(i, F.col("below")), F.col("path")).alias("path")))
        upper = met.select("tree", *more, F.inline(each))
    return upper.drop("tree", "idx")


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """doc_id, leaf, found_leaf, subroot, root and proof (array of left and right siblings, from the leaf up) of each row.

    ``found`` is the text that a later reader of the row has found; ``found_leaf`` is the leaf that he then computes,
    null where that is the leaf itself.
    """
    other = F.when(found.eqNullSafe(F.col("text")), None).otherwise(leaf(text=found)) if found is not None else F.lit(None).cast("string")
    # No source sorts after a null one.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), F.col("doc_id"), leaf().alias("hash"), other.alias("found_leaf"))
    numbered, whole = number_within(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("hash")], "idx", "n")
    rounds, subroots = grow(numbered.withColumn("row", F.struct("doc_id", "found_leaf")))
    discard(whole)
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), "hash")
    ordered, whole = number_within(named, "tree", [F.col("source_key")], "idx", "n")
    over, root = grow(ordered.withColumn("row", F.struct("source_key")))
    discard(whole)
    no_path = F.array().cast(f"array<{_SEGMENT}>")
    tops = descend(over, root.select("tree", no_path.alias("path"), F.col("hash").alias("root")))
    tops = tops.select(F.col("row.source_key").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    leaves = descend(rounds, tops)
    return leaves.select("row.doc_id", F.col("hash").alias("leaf"), "row.found_leaf", "subroot", "root", F.col("path").alias("proof"))


def siblings(proof: Column) -> Column:
    """All digests of a proof, side by side."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest as digests, and whether each row, with the line breaks of half of the ids taken out, still leads to the root."""
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = F.when(half, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, found).withColumn("folded_root", folded(F.coalesce("found_leaf", "leaf"), F.col("proof")))
    proof = F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

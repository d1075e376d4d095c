"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

1. Each document gets the key -ln(u) / w; u in (0, 1) is a hash of its id and text, w its quality weight. Taking the
   smallest keys first is weighted sampling without replacement, and a rerun takes the same documents.
2. Each source gets a target: its share by weight of the sizes of all sources, at most ``CAP`` times its own size, the
   excess reshared by weight. The level at which the shares settle needs only two sums for each step.
3. A source's target is so many complete epochs of all its documents, then a fraction, filled in key order up to the
   word budget. All rows, without texts, are range-partitioned by source and key, so that every range is about as large
   whatever the keys and sizes are. The prefix sums come in two steps: the ranges' sums give where each range of a source
   begins; only rows in the one range that a source's budget ends in are summed one by one.
4. The mix itself needs of each source its epochs and the last row taken beyond them: a row knows from its own key how
   often it comes, so texts are neither copied nor shuffled. Only of repeated rows that a budget parts are some counted off.

Quality weight: 1 / (1 + |c - 6.5| / 6.5) for c characters a word, so prose weighs most; 0.01 without words.

Defined results. Null or empty text: size 0, never fills a budget, taken 0. Null source: a source of its own, last in
order. Ties of keys: by doc_id, nulls first, then text hash, then row. Repeated rows: each counts, and they may fall into
several ranges. Empty table: no rows. Other columns of the input are kept by ``mix_rows`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphgate.llm.common import WORD, discard, materialize, number_rows, number_within, running_total

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 7


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the row id ``__uid``; it holds once it is written."""
    return docs.withColumn("__uid", F.monotonically_increasing_id())


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """__uid, doc_id, mark (hash of the text), source_key, size and key of each numbered document."""
    return _keys(docs, ["__uid"], seed)


def _keys(docs: DataFrame, keep: list, seed: int) -> DataFrame:
    """``keep``, doc_id, mark, source_key, size and key of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *keep,
        F.col("doc_id"),
        F.xxhash64(text).alias("mark"),
        # A string never null: nulls sort last, other sources by code point.
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.length(text).alias("chars"),
    )
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mark", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.when(F.col("size") > 0, 1 / (1 + F.abs(F.col("chars") / F.col("size") - 6.5) / 6.5)).otherwise(F.lit(0.01))
    return rows.withColumn("key", -F.log(u) / weight).drop("chars")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (source_key, source_size). Only sums come to the driver."""
    numbered, count = number_rows(sources, [F.col("source_key")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    level = 0.0
    if count:
        total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
        while True:
            capped = F.col("most") <= F.col("weight") * level
            fixed, free = numbered.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
            new = (total - (fixed or 0.0)) / free if free else level
            if new <= level * (1 + 1e-12):
                break
            level = new
    return numbered.withColumn("target", F.least("most", F.col("weight") * F.lit(level))).select("source_key", "source_size", "target")


def mix_keyed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """source_key, __uid, doc_id, mark, key, size, source_size, target, epochs and extra (how often the mix takes it: their sum) of each numbered document."""
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("__uid")]
    rows = materialize(keyed(docs, seed), "keyed")
    ranged = rows.repartitionByRange(F.col("source_key"), *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    discard(rows)
    sums = materialize(ranged.groupBy("source_key", "range").agg(F.sum("size").alias("range_size")), "sums")
    sources = sums.groupBy("source_key").agg(F.sum("range_size").alias("source_size"))
    goal = targets(sources, weights, cap)
    # One row for each source and range: a source has as many as there are partitions at most.
    starts = running_total(sums, ["source_key"], ["range"], "range_size", "start").join(goal, "source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    starts = starts.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    starts = materialize(starts.select("source_key", "range", "range_size", "start", "source_size", "target", "epochs", "budget"), "starts")
    placed = ranged.join(starts, ["source_key", "range"])
    ends_here = (F.col("start") < F.col("budget")) & (F.col("start") + F.col("range_size") > F.col("budget"))
    clear = placed.where(~ends_here).withColumn("extra", ((F.col("start") < F.col("budget")) & (F.col("size") > 0)).cast("long"))
    # Here the prefix sum decides: a document is taken if more than half of it lies within the budget.
    before = Window.partitionBy("source_key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(ends_here).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    edge = edge.withColumn("extra", ((F.col("at") + F.col("size") / 2 <= F.col("budget")) & (F.col("size") > 0)).cast("long")).drop("at")
    both = clear.unionByName(edge)
    return both.select("source_key", "__uid", "doc_id", "mark", "key", "size", "source_size", "target", "epochs", "extra")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    found = mix_keyed(numbered(docs.select("doc_id", "source", "text")), **options)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"))


def mix_rows(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns of ``docs``."""
    placed = materialize(mix_keyed(numbered(docs.select("doc_id", "source", "text")), seed=seed, **options), "placed")
    place = F.struct("key", "doc_id", "mark")
    ends = placed.groupBy("source_key").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("extra") > 0, place)).alias("last"))
    ends = materialize(ends, "ends")
    # Rows repeated wholly stand at one place: those there, and how many of them are taken.
    there = placed.join(ends.select("source_key", "last"), "source_key").where(place.eqNullSafe(F.col("last")))
    there = there.groupBy("source_key").agg(F.count("*").alias("there"), F.sum("extra").alias("some"))
    ends = materialize(ends.join(there.where("some < there").select("source_key", "some"), "source_key", "left"), "ends")
    discard(placed)
    rows = _keys(docs, [F.struct(*docs.columns).alias("__row")], seed).join(ends, "source_key")
    parted = F.col("some").isNotNull() & place.eqNullSafe(F.col("last"))
    upto = F.coalesce((F.col("size") > 0) & (place <= F.col("last")), F.lit(False))
    taken = rows.where(~parted).select("__row", (F.col("epochs") + upto.cast("long")).alias("__times"))
    if not ends.where("some IS NOT NULL").isEmpty():
        odd = materialize(numbered(rows.where(parted).select("__row", "source_key", "epochs", "some")), "parted")
        nos, _ = number_within(odd.select("source_key", "__uid"), "source_key", [F.col("__uid")], "__no", "__all")
        counted = odd.join(nos.select("__uid", "__no"), "__uid")
        taken = taken.unionByName(counted.select("__row", (F.col("epochs") + (F.col("__no") < F.col("some")).cast("long")).alias("__times")))
    each = taken.where("__times > 0").withColumn("__no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return each.select("__row.*")

"""Helpers that several operators share: durable intermediate tables, global row numbers, document reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glyphgate.functions.shipping import ship
from glyphgate.plans.storage import materialize, new_path, records_per_batch, shared_dir

__all__ = ["WORD", "arrow_map", "discard", "materialize", "new_path", "number_rows", "number_within", "read_table", "records_per_batch", "running_total", "shared_dir"]

#: Words are maximal runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folders = {name.rpartition("/")[0] for name in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` after the package has been sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def number_rows(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Add the gapless global row number ``name`` (from 0, in ``order``) and return it with the row count.

    The rows are range-partitioned and sorted, then written once, so that the numbers cannot change when a task is
    run again. Only one count for each partition meets in one place.
    """
    part, at = f"__{name}_part", f"__{name}_at"
    kept = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    counts = kept.groupBy(part).agg(F.count("*").alias("n")).collect()  # one row for each partition
    starts, total = [], 0
    for row in sorted(counts, key=lambda r: r[part]):
        starts.append((row[part], total))
        total += row["n"]
    if not starts:
        return kept.withColumn(name, F.lit(0).cast("long")).drop(part, at), 0
    offsets = df.sparkSession.createDataFrame(starts, T.StructType([T.StructField(part, T.IntegerType()), T.StructField("__start", T.LongType())]))
    # As many rows as there are partitions.
    joined = kept.join(F.broadcast(offsets), part)
    return joined.withColumn(name, F.col("__start") + F.col(at)).drop(part, at, "__start"), total


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of a bounded group."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def number_within(df: DataFrame, group: str, order: list[Column], name: str, size: str) -> tuple[DataFrame, DataFrame]:
    """Add the gapless number ``name`` (from 0, in ``order``) within ``group`` and the group's row count ``size``.

    Rows are range-partitioned by group and order, so a group of any size is spread over many tasks; only the counts of
    (group, partition) are summed in order. ``group`` is never null. Also returns the written table that the result
    reads, for ``discard``.
    """
    part, at = f"__{name}_part", f"__{name}_at"
    kept = materialize(
        df.repartitionByRange(F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "within",
    )
    # One row for each group and partition: a group has as many as there are partitions at most.
    counts = kept.groupBy(group, part).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    counts = running_total(counts, [group], [part], "__n", "__start").withColumn(size, F.sum("__n").over(Window.partitionBy(group)))
    met = kept.join(counts.select(group, part, (F.col("__start") - F.col("__first")).alias("__by"), size), [group, part])
    return met.withColumn(name, F.col(at) + F.col("__by")).drop(part, at, "__by"), kept

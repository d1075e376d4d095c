"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local one is made only where the session names none and is no cluster (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(docs: DataFrame) -> DataFrame:
    """Documents read from files, dealt evenly where the files hold fewer pieces than there are cores.

    A small table in one row group would be read, and all its texts searched, by one task. Only then is it worth a
    shuffle; a table with twice as many splits as cores is left as it is, without a look at its rows.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or docs.rdd.getNumPartitions() >= 2 * cores:
        return docs
    # Needs no column of the files, only the row counts in their footers.
    filled = docs.select(F.spark_partition_id().alias("part")).distinct().count()
    return docs if filled >= cores else docs.repartition(cores)


@contextmanager
def records_per_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many rows of a Parquet file or to a Python worker at a time, for tables of few and large rows; the session's own values come back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, most)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; this cuts the lineage. ``codec`` is for large tables."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)

"""The scan over a stream of documents: each micro-batch is scanned as a table of its own.

Rules look at one document at a time and the scan groups and joins nothing, so no state is kept between batches. Batches
are written under their number, so one that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from glyphgate.plans.scan import scan


def scan_stream(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the findings of streaming ``docs`` (doc_id, text) to Parquet under ``out``/batch=n."""

    def batch(rows: DataFrame, number: int) -> None:
        scan(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def severity_windows(findings: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by rule in time windows, with a watermark for late rows."""
    return findings.withWatermark(time, late).groupBy(F.window(time, width), "rule").agg(F.count("*").alias("findings"))

"""Corpora of JSON lines as documents: bad lines and overlong texts come apart from the rest, none is lost.

Spark's text source splits files by byte ranges at line ends, so one file of any size is read by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions.text import utf16_length

#: UTF-16 units of the longest text that an interactive view scans.
VIEWED = 100_000


@dataclass
class Corpus:
    """documents (the fields asked for, and file), and rejected (file, reason, line)."""

    documents: DataFrame
    rejected: DataFrame


def read_json_lines(spark: SparkSession, paths: str | list[str], fields: str, text: str = "text", most_units: int | None = None) -> Corpus:
    """Lines of JSON objects as documents with the ``fields`` of a schema string; ``text`` names the one that is scanned.

    Rejected are lines that are no object of these types (``malformed``), whose text is missing or null (``no text``), or
    is longer than ``most_units`` UTF-16 units (``too long``). Blank lines are nothing.
    """
    schema = T.StructType([*T._parse_datatype_string(fields).fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("x", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    body = F.col("x")[text]
    reason = F.when(F.col("x").isNull() | F.col("x.__bad").isNotNull() | ~F.startswith(F.ltrim(F.col("line")), F.lit("{")), "malformed").when(body.isNull(), "no text")
    if most_units is not None:
        reason = reason.when(utf16_length(body) > most_units, "too long")
    judged = parsed.withColumn("reason", reason)
    kept = [F.col("x")[f.name].alias(f.name) for f in schema.fields if f.name != "__bad"]
    return Corpus(judged.where("reason IS NULL").select(*kept, "file"), judged.where("reason IS NOT NULL").select("file", "reason", "line"))

"""Files as documents: listing with exclusions, binary detection, strict decoding; and report and repair sinks.

Everything is a projection of Spark's ``binaryFile`` source, so it reads whatever store Spark reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgate.functions.shipping import ship
from glyphgate.operators.policy import glob_pattern

LARGEST = 5 * 1024 * 1024
SNIFFED = 8_192
IGNORED_FOLDERS = (".git", "node_modules", "dist", "build", "coverage")


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(pattern, excluded) of an ignore file's lines in order; ``!`` takes a path back in."""
    out = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            out.append((glob_pattern(line.removeprefix("!")), not line.startswith("!")))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """True if the last rule that matches a path excludes it."""
    out = F.lit(False)
    for pattern, excluded in rules:
        out = F.when(path.rlike(pattern), F.lit(excluded)).otherwise(out)
    return out


def encoding(content: Column) -> Column:
    start = F.hex(F.substr(content, F.lit(1), F.lit(2)))
    return F.when(start == "FFFE", "utf-16le").when(start == "FEFF", "utf-16be").otherwise("utf-8")


def looks_binary(head: Column) -> Column:
    """Of a file's first characters: a NUL, or over 30 % control characters but tab, line breaks and escape."""
    odd = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"))
    return (F.length(head) > 0) & (head.contains("\0") | (odd > F.length(head) * 0.3))


def _utf16():
    """Strict decoding without the byte-order mark; null where malformed. Spark's own decode would stop the job."""

    def text(raw: bytes, kind: str) -> str | None:
        try:
            return bytes(raw)[2:].decode(kind)
        except UnicodeDecodeError:
            return None

    return F.pandas_udf(lambda contents, kinds: pd.Series([text(c, k) for c, k in zip(contents, kinds)], dtype=object), "string")


def decoded(files: DataFrame) -> DataFrame:
    """Add encoding, text and binary to files with ``content``; text is null where it is malformed. A UTF-8 mark stays.

    Only files with a UTF-16 mark go through a pandas function; they are judged by their characters, others by bytes.
    """
    ship(files.sparkSession)
    marked = files.withColumn("encoding", encoding(F.col("content")))
    narrow = marked.where("encoding = 'utf-8'").withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    narrow = narrow.withColumn("binary", looks_binary(F.decode(F.substr("content", F.lit(1), F.lit(SNIFFED)), "ISO-8859-1")))
    wide = marked.where("encoding <> 'utf-8'").withColumn("text", _utf16()("content", "encoding"))
    wide = wide.withColumn("binary", F.coalesce(looks_binary(F.left("text", F.lit(SNIFFED // 2))), F.lit(False)))
    return narrow.unionByName(wide)


def encoded(text: Column, kind: Column) -> Column:
    """Bytes of a text in the encoding that its file had, byte-order mark included."""
    return F.when(kind == "utf-16le", F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == "utf-16be", F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).otherwise(F.encode(text, "UTF-8"))


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, skipped, errors) under ``root``: (path, doc_id, text, encoding), (path, reason), (path, reason).

    Excluded and oversized files are dropped by path and length, before their bytes are looked at.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + root.rstrip("/").split("://")[-1].lstrip("/").replace(".", r"\.") + "/", "")
    named = files.select(path.alias("path"), "length", "content")
    folders = r"(^|/)(" + "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS) + ")/"
    out = F.when(F.col("path").rlike(folders) | ignored(F.col("path"), ignore_rules(ignore or [])), "ignored").when(F.col("length") > LARGEST, "too large")
    judged = named.withColumn("reason", out)
    kept = decoded(judged.where("reason IS NULL"))
    text = kept.where("NOT binary").select("path", "encoding", "text")
    skipped = judged.where("reason IS NOT NULL").select("path", "reason").unionByName(kept.where("binary").select("path", F.lit("binary").alias("reason")))
    errors = text.where("text IS NULL").select("path", F.concat(F.lit("malformed "), F.col("encoding")).alias("reason"))
    return text.where("text IS NOT NULL").withColumn("doc_id", F.xxhash64("path")), skipped, errors


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines; an existing report is never overwritten."""
    findings.write.mode("errorifexists").json(path)


def write_repaired(docs: DataFrame, path: str) -> None:
    """Repaired texts with their paths and encodings as one table; Spark's commit makes it appear whole or not at all."""
    docs.write.mode("errorifexists").parquet(path)


def exit_status(findings: DataFrame, errors: DataFrame) -> int:
    """2 if an input could not be read, else 1 if there is an error-level finding, else 0."""
    return 2 if not errors.isEmpty() else 1 if not findings.where("severity = 'error'").isEmpty() else 0

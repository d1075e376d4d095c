"""Quality rules and cross-document line frequency, with DataFrame functions only.

Base figures of each text come from one pass, written once as a narrow table (no texts). The method then removes
boilerplate: each line is trimmed, lower-cased, its runs of white space and of digits made one space and one 0, and
hashed. For each host (the ``source`` of a row) it counts the distinct documents that hold a line; copies of one text
count once, so a group of copies cannot turn its own lines into boilerplate. A line is removed where more than
``LINE_SHARE`` of the host's distinct documents, and more than ``LINE_LEAST`` of them, hold it. A document that loses
more than ``LOST_SHARE`` of its words is rejected as depleted.

On hosts of up to 10,000 distinct documents the count decides: any line held by 11 or more goes. On larger ones the
share of 0.001 keeps short lines that independent documents hold by chance. The frequent lines may be many; they meet the
documents in joins on (host, line) and, for the places to cut, on (host, text), never as one list for a host. A line that
every document of a hot host holds is counted by (host, line, text) first and then by (host, line), so no task gets the
line's rows whole.

Defined results. Null text: as an empty text, which fails. Null source: a host of its own. Repeated rows and copies on
one host share a verdict. Lines without a word are never counted nor removed. Empty table: no rows. Other columns are
ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import WORD, materialize

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
LINE_SHARE = 0.001
LINE_LEAST = 10
LOST_SHARE = 0.5


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def normal_line(line: Column) -> Column:
    spaced = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.regexp_replace(spaced, "[0-9]+", "0"))


def worded_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def host_of() -> Column:
    """Never null; a null source is its own host."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words for the array column ``words``: how many stand in a window of WINDOW words found twice or more.

    Where no hash of a window comes twice, no window does, and nothing more is built. Else the windows are compared
    whole: sorted with their positions, equal ones are neighbours; each repeated window covers WINDOW words, less where
    an earlier one reaches into it. The steps are columns of their own, each used more than once by the next, so that
    none is evaluated again inside a lambda.
    """
    at = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.when(F.size("hashes") > WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice("hashes", i + 1, WINDOW))))
    rows = rows.withColumn("windows", F.coalesce(windows, F.array().cast("array<long>")))
    whole = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(whole)).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    equal = lambda x, i: F.coalesce(F.get("sorted", i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["w"] == x["w"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("sorted", equal), lambda x: x["i"]))
    fold = lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.when(s["last"] < 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - s["last"]))).alias("sum"))
    covered = F.aggregate(starts, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum")), fold, lambda s: s["sum"])
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("hashes", "windows", "sorted")


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: base figures, host, text hash, and the hash, words and place of each worded line."""
    text = _text()
    rows = docs.select("doc_id", host_of().alias("host"), text.alias("body"), F.sha2(text, 256).alias("blob"))
    rows = rows.withColumn("words", F.filter(F.split("body", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    rows = rows.withColumn("lines", worded_lines(F.col("body")))
    places = F.transform(F.split("body", "\n", -1), lambda x, i: F.when(x.rlike(WORD), i))
    rows = rows.withColumn("places", F.filter(places, lambda i: i.isNotNull()))
    rows = _with_repeats(rows)
    return rows.select(
        "doc_id",
        "host",
        "blob",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("lines", lambda x, k: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.get("places", k).alias("place"))).alias("lines"),
    )


def frequent_lines(table: DataFrame, share: float = LINE_SHARE, least: int = LINE_LEAST) -> DataFrame:
    """(host, line) held by more than the limit of the host's distinct documents."""
    lines = table.select("host", "blob", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count_distinct("blob").alias("held")).where(F.col("held") > least)
    sizes = table.groupBy("host").agg(F.count_distinct("blob").alias("of"))
    return materialize(counted.join(sizes, "host").where(F.col("held") > F.col("of") * share).select("host", "line"), "frequent")


def lost_words(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, blob, lost, cut): how many words stand in frequent lines and the places of these lines, for texts that have any."""
    once = table.select("host", "blob", F.explode("lines").alias("x"))
    rows = once.select("host", "blob", F.col("x.place").alias("place"), F.col("x.line").alias("line"), F.col("x.n").alias("n"))
    held = rows.join(frequent, ["host", "line"], "left_semi")
    # Copies have the same lines at the same places: each counts once.
    once = held.groupBy("host", "blob", "place").agg(F.max("n").alias("n"))
    return once.groupBy("host", "blob").agg(F.sum("n").alias("lost"), F.collect_list("place").alias("cut"))


def judged(docs: DataFrame) -> DataFrame:
    """The narrow table with base_failed, lost, cut (null where no line goes) and kept."""
    table = materialize(measured(docs), "measured")
    frequent = frequent_lines(table)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    if frequent.isEmpty():
        joined = table.withColumn("lost", F.lit(0).cast("long")).withColumn("cut", F.lit(None).cast("array<int>"))
    else:
        joined = table.join(materialize(lost_words(table, frequent), "lost"), ["host", "blob"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    joined = joined.withColumn("base_failed", failed)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= F.col("n_words") * LOST_SHARE))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of each row."""
    found = judged(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost").alias("n_lost_words"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, without their frequent lines; all columns kept, ``n_chars``, if there, brought up to date."""
    found = judged(docs).where(~F.col("kept") | F.col("cut").isNotNull())
    # Copies on one host share a verdict.
    fate = materialize(found.groupBy(F.col("host").alias("__h"), F.col("blob").alias("__b")).agg(F.min("kept").alias("__kept"), F.first("cut").alias("__cut")), "fate")
    marked = docs.withColumn("__h", host_of()).withColumn("__b", F.sha2(_text(), 256))
    joined = marked.join(fate, ["__h", "__b"], "left").where(F.coalesce("__kept", F.lit(True)))
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__cut", i))
    joined = joined.withColumn("__text", F.when(F.col("__cut").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")))
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*columns)

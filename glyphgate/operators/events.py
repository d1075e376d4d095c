"""From documents to the few characters that rules look at, with their neighbours and positions, as arrays of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import rows
from glyphgate.functions.shipping import ship

# A text is cut after each event; the last piece is empty, and the one before it may have no event at its end. Runs of
# printable ASCII are taken first, which spares nearly all characters the test of the whole class.
_ENDS = P.EVENT_CLASS + r"\z"
_PIECE = r"(?:[\x20-\x7E]++|[^\x20-\x7E" + P.EVENT_CLASS[1:-1] + "])*+(?:" + P.EVENT_CLASS + r"|\z)"


def fast_path(docs: DataFrame) -> DataFrame:
    """Rows that can have a finding: those with a character outside printable ASCII, tab and line breaks."""
    return docs.where(F.col("text").rlike(P.UNPLAIN))


def pieces(text: Column) -> Column:
    """The text cut after each event; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), F.array().cast("array<string>"))


def upto(found: str) -> Column:
    """Where each piece ends, by an Arrow function."""
    return rows.running(F.transform(found, lambda x: F.length(x).cast("long")))


def events(found: str, ends: str) -> Column:
    """The events of pieces as array of (idx, ch, cp, prev_ch, next_ch, prev_cp, next_cp); idx counts code points from 0."""
    col = F.col(found)
    n = F.size(col) - 1
    n = F.when(n < 1, 0).otherwise(n - F.when(F.get(col, n - 1).rlike(_ENDS), 0).otherwise(1))
    each = F.arrays_zip(
        F.slice(col, F.lit(1), n).alias("p"), F.slice(ends, F.lit(1), n).alias("end"),
        F.slice(F.concat(F.array(F.lit(None).cast("string")), col), F.lit(1), n).alias("last"), F.slice(col, F.lit(2), n).alias("next"),
    )
    point = lambda c, name: F.ascii(c).cast("long").alias(name)
    before = lambda x: F.when(F.length(x["p"]) > 1, F.substr(x["p"], F.length(x["p"]) - 1, F.lit(1))).otherwise(F.right(x["last"], F.lit(1)))
    after = lambda x: F.when(x["next"] != "", F.left(x["next"], F.lit(1)))
    own = lambda x: F.right(x["p"], F.lit(1))
    near = F.transform(each, lambda x: F.struct((x["end"] - 1).alias("idx"), own(x).alias("ch"), point(own(x), "cp"), before(x).alias("prev_ch"), after(x).alias("next_ch")))
    return F.transform(near, lambda e: F.struct(*[e[c].alias(c) for c in ("idx", "ch", "cp", "prev_ch", "next_ch")], point(e["prev_ch"], "prev_cp"), point(e["next_ch"], "next_cp")))


def with_events(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__events``; an event is a character that can start or end a finding, break a line or is astral."""
    ship(docs.sparkSession)
    cut = rows.computed(docs, {"__pieces": pieces(F.when(F.col("text").rlike(P.UNPLAIN), F.col("text")))})
    return rows.computed(cut.withColumn("__upto", upto("__pieces")), {"__events": events("__pieces", "__upto")}).drop("__pieces", "__upto")


def place(points: Column) -> Column:
    """(off, line, col) of code point places of the row: UTF-16 units from 0, line and column from 1."""
    return rows.located(points, F.transform("__events", lambda e: e["idx"]), F.transform("__events", lambda e: e["cp"]))


def located(docs: DataFrame) -> DataFrame:
    """Other columns of ``docs``, then idx, ch, cp, off, line and col of each event."""
    placed = with_events(docs).withColumn("__at", place(F.transform("__events", lambda e: e["idx"])))
    each = placed.select(*[c for c in docs.columns if c != "text"], F.explode(F.arrays_zip(F.col("__events").alias("e"), F.col("__at").alias("p"))).alias("x"))
    return each.select(*[c for c in docs.columns if c != "text"], "x.e.idx", "x.e.ch", "x.e.cp", "x.p.off", "x.p.line", "x.p.col")

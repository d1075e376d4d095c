"""Passages in styled alphabets that read as plain text, as arrays of the row.

An island is a run of styled characters with the short gap that leads to another one, if there is one; each is one match
of a pattern that repeats nothing but single characters, so a text of any length is matched without recursion. A passage
is a chain of islands that touch.
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import rows
from glyphgate.operators.rules import span

STYLED_CLASS = "[" + P.char_class(P.STYLED, tuple(P.SMALL_CAPITALS)) + "]"
#: A lookahead before the class spares ASCII characters the test of all its ranges.
ISLAND = r"(?=[^\x00-\x7F])" + STYLED_CLASS + r"++(?:[^\p{L}\p{N}]{1,3}(?=" + STYLED_CLASS + "))?+"
LEAST_LETTERS = 3
#: First of the negative circled and the negative squared capitals, which have no decomposition.
NEGATIVE = (0x1F150, 0x1F170)


def _read_as() -> dict[str, str]:
    """Styled character to the ASCII letters or digits that it stands for."""
    normal = {chr(c): unicodedata.normalize("NFKC", chr(c)) for lo, hi in P.STYLED for c in range(lo, hi + 1)}
    found = {c: plain for c, plain in normal.items() if plain.isascii() and plain.isalnum()}
    found |= {chr(first + i): letter for first in NEGATIVE for i, letter in enumerate(string.ascii_uppercase)}
    return found | {chr(c): plain for c, plain in P.SMALL_CAPITALS.items()}


READ_AS = _read_as()
_class = lambda chars: "[" + P.char_class(P.merged(set(map(ord, chars)))) + "]"
#: Styled characters that stand for something, and those that stand for a letter.
READ_CLASS, LETTER_CLASS = _class(READ_AS), _class(c for c, plain in READ_AS.items() if any(x.isalpha() for x in plain))


def plain(text: Column) -> Column:
    """``text`` with each styled character as what it stands for."""
    single = {c: to for c, to in READ_AS.items() if len(to) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for c, to in READ_AS.items():
        if len(to) > 1:
            text = F.replace(text, F.lit(c), F.lit(to))
    return text


def wanted(far: Column) -> tuple[Column, str, Column]:
    """Arguments of ``rows.matches`` for islands of texts with the far characters ``far``."""
    return F.col("text"), ISLAND, far.rlike(STYLED_CLASS)


def with_passages(df: DataFrame, islands: str, name: str) -> DataFrame:
    """Add ``name``: (start, hit, before, after) of each passage, and leave out ``islands``."""
    col = F.col(islands)
    touches = lambda x: F.coalesce(x["m"]["start"] == x["last"]["start"] + F.length(x["last"]["hit"]), F.lit(False))
    beside = F.arrays_zip(col.alias("m"), rows.beside(col, -1).alias("last"))
    heads = F.filter(F.transform(beside, lambda x, i: F.when(~touches(x), i)), lambda i: i.isNotNull())
    df = rows.computed(df, {"__heads": F.when(F.size(col) > 0, heads).otherwise(F.array().cast("array<int>"))})
    bounds = F.arrays_zip(F.col("__heads").alias("a"), rows.beside(F.col("__heads"), 1).alias("b"))
    chains = F.transform(bounds, lambda h: F.slice(col, h["a"] + 1, F.coalesce(h["b"], F.size(col)) - h["a"]))
    whole = lambda c: F.struct(
        F.get(c, F.lit(0))["start"].alias("start"), F.array_join(F.transform(c, lambda m: m["hit"]), "").alias("hit"), F.get(c, F.lit(0))["before"].alias("before"), F.element_at(c, -1)["after"].alias("after"),
    )
    return rows.computed(df, {name: F.transform(chains, whole)}).drop(islands, "__heads")


def styled_text(passages: Column) -> Column:
    """Spans of the passages; fullwidth ones beside East Asian text are none."""
    east = "[" + P.char_class(P.STYLED_EAST_ASIAN) + "]"
    near = lambda c: F.coalesce(c.rlike(east), F.lit(False))
    only = lambda text, kept: F.regexp_replace(text, "[^" + kept[1:-1] + "]+", "")

    def reported(m: Column) -> Column:
        wide = only(m["hit"], READ_CLASS).rlike("^[" + P.char_class(P.FULLWIDTH) + "]*$")
        return (F.length(only(m["hit"], LETTER_CLASS)) >= LEAST_LETTERS) & ~(wide & (near(m["before"]) | near(m["after"])))

    one = lambda m: span("styled-text", "warning", m["start"], m["start"] + F.length(m["hit"]), rows.code_points(m["hit"]), plain(m["hit"]))
    return F.transform(F.filter(passages, reported), one)

"""Row-local building blocks: where a pattern matches in a text, running sums, and positions, all kept in arrays of the row.

A document is a row and not an id: nothing here groups, joins or shuffles, so null and repeated ids need no care. The
four Arrow functions work on all lists of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONGS = T.ArrayType(T.LongType())
#: More than the characters of any text; keys of (row, place) are row times this plus place.
_ROW = 1 << 34


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch's lists, and where each list begins (one more at the end); a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _lists(values: np.ndarray | pa.Array, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _running(lengths: pa.Array) -> pa.Array:
    values, begin = _flat(lengths)
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return _lists(upto[1:] - np.repeat(upto[begin[:-1]], np.diff(begin)), begin)


def _located(points: pa.Array, idx: pa.Array, cps: pa.Array) -> pa.Array:
    at, begin = _flat(points)
    (place, first), (cp, _) = _flat(idx), _flat(cps)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = row * _ROW + place.astype(np.int64)
    follows = np.zeros(len(key), bool)
    follows[:-1] = (key[1:] == key[:-1] + 1) & (cp[1:] == 0x0A)
    breaks = (cp == 0x0A) | ((cp == 0x0D) & ~follows)
    wide, lines = (np.concatenate(([0], np.cumsum(x))) for x in (cp > 0xFFFF, breaks))
    latest = np.maximum.accumulate(np.concatenate(([-1], np.where(breaks, np.arange(len(cp)), -1))))
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    before = np.searchsorted(key, owner * _ROW + at.astype(np.int64))
    start = first[owner]
    off = at + wide[before] - wide[start]
    last = latest[before]
    none = last < start
    last = np.where(none, 0, last)
    last_off = (place[last] + wide[last] - wide[start]) if len(place) else np.zeros(len(at), np.int64)
    col = np.where(none, off + 1, off - last_off)
    columns = [pa.array(x.astype(np.int64)) for x in (off, 1 + lines[before] - lines[start], col)]
    return _lists(pa.StructArray.from_arrays(columns, ["off", "line", "col"]), begin)


def _touched(starts: pa.Array, ends: pa.Array, span_starts: pa.Array, span_ends: pa.Array) -> pa.Array:
    (a, begin), (b, _), (low, first), (high, _) = map(_flat, (starts, ends, span_starts, span_ends))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    # Of spans that neither overlap nor touch, the last one that begins at or before the end of a run decides.
    key = row * _ROW + (low + (_ROW >> 1)).astype(np.int64)
    last = np.searchsorted(key, owner * _ROW + (b + (_ROW >> 1)).astype(np.int64), "right") - 1
    there = last >= first[owner]
    high = np.append(high, 0)
    return _lists(there & (high[np.where(there, last, -1)] >= a), begin)


def _merged(starts: pa.Array, ends: pa.Array) -> pa.Array:
    (low, begin), (high, _) = _flat(starts), _flat(ends)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((high, low, row))
    low, high = low[order].astype(np.int64), high[order].astype(np.int64)
    reach = np.maximum.accumulate(row * _ROW + high + (_ROW >> 1)) if len(low) else high
    opens = np.ones(len(low), bool)
    opens[1:] = row[1:] * _ROW + low[1:] + (_ROW >> 1) > reach[:-1]
    heads = np.flatnonzero(opens)
    ends_at = reach[np.append(heads[1:], len(low))[: len(heads)] - 1] - row[heads] * _ROW - (_ROW >> 1)
    counts = np.bincount(row[heads], minlength=len(begin) - 1)
    spans = pa.StructArray.from_arrays([pa.array(low[heads]), pa.array(ends_at)], ["start", "end"])
    return _lists(spans, np.concatenate(([0], np.cumsum(counts))))


#: Sums of a list up to and with each element.
running = F.arrow_udf(_running, _LONGS)
_POSITION = T.StructType([T.StructField(n, T.LongType()) for n in ("off", "line", "col")])
#: (off, line, col) of code point places, from a text's events that have all line breaks and astral characters.
located = F.arrow_udf(_located, T.ArrayType(_POSITION))
#: For each run (starts, ends), whether one of the row's merged spans overlaps or touches it.
touched = F.arrow_udf(_touched, T.ArrayType(T.BooleanType()))
#: Maximal unions of spans that overlap or touch.
merged = F.arrow_udf(_merged, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


class Recipe:
    """Steps of columns to add and drop, noted once and then applied to any table.

    It stands in for a DataFrame while functions add their columns. Making the expressions of a scan takes thousands of
    calls to the JVM, and they are the same for every table.
    """

    def __init__(self, session: SparkSession, columns: tuple[str, ...] = ("text",)) -> None:
        self.sparkSession, self.columns, self.steps = session, list(columns), []

    def _noted(self, kind: str, what, columns: list[str]) -> Recipe:
        self.steps.append((kind, what))
        self.columns = columns
        return self

    def computed(self, columns: dict[str, Column]) -> Recipe:
        return self._noted("computed", columns, list(dict.fromkeys([*self.columns, *columns])))

    def withColumns(self, columns: dict[str, Column]) -> Recipe:  # noqa: N802  as a DataFrame has it
        return self._noted("with", columns, list(dict.fromkeys([*self.columns, *columns])))

    def withColumn(self, name: str, column: Column) -> Recipe:  # noqa: N802
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Recipe:
        return self._noted("drop", names, [c for c in self.columns if c not in names])

    def applied(self, df: DataFrame) -> DataFrame:
        for kind, what in self.steps:
            df = computed(df, what) if kind == "computed" else df.withColumns(what) if kind == "with" else df.drop(*what)
        return df


def computed(df: DataFrame | Recipe, columns: dict[str, Column]) -> DataFrame | Recipe:
    """``df`` with ``columns``, each computed once for a row, however often it is used.

    Below an Arrow function the optimizer puts a column's expression wherever the column stands, even within lambdas,
    where it is evaluated for each element. It does not look through a generator. (The outer form, as for an inner one
    it would test the array in a filter.)
    """
    if isinstance(df, Recipe):
        return df.computed(columns)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(c) for c in kept], F.inline_outer(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def matches(df: DataFrame, wanted: dict[str, tuple[Column, str, Column | None]], also: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each name: (text, pattern, condition), the array of (start, hit, before, after) of a pattern's matches.

    ``start`` counts code points from 0; ``before`` and ``after`` are the characters beside a match. A text is cut at its
    matches, so only they and the ends of the gaps between them are made. Where the condition is not true, or the text
    is null, the array is empty. ``also`` are Arrow functions to call in the same step; they may use ``__name_hits``.
    """
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<long>")
    columns = {}
    for name, (text, pattern, condition) in wanted.items():
        holds = F.lit(True) if condition is None else condition
        columns[f"__{name}_gaps"] = F.coalesce(F.when(holds, F.split(text, pattern, -1)), none)
        columns[f"__{name}_hits"] = F.coalesce(F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), none)
    df, sums = computed(df, columns), {}
    for name in wanted:
        both = F.arrays_zip(F.col(f"__{name}_gaps").alias("gap"), F.col(f"__{name}_hits").alias("hit"))
        long = F.when(F.size(f"__{name}_hits") > 0, F.transform(both, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long")))
        sums[f"__{name}_upto"] = running(F.coalesce(long, nothing))
    df, placed = df.withColumns(sums | (also or {})), {}
    for name in wanted:
        gaps, hits, upto = (F.col(f"__{name}_{x}") for x in ("gaps", "hits", "upto"))
        n = F.size(hits)
        each = F.arrays_zip(
            hits.alias("hit"), F.slice(upto, F.lit(1), n).alias("upto"), F.slice(gaps, F.lit(1), n).alias("gap"), F.slice(gaps, F.lit(2), n).alias("next_gap"),
            F.slice(F.concat(F.array(F.lit(None).cast("string")), hits), F.lit(1), n).alias("last"), F.slice(hits, F.lit(2), n).alias("next"),
        )
        one = lambda x: F.struct(
            (x["upto"] - F.length(x["hit"])).alias("start"), x["hit"].alias("hit"),
            F.when(x["gap"] != "", F.right(x["gap"], F.lit(1))).otherwise(F.right(x["last"], F.lit(1))).alias("before"),
            F.when(x["next_gap"] != "", F.left(x["next_gap"], F.lit(1))).otherwise(F.left(x["next"], F.lit(1))).alias("after"),
        )
        placed[name] = F.transform(each, one)
    return computed(df, placed).drop(*columns, *sums)


def beside(array: Column, by: int) -> Column:
    """``array`` moved by one place: the element before (-1) or after (1) each, null at the end."""
    none = F.transform(F.slice(array, 1, 1), lambda x: F.when(F.lit(False), x))
    return F.slice(F.concat(none, array), F.lit(1), F.size(array)) if by < 0 else F.concat(F.slice(array, F.lit(2), F.size(array)), none)


def code_points(text: Column) -> Column:
    """The code points of a short text."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

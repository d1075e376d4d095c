"""Findings, detection rules over single characters, and the balance of bidirectional controls.

A rule makes an array of spans of its row: (rule, severity, start_idx, end_idx, code_points, decoded, skeleton,
removal_start, removal_end); idx counts code points, ends are exclusive, removal is what a repair deletes. Positions are
added to all spans of a row at once, in ``placed``, which makes them findings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions import properties as P

SPANS = (
    "array<struct<rule:string,severity:string,start_idx:bigint,end_idx:bigint,code_points:array<bigint>,decoded:string,skeleton:string,"
    "removal_start:bigint,removal_end:bigint>>"
)
#: The columns of a finding; seq is its place in its document's order.
FINDING = (
    "seq", "rule", "severity", "start_idx", "end_idx", "start_off", "end_off", "start_line", "start_col", "end_line", "end_col", "code_points", "decoded", "skeleton",
    "removal_start", "removal_end", "fixable",
)


def span(rule: Column | str, severity: Column | str, start: Column, end: Column, points: Column, decoded: Column | None = None, skeleton: Column | None = None, removal: Column | None = None) -> Column:
    """One span; its removal begins with it unless ``removal`` is given."""
    named = lambda x, name: (F.lit(x) if isinstance(x, str) else x).cast("string").alias(name)
    return F.struct(
        named(rule, "rule"), named(severity, "severity"), start.cast("long").alias("start_idx"), end.cast("long").alias("end_idx"), points.cast("array<long>").alias("code_points"),
        named(F.lit(None) if decoded is None else decoded, "decoded"), named(F.lit(None) if skeleton is None else skeleton, "skeleton"),
        (start if removal is None else removal).cast("long").alias("removal_start"), end.cast("long").alias("removal_end"),
    )


def single_characters(found: str = "__events") -> Column:
    """bidi-control, bidi-mark, invisible, unusual-whitespace and control-character spans of the row's events."""
    rule = P.of_event(P.single_rule(P.SPARK), "e")
    ruled = F.expr(f"filter(transform({found}, e -> named_struct('idx', e.idx, 'cp', e.cp, 'rule', {rule})), e -> e.rule IS NOT NULL)")
    graded = lambda e: F.when((e["rule"] == "bidi-control") | (e["cp"] == P.ESCAPE), "error").otherwise("warning")
    return F.transform(ruled, lambda e: span(e["rule"], graded(e), e["idx"], e["idx"] + 1, F.array(e["cp"])))


def _lowest(heights: np.ndarray, group: np.ndarray, later: bool = False) -> np.ndarray:
    """For each place the lowest height before it in its group, 0 included, or (``later``) the lowest one after it."""
    if not len(heights):
        return heights
    apart = 2 * int(np.abs(heights).max()) + 2  # groups so far apart that none reaches into the next
    if later:
        shifted = (heights + group * apart)[::-1]
        after = np.minimum.accumulate(shifted)[::-1] - group * apart
        out = np.append(after[1:], 0)
        ends = np.append(group[1:] != group[:-1], True)
        out[ends] = np.iinfo(np.int64).max
        return out
    shifted = heights - group * apart
    before = np.minimum.accumulate(shifted) + group * apart
    out = np.concatenate(([0], before[:-1]))
    out[np.append(True, group[1:] != group[:-1])] = 0
    return np.minimum(out, 0)


def _unmatched(opens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of openers and closers in groups that stand together: which have no partner, and how many are open after each.

    A closer without a partner brings the count of openers less closers to a new low of its group. An opener has none
    where the count never falls below its own again.
    """
    steps = np.where(opens, 1, -1)
    total = np.cumsum(steps)
    first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    heights = total - np.repeat((total - steps)[first], np.diff(np.append(np.flatnonzero(first), len(group))))
    low = _lowest(heights, group)
    return np.where(opens, _lowest(heights, group, True) >= heights, heights < low), heights - np.minimum(heights, low)


def unbalanced(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows' explicit controls and line breaks are controls that open or close nothing on their line.

    Isolates are paired within lines first. Each embedding then belongs to the isolate that is open around it, and
    embeddings are paired within these; the end of an isolate also ends the embeddings that it holds.
    """
    loose = np.zeros(len(cps), bool)
    breaks = (cps == 0x0A) | (cps == 0x0D)
    line = np.cumsum(breaks | np.append(True, rows[1:] != rows[:-1])) if len(cps) else np.zeros(0, np.int64)
    begins = (cps >= P.ISOLATES[0][0]) & (cps <= P.ISOLATES[0][1])
    isolates = np.flatnonzero(begins | (cps == P.POP_ISOLATE))
    alone, depth = _unmatched(begins[isolates], line[isolates])
    loose[isolates] = alone
    # The isolate around a place is the latest one that began at the depth which the line has there.
    at = np.zeros(len(cps), np.int64)
    at[isolates] = depth
    places = np.arange(len(cps))
    latest = np.maximum.accumulate(np.where(begins | (cps == P.POP_ISOLATE), places, -1))
    same = (latest >= 0) & (line[latest] == line)
    here = np.where(same, at[latest], 0)
    order = np.lexsort((places, here, line))
    around = np.full(len(cps), -1)
    around[order] = order[np.maximum.accumulate(np.where(begins[order], places, 0))] if len(cps) else order
    around[here == 0] = -1
    inside = np.flatnonzero(~breaks & ~begins & (cps != P.POP_ISOLATE))
    inside = inside[np.lexsort((inside, around[inside], line[inside]))]
    new = np.append(True, (line[inside][1:] != line[inside][:-1]) | (around[inside][1:] != around[inside][:-1]))[: len(inside)]
    starts = cps[inside] != P.POP_EMBEDDING
    alone, _ = _unmatched(starts, np.cumsum(new))
    ended = (around[inside] >= 0) & ~loose[around[inside]]
    loose[inside] = alone & ~(starts & ended)
    return loose


def _loose(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    cps = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = unbalanced(cps, np.repeat(np.arange(len(sizes)), sizes))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(found))


loose_controls = F.arrow_udf(_loose, T.ArrayType(T.BooleanType()))


def bidi_controls(found: str = "__events") -> Column:
    """The row's explicit controls with the line breaks between them; empty without a control."""
    explicit = lambda e: e["cp"].between(*P.EXPLICIT_BIDI[0]) | e["cp"].between(*P.EXPLICIT_BIDI[1])
    some = F.filter(found, lambda e: explicit(e) | e["cp"].isin(0x0A, 0x0D))
    return F.when(F.exists(found, explicit), some).otherwise(F.slice(found, 1, 0))


def bidi_unbalanced(controls: Column, loose: Column) -> Column:
    """Spans of the controls that ``loose_controls`` marks."""
    marked = F.filter(F.arrays_zip(controls.alias("e"), loose.alias("loose")), lambda x: x["loose"])
    return F.transform(marked, lambda x: span("bidi-unbalanced", "error", x["e"]["idx"], x["e"]["idx"] + 1, F.array(x["e"]["cp"])))

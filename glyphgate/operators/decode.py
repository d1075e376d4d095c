"""Hidden payloads: runs of tag characters and of variation selectors, and what they spell, as arrays of the row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions import properties as P
from glyphgate.functions import rows
from glyphgate.functions import text as X
from glyphgate.functions.shipping import ship
from glyphgate.functions.unicode_data import variation_sequences
from glyphgate.operators import events
from glyphgate.operators.rules import span

STREAM_BYTES, STREAM_BITS = 8, 64
TAG_PATTERN = "[" + P.char_class(P.TAGS) + "]+"
SELECTOR_PATTERN = "[" + P.char_class(P.SELECTORS) + "]+"
_FLAG = chr(P.FLAG_BASE)
_REGISTERED = tuple("".join(chr(0xE0000 + ord(c)) for c in name) + chr(P.CANCEL_TAG) for name in P.FLAG_SEQUENCES)


#: All characters of a text that tags, selectors and styled passages are made of lie beyond this range.
_NEAR = r"[\x00-\x{24F}]++"


def far_characters(text: Column) -> Column:
    """The characters beyond U+024F; nearly always few, and tests of them spare tests of the text."""
    return F.regexp_replace(text, _NEAR, "")


def wanted(kind: str, far: Column) -> tuple[Column, str, Column]:
    """Arguments of ``rows.matches`` for the runs of a kind, ``tags`` or ``selectors``, of texts with the far characters ``far``."""
    pattern = {"tags": TAG_PATTERN, "selectors": SELECTOR_PATTERN}[kind]
    return F.col("text"), pattern, far.rlike(pattern)


def tag_runs(found: Column) -> Column:
    """Matches of tags as array of (start, end, has_base, valid, tags, decoded); a registered flag's tags are a run of their own.

    ``start`` is the first tag; ``tags`` are the code points, ``decoded`` the ASCII that they spell.
    """

    def run(start: Column, tags: Column, has_base: Column, valid: bool) -> Column:
        points = rows.code_points(tags)
        seen = F.filter(points, lambda c: c.between(0xE0020, 0xE007E))
        decoded = F.array_join(F.transform(seen, lambda c: X.from_code_point(c - 0xE0000)), "")
        return F.struct(start.alias("start"), (start + F.length(tags)).alias("end"), has_base.alias("has_base"), F.lit(valid).alias("valid"), points.alias("tags"), decoded.alias("decoded"))

    def parts(x: Column) -> Column:
        flag = F.coalesce(x["before"] == _FLAG, F.lit(False))
        known = F.lit(0)
        for tags in _REGISTERED:
            known = F.when(flag & F.startswith(x["hit"], F.lit(tags)), len(tags)).otherwise(known)
        whole = F.array(run(x["start"], x["hit"], flag, False))
        first = F.array(run(x["start"], F.substr(x["hit"], F.lit(1), known), F.lit(True), True))
        rest = F.array(run(x["start"] + known, F.substr(x["hit"], known + 1), F.lit(False), False))
        return F.when(known == 0, whole).when(known == F.length(x["hit"]), first).otherwise(F.concat(first, rest))

    return F.flatten(F.transform(found, parts))


def tag_smuggling(runs: Column) -> Column:
    """A span for each run that is no registered flag; the flag base belongs to the span but is not removed."""

    def one(r: Column) -> Column:
        base = F.when(r["has_base"], F.array(F.lit(P.FLAG_BASE).cast("long"))).otherwise(F.array().cast("array<long>"))
        decoded = F.when(r["decoded"] != "", r["decoded"])
        return span("tag-smuggling", "error", r["start"] - F.size(base), r["end"], F.concat(base, r["tags"]), decoded, removal=r["start"])

    return F.transform(F.filter(runs, lambda r: ~r["valid"]), one)


def selector_runs(found: Column, folder: str | None = None) -> Column:
    """Matches of selectors as array of (start, n, cps, base_cp, hex, decoded, recognized_first, ordinary, carrier).

    ``hex`` are the bytes that the selectors stand for, ``decoded`` their text where it is strict UTF-8 and not all C0; a
    carrier is a single selector after a base that it does not belong to.
    """
    bases: dict[int, set[int]] = {}
    for base, first in variation_sequences(folder):
        bases.setdefault(first, set()).add(base)
    registered = "^(?:" + "|".join(rf"[{P.char_class(P.merged(found))}]\x{{{first:X}}}" for first, found in sorted(bases.items())) + ")$"
    byte = lambda c: F.when(c < 0xE0100, c - 0xFE00).otherwise(c - 0xE0100 + 16)

    def read(x: Column) -> Column:
        cps, first = rows.code_points(x["hit"]), F.left(x["hit"], F.lit(1))
        emoji = x["before"].rlike(f"^[{P.char_class(P.EMOJI)}]$") & first.isin("\ufe0e", "\ufe0f")
        recognized = F.coalesce(F.concat(x["before"], first).rlike(registered) | emoji, F.lit(False))
        spelled = F.array_join(F.transform(cps, lambda c: F.lpad(F.hex(byte(c)), 2, "0")), "")
        return F.struct(
            x["start"].alias("start"), F.length(x["hit"]).cast("long").alias("n"), cps.alias("cps"), F.ascii(x["before"]).cast("long").alias("base_cp"), spelled.alias("hex"),
            recognized.alias("recognized_first"),
        )

    def judge(r: Column) -> Column:
        ordinary = (r["n"] == 1) & r["recognized_first"]
        kept = [r[c].alias(c) for c in ("start", "n", "cps", "base_cp", "hex")]
        decoded = X.printable(X.strict_utf8(r["hex"]))
        return F.struct(*kept, decoded.alias("decoded"), r["recognized_first"].alias("recognized_first"), ordinary.alias("ordinary"), ((r["n"] == 1) & ~ordinary & r["base_cp"].isNotNull()).alias("carrier"))

    return F.transform(F.transform(found, read), judge)


def _bits(members: Column, one: str) -> Column:
    """Text of bits, eight to a byte; bits left over are dropped."""
    whole = F.array_join(F.transform(members, lambda x: F.when(x["hex"] == one, "1").otherwise("0")), "")
    chunks = F.regexp_extract_all(whole, F.lit("[01]{8}"), F.lit(0))
    return X.clean(X.strict_utf8(F.array_join(F.transform(chunks, lambda c: F.lpad(F.conv(c, 2, 16), 2, "0")), "")))


def with_streams(df: DataFrame, runs: str) -> DataFrame:
    """Add to each run byte_text and byte_start, and bit_text and bit_start, of the stream that it carries a part of.

    A byte stream is made of neighbouring carriers: a carrier is its base and its selector, so the next one's selector
    stands two further. A bit stream is made of all carriers of the two emoji selectors in the whole text.
    """
    col = F.col(runs)
    last = rows.beside(col, -1)
    follows = lambda x: F.coalesce(x["r"]["carrier"] & x["last"]["carrier"] & (x["r"]["start"] == x["last"]["start"] + 2), F.lit(False))
    heads = F.filter(F.transform(F.arrays_zip(col.alias("r"), last.alias("last")), lambda x, i: F.when(~follows(x), i)), lambda i: i.isNotNull())
    is_bit = lambda r: r["carrier"] & r["hex"].isin("0E", "0F")
    df = rows.computed(df, {"__heads": heads, "__bits": F.filter(col, is_bit)})
    heads, bits = F.col("__heads"), F.col("__bits")
    groups = F.transform(F.arrays_zip(heads.alias("a"), rows.beside(heads, 1).alias("b")), lambda h: F.slice(col, h["a"] + 1, F.coalesce(h["b"], F.size(col)) - h["a"]))
    bit_text = F.when(F.size(bits) >= STREAM_BITS, F.coalesce(_bits(bits, "0F"), _bits(bits, "0E")))
    df = rows.computed(df, {"__groups": groups, "__bit_text": bit_text})
    told = lambda g: F.when(F.size(g) >= STREAM_BYTES, X.clean(X.strict_utf8(F.array_join(F.transform(g, lambda r: r["hex"]), ""))))
    texts = F.transform("__groups", lambda g: F.struct(g.alias("g"), told(g).alias("text"), F.get(g, F.lit(0))["start"].alias("start")))
    fields = ("start", "n", "cps", "base_cp", "hex", "decoded", "recognized_first", "ordinary", "carrier")
    bit = lambda r, value: F.when(is_bit(r) & F.col("__bit_text").isNotNull(), value)
    member = lambda r, x: F.struct(
        *[r[c].alias(c) for c in fields], x["text"].alias("byte_text"), F.when(x["text"].isNotNull(), x["start"]).alias("byte_start"),
        bit(r, F.col("__bit_text")).alias("bit_text"), bit(r, F.get("__bits", F.lit(0))["start"]).alias("bit_start"),
    )
    return rows.computed(df, {runs: F.flatten(F.transform(texts, lambda x: F.transform(x["g"], lambda r: member(r, x))))}).drop("__heads", "__bits", "__groups", "__bit_text")


def selector_findings(runs: Column) -> Column:
    """variation-selector-smuggling and -stray spans of runs with their streams."""

    def one(r: Column) -> Column:
        streamed = r["byte_text"].isNotNull() | r["bit_text"].isNotNull()
        hidden = streamed | ((r["n"] > 1) & r["decoded"].isNotNull())
        # The first selector of a longer run that spells nothing is legitimate after its registered base.
        keeps = ((r["n"] > 1) & r["decoded"].isNull() & r["recognized_first"]).cast("int")
        first = F.when(r["byte_text"].isNotNull(), r["byte_start"]).otherwise(r["bit_start"])
        told = F.when(streamed, F.when(r["start"] == first, F.coalesce(r["byte_text"], r["bit_text"]))).otherwise(r["decoded"])
        base = F.when(r["base_cp"].isNotNull(), F.array(r["base_cp"])).otherwise(F.array().cast("array<long>"))
        points = F.concat(base, F.slice(r["cps"], keeps + 1, F.size(r["cps"])))
        rule = F.when(hidden, "variation-selector-smuggling").otherwise("variation-selector-stray")
        return span(rule, F.when(hidden, "error").otherwise("warning"), r["start"] - F.size(base), r["start"] + r["n"], points, told, removal=r["start"] + keeps)

    return F.transform(F.filter(runs, lambda r: ~r["ordinary"]), one)


def unwrap(text: str | None, layers: int = 8) -> str | None:
    """A payload whose text itself holds selector runs, decoded again, up to ``layers`` deep."""
    for _ in range(layers):
        if not text or not any(0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF for c in text):
            break
        out, run, changed = [], bytearray(), False
        for c in [*text, ""]:
            cp = ord(c) if c else 0
            if 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                run.append(cp - 0xFE00 if cp < 0xE0100 else cp - 0xE0100 + 16)
                out.append(c)
                continue
            if len(run) > 1:
                try:
                    spelled = run.decode()
                except UnicodeDecodeError:
                    spelled = ""
                if spelled and any(ord(x) >= 0x20 for x in spelled):
                    del out[-len(run) :]
                    out.append(spelled)
                    changed = True
            run.clear()
            out.append(c)
        text = "".join(out)
        if not changed:
            break
    return text


def _unwrapped(texts: pa.Array) -> pa.Array:
    return pa.array([x and list(map(unwrap, x)) for x in texts.to_pylist()], pa.list_(pa.string()))


unwrapped = F.arrow_udf(_unwrapped, T.ArrayType(T.StringType()))


def nested(spans: str) -> Column:
    """The decoded payloads of the row's spans, unwrapped by an Arrow function; null where none holds another."""
    holds = F.exists(spans, lambda s: F.coalesce(s["decoded"].rlike(SELECTOR_PATTERN), F.lit(False)))
    return unwrapped(F.when(holds, F.transform(spans, lambda s: s["decoded"])))


def told(spans: Column, inner: Column) -> Column:
    """Spans with the payloads of ``nested`` where there are any."""
    fields = ("rule", "severity", "start_idx", "end_idx", "code_points", "decoded", "skeleton", "removal_start", "removal_end")
    swap = F.transform(F.arrays_zip(spans.alias("s"), inner.alias("inner")), lambda x: F.struct(*[(x["inner"] if c == "decoded" else x["s"][c]).alias(c) for c in fields]))
    return F.when(inner.isNotNull(), swap).otherwise(spans)


def with_runs(docs: DataFrame, folder: str | None = None, more: dict | None = None, also: dict | None = None) -> DataFrame:
    """``docs`` with ``__events``, ``__tags`` (tag runs), ``__selectors`` (selector runs with their streams) and matches of ``more``.

    ``also`` are Arrow functions to call in the same step.
    """
    ship(docs.sparkSession)
    text = F.when(F.col("text").rlike(P.UNPLAIN), F.col("text"))
    df = rows.computed(docs, {"__pieces": events.pieces(text), "__far": far_characters(text)})
    found = {"__tags": wanted("tags", F.col("__far")), "__selectors": wanted("selectors", F.col("__far"))} | (more or {})
    df = rows.matches(df, found, {"__upto": events.upto("__pieces")} | (also or {}))
    made = {"__events": events.events("__pieces", "__upto"), "__tags": tag_runs(F.col("__tags")), "__selectors": selector_runs(F.col("__selectors"), folder)}
    return with_streams(rows.computed(df, made), "__selectors").drop("__pieces", "__upto", "__far")

"""Repairs: cutting or replacing flagged spans until nothing flagged is left, and showing what is hidden.

Each works on the row that has the text, so rows with null or repeated ids are repaired like any others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions import properties as P
from glyphgate.functions import rows
from glyphgate.functions import text as X
from glyphgate.functions.shipping import ship
from glyphgate.functions.unicode_data import shared_tables, variation_sequences
from glyphgate.operators.fixpoint import SPECIAL_CLASS, Repairer

MODES = ("remove", "normalize", "keep")


def merged_spans(pad: int = 0, findings: str = "findings") -> Column:
    """(start, end) of maximal unions of a row's findings that overlap or touch, each widened by ``pad`` first."""
    return rows.merged(F.transform(findings, lambda f: f["start_idx"] - pad), F.transform(findings, lambda f: f["end_idx"] + pad))


def splice(text: str, spans: list[dict], kept: str = "") -> str:
    """``text`` with each (start, end, new) replaced; of what spans cut, the characters of ``kept`` stay. Spans may overlap."""
    out, at = [], 0
    for start, end, new in sorted((s["start"], s["end"], s["new"]) for s in spans):
        out.append(text[at:start] if start > at else "")
        out.append(new if new or not kept else "".join(c for c in text[max(at, start) : end] if c in kept))
        at = max(at, end)
    return "".join([*out, text[at:]])


def _spliced(texts: pa.Array, spans: pa.Array, kept: pa.Array) -> pa.Array:
    return pa.array([splice(t, s, k) if s else t for t, s, k in zip(texts.to_pylist(), spans.to_pylist(), kept.to_pylist())], pa.string())


#: ``splice`` as an Arrow function of (text, spans, kept).
spliced = F.arrow_udf(_spliced, T.StringType())


def _removable(f: Column, allowed: tuple[int, ...]) -> Column:
    """True for a fixable finding that would remove a character which is not allowed."""
    n = (f["removal_end"] - f["removal_start"]).cast("int")
    cut = F.slice(f["code_points"], F.size(f["code_points"]) - n + 1, n)
    return f["fixable"] & (F.exists(cut, lambda c: ~c.isin(*allowed)) if allowed else F.lit(True))


def one_pass(found: DataFrame, mode: str = "remove", disabled: tuple[str, ...] = (), allowed: tuple[int, ...] = ()) -> DataFrame:
    """Documents with ``findings``, their texts repaired once; ``__fixed`` counts the findings repaired.

    Characters of ``allowed`` stay, also inside other spans. Mode normalize makes an unusual space a space, or a line
    break where it breaks lines; mode keep repairs nothing.
    """
    ship(found.sparkSession)
    wanted = F.filter("findings", lambda f: _removable(f, allowed) & ~f["rule"].isin(*disabled) if disabled else _removable(f, allowed)) if mode != "keep" else F.slice("findings", 1, 0)
    todo = rows.computed(found, {"__todo": wanted})

    def cut(f: Column) -> Column:
        space = F.when(F.get(f["code_points"], F.lit(0)).isin(*P.LINE_MAKERS), "\n").otherwise(" ")
        new = F.when(f["rule"] == "unusual-whitespace", space).otherwise("") if mode == "normalize" else F.lit("")
        return F.struct(f["removal_start"].alias("start"), f["removal_end"].alias("end"), new.alias("new"))

    some = F.size("__todo") > 0
    done = spliced(F.col("text"), F.when(some, F.transform("__todo", cut)), F.lit("".join(map(chr, allowed))))
    out = todo.withColumns({"__text": done, "__fixed": F.size("__todo").cast("long")})
    columns = [F.col("__text").alias("text") if c == "text" else F.col(c) for c in found.columns if c != "findings"]
    return out.select(*columns, "__fixed")


def repairer(mode: str = "remove", disabled: tuple[str, ...] = (), allowed: tuple[int, ...] = (), folder: str | None = None):
    """(text, fixed, passes) of a text repaired to the end, as an Arrow function; null stays null.

    Without ``folder`` a single ideographic variation selector after an ideograph stays, as no registry can tell whether
    it belongs there.
    """
    options = (variation_sequences(folder), mode == "normalize", tuple(disabled), tuple(allowed), folder is None)
    known = shared_tables(folder)

    def repaired(texts: pa.Array) -> pa.Array:
        own = Repairer(known.value, *options)
        return pa.array([t and dict(zip(("text", "fixed", "passes"), own.repair(t))) for t in texts.to_pylist()], _REPAIRED)

    return F.arrow_udf(repaired, T.StructType([T.StructField("text", T.StringType()), T.StructField("fixed", T.LongType()), T.StructField("passes", T.IntegerType())]))


_REPAIRED = pa.struct([("text", pa.string()), ("fixed", pa.int64()), ("passes", pa.int32())])


def sanitize(docs: DataFrame, mode: str = "remove", disabled: tuple[str, ...] = (), allowed: tuple[int, ...] = (), folder: str | None = None) -> DataFrame:
    """``docs`` repaired to the fixpoint, with ``fixed`` (findings repaired over all passes) and ``passes``.

    One pass over the table: a text goes through all of its passes in one call, of which each looks only at what stood
    beside the cuts of the one before. Texts without a character that a repair may touch never leave the engine. Every row
    comes back once, in its other columns as it was; columns fixed and passes of ``docs`` are replaced.
    """
    if mode not in MODES:
        raise ValueError(mode)
    columns = [c for c in docs.columns if c not in ("fixed", "passes")]
    if mode == "keep":
        return docs.select(*columns, F.lit(0).cast("long").alias("fixed"), F.lit(0).alias("passes"))
    ship(docs.sparkSession)
    odd = F.when(F.col("text").rlike(SPECIAL_CLASS), F.col("text"))
    done = docs.withColumn("__repaired", repairer(mode, disabled, allowed, folder)(odd))
    kept = [F.coalesce("__repaired.text", "text").alias("text") if c == "text" else F.col(c) for c in columns]
    return done.select(*kept, F.coalesce("__repaired.fixed", F.lit(0)).cast("long").alias("fixed"), F.coalesce("__repaired.passes", F.lit(0)).cast("int").alias("passes"))


def revealed(text: Column, findings: str = "findings") -> Column:
    """The text with each hidden span as a label in white brackets, followed by what it decodes to; a span inside another is not shown."""
    hidden = F.filter(findings, lambda f: ~f["rule"].isin(*P.NOT_FIXABLE))
    longest = F.array_sort(F.transform(hidden, lambda f: F.struct(f["start_idx"].alias("start"), (-f["end_idx"]).alias("less"), f["seq"].alias("seq"), f.alias("f"))))
    short = F.create_map(*[F.lit(x) for item in sorted(P.ABBREVIATIONS.items()) for x in item])
    say = lambda c: F.concat(X.u_label(c), F.lit(" "), F.coalesce(F.element_at(short, c.cast("int")), X.unicode_name(c)))

    def chip(f: Column) -> Column:
        points = f["code_points"]
        many = F.concat(say(F.get(points, F.lit(0))), F.lit(" .. "), say(F.element_at(points, -1)), F.lit(" ("), F.size(points).cast("string"), F.lit(" code points)"))
        label = F.when(F.size(points) > 4, many).otherwise(F.array_join(F.transform(points, say), " "))
        quoted = X.diagnostic_text(F.regexp_extract(F.to_json(F.struct(f["decoded"].alias("d"))), r'^\{"d":(.*)\}$', 1))
        told = F.when(F.coalesce(f["decoded"], F.lit("")) != "", F.concat(F.lit(" → "), quoted)).otherwise("")
        return F.struct(f["start_idx"].alias("start"), f["end_idx"].alias("end"), F.concat(F.lit("⟦"), label, F.lit("⟧"), told).alias("new"))

    return shown(text, F.when(F.size(hidden) > 0, F.transform(longest, lambda x: chip(x["f"]))))


def _shown(texts: pa.Array, spans: pa.Array) -> pa.Array:
    def one(text: str, chips: list[dict] | None) -> str:
        apart, at = [], 0
        for c in chips or ():
            if c["start"] >= at:
                apart.append(c)
                at = c["end"]
        return splice(text, apart)

    return pa.array([t if t is None else one(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())


#: A text with its spans, in order, replaced; one that begins within an earlier one is left out.
shown = F.arrow_udf(_shown, T.StringType())


def reveal(found: DataFrame) -> DataFrame:
    """Other columns of documents with ``findings``, and ``revealed``."""
    ship(found.sparkSession)
    return found.withColumn("revealed", revealed(F.col("text"))).drop("text", "findings")


def _changed(before: pa.Array, after: pa.Array) -> pa.Array:
    """(line, old, new) of changed lines: what lies between the common first and last lines of two lists is one change."""
    out = []
    for a, b in zip(before.to_pylist(), after.to_pylist()):
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        most = min(len(a), len(b)) - head
        tail = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
        out.append([{"line": head + 1, "old": "\n".join(a[head : len(a) - tail]), "new": "\n".join(b[head : len(b) - tail])}])
    return pa.array(out, pa.list_(pa.struct([("line", pa.int64()), ("old", pa.string()), ("new", pa.string())])))


_CHANGES = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))
changed_block = F.arrow_udf(_changed, _CHANGES)


def fix_preview(pairs: DataFrame) -> DataFrame:
    """Other columns of ``pairs`` (before, after), and line, old and new of the lines that a repair changes.

    A repair adds a line only where it makes a line break of a line maker, so the line makers of a line tell how many
    lines it became. Where these do not add up, what lies between the common first and last lines is one change.
    """
    ship(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in ("before", "after")]
    lines = lambda c: F.split(c, r"\r\n|\r|\n", -1)
    makers = "[" + P.char_class((), P.LINE_MAKERS) + "]"
    both = rows.computed(pairs.where("before <> after"), {"__a": lines("before"), "__b": lines("after")})
    added = F.size("__b") - F.size("__a")
    more = F.when(added == 0, F.transform("__a", lambda x: F.lit(0).cast("long"))).otherwise(F.transform("__a", lambda x: F.regexp_count(x, F.lit(makers)).cast("long")))
    both = rows.computed(both, {"__more": more}).withColumn("__upto", rows.running(F.transform("__more", lambda n: n + 1)))
    told = F.col("__upto")[F.size("__upto") - 1] == F.size("__b")
    one = lambda z, i: F.struct(
        (i + 1).cast("long").alias("line"), z["a"].alias("old"), F.array_join(F.slice("__b", (z["upto"] - z["more"]).cast("int"), (z["more"] + 1).cast("int")), "\n").alias("new"),
    )
    paired = F.filter(F.transform(F.arrays_zip(F.col("__a").alias("a"), F.col("__more").alias("more"), F.col("__upto").alias("upto")), one), lambda x: x["old"] != x["new"])
    none = F.array().cast("array<string>")
    both = both.withColumn("__block", changed_block(F.when(told, none).otherwise(F.col("__a")), F.when(told, none).otherwise(F.col("__b"))))
    return both.select(*kept, F.explode(F.when(told, paired).otherwise(F.col("__block"))).alias("x")).select(*kept, "x.line", "x.old", "x.new")

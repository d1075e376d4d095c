"""Lookalike words: tokens, skeletons, mixed-script words and collisions within a document, as arrays of the row.

What a token beyond ASCII looks like and which scripts it is read in comes from one Arrow function, which looks its
characters up in broadcast tables and keeps the tokens of a worker. ASCII tokens are looked at only where a token beyond
ASCII has an ASCII skeleton. Collisions are groups in a sorted array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgate.functions import rows
from glyphgate.functions import text as X
from glyphgate.functions.unicode_data import shared_tables
from glyphgate.operators.rules import span
from glyphgate.operators.styled import READ_CLASS

TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}][\p{L}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]*"
CODE_TOKEN = r"[\p{L}\p{Nl}$_][\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}$\x{200C}\x{200D}]*"
BEYOND_ASCII = r"[^\x00-\x7F]"
#: ASCII characters that no token of text mode holds.
_APART = r"[\x00-/:-@\[-\^`{-\x7F]+"
#: Distinct words of one script that make a document one that is written in it.
WRITTEN_IN = 10


_SETS = T.ArrayType(T.ArrayType(T.StringType()))
_FORMS = pa.struct([("skeleton", pa.string()), ("nfd", pa.string()), ("sets", pa.list_(pa.list_(pa.string()))), ("mixed", pa.bool_()), ("turkic", pa.bool_())])
_FORM = T.StructType([*[T.StructField(n, T.StringType()) for n in ("skeleton", "nfd")], T.StructField("sets", _SETS), *[T.StructField(n, T.BooleanType()) for n in ("mixed", "turkic")]])


def spell(folder: str | None = None):
    """The forms (``Tables.forms``) of each token of a list, as an Arrow function; the tables are broadcast, under a megabyte."""
    known = shared_tables(folder)

    def spelled(lists: pa.Array) -> pa.Array:
        # Each distinct token of a batch is looked up and made once.
        words, form = lists.flatten().dictionary_encode(), known.value.form
        told = list(zip(*map(form, words.dictionary.to_pylist()))) or [()] * len(_FORMS)
        forms = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(told, _FORMS)], fields=list(_FORMS))
        begin = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), forms.take(words.indices))

    return F.arrow_udf(spelled, T.ArrayType(_FORM))


def _indexes(tokens: pa.Array, flagged: pa.Array) -> pa.Array:
    out = []
    for some, names in zip(tokens.to_pylist(), flagged.to_pylist()):
        at = {name: i for i, name in enumerate(names or ())}
        out.append([at.get(t) for t in some or ()])
    return pa.array(out, pa.list_(pa.int32()))


#: For each token of a list, its index among other tokens.
indexes = F.arrow_udf(_indexes, T.ArrayType(T.IntegerType()))


def signature(sets: Column) -> Column:
    """The one script that all script sets share, else all scripts joined; Latin for none."""
    shared = F.aggregate(sets, F.flatten(sets), lambda all_, s: F.array_intersect(all_, s))
    joined = F.array_join(F.array_sort(F.array_distinct(F.flatten(sets))), "+")
    return F.when(F.size(sets) == 0, "Latin").when(F.size(shared) == 1, F.get(shared, F.lit(0))).otherwise(joined)


def ascii_skeleton(token: Column) -> Column:
    for source, target in (("I", "l"), ("1", "l"), ("0", "O"), ("m", "rn")):
        token = F.replace(token, F.lit(source), F.lit(target))
    return token


def readable() -> Column:
    """The text, in which the letter of an escape such as backslash-n is no part of the word that follows it."""
    return F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", r"\\[ntrfvb](?=[^\x00-\x7F])", "  ")).otherwise(F.col("text"))


def _extracted(pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(readable(), F.lit(pattern), F.lit(0)))


def beyond_tokens(code: Column) -> Column:
    """The row's distinct tokens that hold a character beyond ASCII; in text mode one of a single UTF-16 unit is none."""
    # Words without a character beyond ASCII go before the pattern of tokens is tried.
    foreign = F.array_join(F.filter(F.split(readable(), _APART), lambda w: w.rlike(BEYOND_ASCII)), " ")
    found = F.array_distinct(F.regexp_extract_all(foreign, F.lit(TOKEN), F.lit(0)))
    prose = F.filter(found, lambda t: t.rlike(BEYOND_ASCII) & (X.utf16_length(t) > 1))
    names = F.filter(_extracted(CODE_TOKEN), lambda t: t.rlike(BEYOND_ASCII))
    return F.when(F.col("text").rlike(BEYOND_ASCII), F.when(code, names).otherwise(prose)).otherwise(F.array().cast("array<string>"))


def ascii_tokens(code: Column) -> Column:
    plain = lambda found: F.filter(found, lambda t: ~t.rlike(BEYOND_ASCII))
    return F.when(code, plain(_extracted(CODE_TOKEN))).otherwise(F.filter(plain(_extracted(TOKEN)), lambda t: F.length(t) > 1))


def with_words(df: DataFrame) -> DataFrame:
    """Add ``__words``: (skeleton, token, nfd, sets, mixed, turkic) of each token of the array ``__tokens``, from its ``__forms``."""
    both = F.arrays_zip(F.col("__tokens").alias("token"), F.col("__forms").alias("f"))
    form = lambda x, *names: [x["f"][n].alias(n) for n in names]
    return rows.computed(df, {"__words": F.transform(both, lambda x: F.struct(*form(x, "skeleton"), x["token"].alias("token"), *form(x, "nfd", "sets", "mixed", "turkic")))}).drop("__forms")


def with_collisions(df: DataFrame, code: Column) -> DataFrame:
    """Add ``__clashes``: (skeleton, token) of the tokens that another spelling in the row collides with; needs ``__words``, ``text``."""
    styled = "^[\\x00-\\x7F" + READ_CLASS[1:] + "*$"
    df = rows.computed(df, {"__other": F.filter("__words", lambda w: code | ~w["token"].rlike(styled))})
    known = F.transform(ascii_tokens(code), lambda t: F.struct(ascii_skeleton(t).alias("skeleton"), t.alias("token"), t.alias("nfd"), F.array().cast("array<array<string>>").alias("sets"), F.lit(False).alias("mixed"), F.lit(False).alias("turkic")))
    meets_ascii = F.exists("__other", lambda w: ~w["skeleton"].rlike(BEYOND_ASCII))
    df = rows.computed(df, {"__sorted": F.array_sort(F.when(meets_ascii, F.concat("__other", known)).otherwise(F.col("__other")))})
    # Nearly all skeletons have one token: only those beside an equal one go on.
    near = F.arrays_zip(F.col("__sorted").alias("w"), rows.beside(F.col("__sorted"), -1).alias("a"), rows.beside(F.col("__sorted"), 1).alias("b"))
    same = lambda x, side: F.coalesce(x["w"]["skeleton"] == x[side]["skeleton"], F.lit(False))
    df = rows.computed(df, {"__shared": F.transform(F.filter(near, lambda x: same(x, "a") | same(x, "b")), lambda x: x["w"])}).drop("__sorted")
    shared = F.col("__shared")
    beside = F.arrays_zip(shared.alias("w"), rows.beside(shared, -1).alias("a"))
    df = rows.computed(df, {"__heads": F.filter(F.transform(beside, lambda x, i: F.when(~same(x, "a"), i)), lambda i: i.isNotNull())})
    bounds = F.arrays_zip(F.col("__heads").alias("a"), rows.beside(F.col("__heads"), 1).alias("b"))
    signed = lambda w: F.struct(*[w[c].alias(c) for c in ("skeleton", "token", "nfd")], (~w["token"].rlike(BEYOND_ASCII)).alias("ascii"), signature(w["sets"]).alias("signature"), w["turkic"].alias("turkic"))
    groups = F.transform(bounds, lambda h: F.transform(F.slice(shared, h["a"] + 1, F.coalesce(h["b"], F.size(shared)) - h["a"]), signed))
    foreign = F.filter(F.transform("__other", lambda w: signature(w["sets"])), lambda s: (s != "Latin") & ~F.contains(s, F.lit("+")))
    some = F.size(shared) > 0
    turkish = F.when(some, F.size(F.filter("__other", lambda w: w["turkic"])) >= WRITTEN_IN)
    df = rows.computed(df, {"__groups": F.filter(groups, lambda g: F.exists(g, lambda w: ~w["ascii"])), "__foreign": F.when(some, foreign), "__turkish": turkish})
    written = F.filter(F.array_distinct("__foreign"), lambda s: F.size(F.filter("__foreign", lambda x: x == s)) >= WRITTEN_IN)
    df = rows.computed(df, {"__written": F.coalesce(written, F.array().cast("array<string>"))})

    def clashes(g: Column) -> Column:
        first = F.get(g, F.lit(0))
        formed = F.exists(g, lambda w: w["nfd"] != first["nfd"])
        one = F.forall(g, lambda w: w["signature"] == first["signature"]) & (first["signature"] != "Latin") & ~F.contains(first["signature"], F.lit("+"))
        ordinary = F.forall(g, lambda w: w["ascii"] | F.array_contains("__written", w["signature"]) | (w["turkic"] & F.coalesce("__turkish", F.lit(False))))
        return code | (formed & ~one & ~ordinary)

    hits = F.flatten(F.transform(F.filter("__groups", clashes), lambda g: F.transform(g, lambda w: F.struct(w["skeleton"].alias("skeleton"), w["token"].alias("token")))))
    return rows.computed(df, {"__clashes": hits}).drop("__other", "__shared", "__heads", "__groups", "__foreign", "__turkish", "__written")


def with_flagged(df: DataFrame, code: Column) -> DataFrame:
    """Add ``__flagged``: (token, skeleton, severity) of the row's mixed and colliding tokens; needs ``__words`` and ``text``."""
    df = with_collisions(df, code)
    mixed = F.filter("__words", lambda w: w["mixed"])
    warned = F.transform(mixed, lambda w: F.struct(w["token"].alias("token"), F.lit(None).cast("string").alias("skeleton"), F.lit("warning").alias("severity")))
    clash = F.transform("__clashes", lambda c: F.struct(c["token"].alias("token"), c["skeleton"].alias("skeleton"), F.lit("error").alias("severity")))
    return rows.computed(df, {"__flagged": F.concat(warned, clash)}).drop("__clashes")


def with_occurrences(df: DataFrame, code: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """Add ``__confusables``: spans of every place of a flagged token; ``also`` are Arrow functions to call in the same step."""
    graded = ("warning", "error")
    of = lambda grade: F.filter("__flagged", lambda x: x["severity"] == grade)
    df = rows.computed(df, {f"__{s}": of(s) for s in graded})
    some = F.size("__flagged") > 0
    # One of the two patterns matches, as a row is prose or code.
    hits = F.concat("____prose_hits", "____names_hits")
    at = {f"__{s}_at": indexes(F.when(F.size(f"__{s}") > 0, hits), F.transform(f"__{s}", lambda x: x["token"])) for s in graded}
    df = rows.matches(df, {"__prose": (readable(), TOKEN, some & ~code), "__names": (readable(), CODE_TOKEN, some & code)}, at | (also or {}))
    df = rows.computed(df, {"__places": F.concat("__prose", "__names")})

    def spans(grade: str) -> Column:
        one = lambda x: span("confusable", grade, x["m"]["start"], x["m"]["start"] + F.length(x["m"]["hit"]), rows.code_points(x["m"]["hit"]), skeleton=F.get(f"__{grade}", x["i"])["skeleton"])
        return F.transform(F.filter(F.arrays_zip(F.col("__places").alias("m"), F.col(f"__{grade}_at").alias("i")), lambda x: x["i"].isNotNull()), one)

    df = rows.computed(df, {"__confusables": F.concat(*map(spans, graded))})
    return df.drop("__places", "__prose", "__names", "__flagged", *[c for s in graded for c in (f"__{s}", f"__{s}_at")])

"""The whole scan: documents to findings, by all rules, in one pass over each text and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import rows
from glyphgate.operators import confusables, decode, events, policy, rules, styled
from glyphgate.operators.rules import FINDING


def placed(df: DataFrame, spans: str) -> DataFrame:
    """``df`` with ``findings``: the array ``spans`` with positions and nested payloads, in the order of (start, rule, place in ``spans``)."""
    points = F.concat(F.transform(spans, lambda s: s["start_idx"]), F.transform(spans, lambda s: s["end_idx"]))
    df = df.withColumns({"__at": events.place(points), "__inner": decode.nested(spans)})
    n = F.size(spans)
    both = F.arrays_zip(decode.told(F.col(spans), F.col("__inner")).alias("s"), F.slice("__at", F.lit(1), n).alias("a"), F.slice("__at", n + 1, n).alias("b"))
    first = F.array_sort(F.transform(both, lambda x, i: F.struct(x["a"]["off"].alias("off"), x["s"]["rule"].alias("rule"), i.alias("i"), x["s"].alias("s"), x["a"].alias("a"), x["b"].alias("b"))))
    one = lambda x, i: F.struct(
        i.cast("long").alias("seq"), *[x["s"][c].alias(c) for c in ("rule", "severity", "start_idx", "end_idx")], x["a"]["off"].alias("start_off"), x["b"]["off"].alias("end_off"),
        x["a"]["line"].alias("start_line"), x["a"]["col"].alias("start_col"), x["b"]["line"].alias("end_line"), x["b"]["col"].alias("end_col"),
        *[x["s"][c].alias(c) for c in ("code_points", "decoded", "skeleton", "removal_start", "removal_end")], (~x["s"]["rule"].isin(*P.NOT_FIXABLE)).alias("fixable"),
    )
    # Made behind a generator: else a filter by them, as that of an explode, would call the Arrow functions again.
    return rows.computed(df, {"findings": F.transform(first, one)}).drop("__at", "__inner")


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` (doc_id unless given) and one row for each of ``findings``."""
    each = df.select(*(keep or ("doc_id",)), F.explode("findings").alias("__f"))
    return each.select(*(keep or ("doc_id",)), *[F.col("__f")[c].alias(c) for c in FINDING])


def scanned(docs: DataFrame, code: bool | Column = False, folder: str | None = None, visible: bool = True, places: bool = True) -> DataFrame:
    """``docs`` with ``findings``, the array of a row's findings in the order of (start, rule, sequence).

    Every row stays as it is, whatever its id: the array is made from the row's text alone. A null or plain text has none.
    ``code`` says for all rows, or as a column for each, whether tokens are identifiers. ``folder`` holds Unicode data
    files. ``visible`` false leaves out lookalikes and styled text, which no repair changes. ``places`` false is for counts:
    the findings are the rules' spans, without lines and columns, in no order, and payloads within payloads stay wrapped.
    """
    key = (docs.sparkSession.sparkContext.applicationId, code, folder, visible, places) if isinstance(code, bool) else None
    recipe = _recipes.get(key) or _scan_recipe(docs.sparkSession, code, folder, visible, places)
    if key:
        _recipes[key] = recipe
    return recipe.applied(docs).select(*[F.col(c) for c in docs.columns], "findings")


#: Recipes by application and options.
_recipes: dict[tuple | None, rows.Recipe] = {}


def _scan_recipe(spark: SparkSession, code: bool | Column, folder: str | None, visible: bool, places: bool) -> rows.Recipe:
    # Arrow functions are called in as few steps as can be: each step is a Python worker more for a task.
    code = F.lit(code) if isinstance(code, bool) else F.coalesce(code, F.lit(False))
    df, more, first = rows.Recipe(spark), {}, {}
    if visible:
        more["__islands"] = styled.wanted(F.col("__far"))
        df = rows.computed(df, {"__code": code, "__tokens": confusables.beyond_tokens(code)})
        first["__forms"] = confusables.spell(folder)("__tokens")
    df = rows.computed(decode.with_runs(df, folder, more, first), {"__controls": rules.bidi_controls()})
    loose = {"__loose": rules.loose_controls(F.transform("__controls", lambda e: e["cp"]))}
    parts = [rules.single_characters(), rules.bidi_unbalanced(F.col("__controls"), F.col("__loose")), decode.tag_smuggling(F.col("__tags")), decode.selector_findings(F.col("__selectors"))]
    if visible:
        df = confusables.with_flagged(confusables.with_words(df), F.col("__code"))
        df = styled.with_passages(confusables.with_occurrences(df, F.col("__code"), loose), "__islands", "__passages")
        parts += [F.col("__confusables"), styled.styled_text(F.col("__passages"))]
    else:
        df = df.withColumns(loose)
    return placed(rows.computed(df, {"__spans": F.concat(*parts)}), "__spans") if places else rows.computed(df, {"findings": F.concat(*parts)})


def scan(docs: DataFrame, code: bool | Column = False, folder: str | None = None, visible: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and one row for each finding. Rows of plain text are dropped first."""
    return exploded(scanned(events.fast_path(docs), code, folder, visible), *keep)


def scan_by_policy(docs: DataFrame, blocks: list[policy.Block], path: str = "path", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The findings of documents with a ``path``, under a policy: its blocks say which texts are code before they are scanned, then grade and allow."""
    found = scan(docs, code=policy.code_by_path(blocks, path), keep=tuple(dict.fromkeys((*keep, path))), **options)
    return policy.by_path(found, blocks, path)

"""Corpus analytics over findings: counts, shares, classifications, audits, coverage and differences.

``findings`` are exploded findings; ``rows`` are documents with the array ``findings`` (``plans.scan.scanned``). What counts
documents, or needs all findings of one, counts rows and reads one row: rows with the same id, or none, stay apart, and
only counts are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphgate.functions import properties as P
from glyphgate.functions import text as X
from glyphgate.functions.rows import computed, matches, touched
from glyphgate.functions.shipping import ship
from glyphgate.operators.repair import merged_spans
from glyphgate.plans.storage import materialize, records_per_batch

#: Texts of an Arrow batch where whole texts go to Python and come back.
FEW_TEXTS = 200
# Probe classes that are independent of the rules, as code point ranges.
PROBES: dict[str, P.Ranges] = {
    "math-alphanumeric": ((0x1D400, 0x1D7FF),),
    "fullwidth-latin-digit": ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "circled-squared-letters": ((0x24B6, 0x24E9), (0x1F130, 0x1F189)),
    "regional-indicator": ((0x1F1E6, 0x1F1FF),),
    "small-caps-modifier-letters": ((0x1D00, 0x1DBF), (0x2B0, 0x2B8), (0x2071, 0x2071), (0x207F, 0x207F), (0x2090, 0x209C)),
    "letterlike-roman-numeral": ((0x2100, 0x214F), (0x2160, 0x217F)),
    "ipa-extensions": ((0x250, 0x2AF),),
    "tag-latin-lookalikes-cherokee-canadian": ((0x13A0, 0x13FF), (0x1400, 0x167F)),
    "zero-width-and-joiners": ((0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF)),
    "soft-hyphen-cgj": ((0xAD, 0xAD), (0x34F, 0x34F)),
    "hangul-filler-braille-blank": ((0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0x2800, 0x2800)),
    "mongolian-fvs-khmer-inherent": ((0x180B, 0x180E), (0x17B4, 0x17B5)),
    "bidi-controls-marks": ((0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069), (0x61C, 0x61C)),
    "private-use": ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)),
    "interlinear-object-replacement": ((0xFFF9, 0xFFFC),),
    "tag-characters": ((0xE0000, 0xE007F),),
    "variation-selectors": ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF)),
    "unusual-spaces": ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)),
    "noncharacter": ((0xFDD0, 0xFDEF), (0xFFFE, 0xFFFF)),
}
# Characters of the probes by pattern.
_LETTERS = r"[\x{370}-\x{3FF}\x{400}-\x{4FF}\x{530}-\x{58F}]"
_ZERO = r"[\x{AD}\x{34F}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{180B}-\x{180E}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{115F}\x{1160}]"
PROBE_PATTERNS = {name: f"[{P.char_class(r)}]+" for name, r in PROBES.items()} | {
    "styled-word-4plus": r"[\x{1D400}-\x{1D6A3}\x{1D6A8}-\x{1D7CB}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{24B6}-\x{24E9}\x{1F130}-\x{1F189}\x{1D00}-\x{1D2B}\x{2B0}-\x{2B8}]{4,}",
    "combining-mark-stack": r"\p{L}[\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]{3,}",
    "mixed-script-word": f"[A-Za-z]+{_LETTERS}+[A-Za-z]*|{_LETTERS}+[A-Za-z]+",
    "invisible-inside-ascii-word": f"[A-Za-z]{_ZERO}+[A-Za-z]",
}
# A character without which a pattern matches nothing, where that is not the class of the probe.
_NEEDED = {"styled-word-4plus": PROBE_PATTERNS["styled-word-4plus"].removesuffix("{4,}"), "combining-mark-stack": PROBE_PATTERNS["combining-mark-stack"].removeprefix(r"\p{L}").removesuffix("{3,}"), "mixed-script-word": _LETTERS, "invisible-inside-ascii-word": _ZERO}
#: All characters that a probe needs lie beyond these ranges.
_UNPROBED = r"[\x00-\x{9F}\x{A1}-\x{AC}\x{AE}-\x{24F}]++"


def _of(severity: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == severity))


def severity_counts(rows: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum(_of(s).cast("long")), F.lit(0)).alias(s)
    whole = F.coalesce(F.sum(F.size("findings").cast("long")), F.lit(0)).alias("total")
    return rows.agg(count("error"), count("warning"), count("info"), whole, F.count_if(F.size("findings") > 0).alias("files"))


def counted_kinds(kind) -> Column:
    """(kind, n) of each distinct ``kind`` of the row's findings."""
    return F.transform(F.array_distinct(F.transform("findings", kind)), lambda k: F.struct(k.alias("kind"), F.size(F.filter("findings", lambda f: kind(f).eqNullSafe(k))).cast("long").alias("n")))


def rule_severity(rows: DataFrame) -> DataFrame:
    """Findings and documents by rule and severity."""
    each = rows.select(F.explode(counted_kinds(lambda f: F.struct(f["rule"].alias("rule"), f["severity"].alias("severity")))).alias("x"))
    return each.groupBy("x.kind.rule", "x.kind.severity").agg(F.sum("x.n").alias("findings"), F.count("*").alias("documents"))


def summary_groups(rows: DataFrame) -> DataFrame:
    """Per document, severity, rule and (for rules about one character) character: count, first and last place, decoded.

    ``no`` orders a document's groups: errors, warnings, notes; the most frequent first, then by first place.
    """
    point = lambda f: F.when(f["rule"].isin(*P.BY_CHARACTER), F.get(f["code_points"], F.lit(0)))
    kind = lambda f: F.struct(f["severity"].alias("severity"), f["rule"].alias("rule"), point(f).alias("cp"))
    rank = lambda k: F.when(k["severity"] == "error", 0).when(k["severity"] == "warning", 1).otherwise(2)

    def group(k: Column) -> Column:
        own = F.filter("findings", lambda f: kind(f).eqNullSafe(k))
        first, last = F.get(own, F.lit(0)), F.element_at(own, -1)
        told = F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda f: F.substr(f["decoded"], F.lit(1), F.lit(120))), lambda d: d.isNotNull())))
        return F.struct(
            rank(k).alias("rank"), (-F.size(own)).alias("less"), first["start_off"].alias("first_off"), k.alias("k"), F.size(own).cast("long").alias("n"), last["start_off"].alias("last_off"),
            first["start_line"].alias("first_line"), last["start_line"].alias("last_line"), F.array_join(F.slice(told, 1, 3), "|").alias("decoded"),
        )

    groups = F.array_sort(F.transform(F.array_distinct(F.transform("findings", kind)), group))
    each = rows.where(F.size("findings") > 0).select("doc_id", F.posexplode(groups).alias("no", "g"))
    return each.select("doc_id", "no", "g.k.severity", "g.k.rule", "g.k.cp", *[f"g.{c}" for c in ("n", "first_off", "last_off", "first_line", "last_line", "decoded")])


def top_share(rows: DataFrame, top: int = 10) -> DataFrame:
    """Share of the ``top`` documents in all findings, and the most in one document; only how many findings a row has is read."""
    per_row = materialize(rows.select("doc_id", F.size("findings").cast("long").alias("n")).where("n > 0"), "counts")  # read twice, scanned once
    first = per_row.orderBy(F.desc("n"), "doc_id").limit(top).agg(F.sum("n").alias("top"))
    whole = per_row.agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    return whole.crossJoin(F.broadcast(first)).select(F.round(F.col("top") / F.col("total"), 4).alias("share"), "largest", "total")  # one row each


def strata(rows: DataFrame, by: str) -> DataFrame:
    """Per stratum of documents with ``findings``: documents, flagged ones, and ones with an error."""
    error = F.exists("findings", lambda f: f["severity"] == "error")
    return rows.groupBy(by).agg(F.count("*").alias("docs"), F.count_if(F.size("findings") > 0).alias("flagged"), F.count_if(error).alias("error_docs"))


def split_rates(rows: DataFrame, condition: str) -> DataFrame:
    """Documents and flagged ones on either side of a condition."""
    return rows.groupBy(F.expr(condition).alias("side")).agg(F.count("*").alias("docs"), F.count_if(F.size("findings") > 0).alias("flagged"))


#: The first rule that holds labels a finding: (label, condition).
LABELS = (
    ("H", "rule IN ('tag-smuggling', 'variation-selector-smuggling') AND decoded IS NOT NULL"),
    ("O", "rule IN ('bidi-control', 'bidi-unbalanced')"),
    ("D", "rule = 'styled-text'"),
    ("A", "rule = 'control-character' AND severity = 'error'"),
    ("X", "rule IN ('control-character', 'variation-selector-stray', 'tag-smuggling', 'variation-selector-smuggling')"),
    ("T", "rule = 'unusual-whitespace'"),
    ("U", "rule = 'invisible'"),
    ("L", "rule IN ('bidi-mark', 'confusable')"),
)


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with the label of each finding, in the array ``labels``."""
    cases = " ".join(f"WHEN {re.sub(r'\b(rule|severity|decoded)\b', r'f.\1', condition)} THEN '{name}'" for name, condition in LABELS)
    return rows.withColumn("labels", F.expr(f"transform(findings, f -> CASE {cases} ELSE raise_error(concat('no label for ', f.rule)) END)"))


def classified(rows: DataFrame) -> DataFrame:
    """Findings by label and rule."""
    both = F.arrays_zip(F.col("labels").alias("label"), F.col("findings").alias("f"))
    return labelled(rows).select(F.explode(both).alias("x")).groupBy("x.label", "x.f.rule").agg(F.count("*").alias("n"))


def label_shares(rows: DataFrame) -> DataFrame:
    """Per label: findings, their share, and the share without the document that has most findings."""
    counted = labelled(rows).where(F.size("findings") > 0).select("doc_id", F.size("labels").alias("all"), F.transform(F.array_distinct("labels"), lambda x: F.struct(x.alias("label"), F.size(F.filter("labels", lambda y: y == x)).cast("long").alias("n"))).alias("kinds"))
    counted = materialize(counted, "labels")
    each = counted.select(F.inline("kinds")).groupBy("label").agg(F.sum("n").alias("findings"))
    big = counted.orderBy(F.desc("all"), "doc_id").limit(1).select(F.inline("kinds")).withColumnRenamed("n", "big")  # one document's few labels
    rolled = each.join(F.broadcast(big), "label", "left").select("label", "findings", (F.col("findings") - F.coalesce("big", F.lit(0))).alias("others"))
    everything = Window.partitionBy(F.lit(1))  # one row for each label
    return rolled.select("label", "findings", F.round(F.col("findings") / F.sum("findings").over(everything), 4).alias("share"), F.round(F.col("others") / F.sum("others").over(everything), 4).alias("share_others"))


def harmless_errors(rows: DataFrame) -> DataFrame:
    """Documents with an error, and those of them none of whose errors is labelled hidden or disguised."""
    errors = F.filter(F.arrays_zip(F.col("labels").alias("label"), F.col("findings").alias("f")), lambda x: x["f"]["severity"] == "error")
    bad = F.exists(errors, lambda x: x["label"].isin("H", "O"))
    return labelled(rows).agg(F.count_if(F.size(errors) > 0).alias("error_docs"), F.count_if((F.size(errors) > 0) & ~bad).alias("harmless"))


def audit_sample(findings: DataFrame, size: int = 100, seed: int = 1) -> DataFrame:
    """The same ``size`` findings on every run: those with the smallest hashes."""
    return findings.orderBy(F.sha2(F.concat_ws("|", "doc_id", "rule", "start_off", F.lit(seed)), 256), "doc_id", "start_off", "rule").limit(size)


def probed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``probes``: (probe, start, end) of every run of a probe class, in code points.

    The characters that probes may need are taken out of a text once; a pattern is tried on the text only where one that it
    cannot do without is among them.
    """
    ship(rows.sparkSession)
    kept, names = rows.columns, list(PROBE_PATTERNS)
    some = computed(rows, {"__odd": F.regexp_replace("text", _UNPROBED, "")})
    needed = {n: _NEEDED.get(n) or f"[{P.char_class(PROBES[n])}]" for n in names}
    cut = matches(some, {f"__p{i}": (F.col("text"), PROBE_PATTERNS[n], F.col("__odd").rlike(needed[n])) for i, n in enumerate(names)})
    parts = [F.transform(f"__p{i}", _probe(name)) for i, name in enumerate(names)]
    return computed(cut, {"probes": F.concat(*parts)}).select(*kept, "probes")


def _probe(name: str):
    def one(x: Column) -> Column:
        label = F.when((x["start"] == 0) & (x["hit"] == chr(P.BOM)), "bom-at-start").otherwise(name) if name == "zero-width-and-joiners" else F.lit(name)
        return F.struct(label.alias("probe"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"))

    return one


def probe_classes(rows: DataFrame) -> DataFrame:
    """Per probe of ``probed`` rows: runs, characters and documents."""
    runs = rows.select("doc_id", F.explode("probes").alias("p")).select("doc_id", "p.*")
    return runs.groupBy("probe").agg(F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.count_distinct("doc_id").alias("docs"))


def coverage(rows: DataFrame, pad: int = 2) -> DataFrame:
    """Per probe of ``probed`` rows with ``findings``: runs, those that a finding's span widened by ``pad`` touches, and documents with one that none does.

    Spans are merged first, so a run meets one of them at most and the search stays near linear within a document. Of a
    finding only start_idx and end_idx are read.
    """
    spans = rows.withColumn("__spans", merged_spans(pad))
    field = lambda column, name: F.transform(column, lambda x: x[name])
    hit = spans.withColumn("__hit", touched(field("probes", "start"), field("probes", "end"), field("__spans", "start"), field("__spans", "end")))
    each = hit.select("doc_id", F.explode(F.arrays_zip(F.col("probes").alias("p"), F.col("__hit").alias("covered"))).alias("x")).select("doc_id", "x.p.probe", "x.covered")
    return each.groupBy("probe").agg(F.count("*").alias("runs"), F.count_if("covered").alias("covered_runs"), F.count_distinct(F.when(~F.col("covered"), F.col("doc_id"))).alias("docs_uncovered"))


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings in only one of two scans, by document, place and rule."""
    key = ["doc_id", "start_off", "rule"]
    joined = old.select(*key, F.lit(1).alias("o")).distinct().join(new.select(*key, F.lit(1).alias("n")).distinct(), key, "full_outer")
    return joined.where("o IS NULL OR n IS NULL").select(*key, F.when(F.col("o").isNull(), "only_new").otherwise("only_old").alias("side"))


def source_stats(rows: DataFrame, by: str = "source") -> DataFrame:
    size = F.size("findings")
    return rows.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count_if(size > 0).alias("flagged"), F.sum(size).alias("findings"))


#: Hexadecimal digits of the prefixes, from the longest; a digest has 4,096 parts below it at most.
LEVELS = (6, 3)


def manifest_digest(docs: DataFrame, by: str = "source", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Per source: documents, and a SHA-256 over the sorted SHA-256 of its distinct texts, each with how often it stands.

    Copies are counted before anything is listed. Hashes are digested by prefix, level by level, so that no list grows
    with a source: the first has a 16,777,216th of a source, each other 4,096 digests at most.
    """
    rows = docs.select(by, F.sha2("text", 256).alias("p")).groupBy(by, "p").agg(F.count("*").alias("n"))
    rows = rows.withColumn("d", F.concat_ws(" ", "p", F.col("n").cast("string")))
    for digits in (*levels, 0):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "\n")
        rows = rows.groupBy(by, F.left("p", F.lit(digits)).alias("p")).agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("d"))
    return rows.select(by, F.col("n").alias("documents"), F.col("d").alias("digest"))


def context(rows: DataFrame, around: int = 40) -> DataFrame:
    """(doc_id, start_off, rule, context): the text around each finding, the finding in double brackets, hidden characters escaped."""
    some = rows.select("doc_id", "text", F.explode("findings").alias("f")).select("doc_id", "text", "f.rule", "f.start_idx", "f.end_idx", "f.start_off")
    part = lambda a, n: X.diagnostic_text(F.substr("text", (a + 1).cast("int"), n.cast("int")))
    low = F.greatest(F.lit(0), F.col("start_idx") - around)
    whole = F.concat(part(low, F.col("start_idx") - low), F.lit("[["), part(F.col("start_idx"), F.col("end_idx") - F.col("start_idx")), F.lit("]]"), part(F.col("end_idx"), F.lit(around)))
    return some.select("doc_id", "start_off", "rule", whole.alias("context"))


def inspection(rows: DataFrame, first: int = 300) -> DataFrame:
    """Per document: code points, findings in all, and places of the first ones."""
    places = F.array_join(F.transform(F.slice("findings", 1, first), lambda f: f["start_off"].cast("string")), ",")
    return rows.select("doc_id", F.length("text").cast("long").alias("code_points"), F.size("findings").cast("long").alias("findings"), places.alias("places"))


def inspection_bundle(rows: DataFrame, first: int = 300, preview: int = 10_000, left: int = 20) -> DataFrame:
    """Per document, what a reader needs to judge it: counts by severity, the first findings, the repaired text, and a preview that cuts no finding.

    ``rows`` are documents with ``findings``; the result has their other columns. ``remaining`` are the first findings
    that a repair leaves: those that no repair changes. The result is written once, as only then the batches are small in
    which texts go to Python: a step's worker holds a few of a task's texts and not all.
    """
    from glyphgate.operators.repair import revealed, sanitize

    of = lambda severity: F.size(F.filter("findings", lambda f: f["severity"] == severity)).cast("long").alias(f"n_{severity}")
    counts = [of(s) for s in ("error", "warning", "info")]
    beyond = F.get("findings", F.lit(first))["start_idx"]
    cut = F.least(F.length("text").cast("long"), F.lit(preview).cast("long"), F.coalesce(beyond, F.lit(preview).cast("long")))
    back = F.aggregate(F.reverse("findings"), cut, lambda end, f: F.when((f["start_idx"] < end) & (f["end_idx"] > end), f["start_idx"]).otherwise(end))
    shown = computed(rows.withColumn("__end", back), {"__preview": F.filter("findings", lambda f: f["end_idx"] <= F.col("__end"))})
    shown = shown.withColumn("preview", revealed(F.left("text", F.col("__end").cast("int")), "__preview")).drop("__preview", "__end")
    repaired = sanitize(shown.withColumn("__whole", F.col("text")).withColumnRenamed("findings", "__findings")).withColumnRenamed("__findings", "findings")
    kept = [c for c in rows.columns if c not in ("text", "findings")]
    remaining = F.filter("findings", lambda f: ~f["fixable"])
    told = repaired.select(
        *kept, F.length("__whole").cast("long").alias("code_points"), F.size("findings").cast("long").alias("n_findings"), *counts, F.slice("findings", 1, first).alias("findings"),
        "preview", F.col("text").alias("sanitized"), F.slice(remaining, 1, left).alias("remaining"),
    )
    with records_per_batch(rows.sparkSession, FEW_TEXTS):
        return materialize(told, "bundle", "zstd")

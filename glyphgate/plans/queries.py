"""Registered queries for the text-integrity operators.

Rules run over ``planted``: the documents with something hidden in fifteen of sixteen by one rule, since the tables
hold no hidden character of their own. Census figures run over the findings of all rules; reports, policies and repairs of one pass
over those of single characters and tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import rows, sql
from glyphgate.functions import text as X
from glyphgate.functions.shipping import ship
from glyphgate.operators import analytics, confusables, decode, events, payloads, policy, repair, reports, rules, styled
from glyphgate.plans.corpora import planted, planted_in
from glyphgate.plans.scan import exploded, placed, scan, scan_by_policy, scanned
from glyphgate.plans.storage import new_path
from glyphgate.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
PLACE = ("doc_id", "rule", "severity", "start_idx", "end_idx", "start_off", "end_off", "start_line", "start_col")
ALLOWED = (0x00A0, 0x200B)
OVERRIDES = {"invisible": "info", "bidi-mark": False, "unusual-whitespace": "error"}
BLOCKS = [
    policy.Block(rules={"bidi-mark": "info"}),
    policy.Block(files=("src1*/**",), rules={"invisible": "error"}, allow=(0x2028,)),
    policy.Block(files=("/src2/en/*", "*/de/*"), rules={"unusual-whitespace": False}, allow=(0x200B,)),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def base_rows(docs: DataFrame, places: bool = True) -> DataFrame:
    """Documents with the findings of single characters and of tags; as spans alone where ``places`` is false."""
    df, spans = decode.with_runs(docs), F.concat(rules.single_characters(), decode.tag_smuggling(F.col("__tags")))
    found = placed(rows.computed(df, {"__spans": spans}), "__spans") if places else rows.computed(df, {"findings": spans})
    return found.select(*docs.columns, "findings")


def base_findings(docs: DataFrame) -> DataFrame:
    return exploded(base_rows(events.fast_path(docs)), "doc_id", *[c for c in ("source", "lang") if c in docs.columns])


def path_of() -> Column:
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


def _rule_findings(docs: DataFrame, spans: Column) -> DataFrame:
    return exploded(placed(rows.computed(docs, {"__spans": spans}), "__spans"))


def _one_rule(rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = events.with_events(events.fast_path(planted(spark, sf_dir)))
        return _rule_findings(some, F.filter(rules.single_characters(), lambda s: s["rule"] == rule)).select(*PLACE)

    return query


def _over_findings(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(base_findings(planted(spark, sf_dir)))


def _over_rows(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(base_rows(planted(spark, sf_dir)))


def _over_scan(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(scan(planted(spark, sf_dir), keep=("doc_id", "source", "lang")))


def _over_scanned(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(scanned(planted(spark, sf_dir)))


def _on_planted(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(planted(spark, sf_dir))


def _hex(cps: Column) -> Column:
    return F.array_join(F.transform(cps, lambda c: F.hex(c)), " ")


def _each(docs: DataFrame, array: str) -> DataFrame:
    return docs.select("doc_id", F.explode(array).alias("x")).select("doc_id", "x.*")


def _with_places(df: DataFrame, array: str) -> DataFrame:
    """One row for each run, with the position of its start."""
    at = df.withColumn("__at", events.place(F.transform(array, lambda r: r["start"])))
    return at.select("doc_id", F.explode(F.arrays_zip(F.col(array).alias("r"), F.col("__at").alias("p"))).alias("x")).select("doc_id", "x.r.*", "x.p.*")


def _tag_runs(docs: DataFrame) -> DataFrame:
    return _with_places(decode.with_runs(events.fast_path(docs)), "__tags").withColumn("tags", _hex("tags"))


def _vs_runs(docs: DataFrame) -> DataFrame:
    found = _with_places(decode.with_runs(events.fast_path(docs)), "__selectors")
    return found.select("doc_id", "start", "n", "base_cp", F.lower("hex").alias("hex"), "decoded", "recognized_first", "ordinary", "off")


def _streams(kind: str) -> Callable[[DataFrame], DataFrame]:
    def query(docs: DataFrame) -> DataFrame:
        found = _each(decode.with_runs(events.fast_path(docs)), "__selectors").where(F.col(f"{kind}_text").isNotNull())
        return found.select("doc_id", "start", F.col(f"{kind}_start").alias("stream_start"), F.col(f"{kind}_text").alias("text"))

    return query


def _vs_findings(docs: DataFrame) -> DataFrame:
    df = decode.with_runs(events.fast_path(docs))
    return _rule_findings(df, decode.selector_findings(F.col("__selectors"))).select(*PLACE, "decoded", "removal_start")


def _tag_smuggling(docs: DataFrame) -> DataFrame:
    return _rule_findings(decode.with_runs(events.fast_path(docs)), decode.tag_smuggling(F.col("__tags"))).select(*PLACE, "decoded", "removal_start")


def _bidi_unbalanced(docs: DataFrame) -> DataFrame:
    df = rows.computed(events.with_events(events.fast_path(docs)), {"__controls": rules.bidi_controls()})
    df = df.withColumn("__loose", rules.loose_controls(F.transform("__controls", lambda e: e["cp"])))
    return _rule_findings(df, rules.bidi_unbalanced(F.col("__controls"), F.col("__loose"))).select(*PLACE)


def _tokens(docs: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(confusables.TOKEN), F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("tokens"), F.size(F.array_distinct(found)).cast("long").alias("spellings"))


def _worded(docs: DataFrame) -> DataFrame:
    """Documents with ``__words``."""
    ship(docs.sparkSession)
    df = rows.computed(docs, {"__tokens": confusables.beyond_tokens(F.lit(False))})
    return confusables.with_words(df.withColumn("__forms", confusables.spell()("__tokens")))


def _skeleton(docs: DataFrame) -> DataFrame:
    return _each(_worded(docs), "__words").select("token", "skeleton").distinct()


def _mixed(docs: DataFrame) -> DataFrame:
    found = _each(_worded(docs), "__words").where("mixed")
    return found.select("doc_id", "token", confusables.signature(F.col("sets")).alias("signature"))


def _collision(docs: DataFrame) -> DataFrame:
    df = confusables.with_collisions(_worded(docs), F.lit(False))
    found = _each(df, "__clashes")
    return found.groupBy("doc_id", "skeleton").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("tokens"))


def _styled(docs: DataFrame) -> DataFrame:
    """Findings of styled text alone."""
    df = rows.computed(events.with_events(events.fast_path(docs)), {"__far": decode.far_characters(F.col("text"))})
    df = styled.with_passages(rows.matches(df, {"__islands": styled.wanted(F.col("__far"))}), "__islands", "__passages")
    return _rule_findings(df, styled.styled_text(F.col("__passages")))


def _lookalikes(code: bool) -> Callable[[DataFrame], DataFrame]:
    """Findings of lookalikes alone, in prose or in code."""

    def query(docs: DataFrame) -> DataFrame:
        df = rows.computed(events.with_events(events.fast_path(docs)), {"__tokens": confusables.beyond_tokens(F.lit(code))})
        df = confusables.with_words(df.withColumn("__forms", confusables.spell()("__tokens")))
        df = confusables.with_occurrences(confusables.with_flagged(df, F.lit(code)), F.lit(code))
        return _rule_findings(df, F.col("__confusables")).select(*PLACE, "skeleton")

    return query


def _names(docs: DataFrame) -> DataFrame:
    found = events.located(docs.select("doc_id", "text")).select("cp").distinct()
    return found.select("cp", X.unicode_name(F.col("cp")).alias("name"))


def _positions(docs: DataFrame) -> DataFrame:
    return events.located(docs.select("doc_id", "text")).select("doc_id", "idx", "cp", "off", "line", "col")


def _sanitized(mode: str) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: repair.sanitize(docs.select("doc_id", "text"), mode)


def _fix_preview(docs: DataFrame) -> DataFrame:
    found = base_rows(docs.select("doc_id", "text")).withColumn("before", F.col("text"))
    return repair.fix_preview(repair.one_pass(found).select("doc_id", "before", F.col("text").alias("after")))


def _one_pass(mode: str) -> Callable[[DataFrame], DataFrame]:
    def query(found: DataFrame) -> DataFrame:
        repaired = repair.one_pass(found.select("doc_id", "text", "findings"), mode)
        return repaired.select("doc_id", F.sha2("text", 256).alias("digest"), F.col("__fixed").alias("fixed"))

    return query


def _merged(found: DataFrame) -> DataFrame:
    return _each(found.withColumn("__spans", repair.merged_spans(2)), "__spans")


def _with_path(found: DataFrame) -> DataFrame:
    return found.withColumn("path", path_of())


def _by_path(found: DataFrame) -> DataFrame:
    return policy.by_path(_with_path(found), BLOCKS).select("path", *PLACE)


def _diff(found: DataFrame) -> DataFrame:
    return analytics.scan_diff(found.where("rule <> 'control-character'"), policy.allow(found, list(ALLOWED)))


def _policy_scan(docs: DataFrame) -> DataFrame:
    """Texts of two sources are code; what their identifiers hide counts as an error there only."""
    blocks = [*BLOCKS, policy.Block(files=("/src0/**", "/src3/**"), code=True), policy.Block(files=("/src3/fr/*",), code=False)]
    return scan_by_policy(_with_path(docs), blocks).select("path", *PLACE, "skeleton")


def _json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as JSON lines, every seventh line broken, read again: documents and what was rejected."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.when(F.col("turn") % 7 == 3, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    path = new_path(spark, "lines")
    turns.select(line.alias("line")).withColumn("turn", F.get_json_object("line", "$.turn").cast("int")).select(broken.alias("value")).write.text(path)
    found = corpus.read_json_lines(spark, path, "conv_id long, turn long, role string, text string", most_units=400)
    kept = found.documents.select("role", F.lit("kept").alias("outcome"), utf16_units("text").alias("units"))
    lost = found.rejected.select(F.lit(None).cast("string").alias("role"), F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("units"))
    return kept.unionByName(lost).groupBy("role", "outcome").agg(F.count("*").alias("n"), F.sum("units").alias("units"))


def utf16_units(name: str) -> Column:
    return X.utf16_length(F.col(name))


def _sql_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skeletons of all tokens beyond ASCII, through the SQL functions."""
    sql.register(spark)
    found = _tokens_beyond(planted(spark, sf_dir))
    return spark.sql("SELECT token, skeleton(token) AS skeleton FROM {found}", found=found)


def _tokens_beyond(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(confusables.beyond_tokens(F.lit(False))).alias("token")).distinct()


def _sarif_run(found: DataFrame) -> DataFrame:
    """The lines of one log for all documents, numbered."""
    results = reports.sarif_results(_with_path(found), F.col("path"))
    lines = reports.sarif_lines(results, {r: r for r in P.RULES}, ["doc_id", "start_off", "rule"])
    return lines.select("part", "key.doc_id", "key.start_off", "key.rule", F.sha2("line", 256).alias("digest"))


def _inspection_bundle(docs: DataFrame) -> DataFrame:
    found = analytics.inspection_bundle(scanned(docs.select("doc_id", "text")))
    return found.select("doc_id", "code_points", "n_findings", "n_error", "n_warning", "n_info", "preview", "sanitized", F.size("remaining").alias("n_remaining"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with something planted, their ids as doc_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.col("url").alias("source"), F.lit("html").alias("lang"))
    return planted_in(pages)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with something planted; a turn is a document whose id repeats within its conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "text", F.col("role").alias("source"), F.col("turn").alias("lang"))
    return planted_in(turns).withColumnRenamed("lang", "turn")


def queries() -> dict[str, Query]:
    a = analytics
    return {
        "fast_path": lambda spark, sf_dir: events.fast_path(_docs(spark, sf_dir)).select("doc_id"),
        "code_point_count": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("code_points"), X.utf16_length(F.col("text")).alias("units")),
        "positions": _on_planted(_positions),
        "bidi_control": _one_rule("bidi-control"),
        "bidi_mark": _one_rule("bidi-mark"),
        "invisible": _one_rule("invisible"),
        "unusual_whitespace": _one_rule("unusual-whitespace"),
        "control_character": _one_rule("control-character"),
        "bidi_unbalanced": _on_planted(_bidi_unbalanced),
        "tag_runs": _on_planted(_tag_runs),
        "tag_smuggling": _on_planted(_tag_smuggling),
        "vs_runs": _on_planted(_vs_runs),
        "vs_byte_stream": _on_planted(_streams("byte")),
        "vs_bit_stream": _on_planted(_streams("bit")),
        "vs_findings": _on_planted(_vs_findings),
        "tokens": _on_planted(_tokens),
        "skeleton": _on_planted(_skeleton),
        "confusable_mixed": _on_planted(_mixed),
        "confusable_collision": _on_planted(_collision),
        "confusable_findings": _on_planted(_lookalikes(False)),
        "code_mode": _on_planted(_lookalikes(True)),
        "styled_text": _on_planted(lambda d: _styled(d).select("doc_id", "start_idx", "end_idx", "start_off", "end_off", "decoded")),
        "names": _on_planted(_names),
        "diagnostic_text": _on_planted(lambda d: d.select("doc_id", X.diagnostic_text(F.col("text")).alias("shown"))),
        "policy_allow": _over_findings(lambda f: policy.allow(f, list(ALLOWED)).select(*PLACE)),
        "policy_override": _over_findings(lambda f: policy.override(f, OVERRIDES).select(*PLACE)),
        "policy_by_path": _over_findings(_by_path),
        "merge_spans": _over_rows(_merged),
        "remove_pass": _over_rows(_one_pass("remove")),
        "normalize_pass": _over_rows(_one_pass("normalize")),
        "sanitize": _on_planted(_sanitized("remove")),
        "sanitize_normalize": _on_planted(_sanitized("normalize")),
        "reveal": _over_rows(lambda r: repair.reveal(r.select("doc_id", "text", "findings"))),
        "fix_preview": _on_planted(_fix_preview),
        "severity_counts": _over_scanned(a.severity_counts),
        "summary_groups": _over_rows(a.summary_groups),
        "census_rule_severity": _over_scanned(a.rule_severity),
        "census_top_share": lambda spark, sf_dir: a.top_share(scanned(planted(spark, sf_dir), places=False)),
        "census_strata": _over_scanned(lambda r: a.strata(r, "lang")),
        "split_rates": _over_scanned(lambda r: a.split_rates(r, "CASE WHEN source LIKE 'src1%' THEN 'a' ELSE 'b' END")),
        "classify": _over_scanned(a.classified),
        "label_shares": _over_scanned(a.label_shares),
        "harmless_errors": _over_scanned(a.harmless_errors),
        "audit_sample": _over_scan(lambda f: a.audit_sample(f).select(*PLACE)),
        "probe_classes": _on_planted(lambda d: a.probe_classes(a.probed(d))),
        "coverage": lambda spark, sf_dir: a.coverage(a.probed(base_rows(planted(spark, sf_dir), places=False))),
        "scan_diff": _over_findings(_diff),
        "source_stats": _over_scanned(a.source_stats),
        "manifest_digest": lambda spark, sf_dir: a.manifest_digest(_docs(spark, sf_dir)),
        "context": _over_rows(a.context),
        "zero_width_payloads": _on_planted(payloads.zero_width_payloads),
        "payload_audit": _over_scanned(payloads.payload_audit),
        "inspection": _over_rows(a.inspection),
        "report_annotations": _over_findings(lambda f: reports.annotations(_with_path(f), F.col("path"))),
        "report_json": _over_rows(reports.json_lines),
        "report_sarif": _over_findings(lambda f: reports.sarif_results(_with_path(f), F.col("path"))),
        "policy_scan": _on_planted(_policy_scan),
        "json_corpus": _json_corpus,
        "sql_skeleton": _sql_skeleton,
        "sarif_run": _over_findings(_sarif_run),
        "census_rows": _over_scanned(lambda r: reports.census_rows(r).select("doc_id", "source", "lang", "n")),
        "scan": _on_planted(lambda d: scan(d).select(*PLACE, "decoded", "skeleton", "fixable")),
        "scan_pages": lambda spark, sf_dir: scan(_pages(spark, sf_dir)).select(*PLACE, "decoded", "skeleton"),
        "scan_conversations": lambda spark, sf_dir: scan(_turns(spark, sf_dir), keep=("doc_id", "turn")).select("turn", *PLACE, "decoded", "skeleton"),
        "inspection_bundle": _on_planted(_inspection_bundle),
        "summary_lines": _over_rows(lambda r: reports.summary_lines(a.summary_groups(r))),
        "report_pretty": _over_rows(reports.pretty),
    }

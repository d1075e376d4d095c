"""Reports: findings as JSON lines, SARIF results, CI annotations and summaries, each line made where its finding is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import text as X

TOOL = "glyphgate"
# Fixed value: the SARIF schema.
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"


def message(f: Column | None = None) -> Column:
    """What a finding says, of columns or of the struct ``f``."""
    get = F.col if f is None else lambda name: f[name]
    names = F.array_join(F.transform(F.slice(get("code_points"), 1, 3), X.unicode_name), ", ")
    return F.concat(get("rule"), F.lit(": "), names, F.when(get("decoded").isNotNull(), F.concat(F.lit(" reads as "), X.diagnostic_text(get("decoded")))).otherwise(""))


def _data(text: Column) -> Column:
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _property(text: Column) -> Column:
    return F.replace(F.replace(_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def annotations(findings: DataFrame, path: Column) -> DataFrame:
    """One CI annotation line for each finding."""
    kind = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    line = F.concat(
        F.lit("::"), kind, F.lit(" file="), _property(path), F.lit(",line="), F.col("start_line").cast("string"), F.lit(",col="), F.col("start_col").cast("string"),
        F.lit(",title="), _property(F.concat(F.lit(f"{TOOL}: "), F.col("rule"))), F.lit("::"), _data(message()),
    )
    return findings.select("doc_id", "start_off", "rule", line.alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, findings, json): one JSON object for each document with findings, its findings in order."""
    one = lambda f: F.struct(
        f["start_off"].alias("start_off"), f["rule"].alias("rule"), f["severity"].alias("severity"),
        F.struct(f["start_line"].alias("line"), f["start_col"].alias("column"), f["start_off"].alias("offset")).alias("start"), f["end_off"].alias("end_off"),
        F.transform(f["code_points"], X.u_label).alias("codePoints"), F.transform(f["code_points"], X.unicode_name).alias("names"), message(f).alias("message"),
        f["decoded"].alias("decoded"), f["skeleton"].alias("skeleton"), f["fixable"].alias("fixable"),
    )
    some = rows.where(F.size("findings") > 0)
    return some.select("doc_id", F.size("findings").cast("long").alias("findings"), F.to_json(F.struct("doc_id", F.transform("findings", one).alias("findings"))).alias("json"))


def sarif_results(findings: DataFrame, path: Column) -> DataFrame:
    """(doc_id, start_off, rule, result): the SARIF result object of each finding."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    uri = F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(message().alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("doc_id", "start_off", "rule", F.to_json(result).alias("result"))


def sarif_lines(results: DataFrame, rules: dict[str, str], order: list[str]) -> DataFrame:
    """(part, key, line): the lines of one SARIF log over all of ``results``, in the order of (part, key).

    Each result is a line, with a comma before all but the first; a head and a foot line stand around them. Nothing but
    the smallest key is gathered. ``rules`` describes each rule.
    """
    keyed = results.select(F.struct(*order, "result").alias("key"), "result")
    first = keyed.agg(F.min("key").alias("first"))  # one row
    kind = keyed.schema["key"].dataType
    about = F.array(*[F.struct(F.lit(r).alias("id"), F.struct(F.lit(text).alias("text")).alias("shortDescription")) for r, text in sorted(rules.items())])
    driver = F.to_json(F.struct(F.struct(F.lit(TOOL).alias("name"), about.alias("rules")).alias("driver")))
    head = F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":'), driver, F.lit(',"results":['))
    smallest = first.first()["first"]
    comma = F.when(F.col("key") == F.lit(None).cast(kind), "") if smallest is None else F.when(F.col("key") > _literal(smallest, kind), ",")
    body = keyed.select(F.lit(1).alias("part"), "key", F.concat(F.coalesce(comma, F.lit("")), F.col("result")).alias("line"))
    ends = results.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("part"), F.lit(None).cast(kind).alias("key"), F.when(F.col("id") == 0, head).otherwise("]}]}").alias("line"))
    return body.unionByName(ends)


def _literal(row, kind) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def write_sarif(results: DataFrame, rules: dict[str, str], order: list[str], path: str) -> None:
    """One SARIF log for a whole run: text files under ``path`` that, put together in the order of their names, are one JSON document."""
    lines = sarif_lines(results, rules, order)
    keys = [F.col("part"), F.col("key").asc_nulls_first()]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("errorifexists").text(path)


def summary_lines(groups: DataFrame) -> DataFrame:
    """(doc_id, no, line) of the groups of ``analytics.summary_groups``: one readable line for each kind of finding of a document."""
    place = lambda which: F.col(f"{which}_line").cast("string")
    where = F.when(F.col("n") == 1, F.concat(F.lit("line "), place("first"))).otherwise(F.concat(F.lit("lines "), place("first"), F.lit(" to "), place("last")))
    what = F.when(F.col("cp").isNotNull(), F.concat(F.lit(" "), X.unicode_name(F.col("cp")))).otherwise("")
    told = F.when(F.col("decoded") != "", F.concat(F.lit(", reads as "), X.diagnostic_text(F.col("decoded")))).otherwise("")
    return groups.select("doc_id", "no", F.concat(F.col("severity"), F.lit(" "), F.col("rule"), what, F.lit(" x"), F.col("n").cast("string"), F.lit(", "), where, told).alias("line"))


def excerpt(text: Column, start: Column, end: Column, around: int = 32, most: int = 80) -> Column:
    """The line around a span, its ends cut to ``around`` characters, the span (its ends, if long) in double brackets, hidden characters escaped."""
    # No more of the text than may be shown is looked at.
    before = F.element_at(F.split(F.right(F.left(text, start.cast("int")), F.lit(around + 1)), "[\r\n]", -1), -1)
    after = F.get(F.split(F.substr(text, (end + 1).cast("int"), F.lit(around + 1)), "[\r\n]", -1), F.lit(0))
    inside = F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))
    half = F.lit(most // 2)
    some = F.concat(X.diagnostic_text(F.left(inside, half)), F.lit(" ... "), X.diagnostic_text(F.right(inside, half)))
    middle = F.when(F.length(inside) > most, some).otherwise(X.diagnostic_text(inside))
    left = F.concat(F.when(F.length(before) > around, "... ").otherwise(""), X.diagnostic_text(F.right(before, F.lit(around))))
    right = F.concat(X.diagnostic_text(F.left(after, F.lit(around))), F.when(F.length(after) > around, " ...").otherwise(""))
    return F.concat(left, F.lit("[["), middle, F.lit("]]"), right)


def pretty(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, line): a readable line for each finding of documents with ``findings``: place, severity, rule, excerpt."""
    each = rows.select("doc_id", "text", F.explode("findings").alias("f")).select("doc_id", "text", "f.*")
    at = lambda end: F.concat(F.col(f"{end}_line").cast("string"), F.lit(":"), F.col(f"{end}_col").cast("string"))
    line = F.concat(at("start"), F.lit("-"), at("end"), F.lit(" "), F.col("severity"), F.lit(" "), message(), F.lit(" | "), excerpt(F.col("text"), F.col("start_idx"), F.col("end_idx")))
    return each.select("doc_id", "seq", line.alias("line"))


def census_rows(rows: DataFrame) -> DataFrame:
    """Per document with findings: its stratum and findings as an array, the shape of a census file."""
    return rows.where(F.size("findings") > 0).select("doc_id", "source", "lang", "findings", F.size("findings").cast("long").alias("n"))

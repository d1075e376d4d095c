"""Discovery, JSON corpora, SQL functions, policies that say what is code, and reports of rows whose ids do not tell them apart."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import sql
from glyphgate.operators import analytics, payloads, policy, repair, reports
from glyphgate.plans.scan import scan, scan_by_policy, scanned
from glyphgate.sources import corpus, discovery


def u(*points: int) -> str:
    return "".join(map(chr, points))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A tree whose folder names hold signs of patterns, with ignore files on three levels."""
    top = tmp_path_factory.mktemp("t+(1)[x]")
    files = {
        ".gitignore": "# comment\n\n*.log\n!keep.log\n/only-here.txt\ncache/\n",
        "a.txt": "a", "x.log": "x", "keep.log": "k", "only-here.txt": "no", "sub/only-here.txt": "yes", "cache/deep/y.txt": "no", "sub/cache/z.txt": "no",
        "sub/.gitignore": "!*.log\n*.tmp\r\ngen?/*.js\n", "sub/b.log": "taken back", "sub/c.tmp": "no", "sub/deep/.gitignore": "!c.tmp\n", "sub/deep/c.tmp": "yes", "sub/deep/d.tmp": "no",
        "sub/gen1/f.js": "no", "sub/gen12/f.js": "yes", "node_modules/m.js": "no", "sub/dist/n.js": "no", "bin.dat": "a\0b", "other/q.txt": "q",
    }
    for name, text in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (top / "other" / "bad.txt").write_bytes(b"abc\xff\xff")
    (top / "other" / "huge.txt").write_bytes(b"x" * (5 * 1024 * 1024 + 1))
    return top


def test_discovery(spark, tree):
    found = discovery.discover(spark, [".", "sub", "x.log", "missing", "sub/c.tmp"], str(tree))
    documents = [r.path for r in found.documents.collect()]
    taken = {"a.txt", "keep.log", "other/q.txt", "sub/b.log", "sub/deep/c.tmp", "sub/gen12/f.js", "sub/only-here.txt"}
    # Seen from sub alone the rules above it do not hold; files that are named themselves are taken.
    assert documents == sorted(taken | {"sub/cache/z.txt", "x.log", "sub/c.tmp"})
    assert {(r.path, r.reason) for r in found.errors.collect()} == {("missing", "does not exist"), ("other/bad.txt", "malformed utf-8")}
    skipped = {r.path: r.reason for r in found.skipped.collect()}
    assert skipped == {
        "bin.dat": "binary", "other/huge.txt": "too large", **dict.fromkeys(("only-here.txt", "cache/deep/y.txt", "sub/deep/d.tmp", "sub/gen1/f.js", "node_modules/m.js", "sub/dist/n.js"), "ignored"),
    }


def test_discovery_from_the_top(spark, tree):
    found = {r.path for r in discovery.discover(spark, ["."], str(tree)).documents.collect()}
    assert "sub/cache/z.txt" not in found and "x.log" not in found and "sub/b.log" in found
    nothing = discovery.discover(spark, ["none"], str(tree))
    assert nothing.documents.count() == nothing.skipped.count() == 0 and nothing.errors.count() == 1


def test_json_lines(spark, tmp_path):
    lines = ['{"id": 1, "text": "a"}', '{"id": "x", "text": "b"}', "", "   ", '{"id": 2}', '{"id": 3, "text": null}', '{"id": 4, "text": "abcdef"}', '{"id": 5, "te', "[1]", '"s"', "7", '{"id": null, "text": ""}', '{"id": 6, "text": "\\ud83d\\ude00\\ud83d\\ude00\\ud83d\\ude00", "more": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    found = corpus.read_json_lines(spark, str(tmp_path), "id long, text string", most_units=5)
    assert sorted((str(r.id), r.text) for r in found.documents.collect()) == [("1", "a"), ("None", "")]
    got = sorted((r.reason, r.line) for r in found.rejected.collect())
    want = [("malformed", lines[1]), ("malformed", lines[7]), ("malformed", "[1]"), ("malformed", '"s"'), ("malformed", "7"), ("no text", lines[4]), ("no text", lines[5]), ("too long", lines[6]), ("too long", lines[12])]
    assert got == sorted(want)


def test_sql(spark):
    sql.register(spark)
    row = spark.sql(f"SELECT skeleton('соре') AS s, nfd('é') AS n, scripts('аb') AS c, sanitize_text('a{u(0x200B)}b') AS r, normalize_text('a{u(0xA0)}b') AS m, skeleton(NULL) AS x, sanitize_text(NULL) AS y").first()
    assert tuple(row) == ("cope", "é", ["Cyrillic", "Latin"], "ab", "a b", None, None)
    spark.createDataFrame([(1, f"a{u(0x200B)}"), (2, "b"), (3, f"{u(0x202E)}c")], "doc_id long, text string").createOrReplaceTempView("texts")
    sql.view(spark, "findings", "texts")
    got = spark.sql("SELECT t.doc_id, f.rule FROM texts t JOIN findings f ON f.doc_id = t.doc_id ORDER BY 1, 2").collect()
    assert list(map(tuple, got)) == [(1, "invisible"), (3, "bidi-control"), (3, "bidi-unbalanced")]


def test_code_by_path(spark):
    """Two spellings of an identifier collide in code, where prose lets accents be."""
    text = "const café = 1; const café = 2;"
    docs = spark.createDataFrame([(1, text, "src/a.js"), (2, text, "docs/a.md"), (3, text, "src/x/b.js")], "doc_id long, text string, path string")
    blocks = policy.read_policy('{"overrides": [{"files": "src/**", "isCode": true}, {"files": "src/x/*", "isCode": false}]}')
    got = {(r.doc_id, r.rule) for r in scan_by_policy(docs, blocks).collect()}
    assert got == {(1, "confusable")}
    strict = policy.read_policy('{"isCode": true, "rules": {"confusable": "info"}, "overrides": [{"files": "docs/**", "rules": {"confusable": false}}]}')
    assert {(r.doc_id, r.severity) for r in scan_by_policy(docs, strict).collect()} == {(1, "info"), (3, "info")}


@pytest.fixture(scope="module")
def alike(spark):
    """Rows with one id, and rows with none."""
    rows = [(5, f"a{u(0x200B)}b"), (5, f"c{u(0x202E)}d{u(0x200B)}{u(0x200B)}"), (None, f"e{u(0xA0)}f"), (None, f"{u(0x1B)}g"), (6, "plain"), (7, None)]
    return scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_rows_with_the_same_id_stay_apart(alike):
    lines = alike.transform(reports.json_lines).collect()
    assert sorted(len(json.loads(r.json)["findings"]) for r in lines) == sorted(r.findings for r in lines) == [1, 1, 1, 4]
    assert tuple(analytics.severity_counts(alike).first()) == (3, 4, 0, 7, 4)
    assert {(r.rule, r.severity): (r.findings, r.documents) for r in analytics.rule_severity(alike).collect()}[("invisible", "warning")] == (3, 2)
    groups = [(str(r.doc_id), r.no, r.severity, r.rule, r.n) for r in analytics.summary_groups(alike).collect()]
    assert sorted(groups) == [("5", 0, "error", "bidi-control", 1), ("5", 0, "warning", "invisible", 1), ("5", 1, "error", "bidi-unbalanced", 1), ("5", 2, "warning", "invisible", 2), ("None", 0, "error", "control-character", 1), ("None", 0, "warning", "unusual-whitespace", 1)]
    assert tuple(analytics.harmless_errors(alike).first()) == (2, 1)
    assert sum(r.findings for r in analytics.label_shares(alike).collect()) == 7


def test_one_sarif_log(spark, alike, tmp_path):
    """The files of a run, put together, are one JSON document; also without a result."""
    found = alike.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode("findings").alias("f")).select("doc_id", "row", "f.*")
    for name, some in (("all", found), ("none", found.limit(0))):
        results = reports.sarif_results(some.withColumn("doc_id", F.col("row")), F.lit("dir/a b.txt"))
        out = tmp_path / name
        reports.write_sarif(results, {r: f"about {r}" for r in P.RULES}, ["doc_id", "start_off", "rule"], str(out))
        log = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(out.glob("part-*"))))
        run = log["runs"][0]
        assert len(run["results"]) == some.count() and len(run["tool"]["driver"]["rules"]) == len(P.RULES)
        assert all(x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "dir/a%20b.txt" for x in run["results"])


def test_audit_finds_misses(spark):
    """What a policy keeps from being reported is still read, and counted as a miss."""
    tags = "".join(chr(0xE0000 + ord(c)) for c in "obey")
    bits = "".join(u(0x2060) if b == "1" else u(0x200B) for c in "run at dawn" for b in f"{ord(c):08b}")
    spelled = "x" + "".join(chr(0xE0100 + b - 16) for b in b"hello")
    emoji = "".join("w" + (u(0xFE0F) if b == "1" else u(0xFE0E)) for c in "meet at 9" for b in f"{ord(c):08b}")
    flag = u(0x1F3F4) + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + u(0xE007F)
    docs = spark.createDataFrame([(1, tags), (1, spelled), (None, emoji), (None, bits), (2, flag), (3, None), (4, "plain")], "doc_id long, text string")
    found = scanned(docs)
    full = {r.kind: (r.payloads, r.reported) for r in payloads.payload_audit(found).collect()}
    assert full == {"tag-characters": (1, 1), "selector-bytes": (1, 1), "selector-bits": (1, 1), "zero-width-binary": (1, 0)}
    less = found.withColumn("findings", F.filter("findings", lambda f: f["rule"] != "tag-smuggling"))
    assert {r.kind: (r.payloads, r.reported) for r in payloads.payload_audit(less).collect()}["tag-characters"] == (1, 0)


def test_preview_of_added_lines(spark):
    """Only lines that change show, though lines between them have moved."""
    text = f"one\ntwo{u(0x2028)}three\nfour\nfi{u(0x200B)}ve\nsix{u(0x85)}{u(0x85)}seven\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pairs = repair.sanitize(docs.withColumn("before", F.col("text")), "normalize").select("doc_id", "before", F.col("text").alias("after"))
    got = [(r.line, r.old, r.new) for r in repair.fix_preview(pairs).orderBy("line").collect()]
    assert got == [(2, f"two{u(0x2028)}three", "two\nthree"), (4, f"fi{u(0x200B)}ve", "five"), (5, f"six{u(0x85)}{u(0x85)}seven", "six\n\nseven")]


def test_scan_of_one_table_after_another(spark):
    """The expressions of a scan are made once; tables with other columns use them all the same."""
    first = spark.createDataFrame([(1, f"a{u(0x200B)}")], "doc_id long, text string")
    other = spark.createDataFrame([("k", 2.5, f"{u(0x200B)}b")], "name string, __pieces double, text string").withColumnRenamed("__pieces", "weight")
    assert scan(first).count() == 1 and scan(other, keep=("name", "weight")).first()["weight"] == 2.5

"""What the Python workers of a scan hold: an executor has one for each Arrow step of each of its tasks, at any size of the input."""

from __future__ import annotations

import re
import tracemalloc

from glyphgate.functions import unicode_data
from glyphgate.operators import analytics, confusables
from glyphgate.plans.scan import scan, scanned
from pyspark.sql import functions as F

TEXTS = [(1, "café pаypal paypal ​ x"), (2, None), (3, "plain"), (4, "‮open café"), (None, "\U0001d41a\U0001d41b\U0001d41c déjà vu"), (4, "")]


def test_words_kept_by_a_worker_are_few_and_small():
    """120,000 words that differ took 69 MB of each worker, and were kept up to 200,000."""
    known = unicode_data.tables()
    known._kept.clear()
    known.imitated  # noqa: B018  made once
    known.forms("été")
    tracemalloc.start()
    for i in range(120_000):
        known.forms(f"wört{i}")
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    known._kept.clear()
    assert held < 16 << 20


def test_forms_of_a_batch_are_those_of_each_word(spark):
    known = unicode_data.tables()
    lists = [["café", "pаypal"], [], ["pаypal", "ışık", "café", "אb", "ａ́"], []]
    docs = spark.createDataFrame(list(enumerate(lists)), "id int, tokens array<string>").coalesce(1)
    got = {r.id: [x.asDict() for x in r.forms] for r in docs.select("id", confusables.spell()("tokens").alias("forms")).collect()}
    want = {i: [known.forms(t) | {"sets": [list(s) for s in known.forms(t)["sets"]]} for t in x] for i, x in enumerate(lists)}
    assert got == want


def steps(df):
    return len(re.findall("ArrowEvalPython", df._jdf.queryExecution().executedPlan().toString()))


def test_a_scan_has_three_arrow_steps(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    assert steps(scan(docs)) <= 3 and steps(scanned(docs).where(F.size("findings") > 1)) <= 3


def test_the_bundle_sends_few_texts_at_a_time(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(key), analytics.materialize
    monkeypatch.setattr(analytics, "materialize", lambda df, *a: (seen.append((int(spark.conf.get(key)), steps(df))), write(df, *a))[1])
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    found = {(r.doc_id, r.code_points): (r.n_findings, r.sanitized) for r in analytics.inspection_bundle(scanned(docs)).collect()}
    assert len(seen) == 1 and seen[0][0] <= 200 and seen[0][1] <= 4 and spark.conf.get(key) == before
    assert len(found) == 6 and found[2, None] == (0, None) and found[3, 5] == (0, "plain") and found[1, 22][1] == "café pаypal paypal  x"
    want = {(r.doc_id, r.n): r.found for r in scanned(docs).select("doc_id", F.length("text").alias("n"), F.size("findings").alias("found")).collect()}
    assert {k: n for k, (n, _) in found.items()} == want


def test_spans_without_places_are_the_findings(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    pairs = lambda df: sorted((str(r.doc_id), str(r.text), sorted((f.rule, f.severity, f.start_idx, f.end_idx) for f in r.findings)) for r in df.collect())
    assert pairs(scanned(docs, places=False)) == pairs(scanned(docs)) and steps(scanned(docs, places=False)) == 2


def test_top_share_scans_once(spark, monkeypatch):
    """The scan is written as counts and read twice; it was made twice."""
    seen, write = [], analytics.materialize
    monkeypatch.setattr(analytics, "materialize", lambda df, *a: (seen.append(steps(df)), write(df, *a))[1])
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    sizes = [len(r.findings) for r in scanned(docs).collect()]
    found = analytics.top_share(scanned(docs, places=False), top=1)
    assert steps(found) == 0 and seen == [2]
    assert found.collect() == [(round(max(sizes) / sum(sizes), 4), max(sizes), sum(sizes))]

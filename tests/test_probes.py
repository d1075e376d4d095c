"""Probes of coverage: what is found, and what is read for it."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from glyphgate.operators import analytics
from glyphgate.operators.events import fast_path
from glyphgate.plans.queries import base_rows


def texts(n: int) -> list[tuple[int, str | None]]:
    """Random texts over letters, marks and the ends of every probe's ranges."""
    rng = random.Random(5)
    some = [chr(c) for r in analytics.PROBES.values() for pair in r for c in pair] + ["́", "̈", "⃐", "︠", "а", "α", "ա", "é", "ß", "一", "­", " ", "͏"]
    word = lambda: "".join(rng.choice(rng.choice((some, "abXY", "ab", " .\n"))) * rng.choice((1, 1, 1, 4)) for _ in range(rng.randrange(12)))
    return [(i, None if i % 97 == 5 else word()) for i in range(n)]


def test_probes_are_all_matches_of_their_patterns(spark):
    docs = spark.createDataFrame(texts(3_000), "doc_id int, text string")
    got = Counter((r.doc_id, r.p.probe.replace("bom-at-start", "zero-width-and-joiners")) for r in analytics.probed(docs).select("doc_id", F.explode("probes").alias("p")).collect())
    each = [F.struct(F.lit(name).alias("probe"), F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n")) for name, pattern in analytics.PROBE_PATTERNS.items()]
    want = {(r.doc_id, r.probe): r.n for r in docs.where("text IS NOT NULL").select("doc_id", F.inline(F.array(*each))).collect() if r.n}
    assert got == want and {probe for _, probe in want} == set(analytics.PROBE_PATTERNS)


def test_no_pattern_is_tried_on_a_text_without_its_characters(spark, monkeypatch):
    """All 23 were tried on every text beyond ASCII."""
    seen, real = [], analytics.matches
    monkeypatch.setattr(analytics, "matches", lambda df, wanted: (seen.extend(str(c) for *_, c in wanted.values()), real(df, wanted))[1])
    analytics.probed(spark.createDataFrame([(1, "é")], "doc_id int, text string"))
    assert len(seen) == len(analytics.PROBE_PATTERNS) and all("RLIKE(__odd," in c.upper().replace("__ODD", "__odd") and "text" not in c for c in seen)


def test_coverage_by_spans_alone(spark):
    docs = spark.createDataFrame(texts(500), "doc_id int, text string")
    both = [sorted(map(tuple, analytics.coverage(analytics.probed(base_rows(fast_path(docs), places=p))).collect())) for p in (False, True)]
    assert both[0] == both[1] and len(both[0]) > 15

"""The mix moves no texts: what is written or shuffled is keys, and each row comes as often as ``mix`` says."""

from __future__ import annotations

import random
from collections import Counter

from glyphgate.llm import mixing


def test_no_text_is_copied_or_shuffled(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 40))), f"s{i % 3}" if i % 7 else None, i) for i in range(400)]
    rows += [(7_000, "the same words", "s1", 1)] * 60 + [(7_001, "other words", "alone", 2)] * 5
    spark.createDataFrame(rows, "doc_id long, text string, source string, key int").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    written, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: (written.append((label, df.columns)), write(df, label))[1])
    mixed = mixing.mix_rows(docs)
    assert written and not any({"text", "__row"} & set(columns) for label, columns in written if label != "parted")
    assert mixed.columns == docs.columns
    size = lambda r: len((r.text or "").split())
    want = Counter()
    for r in mixing.mix(docs).collect():
        if r.taken:
            want[r.doc_id, r.size] += r.taken // r.size
    assert Counter((r.doc_id, size(r)) for r in mixed.collect() if size(r)) == want  # empty texts fill no budget


def test_repeated_rows_that_a_budget_parts(spark):
    rows = [(1, "three words here", "a", k) for k in range(100)] + [(2, "b " * 4, "b", k) for k in range(90)] + [(3, "c " * 5, None, k) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").repartition(4)
    got = Counter((r.doc_id, r.mark) for r in mixing.mix_rows(docs).collect())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken // r.size
    for doc in (1, 2, 3):
        mine = [n for (d, _), n in got.items() if d == doc]
        assert sum(mine) == taken[doc] and max(mine) - min(mine) <= 1

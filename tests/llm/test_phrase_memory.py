"""What a task of the phrase counts holds: two of them must fit beside an executor's heap at any size of the input."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from glyphgate.llm import phrases


def test_a_container_counts_as_a_dict_does():
    rng = random.Random(3)
    container, want = phrases.Container(3), {}
    for size in (1, 5, 3_000, 40, 20_000, 0):
        # Many keys that fall to few slots, and keys of all 63 bits.
        some = sorted({rng.choice((rng.randrange(1, 1 << 63), 1 + (rng.randrange(5_000) << 42))) for _ in range(size)})
        counts = [rng.randrange(1, 9) for _ in some]
        container.add(np.array(some, np.int64), np.array(counts, np.int64))
        for k, n in zip(some, counts):
            want[k] = want.get(k, 0) + n
    keys, counts = container.items()
    assert len(container) == len(want) and dict(zip(keys.tolist(), counts.tolist())) == want and keys.tolist() == sorted(want)


def test_phrases_take_no_python_objects():
    """Numbers in arrays: at most 64 bytes a phrase, while it grows as well (about 150 in a dict of Python numbers)."""
    keys = np.arange(1, 60_001, dtype=np.int64) * 1_000_003
    tracemalloc.start()
    container = phrases.Container(3)
    for k in range(0, len(keys), 6_000):
        container.add(keys[k : k + 6_000], np.full(6_000, 1_000, np.int64))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(container) == len(keys) and held <= 64 * len(keys)


def test_the_table_of_bits_is_small_and_tells_most_rare_phrases_apart(spark, monkeypatch):
    assert (1 << phrases.BITS) // 8 <= 32 << 20
    found = spark.range(40_000).selectExpr("'en' AS lang", "concat('w', id) AS phrase")
    bits = np.frombuffer(phrases.bit_table(found).value, np.uint8)
    assert len(bits) * 8 <= 16 * 40_000
    known = phrases._Vocabulary("en", bits)
    assert all(known[b"w%d" % i] for i in range(0, 40_000, 7))
    assert sum(known[b"x%d" % i] > 0 for i in range(10_000)) < 400


def test_blocks_go_to_python_few_at_a_time(spark, monkeypatch):
    """A task's blocks are no single batch; the session's own batch size comes back."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(key), phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, label: (seen.append(int(spark.conf.get(key))), write(df, label))[1])
    texts = spark.createDataFrame([("en", [b"\xff", b"a", b"b"], [1, 2, 0])] * 9, "lang string, words array<binary>, ids array<int>").coalesce(1)
    assert {r.phrase: r.f for r in phrases.counted(texts, 2, 1).collect()} == {"a b": 9}
    assert seen == [2] and spark.conf.get(key) == before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_hold_no_word_twice(spark, monkeypatch):
    """What a task writes has a phrase alone, and is dealt out once; blocks are read few at a time."""
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before, write = spark.conf.get(key), phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, label: (seen.append((int(spark.conf.get(key)), plan(df))), write(df, label))[1])
    texts = spark.createDataFrame([("e n", [b"\xff", b"a", b"b", b"c"], [1, 2, 3, 0])] * 9, "lang string, words array<binary>, ids array<int>")
    for length, phrase in ((1, "a"), (2, "a b"), (3, "a b c")):
        assert {(r.lang, r.phrase): r.f for r in phrases.counted(texts, length, 1).collect()}["e n", phrase] == 9
    assert all(size == 2 and p.count("Exchange") == 1 and p.split("MapInArrow")[1].split("]")[0].count("#") == 7 for size, p in seen) and len(seen) == 3
    assert spark.conf.get(key) == before


def test_texts_go_to_python_few_at_a_time(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    write = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, label, *a: (seen.setdefault(label, int(spark.conf.get(key))), write(df, label, *a))[1])
    phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect()
    assert seen["blocks"] == 200


def test_a_task_holds_few_words_and_phrases():
    """Of 1,200,000 words that differ some 300,000 at a time, 500,000 before."""
    own, most, given = phrases.Counter(1, None, None), 0, 0
    for k in range(12):
        words = [b"\xff", *(b"%d" % i for i in range(k * 100_000, (k + 1) * 100_000))]
        own.add("en", words, np.arange(1, len(words)))
        given += sum(len(run) for run in own.eased())
        most = max(most, sum(map(len, own.tries.values())), sum(len(v.words) for v in own.known.values()))
    given += sum(len(run) for run in own.spill(0))
    assert most <= 400_000 and given == 1_200_000

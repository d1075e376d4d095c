"""The pipeline's near-copy stage against brute-force Jaccard similarity of 5-word shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from glyphgate.llm import simhash
from tests.llm.test_operators import WORD, slow_fingerprint

SCHEMA = "doc_id long, text string, source string"


def slow_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow_kept(rows):
    """The smallest id of each component of texts whose sets have a similarity of 0.8 or more."""
    sets = sorted({slow_set(t) for _, t, _ in rows}, key=sorted)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
    at, least = {s: i for i, s in enumerate(sets)}, {}
    for doc, text, _ in rows:
        k = find(at[slow_set(text)])
        least[k] = min([d for d in (doc, least.get(k)) if d is not None], default=None)
    return sorted(least.values(), key=str)


def made_rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3_000)}"
    texts = [None, "", " \n", "one two", "ONE  two", "a b c d e", "a b c d f"]
    for _ in range(40):  # similarities on both sides of 0.8, and chains
        words = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(4):
            texts.append(" ".join(words))
            words = words[:]
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(120)]
    for k in range(150):  # one large group, whose members differ in one place, and outsiders that share most of it
        texts.append(" ".join([*base[: k % 100], word(), *base[k % 100 :]]))
    texts += [" ".join([*base[:n], *[word() for _ in range(120 - n)]]) for n in (60, 80, 100, 105, 108, 110) for _ in range(3)]
    line = [word() for _ in range(30)]
    texts += [" ".join([*line, *[word() for _ in range(rng.randint(3, 12))]]) for _ in range(90)]  # one line in many short texts
    rows = [(None if i % 41 == 0 else 1_000 - i, t, "s") for i, t in enumerate(texts)]
    return rows + [(r[0], r[1], "t") for r in rows[::9]]


def test_stage_keeps_one_of_each_component(spark):
    rows = made_rows()
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id for r in got), key=str) == slow_kept(rows)
    assert got[0].__fields__ == ["doc_id", "text", "source"]


def test_a_far_fingerprint_does_not_save_a_near_copy(spark):
    words = [f"x{i}" for i in range(60)]
    for at in range(60):
        other = [*words[:at], "new", *words[at + 1 :]]
        a, b = " ".join(words), " ".join(other)
        if bin(slow_fingerprint(a) ^ slow_fingerprint(b)).count("1") > simhash.RADIUS and 5 * len(slow_set(a) & slow_set(b)) >= 4 * len(slow_set(a) | slow_set(b)):
            break
    else:
        raise AssertionError("no pair")
    got = simhash.deduplicate(spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, "other words " * 3, "s")], SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_blocks_and_crowds_of_any_size_give_the_same(spark, monkeypatch):
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for crowd, block in ((2, 5), (1_000, 40)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert sorted((r.doc_id for r in simhash.deduplicate(docs).collect()), key=str) == slow_kept(rows)


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = random.Random(5)
    for size in (0, 1, 40, 600, 3_000):
        a = {rng.randrange(1 << 64) for _ in range(size)}
        for change in (0, 1, 9, size):
            b = set(list(a)[change:]) | {rng.randrange(1 << 64) for _ in range(change)}
            x, y = (simhash.sketch(simhash.np.array(sorted(s), "<u8")) for s in (a, b))
            assert len(x) == simhash.SKETCH and simhash.np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_order_puts_frequent_shingles_last():
    late, place = simhash.np.array([2, 5, 9], "<u8"), simhash.np.array([3, 1, 2])
    assert simhash.ordered(simhash.np.array([1, 2, 4, 5, 9, 10], "<u8"), late, place).tolist() == [1, 4, 10, 5, 9, 2]
    assert simhash.ordered(simhash.np.array([], "<u8"), late, place).tolist() == []


def test_fingerprints_propose_what_their_radius_connects(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t, _) in enumerate(rows)], "doc_id long, text string, __mark long").repartition(3)
    found = simhash.shingled(docs).select("node", "fp").distinct()
    nodes = [(r.node, r.fp & (1 << 64) - 1) for r in found.collect()]
    assert {f for _, f in nodes} >= {simhash.majority(simhash.shingle_set((t or "").encode())) for _, t, _ in rows[:50]}
    root = {n: n for n, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if (x ^ y).bit_count() <= simhash.COPY_RADIUS:
                root[find(a)] = find(b)
    want, connected = {}, {n: n for n, _ in nodes}
    for n, _ in nodes:
        want.setdefault(find(n), set()).add(n)
    root = connected
    for r in simhash.near_fingerprints(found).collect():
        root[find(r.u)] = find(r.v)
    got = {}
    for n, _ in nodes:
        got.setdefault(find(n), set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 1 < len(got) < len(nodes)


def test_the_stage_decides_what_fingerprints_propose(spark, monkeypatch):
    """The stage takes its first pairs from fingerprints, and a wrong one of them links nothing."""
    calls, propose = [], simhash.near_fingerprints
    monkeypatch.setattr(simhash, "near_fingerprints", lambda nodes: (calls.append(1), propose(nodes, 64))[1])
    rows = made_rows()
    got = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert calls and sorted((r.doc_id for r in got), key=str) == slow_kept(rows)

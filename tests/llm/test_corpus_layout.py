"""Phrase counts, packing and the Merkle manifest against brute-force versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphgate.llm import merkle, packing, phrases
from tests.llm.test_operators import SCHEMA, make_docs

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[.,;:!?\x0a-\x0d]")


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, some of them with punctuation, line breaks and capital letters."""
    made = make_docs(spark)
    marked = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", " (a|b)", ".\n$1")).when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    lang = F.when(F.col("doc_id") % 4 == 0, "de").when(F.col("doc_id") % 4 == 1, None).otherwise(F.col("lang"))
    return made.withColumns({"text": marked, "lang": lang}).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(rows, length):
    found = defaultdict(Counter)
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in SPLIT.split(text):
            words = re.findall(r"[^ \t]+", piece)
            for i in range(len(words) - length + 1):
                found[r.lang or "und"][" ".join(words[i : i + length])] += 1
    return found


def slow_collocations(rows, top, least=10):
    f = {k: grams(rows, k) for k in (1, 2, 3)}
    out = []
    for lang, words in f[1].items():
        n, scored = sum(words.values()), []
        for k in (2, 3):
            for phrase, a in f[k][lang].items():
                w = phrase.split(" ")
                if a < least:
                    continue
                cuts = []
                for j in range(1, k):
                    left, right = f[j][lang][" ".join(w[:j])], f[k - j][lang][" ".join(w[j:])]
                    cuts.append((1_000_000 * a * a // (left * right), j, left, right))
                longer = [b for p, b in f[3][lang].items() if k == 2 and b >= least and phrase in (" ".join(p.split(" ")[:2]), " ".join(p.split(" ")[1:]))]
                if any(100 * b >= 50 * a for b in longer):
                    continue
                score, _, left, right = min(cuts)
                scored.append((-score, -a, phrase.encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def test_collocations(docs, rows, empty):
    want = slow_collocations(rows, 40)
    assert len(want) > 50
    assert sorted(map(tuple, phrases.collocations(docs, top=40).collect())) == want
    assert phrases.collocations(empty).collect() == []


def test_tries_burst_and_spill(docs, rows, monkeypatch):
    """With small bounds every container bursts, subtrees spill and words are forgotten; no count changes."""
    for name, value in (("BURST", 5), ("ENTRIES", 40), ("WORDS", 50)):
        monkeypatch.setattr(phrases, name, value)
    for length in (1, 2, 3):
        counter, found = phrases.Counter(length, None, None), defaultdict(Counter)
        runs = []
        for r in rows:
            if r.text is None:
                continue
            words = [b"\xff", *phrases.split(r.text.encode())]
            counter.add(r.lang or "und", words, np.arange(1, len(words)))
            runs += counter.eased()
        runs += counter.spill(0)
        assert length == 1 or len(runs) > 20
        for run in runs:
            by_lang = defaultdict(list)
            for x in run.to_pylist():
                found[x["lang"]][x["phrase"]] += x["f"]
                by_lang[x["lang"]].append(x["phrase"])
            assert all(len(set(p)) == len(p) for p in by_lang.values())  # a phrase is in a run once
        assert found == {lang: c for lang, c in grams(rows, length).items() if c}


def test_blocks(docs, rows, monkeypatch):
    """Blocks of any size hold the words of all texts, and where pieces end."""
    for name, value in (("BLOCK", 50), ("LANGUAGES", 1)):
        monkeypatch.setattr(phrases, name, value)
    got = defaultdict(list)
    for b in phrases.blocks(docs.coalesce(1)).collect():
        got[b.lang].append(b" ".join(bytes(b.words[i]) for i in b.ids))
    want = defaultdict(list)
    for r in docs.coalesce(1).collect():
        if r.text is not None:
            want[r.lang or "und"].append(b" ".join([*phrases.split(r.text.encode()), b"\xff"]))
    assert {k: b" ".join(v) for k, v in got.items()} == {k: b" ".join(v) for k, v in want.items()}


def test_frequent_table_has_no_misses(spark):
    """Spark sets the bits that the tasks look up."""
    words = [(lang, f"w{i}é") for lang in ("en", "und") for i in range(500)]
    pairs = [(lang, f"{a} {b}") for (lang, a), (_, b) in zip(words, words[1:])]
    bits = np.frombuffer(phrases.bit_table(spark.createDataFrame(words, "lang string, phrase string")).value, np.uint8)
    known = {lang: phrases._Vocabulary(lang, bits) for lang in ("en", "und")}
    assert all(known[lang][w.encode()] for lang, w in words)
    others = phrases._Vocabulary("en", bits)
    assert sum(others[f"x{i}".encode()] > 0 for i in range(2000)) < 200
    table = np.frombuffer(phrases.bit_table(spark.createDataFrame(pairs, "lang string, phrase string")).value, np.uint8)
    for lang, pair in pairs:
        own = phrases._Vocabulary(lang, np.full(1 << 15, 255, np.uint8))
        a, b = (np.array([own.hashes[own[w.encode()]]], np.uint64) for w in pair.split(" "))
        assert phrases._holds(table, phrases._paired(a, b)).all()


def test_packing(docs, rows, empty):
    assert packing.id_bytes(TOKENIZER) == 2
    pieces = packing.pack(docs, TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u2")
    want = Counter((r.doc_id, ids(r.text).tobytes()) for r in rows)
    # Every id of every row lies in one piece; rows alike are told apart by their places.
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc, found in by_doc.items():
        whole = sorted(k for (d, k), n in want.items() if d == doc for _ in range(n))
        assert sum(map(len, whole)) == sum(len(p.ids) for p in found) == 2 * sum(p.length for p in found)
        assert sorted(len(k) // 2 for k in whole) == sorted(p.doc_tokens for p in found if p.start == 0)
        assert all(any(k[2 * p.start : 2 * (p.start + p.length)] == bytes(p.ids) and len(k) == 2 * p.doc_tokens for k in whole) for p in found)
        for n in {p.doc_tokens for p in found}:
            places = sorted((p.start, p.start + p.length) for p in found if p.doc_tokens == n)
            assert sum(b - a for a, b in places) == n * sum(p.start == 0 for p in found if p.doc_tokens == n)
    assert set(by_doc) == {r.doc_id for r in rows}
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    sizes = []
    for no in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[no], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert all(n & (n - 1) == 0 and n <= packing.LENGTH for n in sizes)
    assert sum(n == packing.LENGTH for n in sizes) == sum(sizes) // packing.LENGTH
    crc = packing.digests(docs, TOKENIZER).select("doc_id", "start", "ids_crc32")
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in crc.collect()) == sorted((str(p.doc_id), p.start, zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes())) for p in pieces)
    assert packing.pack(empty, TOKENIZER).collect() == []
    assert sorted(bytes(s.ids) for s in packing.sequences(docs.sparkSession.createDataFrame(pieces)).collect()) == sorted(
        b"".join(bytes(p.ids) for p in sorted(found, key=lambda p: p.offset)) for found in by_sequence.values()
    )


def test_curve():
    """Cells that follow each other on the curve are neighbours, and each cell has a place of its own."""
    for axes, levels in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << levels)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = packing.curve_keys(cells, levels)
        order = np.argsort(keys)
        assert keys[order].tolist() == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(spark):
    """Texts of two vocabularies come to lie apart from each other."""
    rng = np.random.default_rng(5)
    kinds = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in "nst"] for x in ("bdfg", "klmp")]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 200))) for i in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).orderBy("sequence_id", "offset").collect()
    kind = [p.doc_id % 2 for p in pieces]
    assert sum(a != b for a, b in zip(kind, kind[1:])) < len(kind) / 4


def slow_manifest(rows):
    H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        """Root, and the (left, right) siblings of each node."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
                paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
        return nodes[0], paths

    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        found = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        made.append((found, *tree([leaf(r, r.text) for r in found])))
    root, over = tree([subroot for _, subroot, _ in made])
    out = []
    for (found, subroot, paths), above in zip(made, over):
        for r, path in zip(found, paths):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            node = leaf(r, r.text.replace("\n", "") if tampered else r.text)
            for left, right in path + above:
                node = H(left, node, right)
            out.append((str(r.doc_id), leaf(r, r.text), subroot, root, H(*[a + b for a, b in path + above]), node, node == root))
    return sorted(out)


def test_manifest(spark, docs, rows, empty):
    got = lambda d: sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.audit(d).collect())
    want = slow_manifest(rows)
    assert got(docs) == want
    assert {v for *_, v in want} == {True, False}
    assert merkle.audit(empty).collect() == []
    # One source with several rounds of blocks, sources of one row, and a single row.
    many = spark.createDataFrame([(i, f"t\n{i}", "en", "hot" if i % 50 else f"s{i}", i) for i in range(1300)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(many.repartition(5)) == slow_manifest(many.collect())
    one = many.where("doc_id = 0")
    assert got(one) == slow_manifest(one.collect())

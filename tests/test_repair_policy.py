from __future__ import annotations

import random

import pytest

from glyphgate.functions import properties as P
from glyphgate.operators import policy, repair
from glyphgate.plans.scan import scan, scanned
from glyphgate.sources import files


def u(*points: int) -> str:
    return "".join(map(chr, points))


def fixed(spark, text, **options):
    return repair.sanitize(spark.createDataFrame([(1, text)], "doc_id long, text string"), **options).first()


def test_two_passes(spark):
    row = fixed(spark, ":" + u(0x61C, 0x200C, 0x644))
    assert (row.text, row.passes) == (":" + u(0x644), 2)


@pytest.mark.parametrize(("mode", "want"), [("remove", "pleasedonot"), ("normalize", "please do not"), ("keep", f"please{u(0xA0)}do{u(0x2003)}not")])
def test_modes(spark, mode, want):
    assert fixed(spark, f"please{u(0xA0)}do{u(0x2003)}not", mode=mode).text == want


def test_allowed_inside_a_run(spark):
    row = fixed(spark, u(0x1F600, 0xE0158, 0xE0159), allowed=(0xE0158,))
    assert (row.text, row.fixed, row.passes) == (u(0x1F600, 0xE0158), 1, 1)


def test_keep_changes_nothing(spark):
    row = fixed(spark, f"a{u(0x202E)}b", mode="keep")
    assert (row.text, row.fixed, row.passes) == (f"a{u(0x202E)}b", 0, 0)


def test_many_passes(spark):
    """Each pass lays bare what the next removes: a joiner is legitimate only while its neighbour stands."""
    text = ":" + u(0x200B) + u(0x61C, 0x200C) * 15 + u(0x644)
    row = fixed(spark, text)
    assert row.text == ":" + u(0x644) and scan(spark.createDataFrame([(1, row.text)], "doc_id long, text string")).count() == 0


def test_rows_with_null_and_repeated_ids(spark):
    rows = [(None, f"a{u(0x200B)}b", 1), (5, f"c{u(0x200B)}d", 2), (5, f"e{u(0x200B)}f", 3), (6, "g", 4), (None, None, 5), (5, f"c{u(0x200B)}d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fixed long")
    got = sorted((str(r.doc_id), r.text or "") for r in repair.sanitize(docs).collect())
    assert got == sorted([("None", "ab"), ("5", "cd"), ("5", "ef"), ("6", "g"), ("None", ""), ("5", "cd")])
    shown = sorted(r.revealed or "" for r in repair.reveal(scanned(docs.drop("fixed"))).collect())
    assert shown == ["", "a⟦U+200B ZWSP⟧b", "c⟦U+200B ZWSP⟧d", "c⟦U+200B ZWSP⟧d", "e⟦U+200B ZWSP⟧f", "g"]


def test_disabled(spark):
    assert fixed(spark, f"a{u(0x200B)}b", disabled=("invisible",)).text == f"a{u(0x200B)}b"


def test_random_texts_reach_a_fixpoint(spark):
    alphabet = [*map(ord, "aZ9 .:!\n\r"), 0x200B, 0x200C, 0x200D, 0x202E, 0x202C, 0x2066, 0x2069, 0xA0, 0x3000, 0x85, 0x1B, 0xFE0F, 0xFE00, 0xE0101, 0xE0158, 0xE0041, 0xE007F, 0x1F3F4, 0x1F600, 0x644, 0x94D, 0x915, 0x430, 0xFEFF, 0x2800]
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice(alphabet)) for _ in range(rng.randint(1, 24))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan(docs)
    lengths = {i: len(t) for i, t in enumerate(texts)}
    for r in found.collect():
        assert 0 <= r.start_idx < r.end_idx <= lengths[r.doc_id] and r.start_idx <= r.removal_start <= r.removal_end <= r.end_idx
        assert r.end_off == len(texts[r.doc_id][: r.end_idx].encode("utf-16-le")) // 2
    done = {r.doc_id: r.text for r in repair.sanitize(docs).collect()}
    assert len(done) == 500
    again = scan(spark.createDataFrame(sorted(done.items()), "doc_id long, text string")).where("fixable").collect()
    assert again == []
    seen = set(map(chr, [*map(ord, "aZ9.!"), 0x644, 0x915, 0x430]))
    assert all([c for c in t if c in seen] == [c for c in done[i] if c in seen] for i, t in enumerate(texts))


def by_passes(docs, mode="remove", disabled=(), allowed=()):
    """Scan, repair once, and again, until nothing changes."""
    total = {}
    for no in range(60):
        done = repair.one_pass(scanned(docs, visible=False), mode, disabled, allowed).collect()
        for r in done:
            fixed, passes = total.get(r.doc_id, (0, 0))
            total[r.doc_id] = (fixed + r["__fixed"], no + 1 if r["__fixed"] else passes)
        if not any(r["__fixed"] for r in done):
            return {r.doc_id: (r.text, *total[r.doc_id]) for r in done}
        docs = docs.sparkSession.createDataFrame([(r.doc_id, r.text) for r in done], "doc_id long, text string")
    raise AssertionError("no end")


@pytest.mark.parametrize(
    "options",
    [{}, {"mode": "normalize"}, {"disabled": ("variation-selector-stray", "invisible")}, {"disabled": ("bidi-control",)}, {"disabled": ("variation-selector-smuggling", "bidi-unbalanced"), "allowed": (0xE0041, 0xA0, 0x202E)}],
)
def test_one_call_repairs_as_passes_do(spark, options):
    rng = random.Random(len(str(options)))
    alphabet = [*map(ord, "aZ9 .:!\n\r"), 0x200B, 0x200C, 0x200C, 0x200D, 0x61C, 0x202E, 0x202C, 0x2066, 0x2069, 0xA0, 0x3000, 0x85, 0x1B, 0xFE0F, 0xFE00, 0xE0101, 0xE0158, 0xE0041, 0xE007F, 0x1F3F4, 0x1F600, 0x644, 0x94D, 0x915, 0x430, 0xFEFF, 0x2800, 0x2801, 0xAB]
    texts = ["".join(chr(rng.choice(alphabet)) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    flag = u(0x1F3F4) + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + u(0xE007F)
    texts += [flag, flag + u(0xE0041), flag[:1] + u(0x200B) + flag[1:], "x" + u(0x200B, 0xFE0F, 0x200B, 0xFE0E), u(0x200B, 0xFEFF) + "a"]
    bits = "".join("w" + (u(0xFE0F) if b == "1" else u(0xFE0E)) for c in "meet at 9" for b in f"{ord(c):08b}")
    texts += [bits, "x" + bits + u(0x200B) + "w" + u(0xFE0F), "".join("y" + chr(0xE0100 + b - 16) for b in b"attackers"), "y" + u(0xE0150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.fixed, r.passes) for r in repair.sanitize(docs, **options).collect()}
    want = by_passes(docs, **options)
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_ideographic_variants(spark):
    """Without a registry one selector after an ideograph stays; what spells a text goes."""
    assert fixed(spark, "\u845b" + u(0xE0100)).text == "\u845b" + u(0xE0100)
    carried = "".join("\u5c71" + chr(0xE0100 + b - 16) for b in b"attackers")
    assert fixed(spark, carried).text == "\u5c71" * 9
    assert fixed(spark, "a" + u(0xE0100)).text == "a"


def test_long_repairs(spark):
    assert fixed(spark, "a" + u(0xFE0F, 0x200B) * 200_000 + "b").text == "ab"
    row = fixed(spark, ":" + u(0x200B) + u(0x61C, 0x200C) * 20_000 + u(0x644))
    assert row.text == ":" + u(0x644)


def test_reveal(spark):
    docs = spark.createDataFrame([(1, f"a{u(0x202E)}b"), (2, "x"), (3, "z" + "".join(chr(0xE0000 + ord(c)) for c in "obey!"))], "doc_id long, text string")
    got = dict(repair.reveal(scanned(docs)).collect())
    assert got[1] == "a⟦U+202E RLO⟧b" and got[2] == "x"
    assert got[3] == 'z⟦U+E006F TAG o .. U+E0021 TAG ! (5 code points)⟧ → "obey!"'


def test_fix_preview(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc"), (2, "a\nb\nc\nd", "a\nc\nd"), (3, "same", "same"), (4, "x\ny", "")], "doc_id long, before string, after string")
    assert sorted(map(tuple, repair.fix_preview(pairs).collect())) == [(1, 2, "b", "B"), (2, 2, "b", ""), (4, 1, "x\ny", "")]


def test_merge(spark):
    kind = "doc_id long, findings array<struct<start_idx:long,end_idx:long>>"
    rows = spark.createDataFrame([(1, [(5, 9), (0, 2), (2, 3), (6, 7)]), (2, [(0, 1)]), (2, []), (None, [(4, 5), (5, 6)])], kind)
    got = [(r.doc_id, [tuple(s) for s in r.m]) for r in rows.select("doc_id", repair.merged_spans().alias("m")).collect()]
    assert got == [(1, [(0, 3), (5, 9)]), (2, [(0, 1)]), (2, []), (None, [(4, 6)])]
    assert [[tuple(s) for s in r.m] for r in rows.select(repair.merged_spans(2).alias("m")).collect()][0] == [(-2, 11)]


def test_policy_file(spark):
    blocks = policy.read_policy('{"rules": {"invisible": "info"}, "allow": ["U+00A0"], "overrides": [{"files": "docs/**", "rules": {"invisible": false}}]}')
    docs = spark.createDataFrame([(1, f"a{u(0x200B, 0xA0)}")], "doc_id long, text string")
    found = scan(docs)
    from pyspark.sql import functions as F

    for path, want in (("src/a", ["info"]), ("docs/x/a", [])):
        assert [r.severity for r in policy.by_path(found.withColumn("path", F.lit(path)), blocks).collect()] == want


@pytest.mark.parametrize("text", ['{"rule": {}}', '{"rules": {"nope": "error"}}', '{"rules": {"invisible": true}}', '{"allow": ["U+D800"]}', '{"allow": [1114112]}', '{"isCode": 1}'])
def test_policy_refused(text):
    with pytest.raises(ValueError):
        policy.read_policy(text)


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("a")
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "le.txt").write_bytes(b"\xff\xfe" + "hi\u200b".encode("utf-16-le"))
    (tmp_path / "be.txt").write_bytes(b"\xfe\xff" + "hi".encode("utf-16-be"))
    (tmp_path / "bad.txt").write_bytes(b"abc\xff\xffabc")
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfea")
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "skip.log").write_text("a")
    docs, skipped, errors = files.read_files(spark, str(tmp_path), ["*.log"])
    assert {r.path: (r.text, r.encoding) for r in docs.collect()} == {"a.txt": ("é", "utf-8"), "le.txt": ("hi\u200b", "utf-16le"), "be.txt": ("hi", "utf-16be")}
    assert {r.path: r.reason for r in skipped.collect()} == {"node_modules/x.js": "ignored", "bin.dat": "binary", "skip.log": "ignored"}
    assert {r.path for r in errors.collect()} == {"bad.txt", "odd.txt"}
    assert files.exit_status(scan(docs), errors) == 2 and files.exit_status(scan(docs), errors.limit(0)) == 0


def test_stream(spark, tmp_path):
    from glyphgate.streaming.scan import scan_stream

    spark.createDataFrame([(1, f"a{u(0x200B)}"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    scan_stream(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [(r.doc_id, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "invisible")]


def test_property_tables():
    assert sum(hi - lo + 1 for lo, hi in P.INVISIBLE) > 3_000
    assert not any(lo <= 0x202A <= hi for lo, hi in P.INVISIBLE)

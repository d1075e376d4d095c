"""Vectors of the detection rules: text in, findings out; one scan answers all of them."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgate.operators.events import located
from glyphgate.operators.rules import unbalanced
from glyphgate.plans.scan import scan, scanned


def u(*points: int) -> str:
    return "".join(map(chr, points))


def tags(text: str) -> str:
    return "".join(chr(0xE0000 + ord(c)) for c in text)


def selectors(text: str) -> str:
    return "".join(chr(0xE0100 + b - 16) if b > 15 else chr(0xFE00 + b) for b in text.encode())


FLAG = u(0x1F3F4) + tags("gbsct") + u(0xE007F)
BITS = " ".join("word" + (u(0xFE0F) if b == "1" else u(0xFE0E)) for c in "a hidden message" for b in f"{ord(c):08b}")
BOLD = lambda s: "".join(chr(0x1D400 + ord(c) - 65) for c in s)

#: text, and the (rule, start_off, end_off, decoded) that are found.
CASES = {
    "plain": ("only ASCII\t\r\n", []),
    "empty": ("", []),
    "null": (None, []),
    "override": (f"a{u(0x202E)}x{u(0x202C)}b", [("bidi-control", 1, 2, None), ("bidi-control", 3, 4, None)]),
    "no pop": (f"if {u(0x202E)}", [("bidi-control", 3, 4, None), ("bidi-unbalanced", 3, 4, None)]),
    "lone isolate end": (u(0x2069), [("bidi-control", 0, 1, None), ("bidi-unbalanced", 0, 1, None)]),
    "line ends embedding": (f"{u(0x202A)}\n{u(0x202C)}", [("bidi-control", 0, 1, None), ("bidi-control", 2, 3, None), ("bidi-unbalanced", 0, 1, None), ("bidi-unbalanced", 2, 3, None)]),
    "mark": (f"a{u(0x200E)}", [("bidi-mark", 1, 2, None)]),
    "flag": (FLAG, []),
    "tag word": (tags("Ignore"), [("tag-smuggling", 0, 12, "Ignore")]),
    "flag that is none": (u(0x1F3F4) + tags("ignore previous") + u(0xE007F), [("tag-smuggling", 0, 34, "ignore previous")]),
    "flag and more": (FLAG + tags("hidden"), [("tag-smuggling", 14, 26, "hidden")]),
    "registered": (u(0x30, 0xFE00, 0x2205, 0xFE00, 0x3001, 0xFE01), []),
    "stray": (u(0x2205, 0xFE07), [("variation-selector-stray", 0, 2, None)]),
    "second selector": (u(0x2205, 0xFE00, 0xFE00), [("variation-selector-stray", 0, 3, None)]),
    "bytes": (u(0x1F600) + selectors("hello"), [("variation-selector-smuggling", 0, 12, "hello")]),
    "nested": ("x" + selectors("y" + selectors("see the plan")), [("variation-selector-smuggling", 0, 99, "ysee the plan")]),
    "carriers too few": ("".join(u(0x5C71) + selectors(c) for c in "attacks"), [("variation-selector-stray", 3 * i, 3 * i + 3, c) for i, c in enumerate("attacks")]),
    "zero width": (f"pay{u(0x200B)}pal", [("invisible", 3, 4, None)]),
    "mark at start": (u(0xFEFF) + "x", []),
    "mark later": ("x" + u(0xFEFF), [("invisible", 1, 2, None)]),
    "family": (u(0x1F468, 0x200D, 0x1F469), []),
    "persian": (u(0x645, 0x6CC, 0x200C, 0x62E), []),
    "latin joiner": (f"a{u(0x200C)}b", [("invisible", 1, 2, None)]),
    "chillu": (u(0xD28, 0xD4D, 0x200D), []),
    "spaces": (f"a{u(0xA0)}b{u(0x3000)}c", [("unusual-whitespace", 1, 2, None), ("unusual-whitespace", 3, 4, None)]),
    "french": (f"oui{u(0xA0)}! {u(0xAB, 0xA0)}x", []),
    "braille": (u(0x2801, 0x2800, 0x2802), []),
    "cjk space": (u(0x4E00, 0x3000) + "a", []),
    "controls": ("a\x1b\x00\x7f", [("control-character", 1, 2, None), ("control-character", 2, 3, None)]),
    "next line": ("a\x85", [("unusual-whitespace", 1, 2, None)]),
    "mixed": (f"p{u(0x430)}ypal", [("confusable", 0, 6, None)]),
    "greek mixed": (f"g{u(0x3BF)}ogle", [("confusable", 0, 6, None)]),
    "greek letter": ("LaTeX2" + u(0x3B5), []),
    "same word": (f"cop{u(0xE9)} {u(0x441, 0x43E, 0x440, 0x435, 0x301)}", [("confusable", 0, 4, None), ("confusable", 5, 10, None)]),
    "two forms": (f"caf{u(0xE9)} cafe{u(0x301)}", []),
    "dotless": (f"adm{u(0x131)}n admin", [("confusable", 0, 5, None), ("confusable", 6, 11, None)]),
    "ascii pairs": ("modern rnodern l1 I1", []),
    "escape": ("\\n" + u(0x3B1, 0x3B2) + " y", []),
    "styled": (f"say {BOLD('HELLO')} {BOLD('ALL')} now", [("styled-text", 4, 21, "HELLO ALL")]),
    "styled short": (f"a {BOLD('OK')}", []),
    "circled digits": (u(0x2460, 0x2461, 0x2462, 0x2463), []),
    "breaks": (f"a\r\nb\rc\n{u(0x1F600)}{u(0x200B)}", [("invisible", 9, 10, None)]),
}
NAMES = list(CASES)


def walked(text: str, idx: int) -> tuple[int, int, int]:
    """off, line and col of a place by walking the text."""
    off, line, col = 0, 1, 1
    for i, c in enumerate(text[:idx]):
        width = 1 + (ord(c) > 0xFFFF)
        off, col = off + width, col + width
        if c == "\n" or (c == "\r" and text[i + 1 : i + 2] != "\n"):
            line, col = line + 1, 1
    return off, line, col


def test_positions_of_random_texts_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    alphabet = ["a", "é", "\n", "\r", "\r\n", "\U0001f600", "\u200b", "\u2028", "\u0085", "\u202e", "\ufe00", "\U000e0041", "pаy", "ｆｕｌｌ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(None if i % 3 == 0 else 7, i, t) for i, t in enumerate(texts)] + [(None, -1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, no long, text string").repartition(3)
    for r in located(docs).collect():
        text = texts[r.no]
        assert text[r.idx] == r.ch and (r.off, r.line, r.col) == walked(text, r.idx)
    got = scan(docs, keep=("doc_id", "no")).collect()
    assert len(got) > 500
    order = {}
    for r in got:
        text = texts[r.no]
        assert (r.start_off, r.start_line, r.start_col) == walked(text, r.start_idx) and (r.end_off, r.end_line, r.end_col) == walked(text, r.end_idx)
        assert r.doc_id == (None if r.no % 3 == 0 else 7)
        order.setdefault(r.no, []).append((r.seq, r.start_off, r.rule))
    for found in order.values():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_every_row_stays(spark):
    docs = spark.createDataFrame([(5, "a\u200bb"), (5, "cc\n\u200b"), (None, "x"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "", len(r.findings)) for r in scanned(docs).collect())
    assert got == [("5", "a\u200bb", 1), ("5", "cc\n\u200b", 1), ("None", "", 0), ("None", "x", 0)]
    assert sorted(r.start_idx for r in scan(docs).collect()) == [1, 3]
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_code_by_row(spark):
    docs = spark.createDataFrame([(1, "café cafe\u0301", True), (2, "café cafe\u0301", False), (3, "café cafe\u0301", None)], "doc_id long, text string, is_code boolean")
    assert [r.doc_id for r in scan(docs, code=F.col("is_code")).collect()] == [1, 1]


def test_written_in_turkish(spark):
    words = " ".join(f"kap{u(0x131)}{c}" for c in "abcdefghijkl")
    docs = spark.createDataFrame([(1, f"adm{u(0x131)}n admin {words}"), (2, f"adm{u(0x131)}n admin")], "doc_id long, text string")
    assert {r.doc_id for r in scan(docs).collect()} == {2}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, CASES[n][0]) for i, n in enumerate(NAMES)] + [(900, BITS), (901, "".join(u(0x5C71) + selectors(c) for c in "attackers"))], "doc_id long, text string")
    return scan(docs).collect()


@pytest.mark.parametrize("name", NAMES)
def test_case(found, name):
    got = sorted((r.rule, r.start_off, r.end_off, r.decoded or "") for r in found if r.doc_id == NAMES.index(name))
    assert got == sorted((a, b, c, d or "") for a, b, c, d in CASES[name][1])


def test_positions_and_severities(found):
    at = {r.doc_id: r for r in found}
    r = at[NAMES.index("breaks")]
    assert (r.start_line, r.start_col, r.start_idx) == (4, 3, 8)
    severities = {(r.rule, r.severity) for r in found}
    assert {("bidi-control", "error"), ("invisible", "warning"), ("control-character", "error"), ("control-character", "warning"), ("confusable", "error"), ("confusable", "warning")} <= severities


def test_streams(found):
    bits = [r for r in found if r.doc_id == 900]
    assert len(bits) == 128 and {r.rule for r in bits} == {"variation-selector-smuggling"}
    assert [r.decoded for r in sorted(bits, key=lambda r: r.start_idx)][:2] == ["a hidden message", None]
    carried = sorted((r for r in found if r.doc_id == 901), key=lambda r: r.start_idx)
    assert [r.decoded for r in carried] == ["attackers"] + [None] * 8


def test_removal_leaves_bases(found):
    r = next(r for r in found if r.doc_id == NAMES.index("flag that is none"))
    assert (r.removal_start, r.removal_end) == (1, 17)
    r = next(r for r in found if r.doc_id == NAMES.index("second selector"))
    assert (r.removal_start, r.removal_end) == (2, 3)


@pytest.mark.parametrize(
    ("points", "loose"),
    [
        ([0x202A, 0x202C], []),
        ([0x202C, 0x202A], [0, 1]),
        ([0x2066, 0x202A, 0x2069], []),
        ([0x2066, 0x202C, 0x2069], [1]),
        ([0x202A, 0x2066, 0x202C, 0x2069, 0x202C], [2]),
        ([0x2066, 0x2067, 0x2069], [0]),
        ([0x202A, 0x0A, 0x202C], [0, 2]),
        ([0x2066, 0x202A, 0x0D, 0x2069], [0, 1, 3]),
        ([], []),
    ],
)
def test_balance(points, loose):
    assert np.flatnonzero(unbalanced(np.array(points, np.int64), np.zeros(len(points), np.int64))).tolist() == loose


def slow_balance(points):
    """Cut balanced parts out of a text until nothing changes; what is left, or goes alone, is loose."""
    names = {0x2066: "i", 0x2067: "i", 0x2069: "I", 0x202A: "e", 0x202E: "e", 0x202C: "E", 0x0A: "n", 0x0D: "n"}
    left, loose = [(i, names[p]) for i, p in enumerate(points)], []
    while True:
        text = "".join(c for _, c in left)
        if found := re.search("(?:^|n)[eE]*(I)", text):  # ends no isolate
            loose.append(left[found.start(1)][0])
            cut = found.span(1)
        elif found := re.search("eE", text):
            cut = found.span()
        elif found := re.search("i[eE]*I", text):
            loose += [i for i, c in left[found.start() : found.end()] if c == "E"]
            cut = found.span()
        else:
            return sorted(loose + [i for i, c in left if c != "n"])
        left = left[: cut[0]] + left[cut[1] :]


def test_balance_of_random_controls():
    rng = random.Random(8)
    rows = [[rng.choice((0x2066, 0x2067, 0x2069, 0x202A, 0x202E, 0x202C, 0x2069, 0x202C, 0x0A, 0x0D)) for _ in range(rng.randint(0, 40))] for _ in range(2000)]
    want = list(map(slow_balance, rows))
    flat, owner = np.array([p for r in rows for p in r]), np.array([i for i, r in enumerate(rows) for _ in r])
    got = [[] for _ in rows]
    begin = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    for at in np.flatnonzero(unbalanced(flat, owner)):
        got[owner[at]].append(int(at - begin[owner[at]]))
    assert got == want

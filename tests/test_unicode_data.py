"""The default tables of lookalikes and scripts, and texts of a length that recursion would not survive."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphgate.functions.unicode_data import tables
from glyphgate.plans.scan import scan


@pytest.fixture(scope="module")
def known(spark):
    return tables()


# Spellings and the skeletons that the published data give them.
SKELETONS = {
    "copé": "copé", "соре́": "copé", "сорё": "copë", "Τόρο": "Tópo", "cafẹ́": "cafẹ́", "cа̀": "cà",
    "cà̕": "cà̓", "admın": "adrnin", "admín": "adrnín", "ѕсоре": "scope", "сорѐ": "copè", "όρο": "ópo", "modern": "rnodern", "rnodern": "rnodern",
    "ｃａｆé": "caｆé", "𝐩aypal": "paypal", "1l|I0": "llllO", "ℓ": "l", "ꓮ": "A", "ﬁ": "fi",
}


@pytest.mark.parametrize("word", SKELETONS)
def test_skeletons(known, word):
    assert known.skeleton(word) == SKELETONS[word]


def test_scripts(known):
    assert known.script_of("ʼ") == "Common"
    assert known.scripts_of("ʼ") == ("Bengali", "Cyrillic", "Devanagari", "Latin", "Lisu", "Thai", "Toto")
    assert (known.script_of("ー"), known.scripts_of("ー")) == ("Common", ("Hiragana", "Katakana"))
    assert (known.script_of("͂"), known.scripts_of("͂")) == ("Inherited", ("Greek",))
    assert known.scripts_of("A") == ("Latin",) and known.scripts_of("\U0010ffff") == ("Unknown",)
    assert len(known.confusables) > 5000


def test_mixed_words(known):
    for word in ("обʼєкт", "пʼєса", "JavaScriptは", "READMEを", "LaTeXπ", "snake_case_ПРИВЕТ", "한국어API", "ありがとうー", "יְLinux"):
        assert not known.forms(word)["mixed"], word
    for word in ("paypаl", "pаyʼpаl", "а͂", "cловарь", "x_paypаl_y", "ꓮpple", "Ꭱed"):
        assert known.forms(word)["mixed"], word
    assert known.forms("kapı")["turkic"] and not known.forms("каpı")["turkic"]


LONG = 60_000
PASSAGE = "".join(map(chr, (0x1D41A, 0x1D41B, 0x20)))
TEXTS = {
    "passage of short words": (PASSAGE * LONG, {("styled-text", 1)}),
    "passage with wide gaps": ((PASSAGE + "- -") * LONG, set()),
    "token": ("а" * LONG, set()),
    "mixed token": ("аb" * LONG, {("confusable", 1)}),
    "tags": (chr(0xE0061) * LONG, {("tag-smuggling", 1)}),
    "selectors": ("x" + chr(0xFE0E) * LONG, {("variation-selector-stray", 1)}),
    "carriers": ((chr(0x5C71) + chr(0xE0101)) * (LONG // 10), {("variation-selector-stray", LONG // 10)}),
    "zero width": (chr(0x200B) * LONG, {("invisible", LONG)}),
    "controls": (chr(0x202A) * LONG, {("bidi-control", LONG), ("bidi-unbalanced", LONG)}),
    "line breaks": ("\r\n" * LONG + chr(0x85), {("unusual-whitespace", 1)}),
    "marks": ("e" + chr(0x301) * LONG, set()),
    "connectors": ("_" * LONG + "é", set()),
}


def test_long_texts(spark):
    """One run, token, passage or payload as long as a text is scanned by every rule."""
    docs = spark.createDataFrame([(name, text) for name, (text, _) in TEXTS.items()], "doc_id string, text string").repartition(4)
    found = {}
    for r in scan(docs).groupBy("doc_id", "rule").agg(F.count("*").alias("n")).collect():
        found.setdefault(r.doc_id, set()).add((r.rule, r.n))
    assert {name: found.get(name, set()) for name in TEXTS} == {name: want for name, (_, want) in TEXTS.items()}


def test_passages(spark):
    """Islands join over one to three characters that are no letter or digit; what ends in nothing styled ends before the gap."""
    bold = lambda s: "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in s)
    texts = {
        bold("one, two - three") + "!": ["one, two - three"], bold("abc") + " x " + bold("def"): ["abc", "def"], bold("abc") + "    " + bold("def"): ["abc", "def"],
        "ⓐ-ⓑ-ⓒ.": ["a-b-c"], "ⓐⓑ": [], "あａｂｃ": [], "ａｂｃ x": ["abc"], "ᴀʙᴄ": ["abc"], "\U0001f170\U0001f171\U0001f14f": ["ABWC"],
        "\U0001d6fc" + bold("abc"): ["\U0001d6fcabc"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {i: [] for i in range(len(texts))}
    for r in scan(docs).where("rule = 'styled-text'").orderBy("doc_id", "start_idx").collect():
        got[r.doc_id].append(r.decoded)
    assert list(got.values()) == list(texts.values())

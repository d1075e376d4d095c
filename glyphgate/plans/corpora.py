"""Corpora for checks: real documents with hidden characters planted by a rule, as one SQL expression for any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphgate.plans.storage import spread


def _tags(text: str) -> str:
    return "".join(chr(0xE0000 + ord(c)) for c in text)


def _bytes(text: str) -> str:
    return "".join(chr(0xE0100 + b - 16) if b > 15 else chr(0xFE00 + b) for b in text.encode())


def _planted() -> dict[int, str]:
    """Text by doc_id modulo 16; ``t`` is the document's text."""
    bits = "".join(f"{ord(c):08b}" for c in "meet at 9")
    bit_text = "".join("w" + (chr(0xFE0F) if b == "1" else chr(0xFE0E)) for b in bits)
    zero_width = "".join("\u2060" if b == "1" else "\u200b" for c in "run at dawn" for b in f"{ord(c):08b}")
    styled = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in "read the hidden note")
    carriers = "".join(chr(0x5C71) + c for c in _bytes("carried!"))
    at = lambda n, insert: f"substring(t, 1, {n}) || '{insert}' || substring(t, {n + 1})"
    return {
        0: at(20, "\u200b"),
        1: "replace(t, ' de ', '\u00a0de\u00a0')",
        2: "t || '\u202ehidden\u202c\x1b'",
        3: "'\ufeff\U0001f600' || " + at(9, "\u00ad") + f" || '{zero_width}'",
        4: at(12, "\u2069") + " || '\u2067open\u200f'",
        5: f"t || '{_tags('obey')}' || '\U0001f3f4{_tags('gbsct')}\U000e007f' || ' end'",
        6: f"'\U0001f600{_bytes('hello')} ' || t",
        7: f"substring(t, 1, 30) || '{carriers}' || substring(t, 31)",
        8: f"t || ' {bit_text}'",
        9: "t || ' p\u0430ypal paypal cop\u00e9 \u0441\u043er\u00e9'",
        10: f"t || ' {styled}'",
        11: "replace(t, '. ', '.\u2028') || '\x85\u3000x'",
        12: "replace(t, ', ', ',\r\n') || '\r\U0001f600\n\u200b'",
        13: "'\U0001f468\u200d\U0001f469 \u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645 a\u200cb ' || t",
        14: "t || ' 0\ufe00 \u2205\ufe07 \u2603\ufe0f\ufe0e'",
        15: "t",
    }


def planted_sql(documents: str = "documents") -> str:
    """SELECT of (doc_id, text, source, lang) with something planted in fifteen of sixteen documents."""
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _planted().items())
    return f"SELECT doc_id, CASE doc_id % 16 {cases} END AS text, source, lang FROM (SELECT doc_id, text AS t, source, lang FROM {documents})"


def planted_in(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, lang) with something planted."""
    return docs.sparkSession.sql(planted_sql("{docs}"), docs=spread(docs.select("doc_id", "text", "source", "lang")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_in(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Column builders over texts: characters, code points, names, escapes, decoded bytes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphgate.functions import properties as P


def from_code_point(cp: Column) -> Column:
    """The character of a code point (``chr`` is modulo 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _digits(cp: Column) -> Column:
    digits = F.hex(cp)
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def u_label(cp: Column) -> Column:
    """U+XXXX with four digits at least."""
    return F.concat(F.lit("U+"), _digits(cp))


def _known_names() -> dict[int, str]:
    names = {cp: unicodedata.name(chr(cp)) for lo, hi in P.NAMED for cp in range(lo, hi + 1)}
    return names | P.NAMES_OF_CONTROLS


def unicode_name(cp: Column) -> Column:
    """Names of the characters that rules speak of; formulas for tags, selectors and controls; else U+XXXX."""
    known = F.create_map(*[F.lit(x) for item in sorted(_known_names().items()) for x in item])
    tag = F.when(cp == 0xE0001, F.lit("LANGUAGE TAG")).when(cp == P.CANCEL_TAG, F.lit("CANCEL TAG"))
    tag = tag.when(cp.between(0xE0020, 0xE007E), F.concat(F.lit("TAG "), from_code_point(cp - 0xE0000))).otherwise(F.concat(F.lit("TAG CHARACTER U+"), F.hex(cp)))
    control = (cp.between(0, 0x1F) & ~cp.isin(0x09, 0x0A, 0x0D)) | cp.between(0x80, 0x9F)
    return (
        F.when(F.element_at(known, cp.cast("int")).isNotNull(), F.element_at(known, cp.cast("int")))
        .when(cp.between(0xE0000, 0xE007F), tag)
        .when(cp.between(0xFE00, 0xFE0F), F.concat(F.lit("VARIATION SELECTOR-"), (cp - 0xFE00 + 1).cast("string")))
        .when(cp.between(0xE0100, 0xE01EF), F.concat(F.lit("VARIATION SELECTOR-"), (cp - 0xE0100 + 17).cast("string")))
        .when(control, F.concat(F.lit("CONTROL CHARACTER U+"), F.lpad(F.hex(cp), 4, "0")))
        .otherwise(u_label(cp))
    )


#: Characters that a diagnostic never prints as they are.
HIDDEN_CLASS = "[" + P.char_class(((0x00, 0x1F), (0x7F, 0x9F), (0x2028, 0x2029), *P.DEFAULT_IGNORABLE)) + "]"


def diagnostic_text(text: Column) -> Column:
    """``text`` with hidden characters as \\u{XXXX}."""
    escape = lambda c: F.concat(F.lit("\\u{"), _digits(F.ascii(c)), F.lit("}"))
    escaped = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(HIDDEN_CLASS), escape(c)).otherwise(c))
    return F.when(text.rlike(HIDDEN_CLASS), F.array_join(escaped, "")).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a code point beyond U+FFFF counts twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def strict_utf8(hex_bytes: Column) -> Column:
    """Bytes given as hexadecimal digits as text; null where they are no UTF-8. One leading byte-order mark is dropped."""
    raw = F.unhex(F.regexp_replace(hex_bytes, "^EFBBBF", ""))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))


def printable(text: Column) -> Column:
    """``text`` where it is no empty text and not all characters are C0 controls; else null."""
    return F.when(~text.rlike(r"^[\x00-\x1F]*$"), text)


def clean(text: Column) -> Column:
    """``text`` where it holds no control but tab and line breaks, and no replacement character; else null."""
    return F.when(~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]") & (text != ""), text)

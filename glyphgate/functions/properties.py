"""Unicode properties as value ranges, and how to turn them into SQL predicates and regular expressions.

Small property lists stand here as fixed values. Large tables (all confusables, variation sequences, script extensions)
are parameters: ``functions.unicode_data`` reads the public data files, or derives a default by rule.
"""

from __future__ import annotations

import re

Ranges = tuple[tuple[int, int], ...]

# Unicode character properties and code points.
EMBEDDINGS: Ranges = ((0x202A, 0x202B), (0x202D, 0x202E))
POP_EMBEDDING = 0x202C
ISOLATES: Ranges = ((0x2066, 0x2068),)
POP_ISOLATE = 0x2069
EXPLICIT_BIDI: Ranges = ((0x202A, 0x202E), (0x2066, 0x2069))
BIDI_MARKS: Ranges = ((0x061C, 0x061C), (0x200E, 0x200F))
TAGS: Ranges = ((0xE0000, 0xE007F),)
SELECTORS: Ranges = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
FLAG_BASE, CANCEL_TAG = 0x1F3F4, 0xE007F
FLAG_SEQUENCES = ("gbeng", "gbsct", "gbwls")
DEFAULT_IGNORABLE: Ranges = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
SCRIPT_MARKS: Ranges = ((0x17B4, 0x17B5), (0x180B, 0x180D))
ZWNJ, ZWJ, BOM = 0x200C, 0x200D, 0xFEFF
JOINING_SCRIPTS = (
    "Arabic", "Syriac", "Nko", "Mandaic", "Manichaean", "Psalter_Pahlavi", "Sogdian", "Hanifi_Rohingya", "Adlam", "Hebrew", "Devanagari", "Bengali", "Gurmukhi",
    "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Tibetan", "Myanmar", "Khmer", "Javanese", "Balinese", "Limbu", "Buginese",
)
OLD_UYGHUR: Ranges = ((0x10F70, 0x10F89),)  # a joining script that older engines do not know by name
VIRAMAS = (0x094D, 0x09CD, 0x0A4D, 0x0ACD, 0x0B4D, 0x0BCD, 0x0C4D, 0x0CCD, 0x0D4D, 0x0DCA, 0x0F84, 0x1039, 0x103A, 0x17D2, 0x1B44, 0xA9C0)
UNUSUAL_SPACES: Ranges = ((0x85, 0x85), (0xA0, 0xA0), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
NO_BREAK_SPACES = (0xA0, 0x202F)
SPACED_AFTER = (0x21, 0x3A, 0x3B, 0x3F, 0xBB)
OPEN_GUILLEMET, BRAILLE_BLANK, IDEOGRAPHIC_SPACE, ESCAPE = 0xAB, 0x2800, 0x3000, 0x1B
BRAILLE: Ranges = ((0x2801, 0x28FF),)
EAST_ASIAN: Ranges = (
    (0x2E80, 0x303F), (0x3040, 0x30FF), (0x3100, 0x318F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF),
    (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x2FA1F),
)
CONTROLS: Ranges = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x80, 0x84), (0x86, 0x9F))
LINE_MAKERS = (0x85, 0x2028, 0x2029)
EMOJI: Ranges = (
    (0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199),
    (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6),
    (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x2604), (0x260E, 0x260E), (0x2611, 0x2611), (0x2614, 0x2615), (0x2618, 0x2618), (0x261D, 0x261D), (0x2620, 0x2620),
    (0x2622, 0x2623), (0x2626, 0x2626), (0x262A, 0x262A), (0x262E, 0x262F), (0x2638, 0x263A), (0x2640, 0x2640), (0x2642, 0x2642), (0x2648, 0x2653), (0x265F, 0x2660),
    (0x2663, 0x2663), (0x2665, 0x2666), (0x2668, 0x2668), (0x267B, 0x267B), (0x267E, 0x267F), (0x2692, 0x2697), (0x2699, 0x2699), (0x269B, 0x269C), (0x26A0, 0x26A1),
    (0x26A7, 0x26A7), (0x26AA, 0x26AB), (0x26B0, 0x26B1), (0x26BD, 0x26BE), (0x26C4, 0x26C5), (0x26C8, 0x26C8), (0x26CE, 0x26CF), (0x26D1, 0x26D1), (0x26D3, 0x26D4),
    (0x26E9, 0x26EA), (0x26F0, 0x26F5), (0x26F7, 0x26FA), (0x26FD, 0x26FD), (0x2702, 0x2702), (0x2705, 0x2705), (0x2708, 0x270D), (0x270F, 0x270F), (0x2712, 0x2712),
    (0x2714, 0x2714), (0x2716, 0x2716), (0x271D, 0x271D), (0x2721, 0x2721), (0x2728, 0x2728), (0x2733, 0x2734), (0x2744, 0x2744), (0x2747, 0x2747), (0x274C, 0x274C),
    (0x274E, 0x274E), (0x2753, 0x2755), (0x2757, 0x2757), (0x2763, 0x2764), (0x2795, 0x2797), (0x27A1, 0x27A1), (0x27B0, 0x27B0), (0x27BF, 0x27BF), (0x2934, 0x2935),
    (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004),
    (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F1E6, 0x1F1FF), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251), (0x1F300, 0x1F321), (0x1F324, 0x1F393), (0x1F396, 0x1F397), (0x1F399, 0x1F39B), (0x1F39E, 0x1F3F0),
    (0x1F3F3, 0x1F3F5), (0x1F3F7, 0x1F4FD), (0x1F4FF, 0x1F53D), (0x1F549, 0x1F54E), (0x1F550, 0x1F567), (0x1F56F, 0x1F570), (0x1F573, 0x1F57A), (0x1F587, 0x1F587),
    (0x1F58A, 0x1F58D), (0x1F590, 0x1F590), (0x1F595, 0x1F596), (0x1F5A4, 0x1F5A5), (0x1F5A8, 0x1F5A8), (0x1F5B1, 0x1F5B2), (0x1F5BC, 0x1F5BC), (0x1F5C2, 0x1F5C4),
    (0x1F5D1, 0x1F5D3), (0x1F5DC, 0x1F5DE), (0x1F5E1, 0x1F5E1), (0x1F5E3, 0x1F5E3), (0x1F5E8, 0x1F5E8), (0x1F5EF, 0x1F5EF), (0x1F5F3, 0x1F5F3), (0x1F5FA, 0x1F64F),
    (0x1F680, 0x1F6C5), (0x1F6CB, 0x1F6D2), (0x1F6D5, 0x1F6D8), (0x1F6DC, 0x1F6E5), (0x1F6E9, 0x1F6E9), (0x1F6EB, 0x1F6EC), (0x1F6F0, 0x1F6F0), (0x1F6F3, 0x1F6FC),
    (0x1F7E0, 0x1F7EB), (0x1F7F0, 0x1F7F0), (0x1F90C, 0x1F93A), (0x1F93C, 0x1F945), (0x1F947, 0x1F9FF), (0x1FA70, 0x1FA7C), (0x1FA80, 0x1FA8A), (0x1FA8E, 0x1FAC6),
    (0x1FAC8, 0x1FAC8), (0x1FACD, 0x1FADC), (0x1FADF, 0x1FAEA), (0x1FAEF, 0x1FAF8),
)
REGIONAL_INDICATORS: Ranges = ((0x1F1E6, 0x1F1FF),)
SMALL_CAPITALS = {
    0x1D00: "a", 0x0299: "b", 0x1D04: "c", 0x1D05: "d", 0x1D07: "e", 0xA730: "f", 0x0262: "g", 0x029C: "h", 0x026A: "i", 0x1D0A: "j", 0x1D0B: "k", 0x029F: "l",
    0x1D0D: "m", 0x0274: "n", 0x1D0F: "o", 0x1D18: "p", 0x0280: "r", 0xA731: "s", 0x1D1B: "t", 0x1D1C: "u", 0x1D20: "v", 0x1D21: "w", 0x028F: "y", 0x1D22: "z",
}
STYLED: Ranges = ((0x24B6, 0x24E9), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x1D400, 0x1D7FF), (0x1F130, 0x1F189))
STYLED_EAST_ASIAN: Ranges = ((0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF61, 0xFFDC))
FULLWIDTH: Ranges = ((0xFF00, 0xFFEF),)
ABBREVIATIONS = {
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI", 0x200E: "LRM",
    0x200F: "RLM", 0x061C: "ALM", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WJ", 0xFEFF: "BOM", 0x00A0: "NBSP", 0x00AD: "SHY", 0x034F: "CGJ",
    0x180E: "MVS", 0x0085: "NEL", 0x3164: "HF", 0xFFA0: "HHF", 0x115F: "HCF", 0x1160: "HJF", 0x001B: "ESC",
}
NAMES_OF_CONTROLS = {0x0000: "NULL", 0x0007: "BELL", 0x0008: "BACKSPACE", 0x001B: "ESCAPE", 0x007F: "DELETE", 0x0085: "NEXT LINE (NEL)"}
NAMED: Ranges = (
    (0x202A, 0x202E), (0x2066, 0x2069), (0x200E, 0x200F), (0x061C, 0x061C), (0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x180E, 0x180E), (0x200B, 0x200D),
    (0x2060, 0x2064), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x2800, 0x2800), (0x00A0, 0x00A0), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000), (0x1F3F4, 0x1F3F4),
)
RULES = (
    "bidi-control", "bidi-mark", "bidi-unbalanced", "tag-smuggling", "variation-selector-smuggling", "variation-selector-stray", "invisible", "confusable",
    "styled-text", "unusual-whitespace", "control-character",
)
NOT_FIXABLE = ("confusable", "styled-text")
BY_CHARACTER = ("invisible", "unusual-whitespace", "control-character", "bidi-control", "bidi-mark")
#: A text without such a character has no finding.
UNPLAIN = r"[^\t\n\r\x20-\x7E]"


def subtract(ranges: Ranges, *away: Ranges) -> Ranges:
    out = set()
    for lo, hi in ranges:
        out |= set(range(lo, hi + 1))
    for other in away:
        for lo, hi in other:
            out -= set(range(lo, hi + 1))
    return merged(out)


def merged(points: set[int]) -> Ranges:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((lo, hi) for lo, hi in out)


INVISIBLE = subtract(DEFAULT_IGNORABLE, EXPLICIT_BIDI, BIDI_MARKS, TAGS, SELECTORS, SCRIPT_MARKS)


def within(column: str, ranges: Ranges) -> str:
    """SQL predicate, the same in Spark and DuckDB."""
    return "(" + " OR ".join(f"{column} = {lo}" if lo == hi else f"{column} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")"


def one_of(column: str, values: tuple[int, ...]) -> str:
    return f"{column} IN ({', '.join(map(str, values))})"


def char_class(ranges: Ranges, points: tuple[int, ...] = ()) -> str:
    """The inside of a regular expression's character class, for Java and RE2."""
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "".join(rf"\x{{{p:X}}}" for p in points)


class Dialect:
    """The few places in which Spark SQL and DuckDB SQL differ."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def match(self, column: str, pattern: str) -> str:
        return f"({column} RLIKE r'{pattern}')" if self.spark else f"regexp_matches({column}, '{pattern}')"

    def script(self, name: str) -> str:
        return rf"\p{{Is{name}}}" if self.spark else rf"\p{{{name}}}"

    def scripts(self, names: tuple[str, ...]) -> str:
        return "".join(map(self.script, names))


SPARK, DUCKDB = Dialect(True), Dialect(False)


def invisible_predicate(d: Dialect) -> str:
    """Of an event (cp, idx, prev_cp, next_cp, prev_ch, next_ch): an invisible character that its context does not explain."""
    joining = f"[{d.scripts(JOINING_SCRIPTS)}{char_class(OLD_UYGHUR)}]"
    not_hebrew = f"[{d.scripts(tuple(s for s in JOINING_SCRIPTS if s != 'Hebrew'))}{char_class(OLD_UYGHUR)}]"
    like_emoji = f"^[{char_class(EMOJI + ((0xFE0F, 0xFE0F),))}]$"
    alnum = "[0-9A-Za-z]"
    context = f"""(
        (cp = {ZWJ} AND {d.match('prev_ch', like_emoji)} AND {d.match('next_ch', like_emoji)})
        OR ({d.match('prev_ch', joining)} AND {d.match('next_ch', joining)})
        OR (cp = {ZWNJ} AND (({d.match('prev_ch', f'^{alnum}$')} AND {d.match('next_ch', not_hebrew)})
                             OR ({d.match('prev_ch', not_hebrew)} AND {d.match('next_ch', f'^{alnum}$')})))
        OR {one_of('prev_cp', VIRAMAS)})"""
    return f"({within('cp', INVISIBLE)} AND NOT (cp = {BOM} AND idx = 0) AND NOT (cp IN ({ZWNJ}, {ZWJ}) AND coalesce({context}, false)))"


def whitespace_predicate() -> str:
    french = f"({one_of('cp', NO_BREAK_SPACES)} AND (coalesce({one_of('next_cp', SPACED_AFTER)}, false) OR coalesce(prev_cp = {OPEN_GUILLEMET}, false)))"
    east = f"(cp = {IDEOGRAPHIC_SPACE} AND (coalesce({within('prev_cp', EAST_ASIAN)}, false) OR coalesce({within('next_cp', EAST_ASIAN)}, false)))"
    braille = f"(coalesce({within('prev_cp', BRAILLE)}, false) OR coalesce({within('next_cp', BRAILLE)}, false))"
    return f"(({within('cp', UNUSUAL_SPACES)} AND NOT {french} AND NOT {east}) OR (cp = {BRAILLE_BLANK} AND NOT {braille}))"


def control_predicate() -> str:
    return within("cp", CONTROLS)


def single_rule(d: Dialect) -> str:
    """The rule that a single character of an event breaks, or null."""
    return f"""CASE WHEN {within('cp', EXPLICIT_BIDI)} THEN 'bidi-control' WHEN {within('cp', BIDI_MARKS)} THEN 'bidi-mark'
        WHEN {invisible_predicate(d)} THEN 'invisible' WHEN {whitespace_predicate()} THEN 'unusual-whitespace'
        WHEN {control_predicate()} THEN 'control-character' END"""


def of_event(predicate: str, name: str) -> str:
    """A predicate over event columns as one over the fields of the lambda variable ``name``."""
    return re.sub(r"\b(cp|idx|prev_cp|next_cp|prev_ch|next_ch)\b", rf"{name}.\1", predicate)


SINGLE_SEVERITY = f"CASE WHEN rule = 'bidi-control' OR cp = {ESCAPE} THEN 'error' ELSE 'warning' END"
#: Characters that can start or end a finding, break a line or take two UTF-16 units.
EVENT_CLASS = "[" + char_class(((0x00, 0x08), (0x0A, 0x1F), (0x7F, 0xA0), *INVISIBLE, *EXPLICIT_BIDI, *BIDI_MARKS, *SELECTORS[:1], (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x2800, 0x2800), (0x3000, 0x3000), (0x10000, 0x10FFFF))) + "]"

"""Large Unicode tables: of the ICU library that Spark carries, or read from public data files where a folder is given.

ICU's public classes are asked on the driver, in a few hundred calls, once for each process: the skeletons of all
characters in one call, and the characters of each script in one each. What comes back is small (some 5,700 lookalikes
and 2,300 ranges of scripts, under a megabyte) and goes to the workers as a broadcast. With ``confusables.txt``,
``Scripts.txt``, ``ScriptExtensions.txt``, ``StandardizedVariants.txt`` and ``IVD_Sequences.txt`` in ``folder`` the results
follow those files. ICU knows no registered ideographic variants: without files they come from the compatibility
ideographs, which are registered one by one for the ideograph that they decompose to, and a short list.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.java_gateway import launch_gateway

# Script sets that may share a word, scripts that Latin may be joined by, and values that name no script.
EAST_ASIAN_SETS = (frozenset(("Latin", "Han", "Hiragana", "Katakana")), frozenset(("Latin", "Han", "Bopomofo")), frozenset(("Latin", "Han", "Hangul")))
WITH_LATIN = frozenset(
    "Arabic Armenian Bengali Bopomofo Devanagari Ethiopic Georgian Gujarati Gurmukhi Hangul Han Hebrew Hiragana Kannada Katakana Khmer Lao Malayalam Myanmar Oriya "
    "Sinhala Tamil Telugu Thaana Thai Tibetan".split()
)
NO_SCRIPT = frozenset(("Common", "Inherited", "Unknown"))
STANDARD = {(0x30, 0xFE00), (0x2205, 0xFE00), (0x3001, 0xFE00), (0x3001, 0xFE01), (0x3002, 0xFE00), (0x3002, 0xFE01), (0x2229, 0xFE00), (0x222A, 0xFE00), (0x2268, 0xFE00), (0x2269, 0xFE00)}
#: Tokens whose forms a worker keeps, under half a kilobyte each; an executor may have eight workers.
KEPT_WORDS = 20_000
#: What ``Tables.forms`` tells of a token.
FORMS = ("skeleton", "nfd", "sets", "mixed", "turkic")


@dataclass(eq=False)
class Tables:
    """What a text's characters look like and the scripts they are read in."""

    #: Character to the text that it looks like.
    confusables: dict[str, str]
    #: (first, last, names) of ranges, in order: the script, and the scripts with extensions, where they differ.
    script: list[tuple[int, int, str]]
    extended: list[tuple[int, int, tuple[str, ...]]]
    _kept: dict[str, tuple] = field(default_factory=dict, repr=False)
    _sets: dict[tuple, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": {}, "_sets": {}}

    @functools.cached_property
    def imitated(self) -> dict[str, frozenset[str]]:
        """For each ASCII letter or digit, the scripts that have a single character which looks like it."""
        out: dict[str, set[str]] = {}
        for source, target in self.confusables.items():
            if ord(source) > 0x7F and len(target) == 1 and target.isascii() and target.isalnum():
                out.setdefault(target, set()).update(self.scripts_of(source))
        return {k: frozenset(v - NO_SCRIPT) for k, v in out.items()}

    def script_of(self, ch: str) -> str:
        return _found(self.script, ord(ch)) or "Unknown"

    @functools.cache  # noqa: B019  one instance for each process
    def scripts_of(self, ch: str) -> tuple[str, ...]:
        """The scripts that a character is read in: its extensions if it has any, else its script."""
        return _found(self.extended, ord(ch)) or (self.script_of(ch),)

    def skeleton(self, token: str) -> str:
        mapped = "".join(self.confusables.get(c, c) for c in unicodedata.normalize("NFD", token))
        return unicodedata.normalize("NFD", mapped)

    def sets(self, word: str) -> list[frozenset[str]]:
        """The script sets of those characters of a word that have one."""
        return [s for c in word if (s := frozenset(self.scripts_of(c)) - NO_SCRIPT)]

    def _lookalike(self, word: str, sets: list[frozenset[str]]) -> bool:
        """A character passes for ASCII, or, among more others than ASCII, an ASCII one passes for the script of half of them."""
        beyond = [c for c in word if not c.isascii()]
        plain = {c for c in word if c.isascii() and c.isalnum()}
        for c in beyond:
            to = self.confusables.get(c, "")
            if to.isascii() and to.isalnum() and "Latin" not in self.scripts_of(c):
                return True
        if sum(c in plain for c in word) >= len(beyond):
            return False
        half = {name for s in sets for name in s if 2 * sum(name in x for x in sets) >= len(beyond)} - {"Latin"}
        return any(half & self.imitated.get(c, frozenset()) for c in plain)

    def mixed(self, word: str) -> bool:
        """No permitted set of scripts covers the word, and a lookalike stands in it."""
        sets = self.sets(word)
        if not sets or frozenset.intersection(*sets):
            return False
        joined = (frozenset(("Latin", name)) for name in frozenset().union(*sets) & WITH_LATIN)
        return not any(all(s & group for s in sets) for group in (*EAST_ASIAN_SETS, *joined)) and self._lookalike(word, sets)

    def forms(self, token: str) -> dict:
        """Skeleton, normal form D, the distinct script sets, and whether the token is mixed or a Latin one with a Turkic i."""
        return dict(zip(FORMS, self.form(token)))

    def form(self, token: str) -> tuple:
        """The values of ``forms``; texts and sets that are equal are one object in what is kept."""
        found = self._kept.get(token)
        if found is None:
            if len(self._kept) >= KEPT_WORDS:
                self._kept.clear()
            words = re.split(r"[_\u203f\u2040\u2054\ufe33\ufe34\ufe4d-\ufe4f\uff3f]+", token)  # connectors
            turkic = ("ı" in token or "İ" in token) and all(c.isascii() or "Latin" in self.scripts_of(c) for c in token)
            skeleton, nfd = self.skeleton(token), unicodedata.normalize("NFD", token)
            sets = tuple(sorted({tuple(sorted(s)) for s in self.sets(token)}))
            sets = self._sets.setdefault(sets, sets)
            found = self._kept[token] = (skeleton, skeleton if nfd == skeleton else nfd, sets, any(map(self.mixed, words)), turkic)
        return found


def _found(ranges: list[tuple], cp: int):
    at = bisect.bisect_right(ranges, cp, key=lambda r: r[0]) - 1
    return ranges[at][2] if at >= 0 and cp <= ranges[at][1] else None


def _lines(folder: str | None, name: str) -> list[list[str]] | None:
    """Fields of a data file without comments; null where there is none."""
    path = os.path.join(folder, name) if folder else ""
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8-sig") as lines:
        bare = (line.partition("#")[0].strip() for line in lines)
        return [[part.strip() for part in line.split(";")] for line in bare if line]


def _span(field: str) -> range:
    low, _, high = field.partition("..")
    return range(int(low, 16), int(high or low, 16) + 1)



def _runs(points: dict[int, object]) -> list[tuple]:
    """(first, last, value) of neighbouring code points with the same value."""
    out: list[list] = []
    for cp in sorted(points):
        if out and out[-1][1] == cp - 1 and out[-1][2] == points[cp]:
            out[-1][1] = cp
        else:
            out.append([cp, cp, points[cp]])
    return [tuple(x) for x in out]


def _from_icu(jvm) -> Tables:
    icu = jvm.com.ibm.icu
    # No lookalike stands beyond the last plane of ideographs.
    sources = [c for c in map(chr, range(0x21, 0x33480)) if unicodedata.category(c) not in ("Cn", "Co", "Cc", "Cs") and unicodedata.normalize("NFD", c) == c]
    told = icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(sources)).split("\n")
    if len(told) != len(sources):
        raise ValueError("ICU's skeletons cannot be told apart")
    names, kinds = icu.lang.UScript, icu.lang.UProperty
    own, extended, left = [], {}, {}
    for code in range(icu.lang.UCharacter.getIntPropertyMaxValue(kinds.SCRIPT) + 1):
        name = names.getName(code)
        primary, wider = (icu.text.UnicodeSet().applyIntPropertyValue(kind, code) for kind in (kinds.SCRIPT, kinds.SCRIPT_EXTENSIONS))
        if name == "Unknown" or primary.isEmpty() and wider.isEmpty():
            continue
        own += [(lo, hi, name) for lo, hi in _pattern_ranges(primary.toPattern(True))]
        # Few characters have extensions: those that other scripts share, and those that their own script does not keep.
        for into, found in ((extended, wider.cloneAsThawed().removeAll(primary)), (left, primary.cloneAsThawed().removeAll(wider))):
            for lo, hi in _pattern_ranges(found.toPattern(True)):
                for cp in range(lo, hi + 1):
                    into.setdefault(cp, set()).add(name)
    own.sort()
    more = {cp: tuple(sorted(extended[cp] | {_found(own, cp) or "Unknown"} - left.get(cp, set()))) for cp in extended}
    # What ICU leaves out of skeletons is invisible and has rules of its own.
    return Tables({c: to for c, to in zip(sources, told) if to not in (c, "")}, own, _runs(more))


def _pattern_ranges(pattern: str) -> list[tuple[int, int]]:
    """The ranges of a set pattern with escapes, such as [\\u0600-\\u0604a-z]."""
    one = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]"
    code = lambda c: int(c[2:], 16) if len(c) > 2 else ord(c[-1])
    return [(code(a), code(b or a)) for a, b in re.findall(rf"({one})(?:-({one}))?", pattern[1:-1])]


def _from_files(folder: str) -> Tables:
    own = {cp: row[1] for row in _lines(folder, "Scripts.txt") for cp in _span(row[0])}
    more = {cp: tuple(sorted(row[1].split())) for row in _lines(folder, "ScriptExtensions.txt") or [] for cp in _span(row[0])}
    rows = _lines(folder, "confusables.txt")
    return Tables({chr(int(row[0], 16)): "".join(chr(int(cp, 16)) for cp in row[1].split()) for row in rows}, _runs(own), _runs(more))


@functools.cache
def tables(folder: str | None = None) -> Tables:
    """The tables of ``folder``'s files, else ICU's, on the driver."""
    if folder and all(os.path.exists(os.path.join(folder, name)) for name in ("confusables.txt", "Scripts.txt")):
        return _from_files(folder)
    if SparkContext._active_spark_context is not None:
        return _from_icu(SparkContext._active_spark_context._jvm)
    gateway = launch_gateway()  # no session yet: a virtual machine for these calls alone
    try:
        return _from_icu(gateway.jvm)
    finally:
        gateway.shutdown()


@functools.cache
def _broadcast(application: str, folder: str | None):
    return SparkContext._active_spark_context.broadcast(tables(folder))


def shared_tables(folder: str | None = None):
    """The tables as a broadcast of the running application, for Arrow functions; under a megabyte."""
    return _broadcast(SparkContext._active_spark_context.applicationId, folder)


@functools.cache
def variation_sequences(folder: str | None = None) -> frozenset[tuple[int, int]]:
    """Registered (base, selector) pairs."""
    out = set()
    for name in ("StandardizedVariants.txt", "IVD_Sequences.txt"):
        for row in _lines(folder, name) or []:
            base, selector, *_ = row[0].split()
            out.add((int(base, 16), int(selector, 16)))
    if out:
        return frozenset(out)
    out |= STANDARD
    count: dict[int, int] = {}
    for cp in (*range(0xF900, 0xFAFF), *range(0x2F800, 0x2FA1E)):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) == 1 and base != chr(cp):
            n = count.get(ord(base), 0)
            out.add((ord(base), 0xFE00 + n))
            count[ord(base)] = n + 1
    return frozenset(out)

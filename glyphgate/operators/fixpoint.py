"""Repairs of one text to the end: what is flagged is cut, and only what stood beside a cut is judged again.

A text is a chain of single special characters and the plain stretches between them. All special characters are judged
first; what is removed goes at once, and the specials on both sides of it, with the runs that they belong to, are judged
in the next round. A removal never makes a verdict elsewhere change, so the rounds are the passes that a scan of the whole
text each time would take, and a text costs its length plus its removals.
"""

from __future__ import annotations

import re

import numpy as np

from glyphgate.functions import properties as P
from glyphgate.functions.unicode_data import Tables
from glyphgate.operators import rules

_SPECIAL: P.Ranges = (*P.INVISIBLE, *P.EXPLICIT_BIDI, *P.BIDI_MARKS, *P.TAGS, *P.SELECTORS, *P.UNUSUAL_SPACES, (P.BRAILLE_BLANK, P.BRAILLE_BLANK), *P.CONTROLS)
#: The class of the characters that a repair may touch, for Spark; a text without one is left alone.
SPECIAL_CLASS = "[" + P.char_class(_SPECIAL) + "]"
_SPECIALS = re.compile("[" + "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi))}" for lo, hi in _SPECIAL) + "]")
_IDEOGRAPHS: P.Ranges = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_INVISIBLE = frozenset(c for lo, hi in P.INVISIBLE for c in range(lo, hi + 1))
_EMOJI = frozenset(c for lo, hi in P.EMOJI for c in range(lo, hi + 1))
_FLAGS = tuple("".join(chr(0xE0000 + ord(c)) for c in name) + chr(P.CANCEL_TAG) for name in P.FLAG_SEQUENCES)
_HIDDEN, _STRAY = "variation-selector-smuggling", "variation-selector-stray"


def _in(cp: int, ranges: P.Ranges) -> bool:
    return any(lo <= cp <= hi for lo, hi in ranges)


class Repairer:
    """What a repair removes and keeps, and the tables that its verdicts need."""

    def __init__(self, tables: Tables, sequences: frozenset[tuple[int, int]], normalize: bool, disabled: tuple[str, ...], allowed: tuple[int, ...], spare: bool) -> None:
        self.script, self.sequences, self.normalize = tables.script_of, sequences, normalize
        self.off, self.allowed, self.spare = frozenset(disabled), frozenset(map(chr, allowed)), spare

    # Verdicts over single characters.

    def _joins(self, ch: str) -> str:
        """The joining script of a character, if it has one."""
        if not ch:
            return ""
        name = self.script(ch)
        return name if name in P.JOINING_SCRIPTS else "Old_Uyghur" if _in(ord(ch), P.OLD_UYGHUR) else ""

    def _needed(self, cp: int, before: str, after: str) -> bool:
        """Whether a joiner or non-joiner does something where it stands."""
        if before and ord(before) in P.VIRAMAS:
            return True
        pictured = lambda c: bool(c) and (ord(c) in _EMOJI or c == "️")
        if cp == P.ZWJ and pictured(before) and pictured(after):
            return True
        left, right = self._joins(before), self._joins(after)
        if left and right:
            return True
        latin = lambda c: c.isascii() and c.isalnum()
        return cp == P.ZWNJ and ((latin(before) and right not in ("", "Hebrew")) or (left not in ("", "Hebrew") and latin(after)))

    def single(self, ch: str, before: str, after: str) -> str | None:
        """The rule that a character breaks between its neighbours (empty at an end of the text)."""
        cp = ord(ch)
        if _in(cp, P.EXPLICIT_BIDI):
            return "bidi-control"
        if _in(cp, P.BIDI_MARKS):
            return "bidi-mark"
        if cp in _INVISIBLE:
            kept = (cp == P.BOM and not before) or (cp in (P.ZWNJ, P.ZWJ) and self._needed(cp, before, after))
            return None if kept else "invisible"
        if _in(cp, P.UNUSUAL_SPACES):
            french = cp in P.NO_BREAK_SPACES and ((after and ord(after) in P.SPACED_AFTER) or (before and ord(before) == P.OPEN_GUILLEMET))
            wide = cp == P.IDEOGRAPHIC_SPACE and any(c and _in(ord(c), P.EAST_ASIAN) for c in (before, after))
            return None if french or wide else "unusual-whitespace"
        if cp == P.BRAILLE_BLANK:
            return None if any(c and _in(ord(c), P.BRAILLE) for c in (before, after)) else "unusual-whitespace"
        return "control-character" if _in(cp, P.CONTROLS) else None

    # Verdicts over runs: which of their characters go, and the rule that says so.

    def tags(self, run: str, before: str) -> tuple[int, str | None]:
        """From which character on a run of tags goes; a registered flag stays."""
        if before == chr(P.FLAG_BASE):
            flag = next((f for f in _FLAGS if run.startswith(f)), "")
            return len(flag), "tag-smuggling" if len(flag) < len(run) else None
        return 0, "tag-smuggling"

    def selectors(self, run: str, before: str) -> tuple[int, str | None]:
        """From which selector on a run goes; a single one after its base stays, and the first of a longer run that spells nothing."""
        first = ord(run[0])
        known = bool(before) and ((ord(before), first) in self.sequences or (ord(before) in _EMOJI and first in (0xFE0E, 0xFE0F)))
        spelled = len(run) > 1 and _printable(_bytes(run))
        if len(run) == 1 and known:
            return 1, None
        return int(len(run) > 1 and known and not spelled), _HIDDEN if spelled else _STRAY

    def repair(self, text: str) -> tuple[str, int, int]:
        """The repaired text, how many findings were repaired, and in how many rounds."""
        chain = _Chain(text)
        todo, fixed, rounds = [i for i in range(1, len(chain.text) - 1) if chain.special[i]], 0, 0
        while todo:
            found = self._judged(chain, todo)
            if not found:
                break
            rounds += 1
            fixed += sum(n for *_, n in found)
            touched: set[int] = set()
            for places, new, _ in found:
                for i in places:
                    if new:
                        chain.text[i], chain.special[i] = new, False
                        touched.update(chain.beside(i))
                    else:
                        touched.update(chain.cut(i))
            todo = sorted(i for i in touched if chain.alive[i] and chain.special[i])
        return "".join(chain.all()), fixed, rounds

    def _judged(self, chain: _Chain, todo: list[int]) -> list[tuple[list[int], str, int]]:
        """(places, what replaces them, findings) of what goes."""
        out, seen, runs = [], set(), []
        controls = []
        for i in todo:
            ch = chain.text[i]
            ranges = P.TAGS if _in(ord(ch), P.TAGS) else P.SELECTORS if _in(ord(ch), P.SELECTORS) else None
            if ranges is None:
                rule = self.single(ch, chain.before(i), chain.after(i))
                if rule == "bidi-control":
                    controls.append(i)
                if rule and rule not in self.off and ch not in self.allowed:
                    space = ("\n" if ord(ch) in P.LINE_MAKERS else " ") if self.normalize and rule == "unusual-whitespace" else ""
                    out.append(([i], space, 1))
                continue
            if i in seen:
                continue
            run = chain.run(i, ranges)
            seen.update(run)
            runs.append((run, ranges is P.TAGS))
        if controls and "bidi-unbalanced" not in self.off:
            loose = chain.loose()
            for i in controls:
                if i in loose and chain.text[i] not in self.allowed:
                    out.append(([i], "", 1))
        streams = None
        for run, tagged in runs:
            text, base = "".join(chain.text[i] for i in run), chain.before(run[0])
            skip, rule = (self.tags if tagged else self.selectors)(text, base)
            single = not tagged and rule == _STRAY and len(run) == 1 and base
            if single and (self.off & {_HIDDEN, _STRAY} or self._sparable(text, base)):
                streams = self._streams(chain) if streams is None else streams
                if run[0] in streams:
                    rule = _HIDDEN
                elif self._sparable(text, base):
                    rule = None
            going = [i for i in run[skip:] if chain.text[i] not in self.allowed]
            if rule and rule not in self.off and going:
                out.append((going, "", 1))
        return out

    def _sparable(self, run: str, base: str) -> bool:
        """An ideographic variant that only a registry could tell from a stray selector."""
        return self.spare and len(run) == 1 and ord(run) >= 0xE0100 and _in(ord(base), _IDEOGRAPHS)

    def _streams(self, chain: _Chain) -> set[int]:
        """The carriers (single selectors that do not belong to their base) which together spell a text."""
        carriers = []
        for run in chain.runs(P.SELECTORS):
            text, base = chain.text[run[0]], chain.before(run[0])
            if len(run) == 1 and base and self.selectors(text, base)[1]:
                carriers.append((run[0], chain.previous(run[0]), text))
        out: set[int] = set()
        groups: list[list] = []
        for k, (i, plain, ch) in enumerate(carriers):
            # The next carrier is a base and its selector: one plain character stands between the two selectors.
            joined = k and plain is not None and chain.prev[plain] == carriers[k - 1][0] and len(chain.text[plain]) == 1
            if joined:
                groups[-1].append((i, ch))
            else:
                groups.append([(i, ch)])
        for group in groups:
            if len(group) >= 8 and _clean(_bytes("".join(ch for _, ch in group))):
                out.update(i for i, _ in group)
        bits = [(i, ch) for i, _, ch in carriers if ch in "︎️"]
        if len(bits) >= 64:
            for one in "️︎":
                spelled = "".join("1" if ch == one else "0" for _, ch in bits)
                if _clean(bytes(int(spelled[k : k + 8], 2) for k in range(0, len(spelled) - 7, 8))):
                    out.update(i for i, _ in bits)
                    break
        return out


def _bytes(run: str) -> bytes:
    return bytes(c - 0xFE00 if c < 0xE0100 else c - 0xE0100 + 16 for c in map(ord, run))


def _decoded(raw: bytes) -> str:
    try:
        return raw.removeprefix(b"\xef\xbb\xbf").decode()
    except UnicodeDecodeError:
        return ""


def _printable(raw: bytes) -> bool:
    return any(c >= " " for c in _decoded(raw))


def _clean(raw: bytes) -> bool:
    text = _decoded(raw)
    return bool(text) and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]", text)


class _Chain:
    """Special characters and the plain stretches between them, linked in both directions."""

    def __init__(self, text: str) -> None:
        self.text, self.special, at = [""], [False], 0
        for m in _SPECIALS.finditer(text):
            if m.start() > at:
                self.text.append(text[at : m.start()])
                self.special.append(False)
            self.text.append(m[0])
            self.special.append(True)
            at = m.end()
        self.text += [text[at:], ""] if at < len(text) else [""]
        self.special += [False] * (len(self.text) - len(self.special))
        n = len(self.text)
        self.prev, self.next, self.alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def before(self, i: int) -> str:
        return self.text[self.prev[i]][-1:]

    def after(self, i: int) -> str:
        return self.text[self.next[i]][:1]

    def previous(self, i: int) -> int | None:
        """The plain stretch before a place, if there is one."""
        j = self.prev[i]
        return j if self.text[j] and not self.special[j] else None

    def beside(self, i: int) -> list[int]:
        """The special characters next to a place, beyond a stretch of plain text on either side."""
        out = []
        for step in (self.prev, self.next):
            j = step[i]
            if 0 < j < len(self.text) - 1:
                out.append(j)
                if not self.special[j] and 0 < step[j] < len(self.text) - 1:
                    out.append(step[j])
        return out

    def cut(self, i: int) -> list[int]:
        """Take a place out, once; the special characters that were next to it."""
        if not self.alive[i]:
            return []
        near = self.beside(i)
        a, b = self.prev[i], self.next[i]
        self.next[a], self.prev[b], self.alive[i] = b, a, False
        return near

    def run(self, i: int, ranges: P.Ranges) -> list[int]:
        """The run of special characters of a kind around a place."""
        kind = lambda j: self.special[j] and _in(ord(self.text[j]), ranges)
        while kind(self.prev[i]):
            i = self.prev[i]
        out = [i]
        while kind(self.next[i]):
            i = self.next[i]
            out.append(i)
        return out

    def places(self) -> list[int]:
        out, i = [], self.next[0]
        while i < len(self.text) - 1:
            out.append(i)
            i = self.next[i]
        return out

    def all(self) -> list[str]:
        return [self.text[i] for i in self.places()]

    def runs(self, ranges: P.Ranges) -> list[list[int]]:
        out: list[list[int]] = []
        for i in self.places():
            if self.special[i] and _in(ord(self.text[i]), ranges):
                if out and self.prev[i] == out[-1][-1]:
                    out[-1].append(i)
                else:
                    out.append([i])
        return out

    def loose(self) -> set[int]:
        """The places of explicit controls that open or close nothing on their line."""
        owner, points = [], []
        for i in self.places():
            if self.special[i]:
                found = [ord(self.text[i])] if _in(ord(self.text[i]), P.EXPLICIT_BIDI) else []
            else:
                found = [ord(c) for c in re.findall("[\n\r]", self.text[i])]
            owner += [i] * len(found)
            points += found
        flags = rules.unbalanced(np.array(points, np.int64), np.zeros(len(points), np.int64))
        return {owner[k] for k in np.flatnonzero(flags)}

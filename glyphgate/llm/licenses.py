"""License scans by template-markup matching.

A template is a line of words with two kinds of markup: ``<<opt words>>`` may be absent, ``<<var n>>`` stands for up to
n words of any kind (a name, a year). A template compiles into an automaton over words: states are places in the
template, optional and replaceable regions are edges that skip or repeat. A text carries a template's label where the
automaton accepts a run of its words, that is, where all mandatory wording matches exactly.

Words are ASCII-lower-cased runs of digits, ASCII letters and all characters beyond ASCII. The base phrases are plain
templates and counted at every place. Each automaton begins with mandatory words, so a text's places for it are found
by a byte search, and only there does it run.

Templates are whole notices and license bodies, which get a label of their own, and opening sentences and references, by
which a text names a license without giving its terms.

Score: the largest weight of a text's matches, 0 without any. A whole text weighs 1; a reference its mandatory words / 20,
half at most.

Defined results. Null text: as an empty text: no words, nothing found. Repeated rows: each its own row. Null doc_id:
kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgate.llm.common import arrow_map

# The base phrases.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public license texts, as words, with optional and replaceable regions.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "<<opt including the next paragraph>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of "
    "any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
    "the <<var 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt 1>> "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt 2>> redistributions in binary "
    "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution "
)
_BSD_NAMES = (
    "<<opt 3>> neither the name of <<var 12>> nor the names of <<opt its>> <<opt any>> contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission "
)
_BSD_END = (
    "this software is provided by <<var 10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall <<var 10>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
    "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_ISC = (
    "permission to use copy modify <<opt and>> <<opt or>> distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and <<var 4>> disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness in no event shall <<var 4>> be liable for any special direct indirect or consequential damages or "
    "any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http<<opt s>> <<opt www>> apache org licenses license 2 0 <<opt txt>> unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
    "governing permissions and limitations under the license"
).replace("http<<opt s>>", "<<opt http>> <<opt https>>")
_GNU = (
    "this program is free software <<opt you can>> redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software "
    "foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} general public license for more details"
)

#: Label, template, and whether it is a whole text.
WHOLE = (
    ("mit-text", _MIT),
    ("bsd-2-text", _BSD_START + _BSD_END),
    ("bsd-3-text", _BSD_START + _BSD_NAMES + _BSD_END),
    ("isc-text", _ISC),
    ("apache-2-notice", _APACHE),
    *((f"{kind}gpl-{n}-notice", _GNU.format(*([word, n, word] if word else ["", n, ""])).replace("gnu  general", "gnu general")) for kind, word in (("", ""), ("l", "lesser"), ("a", "affero")) for n in ("2", "3")),
)
REFERENCES = (
    ("mit", "released under <<opt the terms of>> the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 <<opt 0>>"),
    ("cc-by-nc", "licensed under <<opt a>> <<opt creative commons>> cc by nc <<opt sa>> <<var 2>>"),
    ("cc-by", "licensed under <<opt a>> <<opt the>> creative commons attribution <<opt 4 0 international>> license"),
    ("gpl-3", "licensed under the gnu general public license <<opt as published by the free software foundation>> <<opt either>> version 3"),
    ("gpl-2", "licensed under the gnu general public license <<opt as published by the free software foundation>> <<opt either>> version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright <<opt c>> <<var 6>> all rights reserved"),
)

#: Bytes of words to themselves, A-Z to lower case, all others to spaces. UTF-8 bytes beyond ASCII are word bytes.
_MAP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_PART = re.compile(rb"<<opt ([^>]*)>>|<<var (\d+)>>|(\S+)")


@dataclass(frozen=True)
class Automaton:
    """edges[state] lists (word or None for any, next state); skips[state] lists states reached without a word."""

    label: str
    lead: bytes
    edges: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]
    weight: float

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts(self, words: list[bytes], at: int) -> bool:
        """True if a run of words that begins at ``at`` is accepted."""
        last = len(self.edges) - 1
        states = self.closed({0})
        for word in words[at:]:
            if last in states or not states:
                break
            states = self.closed({to for s in states for want, to in self.edges[s] if want is None or want == word})
        return last in states


def compile_template(label: str, template: str, whole: bool = False) -> Automaton:
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[list[int]] = [[]]

    def new() -> int:
        edges.append([])
        skips.append([])
        return len(edges) - 1

    now, lead, mandatory, leading = 0, [], 0, True
    for optional, many, word in _PART.findall(template.encode()):
        if word:
            to = new()
            edges[now].append((word, to))
            now, mandatory = to, mandatory + 1
            if leading:
                lead.append(word)
            continue
        leading = False
        begin, path = now, [now]
        for want in optional.split() if optional else [None] * int(many):
            to = new()
            edges[now].append((want, to))
            now = to
            path.append(to)
        if optional:
            skips[begin].append(now)
        else:  # any number of the words may be absent
            for s in path[:-1]:
                skips[s].append(now)
    if not lead:
        raise ValueError(f"a template begins with mandatory words: {template}")
    return Automaton(label, b" ".join(lead), tuple(map(tuple, edges)), tuple(map(tuple, skips)), 1.0 if whole else min(0.5, mandatory / 20))


TEMPLATES = (*WHOLE, *REFERENCES)
AUTOMATA = tuple(compile_template(*x, whole=x in WHOLE) for x in TEMPLATES)


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which ``phrase`` stands in space-joined words that also begin and end with a space."""
    wanted, at, seen, no = b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(wanted, at + 1)) >= 0:
        no += joined.count(b" ", seen, at)
        seen = at
        yield no


def scan_text(text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one UTF-8 text."""
    words = (text or b"").translate(_MAP).split()
    joined = b" " + b" ".join(words) + b" "
    base, labels, at = set(), {}, []
    for phrase, label in PHRASES:
        if found := list(places(joined, phrase.encode())):
            at += found
            base.add(label)
            labels[label] = max(labels.get(label, 0.0), len(phrase.split()) / 20)
    for a in AUTOMATA:
        if labels.get(a.label, 0.0) < a.weight and any(a.accepts(words, i) for i in places(joined, a.lead)):
            labels[a.label] = a.weight
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max(labels.values(), default=0.0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan_text`` finds in each whole text."""
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return arrow_map(narrow, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

"""DuckDB SQL for the queries that SQL can express, over the same planted documents."""

from __future__ import annotations

import json
import unicodedata

from glyphgate.functions import properties as P
from glyphgate.functions import text as X
from glyphgate.functions.unicode_data import tables, variation_sequences
from glyphgate.operators import analytics, policy, reports
from glyphgate.operators.confusables import TOKEN
from glyphgate.plans import queries as Q
from glyphgate.plans.corpora import planted_sql

D = P.DUCKDB

PLANTED = f"""
  planted AS MATERIALIZED ({planted_sql()}),"""

EVENTS = f"""{PLANTED}
  chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS idx FROM planted WHERE regexp_matches(text, '{P.UNPLAIN}')),
  near AS (
    SELECT doc_id, idx, ch, unicode(ch)::BIGINT AS cp, lag(ch) OVER w AS prev_ch, lead(ch) OVER w AS next_ch,
      lag(unicode(ch)) OVER w AS prev_cp, lead(unicode(ch)) OVER w AS next_cp
    FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
  offs AS (
    SELECT *, (idx + coalesce(sum((cp > 65535)::INT) OVER b, 0))::BIGINT AS off,
      cp = 10 OR (cp = 13 AND next_cp IS DISTINCT FROM 10) AS brk
    FROM near WINDOW b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ev AS MATERIALIZED (
    SELECT *, (1 + coalesce(sum(brk::INT) OVER b, 0))::BIGINT AS line, (off - coalesce(max(CASE WHEN brk THEN off END) OVER b, -1))::BIGINT AS col
    FROM offs WINDOW b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

SINGLES = f"""
  ruled AS (SELECT *, {P.single_rule(D)} AS rule FROM ev),
  singles AS (
    SELECT doc_id, rule, {P.SINGLE_SEVERITY} AS severity, idx AS start_idx, idx + 1 AS end_idx, off AS start_off,
      off + CASE WHEN cp > 65535 THEN 2 ELSE 1 END AS end_off, line AS start_line, col AS start_col, cp, [cp] AS cps, NULL::VARCHAR AS decoded, idx AS removal_start
    FROM ruled WHERE rule IS NOT NULL)"""

_FLAGS = " ".join(f"WHEN starts_with(spelled, '{n}' || chr(127)) THEN {len(n) + 1}" for n in P.FLAG_SEQUENCES)
TAG_RUNS = f"""
  tagged AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM ev WHERE {P.within('cp', P.TAGS)}),
  whole AS (
    SELECT doc_id, min(idx) AS start, count(*) AS n, list(cp ORDER BY idx) AS cps, arg_min(prev_cp, idx) AS base, arg_min(off, idx) AS off,
      arg_min(line, idx) AS line, arg_min(col, idx) AS col, string_agg(chr((cp - 917504)::INT), '' ORDER BY idx) AS spelled
    FROM tagged GROUP BY doc_id, island),
  split AS (SELECT *, coalesce(base = {P.FLAG_BASE}, false) AS flag, CASE WHEN coalesce(base, 0) <> {P.FLAG_BASE} THEN 0 {_FLAGS} ELSE 0 END AS k FROM whole),
  parts AS (
    SELECT *, 0 AS skip, CASE WHEN k = 0 THEN n ELSE k END AS m, flag AS has_base, k > 0 AS valid FROM split
    UNION ALL SELECT *, k AS skip, n - k AS m, false AS has_base, false AS valid FROM split WHERE k > 0 AND k < n),
  runs AS (
    SELECT doc_id, (start + skip)::BIGINT AS start, (start + skip + m)::BIGINT AS "end", has_base, valid, cps[skip + 1:skip + m] AS tags,
      regexp_replace(substring(spelled, (skip + 1)::INT, m::INT), '[\\x00-\\x1F\\x7F]', '', 'g') AS decoded, (off + 2 * skip)::BIGINT AS off, line, (col + 2 * skip)::BIGINT AS col
    FROM parts)"""

TAG_FINDINGS = """
  tags AS (
    SELECT doc_id, 'tag-smuggling' AS rule, 'error' AS severity, start - has_base::INT AS start_idx, "end" AS end_idx, off - 2 * has_base::INT AS start_off,
      (off + 2 * len(tags))::BIGINT AS end_off, line AS start_line, col - 2 * has_base::INT AS start_col, NULL::BIGINT AS cp,
      CASE WHEN has_base THEN [127988::BIGINT] ELSE []::BIGINT[] END || tags AS cps, nullif(decoded, '') AS decoded, start AS removal_start
    FROM runs WHERE NOT valid)"""

FOUND = f"{EVENTS}, {SINGLES}, {TAG_RUNS}, {TAG_FINDINGS}, found AS MATERIALIZED (SELECT * FROM singles UNION ALL SELECT * FROM tags)"
PLACE = ", ".join(Q.PLACE)

SELECTOR_RUNS = f"""
  picked AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM ev WHERE {P.within('cp', P.SELECTORS)}),
  grouped AS (
    SELECT doc_id, min(idx) AS start, count(*) AS n, arg_min(prev_cp, idx)::BIGINT AS base_cp, arg_min(prev_ch, idx) AS base_ch, arg_min(cp, idx) AS first, arg_min(off, idx) AS off,
      string_agg(printf('%02x', (CASE WHEN cp < 917760 THEN cp - 65024 ELSE cp - 917760 + 16 END)::INT), '' ORDER BY idx) AS hex
    FROM picked GROUP BY doc_id, island),
  registered(b, f) AS (VALUES {', '.join(map(str, sorted(variation_sequences())))}),
  known AS (
    SELECT g.*, base_cp IS NOT NULL AND (r.b IS NOT NULL OR (regexp_matches(base_ch, '^[{P.char_class(P.EMOJI)}]$') AND first IN (65038, 65039))) AS recognized_first
    FROM grouped g LEFT JOIN registered r ON r.b = base_cp AND r.f = first),
  vs AS MATERIALIZED (SELECT *, n = 1 AND recognized_first AS ordinary, CASE WHEN is_utf8 THEN decode(unhex(hex)) END AS t FROM (SELECT *, regexp_matches(hex, '^([0-7][0-9a-f]|c[2-9a-f][89ab][0-9a-f]|d[0-9a-f][89ab][0-9a-f])*$') AS is_utf8 FROM known)),
  carriers AS (SELECT * FROM vs WHERE n = 1 AND NOT ordinary AND base_cp IS NOT NULL)"""

_CLEAN = r"regexp_matches(g.t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]')"


def _names() -> str:
    known = " ".join(f"WHEN {cp} THEN '{name}'" for cp, name in sorted(X._known_names().items()))
    return f"""CASE cp {known} ELSE CASE WHEN cp = 917505 THEN 'LANGUAGE TAG' WHEN cp = 917631 THEN 'CANCEL TAG' WHEN cp BETWEEN 917536 AND 917630 THEN 'TAG ' || chr((cp - 917504)::INT)
      WHEN cp BETWEEN 917504 AND 917631 THEN 'TAG CHARACTER U+' || printf('%X', cp) WHEN cp BETWEEN 65024 AND 65039 THEN 'VARIATION SELECTOR-' || (cp - 65023)
      WHEN cp BETWEEN 917760 AND 917999 THEN 'VARIATION SELECTOR-' || (cp - 917760 + 17)
      WHEN (cp <= 31 AND cp NOT IN (9, 10, 13)) OR cp BETWEEN 128 AND 159 THEN 'CONTROL CHARACTER U+' || printf('%04X', cp) ELSE 'U+' || printf('%04X', cp) END END"""


def _skeletons() -> str:
    """(ch, nfd, mapped) of the characters that the planted documents can hold beyond ASCII, and ASCII sources."""
    table, rows = tables().confusables, []
    for cp in (*range(0x30, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x600, 0x700), 0x200C, 0x5C71, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x1D400, 0x1D800)):
        nfd = unicodedata.normalize("NFD", chr(cp))
        rows.append((chr(cp), nfd, unicodedata.normalize("NFD", "".join(table.get(c, c) for c in nfd))))
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


#: Stands for the rows of ``_skeletons``, which are made when the SQL is asked for.
_SKELETONS = "@skeletons@"
#: Cyrillic letters that pass for Latin ones.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ"
_STYLED = "[" + P.char_class(P.STYLED, tuple(P.SMALL_CAPITALS)) + "]"
PASSAGE = _STYLED + r"+(?:[^\p{L}\p{N}]{1,3}" + _STYLED + "+)*"

WORDS = f"""{PLANTED}
  words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM planted WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
  long AS MATERIALIZED (SELECT *, NOT regexp_matches(token, '[^\\x00-\\x7F]') AS is_ascii FROM words WHERE length(token) + len(regexp_extract_all(token, '[\\x{{10000}}-\\x{{10FFFF}}]')) > 1),
  map(ch, nfd, mapped) AS (VALUES {_SKELETONS}),
  spelled AS MATERIALIZED (SELECT token, string_agg(coalesce(mapped, ch0), '' ORDER BY i) AS skeleton, string_agg(coalesce(nfd, ch0), '' ORDER BY i) AS nfd
    FROM (SELECT token, unnest(string_split(token, '')) AS ch0, unnest(range(length(token))) AS i FROM (SELECT DISTINCT token FROM long)) LEFT JOIN map ON ch = ch0 GROUP BY token)"""


_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _folds() -> str:
    """The mathematical letters a to z of the planted passage, as a list of pairs."""
    return "[" + ", ".join(f"['{chr(0x1D41A + i)}', '{chr(97 + i)}']" for i in range(26)) + "]"


def _before(gap: str, hit: str) -> str:
    """Where a match starts: all lengths before it and its gap."""
    return f"(coalesce(sum({gap} + {hit}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {gap})"


def _over(select: str, ctes: str = FOUND) -> str:
    return f"WITH {ctes} {select}"


def _path_policy() -> str:
    """The three blocks of the example policy, by hand."""
    hits = ["true" if not b.files else "(" + " OR ".join(f"regexp_matches(path, '{policy.glob_pattern(g)}')" for g in b.files) + ")" for b in Q.BLOCKS]
    severity = "severity"
    allowed = "[]::BIGINT[]"
    for b, hit in zip(Q.BLOCKS, hits):
        for rule, value in b.rules.items():
            severity = f"CASE WHEN {hit} AND rule = '{rule}' THEN '{'off' if value is False else value}' ELSE {severity} END"
        if b.allow:
            allowed += f" || CASE WHEN {hit} THEN {list(b.allow)} ELSE [] END"
    columns = PLACE.replace("severity", "new_severity AS severity")
    return f"""SELECT path, {columns} FROM (SELECT *, {severity} AS new_severity, {allowed} AS allowed FROM (
        SELECT found.*, concat_ws('/', source, lang, doc_id) AS path FROM found JOIN planted USING (doc_id)))
      WHERE new_severity <> 'off' AND NOT list_has_all(allowed, cps)"""


_LABEL = "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for label, c in analytics.LABELS) + " END"
_PROBES = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS probe, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM planted WHERE regexp_matches(text, '{p}')" for n, p in analytics.PROBE_PATTERNS.items())
PROBES = f"""
  probed AS ({_PROBES}),
  places AS (SELECT doc_id, probe, i, gaps[i] AS gap, hits[i] AS hit FROM probed, range(1, len(gaps) + 1) AS r(i)),
  begun AS (SELECT *, coalesce(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, probe ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start FROM places),
  probes AS MATERIALIZED (SELECT doc_id, CASE WHEN probe = 'zero-width-and-joiners' AND start = 0 AND hit = chr(65279) THEN 'bom-at-start' ELSE probe END AS probe, start, start + length(hit) AS "end" FROM begun WHERE hit IS NOT NULL)"""
SPANS = """
  wide AS (SELECT doc_id, start_idx - 2 AS start, end_idx + 2 AS "end" FROM found),
  opened AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM wide),
  numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened),
  spans AS (SELECT doc_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM numbered GROUP BY doc_id, island)"""
_CUT = "(SELECT DISTINCT doc_id, unnest(range(removal_start, end_idx)) AS idx, rule = 'unusual-whitespace' AS space FROM found)"


def _pass(piece: str) -> str:
    return f"""SELECT doc_id, sha256(coalesce(new, text)) AS digest, coalesce(fixed, 0)::BIGINT AS fixed FROM planted
      LEFT JOIN (SELECT doc_id, string_agg({piece}, '' ORDER BY idx) AS new FROM ev LEFT JOIN {_CUT} c USING (doc_id, idx) GROUP BY doc_id) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS fixed FROM found GROUP BY doc_id) USING (doc_id)"""


def _escaped(text: str) -> str:
    return f"array_to_string([CASE WHEN regexp_matches(c, '{X.HIDDEN_CLASS}') THEN '\\u{{' || printf('%04X', unicode(c)) || '}}' ELSE c END for c in string_split({text}, '')], '')"


def _context(around: int = 40) -> str:
    low = f"greatest(0, start_idx - {around})"
    parts = [f"substring(text, ({low} + 1)::INT, (start_idx - {low})::INT)", "substring(text, (start_idx + 1)::INT, (end_idx - start_idx)::INT)", f"substring(text, (end_idx + 1)::INT, {around})"]
    before, inside, after = map(_escaped, parts)
    return f"SELECT doc_id, start_off, rule, {before} || '[[' || {inside} || ']]' || {after} AS context FROM found JOIN planted USING (doc_id)"


def _annotations() -> str:
    data = lambda x: f"replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
    prop = lambda x: f"replace(replace({data(x)}, ':', '%3A'), ',', '%2C')"
    message = f"rule || ': ' || array_to_string([{_names()} for cp in cps[1:3]], ', ') || CASE WHEN decoded IS NULL THEN '' ELSE ' reads as ' || {_escaped('decoded')} END"
    return f"""SELECT doc_id, start_off, rule, '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || {prop("concat_ws('/', source, lang, doc_id)")} || ',line=' || start_line
      || ',col=' || start_col || ',title=' || {prop("'glyphgate: ' || rule")} || '::' || {data(message)} AS line
      FROM (SELECT f.* EXCLUDE (cp), p.source, p.lang FROM found f JOIN planted p USING (doc_id))"""


BIDI = f"""
  ctl AS (SELECT doc_id, line, idx, cp, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS k FROM ev WHERE cp BETWEEN 8234 AND 8238 OR cp BETWEEN 8294 AND 8297),
  walk AS (
    SELECT DISTINCT doc_id, line, 0::BIGINT AS k, []::BIGINT[] AS opened, []::BOOLEAN[] AS isolate, []::BIGINT[] AS loose FROM ctl
    UNION ALL
    SELECT doc_id, line, c.k,
      CASE WHEN cp = 8297 THEN (CASE WHEN outer_ > 0 THEN opened[1:outer_ - 1] ELSE opened END) WHEN cp = 8236 THEN (CASE WHEN inner_ THEN opened[1:len(opened) - 1] ELSE opened END) ELSE opened || [idx] END,
      CASE WHEN cp = 8297 THEN (CASE WHEN outer_ > 0 THEN isolate[1:outer_ - 1] ELSE isolate END) WHEN cp = 8236 THEN (CASE WHEN inner_ THEN isolate[1:len(isolate) - 1] ELSE isolate END) ELSE isolate || [cp >= 8294] END,
      CASE WHEN (cp = 8297 AND outer_ = 0) OR (cp = 8236 AND NOT inner_) THEN loose || [idx] ELSE loose END
    FROM (SELECT *, CASE WHEN list_contains(isolate, true) THEN len(isolate) + 1 - list_position(list_reverse(isolate), true) ELSE 0 END AS outer_, len(isolate) > 0 AND NOT coalesce(isolate[-1], true) AS inner_ FROM walk) w
      JOIN (SELECT doc_id, line, k - 1 AS before, k, idx, cp FROM ctl) c USING (doc_id, line) WHERE c.before = w.k),
  unbalanced AS (SELECT doc_id, unnest(arg_max(loose || opened, k)) AS idx FROM walk GROUP BY doc_id, line)"""

SELECTOR_FINDINGS = f"""
  s1 AS (SELECT *, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <> 2, true) AS opens FROM carriers),
  s2 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start) AS stream FROM s1),
  bytes AS (
    SELECT doc_id, stream, b AS first, g.t AS text FROM (
      SELECT doc_id, stream, min(start) AS b, decode(unhex(string_agg(hex, '' ORDER BY start))) AS t FROM s2 GROUP BY doc_id, stream HAVING count(*) >= 8 AND bool_and(is_utf8)) g WHERE NOT {_CLEAN}),
  bits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM carriers WHERE hex IN ('0e', '0f')),
  spelled_bits AS (
    SELECT doc_id, first, g.t AS text FROM (SELECT doc_id, min(b) AS first, string_agg(chr(v::INT), '' ORDER BY o) AS t FROM (
      SELECT doc_id, (r - 1) // 8 AS o, min(start) AS b, sum((hex = '0f')::INT * (1 << ((7 - (r - 1) % 8))::INT)) AS v FROM bits WHERE total >= 64 GROUP BY ALL HAVING count(*) = 8) GROUP BY doc_id) g WHERE NOT {_CLEAN}),
  judged AS (
    SELECT v.*, coalesce(y.first, CASE WHEN v.start IN (SELECT b.start FROM bits b WHERE b.doc_id = v.doc_id) THEN x.first END) AS opening,
      coalesce(y.text, CASE WHEN v.start IN (SELECT b.start FROM bits b WHERE b.doc_id = v.doc_id) THEN x.text END) AS streamed,
      CASE WHEN NOT regexp_matches(v.t, '^[\\x00-\\x1F]*$') THEN v.t END AS plain
    FROM vs v LEFT JOIN s2 USING (doc_id, start) LEFT JOIN bytes y ON y.doc_id = v.doc_id AND y.stream = s2.stream LEFT JOIN spelled_bits x ON x.doc_id = v.doc_id WHERE NOT v.ordinary),
  selectors AS (
    SELECT j.doc_id, CASE WHEN hidden THEN 'variation-selector-smuggling' ELSE 'variation-selector-stray' END AS rule, CASE WHEN hidden THEN 'error' ELSE 'warning' END AS severity,
      j.start - (base_cp IS NOT NULL)::INT AS start_idx, (j.start + n)::BIGINT AS end_idx, coalesce(e.off, j.off) AS start_off, (j.off + w)::BIGINT AS end_off,
      coalesce(e.line, o.line) AS start_line, coalesce(e.col, o.col) AS start_col,
      CASE WHEN streamed IS NULL THEN plain WHEN j.start = j.opening THEN streamed END AS decoded,
      j.start + (n > 1 AND plain IS NULL AND recognized_first)::INT AS removal_start
    FROM (SELECT *, streamed IS NOT NULL OR (n > 1 AND plain IS NOT NULL) AS hidden FROM judged) j
      JOIN (SELECT v.doc_id, v.start, sum(CASE WHEN c.cp > 65535 THEN 2 ELSE 1 END) AS w FROM vs v JOIN ev c ON c.doc_id = v.doc_id AND c.idx >= v.start AND c.idx < v.start + v.n GROUP BY ALL) l ON l.doc_id = j.doc_id AND l.start = j.start
      JOIN ev o ON o.doc_id = j.doc_id AND o.idx = j.start
      LEFT JOIN ev e ON e.doc_id = j.doc_id AND e.idx = j.start - 1 AND j.base_cp IS NOT NULL)"""


def _named(points: str) -> str:
    return f"[{_names()} for cp in {points}]"


def _message() -> str:
    return f"rule || ': ' || array_to_string({_named('cps[1:3]')}, ', ') || CASE WHEN decoded IS NULL THEN '' ELSE ' reads as ' || {_escaped('decoded')} END"


_FILED = "(SELECT f.* EXCLUDE (cp), p.source, p.lang, p.text FROM found f JOIN planted p USING (doc_id))"


def _json() -> str:
    fixed = ", ".join(f"'{r}'" for r in sorted(P.NOT_FIXABLE))
    listed = lambda x: f"'[' || array_to_string([to_json(v)::VARCHAR for v in {x}], ',') || ']'"
    one = f"""'{{"start_off":' || start_off || ',"rule":"' || rule || '","severity":"' || severity || '","start":{{"line":' || start_line || ',"column":' || start_col || ',"offset":' || start_off || '}},"end_off":' || end_off
      || ',"codePoints":' || {listed("[printf('U+%04X', cp) for cp in cps]")} || ',"names":' || {listed(_named('cps'))} || ',"message":' || to_json({_message()})::VARCHAR
      || CASE WHEN decoded IS NULL THEN '' ELSE ',"decoded":' || to_json(decoded)::VARCHAR END || ',"fixable":' || CASE WHEN rule IN ({fixed}) THEN 'false' ELSE 'true' END || '}}'"""
    return f"""SELECT doc_id, count(*) AS findings, '{{"doc_id":' || doc_id || ',"findings":[' || string_agg(one, ',' ORDER BY start_off, rule) || ']}}' AS json FROM (SELECT doc_id, start_off, rule, {one} AS one FROM {_FILED}) GROUP BY doc_id"""


def _sarif() -> str:
    return f"""SELECT doc_id, start_off, rule, '{{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":{{"text":' || to_json({_message()})::VARCHAR
      || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || replace(url_encode(concat_ws('/', source, lang, doc_id)), '%2F', '/') || '"}},"region":{{"startLine":' || start_line || ',"startColumn":' || start_col
      || ',"endLine":' || start_line || ',"endColumn":' || (start_col + end_off - start_off) || '}}}}}}]}}' AS result FROM {_FILED}"""


def _pretty(around: int = 32, most: int = 80) -> str:
    inside = "substring(text, (start_idx + 1)::INT, (end_idx - start_idx)::INT)"
    whole = f"""CASE WHEN length(before) > {around} THEN '... ' ELSE '' END || {_escaped(f'right(before, {around})')} || '[['
      || CASE WHEN length(inside) > {most} THEN {_escaped(f'left(inside, {most // 2})')} || ' ... ' || {_escaped(f'right(inside, {most // 2})')} ELSE {_escaped('inside')} END
      || ']]' || {_escaped(f'left(after, {around})')} || CASE WHEN length(after) > {around} THEN ' ...' ELSE '' END"""
    return f"""SELECT doc_id, seq, start_line || ':' || start_col || '-' || start_line || ':' || (start_col + end_off - start_off) || ' ' || severity || ' ' || {_message()} || ' | ' || {whole} AS line FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_off, rule) - 1 AS seq, {inside} AS inside,
        string_split_regex(right(substring(text, 1, start_idx::INT), {around + 1}), '[\r\n]')[-1] AS before, string_split_regex(substring(text, (end_idx + 1)::INT, {around + 1}), '[\r\n]')[1] AS after
      FROM {_FILED})"""


def _reveal() -> str:
    short = " ".join(f"WHEN {cp} THEN '{name}'" for cp, name in sorted(P.ABBREVIATIONS.items()))
    said = lambda points: f"[printf('U+%04X', cp) || ' ' || coalesce(CASE cp {short} END, {_names()}) for cp in {points}]"
    label = f"CASE WHEN len(cps) > 4 THEN {said('cps[1:1]')}[1] || ' .. ' || {said('cps[-1:]')}[1] || ' (' || len(cps) || ' code points)' ELSE array_to_string({said('cps')}, ' ') END"
    fixed = ", ".join(f"'{r}'" for r in sorted(P.NOT_FIXABLE))
    return f"""SELECT doc_id, coalesce(shown, text) AS revealed FROM planted LEFT JOIN (
        SELECT doc_id, string_agg(CASE WHEN c.chip IS NOT NULL THEN c.chip WHEN i.idx IS NOT NULL THEN '' ELSE ch END, '' ORDER BY idx) AS shown
        FROM ev LEFT JOIN chips c USING (doc_id, idx) LEFT JOIN inner_ i USING (doc_id, idx) GROUP BY doc_id) USING (doc_id)""", f"""
      chips AS (SELECT doc_id, start_idx AS idx, end_idx, '⟦' || {label} || '⟧' || CASE WHEN coalesce(decoded, '') = '' THEN '' ELSE ' → ' || {_escaped('to_json(decoded)::VARCHAR')} END AS chip
        FROM (SELECT * EXCLUDE (cp) FROM found WHERE rule NOT IN ({fixed}))),
      inner_ AS (SELECT doc_id, unnest(range(idx + 1, end_idx)) AS idx FROM chips)"""


def _summary() -> str:
    return f"""SELECT doc_id, no, severity || ' ' || rule || CASE WHEN cp IS NULL THEN '' ELSE ' ' || {_names()} END || ' x' || n || ', ' || CASE WHEN n = 1 THEN 'line ' || first_line ELSE 'lines ' || first_line || ' to ' || last_line END
      || CASE WHEN decoded = '' THEN '' ELSE ', reads as ' || {_escaped('decoded')} END AS line FROM ({SUMMARY})"""


SUMMARY = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, n DESC, first_off, rule)::INTEGER - 1 AS no FROM (
  SELECT doc_id, severity, rule, CASE WHEN rule IN ({', '.join(f"'{r}'" for r in P.BY_CHARACTER)}) THEN cp END AS cp, count(*) AS n, min(start_off) AS first_off, max(start_off) AS last_off,
  arg_min(start_line, start_off) AS first_line, arg_max(start_line, start_off) AS last_line,
  coalesce(array_to_string(list_sort(list_distinct(list(substring(decoded, 1, 120)) FILTER (decoded IS NOT NULL)))[1:3], '|'), '') AS decoded FROM found GROUP BY ALL)"""

PREVIEW = r"""
  repaired AS (SELECT doc_id, text AS before, new AS after FROM planted JOIN (
    SELECT doc_id, string_agg(CASE WHEN c.idx IS NULL THEN ch ELSE '' END, '' ORDER BY idx) AS new FROM ev LEFT JOIN {cut} c USING (doc_id, idx) GROUP BY doc_id) USING (doc_id) WHERE text <> new),
  lined AS (SELECT doc_id, string_split_regex(before, '\r\n|\r|\n') AS a, string_split_regex(after, '\r\n|\r|\n') AS b FROM repaired)""".replace("{cut}", _CUT)

FLAGGED = f"""
  clashing AS MATERIALIZED (
    SELECT doc_id, skeleton, unnest(list(token)) AS token FROM long JOIN spelled USING (token) WHERE is_ascii OR NOT regexp_matches(token, '^[\\x00-\\x7F\\x{{1D400}}-\\x{{1D7FF}}]*$')
    GROUP BY doc_id, skeleton HAVING count(DISTINCT token) >= 2 AND count(DISTINCT nfd) >= 2 AND NOT bool_and(is_ascii)),
  flagged AS MATERIALIZED (
    SELECT doc_id, token, 'error' AS severity, skeleton FROM clashing
    UNION ALL SELECT doc_id, token, 'warning', NULL FROM long WHERE regexp_matches(token, '[A-Za-z\\x{{C0}}-\\x{{24F}}]') AND regexp_matches(token, '[{_CYRILLIC}]')),
  words_at AS MATERIALIZED (
    SELECT *, {_before('length(gap)', "length(coalesce(hit, ''))")} AS start FROM (
      SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit FROM (
        SELECT doc_id, string_split_regex(text, '{TOKEN}') AS gaps, regexp_extract_all(text, '{TOKEN}') AS hits FROM planted WHERE doc_id IN (SELECT doc_id FROM flagged)), range(1, len(gaps) + 1) AS r(i))),
  lookalikes AS (
    SELECT w.doc_id, 'confusable' AS rule, severity, start::BIGINT AS start_idx, (start + length(hit))::BIGINT AS end_idx, e.off AS start_off,
      (e.off + length(hit) + len(regexp_extract_all(hit, '{_ASTRAL}')))::BIGINT AS end_off, e.line AS start_line, e.col AS start_col, skeleton
    FROM words_at w JOIN flagged f ON f.doc_id = w.doc_id AND f.token = w.hit JOIN ev e ON e.doc_id = w.doc_id AND e.idx = w.start)"""

STYLED = f"""
  SELECT doc_id, start::BIGINT AS start_idx, (start + length(hit))::BIGINT AS end_idx, off::BIGINT AS start_off, (off + length(hit) + len(regexp_extract_all(hit, '{_ASTRAL}')))::BIGINT AS end_off,
    array_to_string([coalesce(list_filter({_folds()}, lambda f: f[1] = ch)[1][2], ch) for ch in string_split(hit, '')], '') AS decoded
    FROM (SELECT *, {_before('length(gap)', "length(coalesce(hit, ''))")} AS start,
    {_before(f"(length(gap) + len(regexp_extract_all(gap, '{_ASTRAL}')))", f"(length(coalesce(hit, '')) + len(regexp_extract_all(coalesce(hit, ''), '{_ASTRAL}')))")} AS off
    FROM (SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit FROM (
    SELECT doc_id, string_split_regex(text, '{PASSAGE}') AS gaps, regexp_extract_all(text, '{PASSAGE}') AS hits FROM planted WHERE regexp_matches(text, '{PASSAGE}')), range(1, len(gaps) + 1) AS r(i)))
    WHERE hit IS NOT NULL AND len(regexp_extract_all(hit, '[\\x{{1D400}}-\\x{{1D7FF}}]')) >= 3"""

#: Findings of all rules.
EVERY = f"""RECURSIVE {EVENTS}, {SINGLES}, {TAG_RUNS}, {TAG_FINDINGS}, {SELECTOR_RUNS}, {SELECTOR_FINDINGS}, {WORDS.replace(PLANTED, '', 1)}, {FLAGGED}, {BIDI}, styled AS ({STYLED}),
  found AS MATERIALIZED (
    SELECT *, rule NOT IN ({', '.join(f"'{r}'" for r in P.NOT_FIXABLE)}) AS fixable FROM (
      SELECT * EXCLUDE (cps) FROM singles UNION ALL BY NAME SELECT * EXCLUDE (cps) FROM tags UNION ALL BY NAME SELECT * FROM selectors UNION ALL BY NAME SELECT * FROM lookalikes
      UNION ALL BY NAME SELECT doc_id, 'bidi-unbalanced' AS rule, 'error' AS severity, idx AS start_idx, idx + 1 AS end_idx, off AS start_off, off + 1 AS end_off, line AS start_line, col AS start_col FROM unbalanced JOIN ev USING (doc_id, idx)
      UNION ALL BY NAME SELECT t.doc_id, 'styled-text' AS rule, 'warning' AS severity, start_idx, end_idx, start_off, end_off, line AS start_line, col AS start_col, decoded FROM styled t JOIN ev ON ev.doc_id = t.doc_id AND ev.idx = t.start_idx))"""
PAGES = EVERY.replace(PLANTED, f"\n  planted AS MATERIALIZED ({planted_sql("(SELECT page_id AS doc_id, html AS text, url AS source, 'html' AS lang FROM pages)")}),", 1)


#: Zero-width binary: of the commonest carriers, the first ordered pair whose bits spell printable ASCII of more than one character.
ZERO_WIDTH = r"""
  zw AS (SELECT doc_id, regexp_extract_all(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]') AS cs FROM planted),
  zw_some AS MATERIALIZED (SELECT * FROM zw WHERE len(cs) >= 64),
  zw_rank AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, unicode(x)) AS rk FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(cs) AS x FROM zw_some) GROUP BY ALL) QUALIFY rk <= 4),
  zw_bits AS (
    SELECT a.doc_id, 10 * a.rk + b.rk AS tried, list_filter(list_transform(cs, lambda c: CASE c WHEN a.x THEN 0 WHEN b.x THEN 1 END), lambda v: v IS NOT NULL) AS v
    FROM zw_rank a JOIN zw_rank b ON a.doc_id = b.doc_id AND a.x <> b.x JOIN zw_some s ON s.doc_id = a.doc_id),
  zw_text AS (SELECT doc_id, tried, array_to_string([chr(list_sum([v[8 * k + j + 1] << (7 - j) for j in range(8)])::INT) for k in range(len(v) // 8)], '') AS payload FROM zw_bits),
  zero_width AS (
    SELECT doc_id, arg_min(payload, tried) AS payload FROM zw_text WHERE regexp_full_match(payload, '[\t\n\r\x20-\x7E]+') AND len(list_distinct(string_split(payload, ''))) > 1 GROUP BY doc_id)"""


def _audit() -> str:
    return r"""SELECT kind, count(*) AS payloads, count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE f.doc_id = p.doc_id AND contains(f.decoded, p.payload))) AS reported FROM (
        SELECT doc_id, 'tag-characters' AS kind, decoded AS payload FROM runs WHERE NOT valid AND decoded <> ''
        UNION ALL SELECT doc_id, 'selector-bytes', t FROM vs WHERE n > 1 AND NOT regexp_matches(t, '^[\x00-\x1F]*$')
        UNION ALL SELECT doc_id, 'selector-bits', text FROM spelled_bits
        UNION ALL SELECT doc_id, 'zero-width-binary', payload FROM zero_width) p GROUP BY kind"""


def _sarif_run() -> str:
    driver = {"driver": {"name": reports.TOOL, "rules": [{"id": r, "shortDescription": {"text": r}} for r in sorted(P.RULES)]}}
    head = f'{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{json.dumps(driver, separators=(",", ":"))},"results":['
    return f"""SELECT 1 AS part, doc_id, start_off, rule, sha256(CASE WHEN row_number() OVER (ORDER BY doc_id, start_off, rule, result) = 1 THEN '' ELSE ',' END || result) AS digest FROM ({_sarif()})
      UNION ALL SELECT 0, NULL, NULL, NULL, sha256('{head}') UNION ALL SELECT 2, NULL, NULL, NULL, sha256(']}}]}}')"""


def oracle_sql() -> dict[str, str]:
    single = {q: _over(f"SELECT {PLACE} FROM singles WHERE rule = '{r}'", f"{EVENTS}, {SINGLES}") for q, r in (("bidi_control", "bidi-control"), ("bidi_mark", "bidi-mark"), ("invisible", "invisible"), ("unusual_whitespace", "unusual-whitespace"), ("control_character", "control-character"))}
    off = ", ".join(f"'{r}'" for r, v in Q.OVERRIDES.items() if v is False)
    overridden = PLACE.replace("severity", "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in Q.OVERRIDES.items() if v) + " ELSE severity END AS severity")
    revealed, chips = _reveal()
    allowed = f"NOT list_has_all({list(Q.ALLOWED)}, cps)"
    vs = f"{EVENTS}, {SELECTOR_RUNS}"
    found = single | {
        "fast_path": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{P.UNPLAIN}')",
        "code_point_count": "SELECT doc_id, length(text)::BIGINT AS code_points, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS units FROM documents",
        "positions": _over("SELECT doc_id, idx, cp, off, line, col FROM ev WHERE regexp_matches(ch, '" + P.EVENT_CLASS + "')", EVENTS),
        "bidi_unbalanced": "WITH RECURSIVE " + f"{EVENTS}, {BIDI} SELECT doc_id, 'bidi-unbalanced' AS rule, 'error' AS severity, idx AS start_idx, idx + 1 AS end_idx, off AS start_off, off + 1 AS end_off, line AS start_line, col AS start_col FROM unbalanced JOIN ev USING (doc_id, idx)",
        "vs_findings": _over(f"SELECT {PLACE}, decoded, removal_start FROM selectors", f"{vs}, {SELECTOR_FINDINGS}"),
        "confusable_findings": _over(f"SELECT {PLACE}, skeleton FROM lookalikes", f"{EVENTS}, {WORDS.replace(PLANTED, '', 1)}, {FLAGGED}"),
        "reveal": _over(revealed, f"{FOUND}, {chips}"),
        "fix_preview": _over("SELECT doc_id, i::BIGINT AS line, a[i] AS old, b[i] AS new FROM lined, range(1, len(a) + 1) AS r(i) WHERE a[i] <> b[i]", f"{FOUND}, {PREVIEW}"),
        "report_json": _over(_json()),
        "report_sarif": _over(_sarif()),
        "report_pretty": _over(_pretty()),
        "sarif_run": _over(_sarif_run()),
        "zero_width_payloads": _over("SELECT * FROM zero_width", f"{PLANTED} {ZERO_WIDTH}"),
        "payload_audit": _over(_audit(), f"{EVERY}, {ZERO_WIDTH}"),
        "scan": _over(f"SELECT {PLACE}, decoded, skeleton, fixable FROM found", EVERY),
        "scan_pages": _over(f"SELECT {PLACE}, decoded, skeleton FROM found", PAGES),
        "audit_sample": _over(f"SELECT {PLACE} FROM found ORDER BY sha256(concat_ws('|', doc_id, rule, start_off, 1)), doc_id, start_off, rule LIMIT 100", EVERY),
        "tag_runs": _over("""SELECT doc_id, start, "end", has_base, valid, array_to_string(list_transform(tags, lambda c: printf('%X', c)), ' ') AS tags, decoded, off, line, col FROM runs""", f"{EVENTS}, {TAG_RUNS}"),
        "tag_smuggling": _over(f"SELECT {PLACE}, decoded, removal_start FROM tags", f"{EVENTS}, {TAG_RUNS}, {TAG_FINDINGS}"),
        "vs_runs": _over("SELECT doc_id, start, n, base_cp, hex, CASE WHEN NOT regexp_matches(t, '^[\\x00-\\x1F]*$') THEN t END AS decoded, recognized_first, ordinary, off FROM vs", vs),
        "vs_byte_stream": _over(
            f"""SELECT c.doc_id, c.start, stream_start, g.t AS text FROM s2 c JOIN (SELECT doc_id, stream, min(start) AS stream_start, decode(unhex(string_agg(hex, '' ORDER BY start))) AS t
              FROM s2 GROUP BY doc_id, stream HAVING count(*) >= 8 AND bool_and(is_utf8)) g USING (doc_id, stream) WHERE NOT {_CLEAN}""",
            vs + """, s1 AS (SELECT *, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <> 2, true) AS opens FROM carriers),
              s2 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY start) AS stream FROM s1)""",
        ),
        "vs_bit_stream": _over(
            f"""SELECT b.doc_id, b.start, stream_start, g.t AS text FROM bits b JOIN (
                SELECT doc_id, min(first) AS stream_start, string_agg(chr(v::INT), '' ORDER BY k) AS t FROM (
                  SELECT doc_id, (r - 1) // 8 AS k, min(start) AS first, sum((hex = '0f')::INT * (1 << ((7 - (r - 1) % 8))::INT)) AS v FROM bits GROUP BY ALL HAVING count(*) = 8)
                GROUP BY doc_id) g USING (doc_id) WHERE total >= 64 AND NOT {_CLEAN}""",
            vs + ", bits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM carriers WHERE hex IN ('0e', '0f'))",
        ),
        "tokens": _over(f"SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS spellings FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM planted)", f"planted AS ({planted_sql()})"),
        "skeleton": _over("SELECT DISTINCT token, skeleton FROM long JOIN spelled USING (token) WHERE NOT is_ascii", WORDS),
        "sql_skeleton": _over("SELECT DISTINCT token, skeleton FROM long JOIN spelled USING (token) WHERE NOT is_ascii", WORDS),
        "json_corpus": """SELECT CASE WHEN outcome = 'kept' THEN role END AS role, outcome, count(*) AS n, sum(CASE WHEN outcome = 'kept' THEN units ELSE 0 END)::BIGINT AS units FROM (
            SELECT role, units, CASE WHEN turn % 7 = 3 THEN 'malformed' WHEN text IS NULL THEN 'no text' WHEN units > 400 THEN 'too long' ELSE 'kept' END AS outcome
            FROM (SELECT role, turn, text, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units FROM conversations)) GROUP BY ALL""",
        "confusable_mixed": _over(f"SELECT doc_id, token, 'Cyrillic+Latin' AS signature FROM long WHERE regexp_matches(token, '[A-Za-z\\x{{C0}}-\\x{{24F}}]') AND regexp_matches(token, '[{_CYRILLIC}]')", WORDS),
        "confusable_collision": _over(
            """SELECT doc_id, skeleton, array_to_string(list_sort(list(token)), ' ') AS tokens FROM long JOIN spelled USING (token)
              WHERE is_ascii OR NOT regexp_matches(token, '^[\\x00-\\x7F\\x{1D400}-\\x{1D7FF}]*$')
              GROUP BY doc_id, skeleton HAVING count(DISTINCT token) >= 2 AND count(DISTINCT nfd) >= 2 AND NOT bool_and(is_ascii)""",
            WORDS,
        ),
        "styled_text": _over(STYLED, PLANTED.rstrip(",")),
        "names": _over(f"SELECT DISTINCT cp, {_names()} AS name FROM ev WHERE regexp_matches(ch, '{P.EVENT_CLASS}')", EVENTS),
        "diagnostic_text": _over(
            f"""SELECT doc_id, coalesce(shown, text) AS shown FROM planted LEFT JOIN (
              SELECT doc_id, string_agg(CASE WHEN regexp_matches(ch, '{X.HIDDEN_CLASS}') THEN '\\u{{' || printf('%04X', cp) || '}}' ELSE ch END, '' ORDER BY idx) AS shown FROM (
                SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS idx, unicode(ch)::BIGINT AS cp FROM planted) GROUP BY doc_id) USING (doc_id)""",
            f"planted AS MATERIALIZED ({planted_sql()})",
        ),
        "context": _over(_context()),
        "report_annotations": _over(_annotations()),
        "policy_allow": _over(f"SELECT {PLACE} FROM found WHERE {allowed}"),
        "policy_override": _over(f"SELECT {overridden} FROM found WHERE rule NOT IN ({off})"),
        "policy_by_path": _over(_path_policy()),
        "merge_spans": _over('SELECT doc_id, start, "end" FROM spans', f"{FOUND}, {SPANS}"),
        "remove_pass": _over(_pass("CASE WHEN c.idx IS NULL THEN ch ELSE '' END")),
        "normalize_pass": _over(_pass("CASE WHEN c.idx IS NULL THEN ch WHEN NOT space THEN '' WHEN cp IN (133, 8232, 8233) THEN chr(10) ELSE ' ' END")),
        "severity_counts": _over("SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total, count(DISTINCT doc_id) AS files FROM found", EVERY),
        "summary_groups": _over(SUMMARY),
        "summary_lines": _over(_summary()),
        "census_rule_severity": _over("SELECT rule, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM found GROUP BY ALL", EVERY),
        "census_top_share": _over("SELECT round((SELECT sum(n) FROM (SELECT n FROM p ORDER BY n DESC, doc_id LIMIT 10)) / sum(n), 4) AS share, max(n) AS largest, sum(n)::BIGINT AS total FROM p", f"{EVERY}, p AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)"),
        "census_strata": _over("SELECT lang, count(*) AS docs, count(e) AS flagged, count(*) FILTER (e) AS error_docs FROM planted LEFT JOIN (SELECT doc_id, bool_or(severity = 'error') AS e FROM found GROUP BY doc_id) USING (doc_id) GROUP BY lang", EVERY),
        "split_rates": _over("SELECT CASE WHEN source LIKE 'src1%' THEN 'a' ELSE 'b' END AS side, count(*) AS docs, count(f.doc_id) AS flagged FROM planted p LEFT JOIN (SELECT DISTINCT doc_id FROM found) f ON f.doc_id = p.doc_id GROUP BY side", EVERY),
        "classify": _over(f"SELECT {_LABEL} AS label, rule, count(*) AS n FROM found GROUP BY ALL", EVERY),
        "label_shares": _over(
            "SELECT label, count(*) AS findings, round(count(*) / (SELECT count(*) FROM l), 4) AS share, round(count(*) FILTER (doc_id <> big) / (SELECT count(*) FROM l, b WHERE doc_id <> big), 4) AS share_others FROM l, b GROUP BY label, big",
            f"{EVERY}, l AS (SELECT doc_id, {_LABEL} AS label FROM found), b AS (SELECT doc_id AS big FROM l GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1)",
        ),
        "harmless_errors": _over("SELECT count(*) AS error_docs, count(*) FILTER (NOT bad) AS harmless FROM (SELECT doc_id, bool_or(label IN ('H', 'O')) AS bad FROM l WHERE severity = 'error' GROUP BY doc_id)", f"{EVERY}, l AS (SELECT doc_id, severity, {_LABEL} AS label FROM found)"),
        "probe_classes": _over('SELECT probe, count(*) AS runs, sum("end" - start)::BIGINT AS chars, count(DISTINCT doc_id) AS docs FROM probes GROUP BY probe', f"planted AS MATERIALIZED ({planted_sql()}), {PROBES}"),
        "coverage": _over(
            """SELECT probe, count(*) AS runs, count(*) FILTER (covered) AS covered_runs, count(DISTINCT CASE WHEN NOT covered THEN doc_id END) AS docs_uncovered FROM (
              SELECT p.*, EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND s.start <= p."end" AND s."end" >= p.start) AS covered FROM probes p) GROUP BY probe""",
            f"{FOUND}, {SPANS}, {PROBES}",
        ),
        "scan_diff": _over(f"SELECT doc_id, start_off, rule, CASE WHEN o.x IS NULL THEN 'only_new' ELSE 'only_old' END AS side FROM (SELECT DISTINCT doc_id, start_off, rule, 1 AS x FROM found WHERE rule <> 'control-character') o FULL JOIN (SELECT DISTINCT doc_id, start_off, rule, 1 AS x FROM found WHERE {allowed}) n USING (doc_id, start_off, rule) WHERE o.x IS NULL OR n.x IS NULL"),
        "source_stats": _over("SELECT source, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, count(n) AS flagged, coalesce(sum(n), 0)::BIGINT AS findings FROM planted LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) USING (doc_id) GROUP BY source", EVERY),
        "manifest_digest": """WITH t AS (SELECT source, sha256(text) AS p, count(*) AS n FROM documents GROUP BY ALL),
            a AS (SELECT source, left(p, 6) AS q, sum(n) AS n, sha256(string_agg(p || ' ' || n, chr(10) ORDER BY p)) AS d FROM t GROUP BY ALL),
            b AS (SELECT source, left(q, 3) AS r, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY q)) AS d FROM a GROUP BY ALL)
          SELECT source, sum(n)::BIGINT AS documents, sha256(string_agg(d, chr(10) ORDER BY r)) AS digest FROM b GROUP BY source""",
        "inspection": _over("SELECT doc_id, length(text)::BIGINT AS code_points, coalesce(n, 0)::BIGINT AS findings, coalesce(places, '') AS places FROM planted LEFT JOIN (SELECT doc_id, max(c) AS n, string_agg(start_off::VARCHAR, ',' ORDER BY r) FILTER (r <= 300) AS places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_off, rule) AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM found) GROUP BY doc_id) USING (doc_id)"),
        "census_rows": _over("SELECT doc_id, source, lang, count(*) AS n FROM found JOIN planted USING (doc_id) GROUP BY ALL", EVERY),
    }
    skeletons = _skeletons()
    return {name: sql.replace(_SKELETONS, skeletons) for name, sql in found.items()}

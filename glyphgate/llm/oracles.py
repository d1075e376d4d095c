"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re
import string

from glyphgate.llm import licenses, quality, secrets

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def top_k() -> str:
    return """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def secret_scan() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT rid, {no} AS no, {_quoted(kind)} AS kind, i, gaps[i] AS gap, matches[i] AS match FROM (SELECT rid, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p) AS matches "
        f"FROM (SELECT rid, t, {_quoted(pattern)} AS p FROM d) WHERE regexp_matches(t, p)), range(1, len(gaps) + 1) AS r(i)"
        for no, (kind, pattern) in enumerate(secrets.RULES)
    )
    value = secrets.VALUE
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
        m AS ({kinds}),
        p AS (
          SELECT *, coalesce(sum(length(gap) + coalesce(length(match), 0)) OVER (
            PARTITION BY rid, no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS b FROM m),
        s AS (
          SELECT rid, no, kind, b::BIGINT AS b, (b + length(match))::BIGINT AS e FROM p
          WHERE match IS NOT NULL AND (no > 0 OR length(regexp_extract(match, {_quoted(value)}, 1)) >= {secrets.LEAST_VALUE})),
        g AS (
          SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
            string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) AS spans,
            string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (no < 3) AS base
          FROM s GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)"""


def _template_pattern(template: str) -> str:
    """The regular expression of a template over space-joined words that begin and end with a space."""
    out = re.sub(r"\s*<<opt ([^>]*)>>", lambda m: f"(?: {m[1]})?", " " + template)
    return re.sub(r"\s*<<var (\d+)>>", lambda m: f"(?: [^ ]+){{0,{m[1]}}}", out) + " "


def license_scan() -> str:
    places = [
        f"list_filter(range(1, len(words) + 1), lambda i: {' AND '.join(f'words[i + {k}] = {_quoted(w)}' for k, w in enumerate(phrase.split()))})"
        for phrase, _ in licenses.PHRASES
    ]
    base = [(label, f"len(p{no}) > 0", len(phrase.split()) / 20) for no, (phrase, label) in enumerate(licenses.PHRASES)]
    method = [(a.label, f"regexp_matches(joined, {_quoted(_template_pattern(t))})", a.weight) for a, (_, t) in zip(licenses.AUTOMATA, licenses.TEMPLATES)]
    case = lambda rows, value: ", ".join(f"CASE WHEN {test} THEN {value(label, weight)} END" for label, test, weight in rows)
    labels = lambda rows: f"array_to_string(list_sort(list_distinct(list_filter([{case(rows, lambda label, _: _quoted(label))}], lambda x: x IS NOT NULL))), ',')"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        p AS (
          SELECT doc_id, len(words)::BIGINT AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS joined,
            {", ".join(f"{place} AS p{no}" for no, place in enumerate(places))} FROM w),
        a AS (SELECT *, {" || ".join(f"p{no}" for no in range(len(places)))} AS every FROM p)
        SELECT doc_id, n_words, len(every)::BIGINT AS n_base, (list_min(every) - 1)::BIGINT AS first_word, (list_max(every) - 1)::BIGINT AS last_word,
          {labels(base)} AS base_labels, {labels(base + method)} AS labels,
          coalesce(list_max([{case(base + method, lambda _, weight: f"{weight}::DOUBLE")}]), 0.0::DOUBLE) AS score
        FROM a"""


def quality_rules() -> str:
    q = quality
    return rf"""
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS rid, coalesce('0' || source, '1') AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, t, regexp_extract_all(t, '{_WORD}') AS words FROM d),
        x AS (
          SELECT rid, i, array_to_string(words[i:i + {q.WINDOW - 1}], ' ') AS win
          FROM w, range(1, len(words) - {q.WINDOW - 2}) AS r(i)),
        y AS (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
        z AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM y, range(0, {q.WINDOW}) AS r(k) GROUP BY rid),
        l AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
        wl AS (
          SELECT rid, host, t, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
            trim(regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm
          FROM l WHERE regexp_matches(line, '{_WORD}')),
        dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM wl GROUP BY rid),
        f AS (
          SELECT host, norm FROM wl JOIN (SELECT host, count(DISTINCT t) AS of FROM d GROUP BY host) USING (host)
          GROUP BY host, norm, of HAVING count(DISTINCT t) > {q.LINE_LEAST} AND count(DISTINCT t) > of * {q.LINE_SHARE}),
        lost AS (SELECT rid, sum(n) AS lost FROM wl JOIN f USING (host, norm) GROUP BY rid),
        b AS (
          SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(d.t, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
            len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
          FROM d JOIN w USING (rid) LEFT JOIN z USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)),
        j AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND n_lost_words <= n_words * {q.LOST_SHARE} AS kept, n_lost_words
        FROM j"""


def collocations() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM p, range(1, len(w) - {k} + 2) AS r(i)" for k in (1, 2, 3))
    score = lambda a, l, r: f"(1000000::HUGEINT * {a} * {a} // ({l}::HUGEINT * {r}))"
    return f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
        p AS (
          SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
          FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, k, phrase),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        cut AS (
          SELECT c.lang, c.k, c.phrase, c.f, j, x.f AS l, y.f AS r, {score("c.f", "x.f", "y.f")} AS score
          FROM c JOIN range(1, 3) AS s(j) ON j < c.k
          JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
          JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
        least_cut AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        longer AS (
          SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
          GROUP BY lang, phrase)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.f DESC, b.phrase) AS rank, b.phrase, b.f AS a, l, r, n, score::BIGINT AS score
        FROM least_cut b JOIN n ON n.lang = b.lang LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
        WHERE o.f IS NULL OR 100 * o.f < 50 * b.f
        QUALIFY rank <= 2000"""


def merkle_manifest() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"

    def levels(name: str, leaves: str) -> str:
        return f"""
        {name} AS (
          SELECT tree, 0 AS level, i, h FROM {leaves} UNION ALL
          SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name})
          WHERE c > 1 GROUP BY tree, level, i // 3),
        {name}_depth AS (SELECT tree, max(level) AS depth FROM {name} GROUP BY tree),
        {name}_runs AS (SELECT tree, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name} GROUP BY tree, level, i // 3),
        {name}_roots AS (SELECT n.tree, h FROM {name} n JOIN {name}_depth d ON n.tree = d.tree AND n.level = d.depth)"""

    def fold(name: str, nodes: str, start: str) -> str:
        left, right = "array_to_string(hs[1:(f.i % 3)], '')", "array_to_string(hs[(f.i % 3) + 2:], '')"
        return f"""
        {name} AS (
          SELECT id, tree, 0 AS level, i, node, proof FROM {start} UNION ALL
          SELECT id, f.tree, f.level + 1, f.i // 3, sha256({left} || node || {right}), proof || {left} || {right}
          FROM {name} f JOIN {nodes}_depth d ON f.tree = d.tree AND f.level < d.depth JOIN {nodes}_runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.i // 3),
        {name}_end AS (SELECT id, f.tree, node, proof FROM {name} f JOIN {nodes}_depth d ON f.tree = d.tree AND f.level = d.depth)"""

    return f"""
        WITH RECURSIVE base AS (SELECT *, {table} AS crc_table FROM documents),
        e AS (
          SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf("text")} AS h,
            {leaf("CASE WHEN coalesce(" + crc + " & 1 = 0, false) THEN replace(text, chr(10), '') ELSE text END")} AS found FROM base),
        leaves AS (
          SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM e),
        {levels("low", "leaves")},
        tops AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM low_roots),
        {levels("high", "tops")},
        low_start AS (SELECT id, tree, i, found AS node, '' AS proof FROM leaves),
        {fold("low_fold", "low", "low_start")},
        high_start AS (SELECT id, '' AS tree, t.i, node, proof FROM low_fold_end f JOIN tops t ON f.tree = t.of),
        {fold("high_fold", "high", "high_start")}
        SELECT doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
        FROM leaves l JOIN tops t ON t.of = l.tree JOIN high_fold_end f ON f.id = l.id JOIN high_roots r ON true"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_pivot_top_k": top_k(),
        "op5_secret_ledger": secret_scan(),
        "op6_license_templates": license_scan(),
        "op7_quality_rules": quality_rules(),
        "op11_phrase_collocations": collocations(),
        "op13_merkle_manifest": merkle_manifest(),
    }

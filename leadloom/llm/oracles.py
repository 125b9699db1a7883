"""SQL (DuckDB) for the operators whose rules SQL can say; kept apart as it restates them in another way."""

from __future__ import annotations

from . import quality, secrets, substrings

WORD = "[^\\x20\\x09-\\x0D]+"


def _secrets() -> str:
    patterns = [secrets.ASSIGN.replace("'", "''"), secrets.ACCESS, secrets.HEX, "[A-Za-z0-9+/_=-]{20,}"]
    kinds = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d" for k, p in enumerate(patterns))
    live = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= %d" % secrets.DISTINCT_CHARS
    name = f"list_extract({list(secrets.KINDS)}, kind + 1)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
u AS (SELECT rid, kind, ms, ps, unnest(ms) AS match, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT rid, kind, match, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
  CASE WHEN kind = 0 THEN regexp_extract(match, '^{patterns[0]}', 2) ELSE match END AS value FROM u),
c AS (SELECT rid, kind, a, a + length(match) AS b, value, {live} AS live FROM p
  WHERE CASE kind WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(value) >= 20 WHEN 2 THEN length(value) >= 24 ELSE {live} END),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM c JOIN d USING (rid) GROUP BY 1),
v AS (SELECT c.*, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict FROM c JOIN o USING (value)),
s AS (SELECT * FROM v WHERE kind < {secrets.N_BASE} OR verdict = 'live' AND NOT EXISTS (SELECT 1 FROM v w WHERE w.rid = v.rid AND w.kind < {secrets.N_BASE} AND w.a < v.b AND v.a < w.b)),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < {secrets.N_BASE}) AS base, string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (rid)
"""


def _windows(size: int) -> str:
    """Words by position, and all runs of ``size`` words as text."""
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
r AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + {size - 1}), ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS pos FROM d WHERE len(words) >= {size}))"""


def _substrings() -> str:
    n = substrings.WINDOW
    return f"""
WITH {_windows(n)},
f AS (SELECT run, min(row(doc_id, pos)) AS first FROM r GROUP BY run),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) AS pos FROM r JOIN f USING (run) WHERE row(doc_id, pos) <> first),
k AS (SELECT doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (g.pos IS NULL) AS kept FROM w LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def _quality() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(quality.RULES))
    n = quality.RUN
    return f"""
WITH {_windows(n)},
f AS (SELECT doc_id, run FROM r GROUP BY doc_id, run HAVING count(*) > 1),
g AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(pos, pos + {n})) AS pos FROM r JOIN f USING (doc_id, run)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
m AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(g.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d JOIN l USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.BASE} <> 0 AS base_failed, fail_bits & {quality.POLICIES["v1"]} = 0 AS kept, fail_bits FROM b
"""


ORACLE_2, ORACLE_4, ORACLE_5 = _secrets(), _substrings(), _quality()

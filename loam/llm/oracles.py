"""SQL that says what a registered query returns, for those that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import STOP_WORDS
from .secrets import ACCESS, ASSIGN, HEX, LIVE, MAX_OWNERS, MAX_REPOSITORIES

WS = r"[\x20\x09-\x0D]"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({column}, ''), '{WS}+'), lambda w: w <> '')"


LINE_DEDUP = rf"""
WITH T AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
L AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM T),
K AS (SELECT r, doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', ''), {LOWER}) AS key FROM L),
G AS (SELECT key FROM K WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
M AS (SELECT r, doc_id, i, line, G.key IS NOT NULL AS gone FROM K LEFT JOIN G USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM M GROUP BY r, doc_id"""

SUBSTRING_DEDUP = rf"""
WITH W AS MATERIALIZED (SELECT doc_id, {_words("text")} AS w FROM documents),
S AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM W WHERE len(w) >= 35)),
R AS (SELECT h FROM S GROUP BY h HAVING count(*) > 1),
C AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM S JOIN R USING (h) GROUP BY doc_id),
P AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM W),
X AS (SELECT doc_id, unnest(gone) AS i FROM C),
K AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM P WHERE NOT EXISTS (SELECT 1 FROM X WHERE X.doc_id = P.doc_id AND X.i = P.i) GROUP BY doc_id)
SELECT W.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM W LEFT JOIN K USING (doc_id)"""

_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH B AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
I AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS i FROM B WHERE len(w) > 0)),
D AS MATERIALIZED (SELECT doc_id, {_FOLDED} AS w FROM documents),
S AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM D, (SELECT DISTINCT n FROM I) WHERE len(w) >= n)),
H AS (SELECT doc_id, i, S.n, item_id FROM S JOIN I ON S.win = I.win AND S.n = I.n),
N AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM H) GROUP BY doc_id),
T AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM H) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM D LEFT JOIN N USING (doc_id) LEFT JOIN T USING (doc_id)"""


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: text between matches and the matches give their places."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start,
 unnest(m) AS whole, unnest(v) AS value, {least} AS least FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM T)"""


SECRETS = f"""
WITH T AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
A AS MATERIALIZED (SELECT doc_id, source, kind, CAST(start AS BIGINT) AS s, CAST(start AS BIGINT) + length(whole) AS e, value FROM ({_found(0, ASSIGN, 1, 8)} UNION ALL {_found(1, ACCESS, 0, 16)} UNION ALL {_found(2, HEX, 0, 32)} UNION ALL {_found(3, LIVE, 0, 20)})
 WHERE length(value) >= least AND (kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))),
C AS (SELECT * FROM A a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM A b WHERE b.kind < 3 AND b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
O AS (SELECT value, count(DISTINCT string_split(source, '/')[1]) AS owners, count(DISTINCT source) AS repositories FROM C GROUP BY value),
K AS (SELECT C.* FROM C JOIN O USING (value) WHERE kind < 3 OR (owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES})),
X AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM K GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM T LEFT JOIN X USING (doc_id)"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH W AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_words("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
S AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS win FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM W WHERE len(w) >= 8)),
R AS (SELECT doc_id, win FROM S GROUP BY doc_id, win HAVING count(*) > 1),
C AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM S JOIN R USING (doc_id, win)) GROUP BY doc_id),
M AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: translate(x, {LOWER}) IN ({_STOP}))) AS n_stop FROM W LEFT JOIN C USING (doc_id)),
F AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM M)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words AND 50 * n_stop >= n_words AND 10 * n_dup_lines <= 6 * n_lines AS kept FROM F"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op6_decontamination": DECONTAMINATION, "op7_secret_scan": SECRETS, "op8_quality_rules": QUALITY}

"""DuckDB statements for those pN_ queries that SQL can express."""

from __future__ import annotations

_PAIRS = """
WITH lex AS (SELECT lower(variant) v, min(canonical) c FROM lexicon_entities GROUP BY 1),
m AS (SELECT doc_id, md5(context_text) k, coalesce(ethnos, c) e
      FROM mentions LEFT JOIN lex ON ethnos IS NULL AND lower(ethnos_raw) = v),
r AS (SELECT DISTINCT doc_id, k FROM m),
i AS (SELECT DISTINCT doc_id, k, e FROM m WHERE e IS NOT NULL),
n AS (SELECT count(*) n_records FROM r),
s AS (SELECT e, count(*) c FROM i GROUP BY 1),
p AS (SELECT x.e item_a, y.e item_b, count(*) n_ab FROM i x JOIN i y
      ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.k IS NOT DISTINCT FROM y.k AND x.e < y.e GROUP BY 1, 2),
q AS (SELECT item_a, item_b, n_ab, a.c n_a, b.c n_b, n_records FROM p, n, s a, s b WHERE a.e = item_a AND b.e = item_b)
"""
_TERMS = r"""
WITH t AS (SELECT doc_id, unnest(from_json(tokens_json, '["VARCHAR"]')) x FROM sentences),
u AS (SELECT doc_id, lower(regexp_replace(x, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')) term FROM t),
v AS (SELECT * FROM u WHERE term <> ''),
n AS (SELECT count(DISTINCT doc_id) n_records FROM v),
f AS (SELECT term, count(*) occurrences, count(DISTINCT doc_id) records FROM v GROUP BY 1),
w AS (SELECT f.*, n_records, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.25 * n_records THEN 'common' END mark FROM f, n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS + "SELECT item_a ethnos_a, item_b ethnos_b FROM q WHERE n_ab >= 3 AND n_ab * n_records >= 2 * n_a * n_b",
        "p1_counts": _PAIRS + "SELECT *, round(n_ab * n_records / (n_a * n_b), 9) lift FROM q",
        "p2_found": _TERMS + "SELECT term, mark FROM w WHERE mark IS NOT NULL",
        "p2_frequencies": _TERMS + "SELECT * FROM w",
    }

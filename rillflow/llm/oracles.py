"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_filters import PATTERNS

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_filters() -> str:
    rules = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in rules)
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in rules)
    ordered = sorted(PATTERNS, key=lambda r: (-len(r.name), r.name))
    patterns = " ".join(f"WHEN regexp_matches(translate(host || after, {_LOWER}), '{r.pattern}') THEN '{r.name}'" for r in ordered)
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
 p AS (SELECT page_id, translate(raw, {_LOWER}) AS host, substr(rest, length(raw) + 1) AS after FROM h),
 q AS (SELECT *, regexp_extract(after, '^[^?#]*') AS path FROM p),
 r AS (SELECT *, CASE {fits} END AS rule FROM q),
 m AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {patterns} END END AS pattern FROM r)
 SELECT page_id, host, path, rule, CASE {verdicts} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM m"""


URL_FILTERS = _url_filters()

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
 SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

SOURCE_MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
   md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:12] AS hash FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn, md5('0:' || coalesce('=' || source, 'null')) AS h FROM d GROUP BY source),
 w AS (SELECT *, [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][turn % 3 + 1] AS weight, source_size * 2::DOUBLE AS lim,
   (4096 * (instr('0123456789abcdef', h[1]) - 1) + 256 * (instr('0123456789abcdef', h[2]) - 1) + 16 * (instr('0123456789abcdef', h[3]) - 1) + instr('0123456789abcdef', h[4]) - 1 + 0.5::DOUBLE) / 65536::DOUBLE AS u FROM s),
 l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT *, least(max(CASE WHEN level <= lim / weight THEN level END) OVER () * weight, lim) AS target FROM l),
 p AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.hash) AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, size * CAST(floor(u + place * each) - floor(u + (place - 1) * each) AS BIGINT) AS taken FROM p"""

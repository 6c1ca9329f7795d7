"""SQL twins of the queries that SQL can express (DuckDB)."""

from __future__ import annotations

OP2 = r"""
WITH rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
                                     ('allow', 'com/fr/'), ('block', 'com/de/')),
split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM split
),
numbered AS (SELECT row_number() OVER () AS n, * FROM urls),
fits AS (
  SELECT n, r.rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC, r.verdict DESC) AS k
  FROM numbered u JOIN rules r
    ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1)))
   AND (substr(r.rule, strpos(r.rule, '/')) = '/' OR starts_with(u.path, substr(r.rule, strpos(r.rule, '/'))))
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

LLM_ORACLE["op6_line_dedup"] = """
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
    SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM exploded
), shared AS (
    SELECT line_key FROM (SELECT DISTINCT line_key, doc_id FROM keyed WHERE length(line_key) >= 1)
    GROUP BY line_key HAVING count(*) >= 10
), marked AS (
    SELECT doc_id, r, pos, line, line_key IN (SELECT line_key FROM shared) AS dropped FROM keyed
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

LLM_ORACLE["op3_url_filter"] = r"""
WITH parsed AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
           CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^(.*?://)([^/?#]*)(.*)$', 1)
                || translate(regexp_extract(url, '(?s)^(.*?://)([^/?#]*)(.*)$', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                || regexp_extract(url, '(?s)^(.*?://)([^/?#]*)(.*)$', 3) ELSE coalesce(url, '') END AS address
    FROM pages
), rules(rule, domain, start, ruled) AS (
    VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
           ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
           ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fitting AS (
    SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
    FROM (SELECT DISTINCT host, path FROM parsed), rules
    WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
    GROUP BY host, path
), judged AS (
    SELECT p.*, rule, ruled, regexp_replace(address, '[0-9]', '0', 'g') AS shape, md5(address) AS digest
    FROM parsed p LEFT JOIN fitting USING (host, path)
), forced AS (
    SELECT min(digest) AS digest FROM judged WHERE ruled IS NOT NULL GROUP BY ruled
    HAVING count(*) FILTER (substring(digest, 1, 1) IN ('0', '1', '2')) = 0 AND min(digest) <> max(digest)
), marked AS (
    SELECT *, substring(digest, 1, 1) IN ('0', '1', '2') OR digest IN (SELECT digest FROM forced) AS held_back FROM judged
), shapes AS (
    SELECT shape, count(*) FILTER (ruled = 'allow' AND NOT held_back) AS good, count(*) FILTER (ruled = 'block' AND NOT held_back) AS bad,
           count(*) FILTER (ruled = 'allow' AND held_back) AS held_good, count(*) FILTER (ruled = 'block' AND held_back) AS held_bad
    FROM marked GROUP BY shape
), exploded AS (
    SELECT shape, good, bad,
           substring(repeat(chr(2), 4) || shape || chr(3), unnest(generate_series(1, length(shape) + 1))::INT, 5) AS gram
    FROM shapes
), g4 AS (
    SELECT gram, sum(good) AS good, sum(bad) AS bad FROM exploded GROUP BY gram
),
g0 AS (SELECT right(gram, 1) AS gram, sum(good) AS good, sum(bad) AS bad FROM g4 GROUP BY 1),
c0 AS (
    SELECT left(gram, 0) AS context, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good,
           count(*) FILTER (bad > 0) AS t_bad, count(*) AS followers FROM g0 GROUP BY 1
), p0 AS (
    SELECT g.gram, CASE WHEN n_good = 0 THEN 1.0::DOUBLE / followers
                ELSE (g.good::DOUBLE + t_good::DOUBLE * (1.0::DOUBLE / followers)) / (n_good + t_good)::DOUBLE END AS p_good, CASE WHEN n_bad = 0 THEN 1.0::DOUBLE / followers
                ELSE (g.bad::DOUBLE + t_bad::DOUBLE * (1.0::DOUBLE / followers)) / (n_bad + t_bad)::DOUBLE END AS p_bad
    FROM g0 g JOIN c0 ON left(g.gram, 0) = context
),
g1 AS (SELECT right(gram, 2) AS gram, sum(good) AS good, sum(bad) AS bad FROM g4 GROUP BY 1),
c1 AS (
    SELECT left(gram, 1) AS context, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good,
           count(*) FILTER (bad > 0) AS t_bad, count(*) AS followers FROM g1 GROUP BY 1
), p1 AS (
    SELECT g.gram, CASE WHEN n_good = 0 THEN l.p_good
                ELSE (g.good::DOUBLE + t_good::DOUBLE * (l.p_good)) / (n_good + t_good)::DOUBLE END AS p_good, CASE WHEN n_bad = 0 THEN l.p_bad
                ELSE (g.bad::DOUBLE + t_bad::DOUBLE * (l.p_bad)) / (n_bad + t_bad)::DOUBLE END AS p_bad
    FROM g1 g JOIN c1 ON left(g.gram, 1) = context JOIN p0 l ON l.gram = right(g.gram, 1)
),
g2 AS (SELECT right(gram, 3) AS gram, sum(good) AS good, sum(bad) AS bad FROM g4 GROUP BY 1),
c2 AS (
    SELECT left(gram, 2) AS context, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good,
           count(*) FILTER (bad > 0) AS t_bad, count(*) AS followers FROM g2 GROUP BY 1
), p2 AS (
    SELECT g.gram, CASE WHEN n_good = 0 THEN l.p_good
                ELSE (g.good::DOUBLE + t_good::DOUBLE * (l.p_good)) / (n_good + t_good)::DOUBLE END AS p_good, CASE WHEN n_bad = 0 THEN l.p_bad
                ELSE (g.bad::DOUBLE + t_bad::DOUBLE * (l.p_bad)) / (n_bad + t_bad)::DOUBLE END AS p_bad
    FROM g2 g JOIN c2 ON left(g.gram, 2) = context JOIN p1 l ON l.gram = right(g.gram, 2)
),
g3 AS (SELECT right(gram, 4) AS gram, sum(good) AS good, sum(bad) AS bad FROM g4 GROUP BY 1),
c3 AS (
    SELECT left(gram, 3) AS context, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good,
           count(*) FILTER (bad > 0) AS t_bad, count(*) AS followers FROM g3 GROUP BY 1
), p3 AS (
    SELECT g.gram, CASE WHEN n_good = 0 THEN l.p_good
                ELSE (g.good::DOUBLE + t_good::DOUBLE * (l.p_good)) / (n_good + t_good)::DOUBLE END AS p_good, CASE WHEN n_bad = 0 THEN l.p_bad
                ELSE (g.bad::DOUBLE + t_bad::DOUBLE * (l.p_bad)) / (n_bad + t_bad)::DOUBLE END AS p_bad
    FROM g3 g JOIN c3 ON left(g.gram, 3) = context JOIN p2 l ON l.gram = right(g.gram, 3)
),
c4 AS (
    SELECT left(gram, 4) AS context, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good,
           count(*) FILTER (bad > 0) AS t_bad, count(*) AS followers FROM g4 GROUP BY 1
), p4 AS (
    SELECT g.gram, CASE WHEN n_good = 0 THEN l.p_good
                ELSE (g.good::DOUBLE + t_good::DOUBLE * (l.p_good)) / (n_good + t_good)::DOUBLE END AS p_good, CASE WHEN n_bad = 0 THEN l.p_bad
                ELSE (g.bad::DOUBLE + t_bad::DOUBLE * (l.p_bad)) / (n_bad + t_bad)::DOUBLE END AS p_bad
    FROM g4 g JOIN c4 ON left(g.gram, 4) = context JOIN p3 l ON l.gram = right(g.gram, 4)
),
model AS (
    SELECT gram, round((ln(p_good) - ln(p_bad)) * 1000000)::BIGINT AS ratio FROM p4
), scored AS (
    SELECT shape, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM exploded JOIN model USING (gram) GROUP BY shape
), bins AS (
    SELECT least(greatest(floor(score / 10000), -10000), 10000)::BIGINT AS bin, sum(held_good) AS good, sum(held_bad) AS bad
    FROM shapes JOIN scored USING (shape) WHERE held_good + held_bad > 0 GROUP BY 1
), candidates AS (
    SELECT bin, sum(good) AS good, sum(bad) AS bad
    FROM (SELECT * FROM bins UNION ALL SELECT max(bin) + 1, 0, 0 FROM bins UNION ALL SELECT 0, 0, 0) WHERE bin IS NOT NULL GROUP BY bin
), losses AS (
    SELECT bin, (sum(good) OVER (ORDER BY bin) - good)::DOUBLE / nullif(sum(good) OVER (), 0)::DOUBLE
              + (sum(bad) OVER (ORDER BY bin DESC))::DOUBLE / nullif(sum(bad) OVER (), 0)::DOUBLE AS loss
    FROM candidates
), threshold AS (
    SELECT coalesce((SELECT bin FROM losses WHERE loss IS NOT NULL ORDER BY round(loss, 9), abs(bin), bin LIMIT 1), 0) * 10000 AS t
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, score - t AS score
FROM judged JOIN scored USING (shape), threshold
"""

"""DuckDB SQL with the meaning of the operators' queries."""

from __future__ import annotations

from .words import WORD_SQL

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({{}}, '{WORD_SQL}'), [])"

REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT words.doc_id, array_to_string(list(word ORDER BY words.p) FILTER (gone.p IS NULL), ' ') AS kept, count(gone.p) AS n_removed
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

URLS = f"""
WITH rules(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
split AS (SELECT page_id, {_LOWER.format("regexp_extract(substr(url, pos + 3), '^[^/?#]*')")} AS h,
                 regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) AS p, pos > 0 AS ok FROM cut),
clean AS (SELECT page_id, CASE WHEN ok THEN h ELSE '' END AS host, CASE WHEN ok THEN p ELSE '' END AS path FROM split),
urls AS (SELECT DISTINCT host, path FROM clean),
best AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
         FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, clean.host, clean.path, rule, coalesce(v, 'allow') AS verdict
FROM clean LEFT JOIN best ON clean.host = best.host AND clean.path = best.path"""

NEAR_TEXTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 1)
             UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * m >= 80 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id LEFT JOIN least ON w.doc_id = a"""

NEAR_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM e LEFT JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a"""

BM25 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents),
stats AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w),
bags AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS t FROM w) GROUP BY doc_id, len, t),
idf AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM bags, stats GROUP BY t, n),
scores AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(w * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.len / mean))), 6) AS score
           FROM bags q JOIN idf ON q.t = idf.t JOIN bags d ON d.t = q.t, stats WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, place::INTEGER AS place, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scores) WHERE place <= 10"""

_DAY = "(b % 300 + e * (1 + b % 3))"
_BARE = "regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
REVISITS = f"""
WITH base AS (SELECT page_id, url, md5(html) AS digest, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT AS b FROM pages),
log AS (SELECT page_id * 10 + e AS record_id, {_BARE} AS bare, e IN (0, 3) AS response, {_DAY} AS day,
               '"' || substr(digest, 1, 8) || CASE WHEN e >= 3 THEN 'b' ELSE 'a' END || '"' AS etag,
               (e + b) % 5 = 0 AS other, (e + b) % 2 = 0 AS weak, (e + b) % 7 = 0 AS lacking
        FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6]) AS e FROM base)),
named AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\\.|:(80|443)$', '', 'g') AS host,
                 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\\?(.*)$', 1, 's'), '&'),
                                       lambda p: p <> '' AND NOT regexp_matches(p, '^utm_[a-z]+='))) AS query FROM log),
keyed AS (SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url FROM named),
found AS (SELECT *, CASE WHEN other THEN '"other"' ELSE etag END AS shown,
                 last_value(CASE WHEN response THEN record_id END IGNORE NULLS) OVER past AS response_id,
                 last_value(CASE WHEN response THEN etag END IGNORE NULLS) OVER past AS wanted
          FROM keyed WINDOW past AS (PARTITION BY url ORDER BY day, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT record_id, url, response_id,
       CASE WHEN response_id IS NULL THEN 'missing' WHEN lacking THEN 'unchecked' WHEN shown = wanted THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN response_id IS NOT NULL AND NOT lacking AND shown = wanted THEN
            'cache-control=max-age=90;content-type=text/html;date=' || day || ';etag=' || CASE WHEN weak AND NOT other THEN 'W/' ELSE '' END || shown END AS headers
FROM found WHERE NOT response"""

"""Shared CTEs of the checking SQL, put together by name."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def u(purpose: str, key: str, seed: int = 42) -> str:
    """The SQL twin of ``functions.rand.uniform``."""
    return (f"(('0x'||substr(md5('{seed}:{purpose}:'||{key}),1,13))::BIGINT"
            " / 4503599627370496.0::DOUBLE)")


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(body: str) -> str:
    """Prefix ``body`` with every registered CTE it needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {parts},\n{body.lstrip()[5:]}"
    return f"WITH {parts}\n{body}"


# ---- order cases -----------------------------------------------------------------------
cte("lp", "SELECT l_orderkey AS case_id, p_name, p_brand, p_type, l_returnflag, l_quantity,"
          " l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey")
cte("raw_tags", """
SELECT case_id, 'flag:'||l_returnflag AS tag FROM lp
UNION SELECT case_id, 'type:'||p_type FROM lp
UNION SELECT case_id, 'brand:'||p_brand FROM lp
UNION SELECT case_id, 'bulk:'||p_type FROM lp WHERE l_quantity >= 50
UNION SELECT case_id, 'ultra:'||p_brand FROM lp
      WHERE l_quantity >= 49 AND l_discount >= 0.1 AND l_tax >= 0.08""")
cte("labels_all", "SELECT o_orderkey AS case_id, tag FROM orders JOIN raw_tags ON o_orderkey = case_id")
cte("case_kw", "SELECT DISTINCT o_orderkey AS case_id, p_name AS keyword FROM orders JOIN lp ON o_orderkey = case_id")
cte("cases", f"""
SELECT o_orderkey AS case_id, o_orderpriority AS service, t.tags, k.keywords,
  CASE o_orderkey % 3 WHEN 0 THEN '['''||array_to_string(t.tags, ''', ''')||''']'
       WHEN 1 THEN array_to_string(t.tags, ', ')
       ELSE ' '||array_to_string(t.tags, ' ,, ')||' , ' END AS tier_2,
  CASE WHEN o_orderkey % 17 <> 0 THEN {u('quality', 'o_orderkey')} END AS quality,
  CASE WHEN o_orderkey % 11 <> 0 THEN (1 + o_orderkey % 3)::DOUBLE END AS sample_weight,
  (['TRUE',' false ','1','0','maybe'])[o_orderkey % 5 + 1] AS has_label_issue
FROM orders
JOIN (SELECT case_id, list_sort(list(tag)) AS tags FROM raw_tags GROUP BY 1) t ON o_orderkey = t.case_id
JOIN (SELECT case_id, list_sort(list(DISTINCT p_name)) AS keywords FROM lp GROUP BY 1) k ON o_orderkey = k.case_id""")
cte("cnt_all", "SELECT tag, count(*) AS cnt FROM labels_all GROUP BY tag")
cte("base", """
SELECT n, n_tags, max_count, min_count, max_count / greatest(min_count, 1)::DOUBLE AS ratio, avg_quality
FROM (SELECT count(*) AS n, avg(coalesce(quality, 0.9::DOUBLE)) AS avg_quality FROM cases),
     (SELECT count(*) AS n_tags, max(cnt) AS max_count, min(cnt) AS min_count FROM cnt_all)""")
cte("settings", """
SELECT *, greatest(3, least(10, floor(n * 0.005::DOUBLE)))::BIGINT AS min_tag_samples,
  greatest(10, floor(n * 0.03::DOUBLE))::BIGINT AS rare_threshold,
  greatest(0.02::DOUBLE, least(0.08::DOUBLE, 1.5::DOUBLE / n_tags)) AS rare_freq,
  least(0.55::DOUBLE, 0.2::DOUBLE + least(ratio, 100) / 200) AS kw_dropout,
  round(least(0.15::DOUBLE, greatest(0.02::DOUBLE, 0.02::DOUBLE + (1 - avg_quality) * 0.25::DOUBLE)), 3) AS base_smooth,
  floor(least(6, greatest(2, 2 + least(ratio, 100) / 30)))::BIGINT AS gamma_neg
FROM base""")
cte("kept", "SELECT tag, cnt FROM cnt_all WHERE cnt >= (SELECT min_tag_samples FROM settings)")
cte("labels_kept", "SELECT case_id, tag FROM labels_all JOIN kept USING (tag)")
cte("cases_kept", "SELECT c.* REPLACE (t.tags AS tags) FROM cases c JOIN (SELECT case_id, "
                  "list_sort(list(tag)) AS tags FROM labels_kept GROUP BY 1) t USING (case_id)")
cte("n_kept", "SELECT count(*) AS n FROM cases_kept")

# ---- predictions and thresholds ---------------------------------------------------------
cte("preds", f"""
SELECT c.case_id, k.tag, list_contains(c.tags, k.tag)::INT AS y,
  0.35::DOUBLE * list_contains(c.tags, k.tag)::INT + 0.65::DOUBLE * {u('pred', "c.case_id||':'||k.tag")} AS p
FROM cases_kept c CROSS JOIN kept k""")
GRID = [0.1 + i * ((0.1 + 0.05) - 0.1) for i in range(17)]
cte("grid", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(GRID)) + ") g(i, t)")
cte("sweep", """
SELECT tag, i, t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp,
  count(*) FILTER (y = 1 AND p < t) AS fn
FROM preds CROSS JOIN grid GROUP BY tag, i, t""")
cte("freqs", """
SELECT tag, cnt AS n_pos, cnt / n::DOUBLE AS freq,
  CASE WHEN cnt / n::DOUBLE > 0.5 THEN 'dominant'
       WHEN cnt / n::DOUBLE < (SELECT rare_freq FROM settings) THEN 'rare' ELSE 'normal' END AS category
FROM (SELECT tag, count(*) AS cnt FROM labels_kept GROUP BY tag) CROSS JOIN n_kept""")
cte("best", """
SELECT tag, CASE WHEN f1 = 0 THEN 0.5::DOUBLE ELSE t END AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, i) AS rn FROM (
    SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM sweep))
WHERE rn = 1""")
cte("tag_info", """
SELECT tag, n_pos, freq, category,
  CASE category WHEN 'dominant' THEN greatest(t, 0.65::DOUBLE) WHEN 'rare' THEN least(t, 0.35::DOUBLE)
       ELSE t END AS threshold
FROM best JOIN freqs USING (tag)""")
cte("judged", """
SELECT case_id, tag, y, p, threshold, category, (p >= threshold)::INT AS pred
FROM preds JOIN tag_info USING (tag)""")

# ---- document cases ----------------------------------------------------------------------
cte("doc_cases", """
SELECT d.doc_id AS case_id, d.text AS summary, d.source AS service, [d.lang] AS keywords,
  list_sort(list_filter(['lang:'||d.lang, CASE WHEN n_chars < 850 THEN 'len:short' END,
    CASE WHEN n_chars > 2700 THEN 'len:long' END, CASE WHEN l.quality = 1 THEN 'quality' END,
    CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS tags
FROM documents d LEFT JOIN labels l USING (doc_id)""")
cte("doc_labels", "SELECT case_id, unnest(tags) AS tag FROM doc_cases")

"""Queries of the sampling, shortlisting and rebalancing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L, sampling as S
from ..plans.storage import stage
from . import inputs as I
from .registry import query
from .sql import cte, sql, u

cte("kw_cnt", "SELECT keyword, count(*) AS cnt FROM case_kw GROUP BY keyword")
cte("quota_ids", f"""
SELECT DISTINCT case_id FROM (SELECT *, row_number() OVER (PARTITION BY keyword
  ORDER BY {u('quota', 'case_id')}, case_id) AS rn FROM case_kw) WHERE rn <= 20""")
cte("kw_weight", "SELECT case_id, avg(1.0::DOUBLE / cnt) AS weight FROM case_kw JOIN kw_cnt USING (keyword) GROUP BY case_id")
_KEY = f"-ln(greatest({u('fill', 'case_id')}, 1e-12::DOUBLE)) / weight"
cte("sampled", f"""
SELECT case_id, 'quota' AS phase FROM quota_ids
UNION ALL SELECT case_id, 'fill' FROM (
  SELECT case_id, row_number() OVER (ORDER BY {_KEY}, case_id) AS rn FROM kw_weight
  WHERE case_id NOT IN (SELECT case_id FROM quota_ids))
WHERE rn <= greatest(0, 3500 - (SELECT count(*) FROM quota_ids))""")


@query("quota_sample", sql("SELECT case_id FROM quota_ids"))
def quota_query(spark, folder):
    return S.quota_sample(I.cases(spark, folder))


@query("quota_walk", sql(f"""
SELECT * FROM (WITH RECURSIVE lists AS (
  SELECT row_number() OVER (ORDER BY keyword) AS i, keyword, list(case_id ORDER BY {u('quota-walk', "keyword || ':' || case_id")}, case_id) AS ids
  FROM case_kw GROUP BY keyword),
walk AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS keyword, []::BIGINT[] AS took, []::BIGINT[] AS seen
  UNION ALL SELECT i, keyword, took, list_concat(seen, took) FROM (
    SELECT l.i, l.keyword, list_filter(l.ids, lambda x: NOT list_contains(w.seen, x))[1:20] AS took, w.seen
    FROM walk w JOIN lists l ON l.i = w.i + 1))
SELECT unnest(took) AS case_id, keyword FROM walk WHERE i > 0)"""))
def quota_walk_query(spark, folder):
    return S.quota_walk(I.cases(spark, folder))


@query("inverse_freq_fill", sql(f"""
SELECT case_id, round(weight, 9) AS weight FROM kw_weight ORDER BY {_KEY.replace('/ weight', '/ kw_weight.weight')}, case_id LIMIT 3500"""))
def fill_query(spark, folder):
    out = S.inverse_freq_fill(I.cases(spark, folder), 3500)
    return out.withColumn("weight", F.round("weight", 9))


@query("smart_sample", sql("SELECT case_id, phase FROM sampled"))
def smart_query(spark, folder):
    return S.smart_sample(stage(I.cases(spark, folder), "cases"))


@query("keyword_coverage", sql("""
SELECT keyword, c.cnt AS count_full, coalesce(s.cnt, 0) AS count_short, coalesce(s.cnt, 0) < 100 AS below_min
FROM kw_cnt c LEFT JOIN (SELECT keyword, count(*) AS cnt FROM case_kw JOIN sampled USING (case_id) GROUP BY keyword) s
USING (keyword)"""))
def coverage_query(spark, folder):
    cases = stage(I.cases(spark, folder), "cases")
    return S.keyword_coverage(cases, S.smart_sample(cases), minimum=100)


cte("rarities", """
SELECT case_id, list_reduce(list_sort(list(1.0::DOUBLE / cnt)), lambda a, b: a + b) AS rarity
FROM labels_all JOIN cnt_all USING (tag) GROUP BY case_id""")
cte("short_ids", """
SELECT DISTINCT case_id FROM (SELECT case_id, row_number() OVER (PARTITION BY tag ORDER BY rarity DESC, case_id) AS rn
  FROM labels_all JOIN rarities USING (case_id)) WHERE rn <= 300""")


@query("rarity_rank", sql("SELECT case_id, round(rarity, 9) AS rarity FROM rarities"))
def rarity_query(spark, folder):
    labels = L.binarize_labels(stage(I.cases(spark, folder), "cases"))
    return S.rarity_rank(labels, L.tag_counts(labels)).withColumn("rarity", F.round("rarity", 9))


@query("shortlist_min", sql("SELECT case_id FROM short_ids"))
def shortlist_query(spark, folder):
    return S.shortlist_min(L.binarize_labels(stage(I.cases(spark, folder), "cases")), 300)


@query("shortlist_coverage", sql("""
SELECT min(cnt) AS min_cases, max(cnt) AS max_cases, floor(avg(cnt))::BIGINT AS mean_cases,
  count(*) FILTER (cnt < 300) AS tags_under
FROM (SELECT tag, count(*) AS cnt FROM labels_all JOIN short_ids USING (case_id) GROUP BY tag)"""))
def shortlist_coverage_query(spark, folder):
    labels = L.binarize_labels(stage(I.cases(spark, folder), "cases"))
    chosen = labels.join(S.shortlist_min(labels, 300), "case_id", "left_semi")
    return S.shortlist_coverage(chosen, 300)


_WALKED = """
counts AS (SELECT tag, count(*) AS cnt, row_number() OVER (ORDER BY tag) AS idx FROM walked GROUP BY tag),
turns AS (SELECT row_number() OVER (ORDER BY case_id) AS i, case_id, list(idx) AS own FROM walked JOIN counts USING (tag) GROUP BY case_id),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS case_id, false AS gone, (SELECT list(cnt ORDER BY idx) FROM counts) AS covered
  UNION ALL SELECT i, case_id, gone, CASE WHEN gone THEN list_transform(covered, lambda c, k: c - list_contains(own, k)::BIGINT) ELSE covered END
  FROM (SELECT t.i, t.case_id, t.own, w.covered,
    len(list_filter(t.own, lambda k: w.covered[k] <= 300)) = 0 AS gone FROM walk w JOIN turns t ON t.i = w.i + 1))"""


@query("shortlist_cap_walk")  # its SQL walks every case and takes minutes; tests walk a small table
def cap_walk_query(spark, folder):
    """The cases dropped at a maximum of two thirds of the least common tag."""
    labels = stage(L.binarize_labels(I.cases(spark, folder)), "labels")
    return S.cap_walk(labels, L.tag_counts(labels).agg(F.min("cnt")).first()[0] * 2 // 3)


@query("shortlist_balanced", sql(f"""
SELECT * FROM (WITH RECURSIVE walked AS (SELECT * FROM labels_all WHERE case_id IN (SELECT case_id FROM short_ids)),
{_WALKED}
SELECT case_id, tag FROM walked WHERE case_id NOT IN (SELECT case_id FROM walk WHERE gone))"""))
def balanced_query(spark, folder):
    return S.shortlist_balanced(L.binarize_labels(I.cases(spark, folder)), 300, 300)


@query("shortlist_cap")
def cap_query(spark, folder):
    labels = stage(L.binarize_labels(I.cases(spark, folder)), "labels")
    chosen = labels.join(S.shortlist_min(labels, 300), "case_id", "left_semi")
    return S.shortlist_cap(chosen, 500)


@query("shortlist_cap_drops", sql("SELECT true AS dropped, 0::BIGINT AS tags_under, 0::BIGINT AS cases_left"))
def cap_drops_query(spark, folder):
    """What the cap promises where cases must go: a maximum of two thirds of the least common tag."""
    labels = stage(L.binarize_labels(I.cases(spark, folder)), "labels")
    given = stage(L.tag_counts(labels), "counts")
    most = given.agg(F.min("cnt")).first()[0] * 2 // 3
    chosen = stage(S.shortlist_cap(labels, most), "capped")
    left = stage(L.tag_counts(chosen), "left")
    under = given.select("tag").join(left, "tag", "left").where(F.coalesce("cnt", F.lit(0)) < most)
    whole = chosen.join(left, "tag").groupBy("case_id").agg(F.min("cnt").alias("least")).where(F.col("least") > most)
    dropped = chosen.select("case_id").distinct().count() < labels.select("case_id").distinct().count()
    return spark.range(1).select(F.lit(dropped).alias("dropped"), F.lit(under.count()).cast("bigint").alias("tags_under"),
                                 F.lit(whole.count()).cast("bigint").alias("cases_left"))


cte("splits", f"""
SELECT *, CASE WHEN {u('split', 'case_id')} < 0.8 THEN 'train' WHEN {u('split', 'case_id')} < 0.9 THEN 'val'
  ELSE 'test' END AS split FROM doc_cases""")
cte("train", "SELECT * EXCLUDE (split) FROM splits WHERE split = 'train'")
cte("train_cnt", "SELECT tag, count(*) AS cnt FROM (SELECT unnest(tags) AS tag FROM train) GROUP BY tag")


@query("split_80_10_10", sql("SELECT case_id, split FROM splits"))
def split_query(spark, folder):
    return S.split_80_10_10(I.docs(spark, folder)).select("case_id", "split")


def _train(spark, folder):
    return S.split_80_10_10(I.docs(spark, folder)).filter(F.col("split") == "train").drop("split")


_WORDS = "list_filter(regexp_split_to_array(summary, '\\s+'), lambda w: w <> '')"


@query("augment_rare", sql(f"""
WITH c AS (
  SELECT case_id, summary, tags, {_WORDS} AS w, floor({u('augment-op', 'case_id')} * 3)::INT AS op,
    {u('augment-at', 'case_id')} AS pos FROM train
  WHERE list_has_any(tags, (SELECT list(tag) FROM train_cnt WHERE cnt < greatest(10, floor((SELECT count(*) FROM train) * 0.06::DOUBLE))))),
d AS (SELECT *, len(w) AS n, floor(pos * (len(w) - 1))::INT + 1 AS i, floor(pos * (len(w) - 2))::INT + 2 AS j FROM c)
SELECT case_id, md5(summary) AS text_md5, false AS is_copy, array_to_string(tags, '|') AS tags FROM train
UNION ALL SELECT case_id, md5(CASE WHEN n < 6 THEN summary ELSE array_to_string(CASE
  WHEN op = 0 THEN w[1:i-1] || [w[i+1], w[i]] || w[i+2:n]
  WHEN op = 1 THEN CASE WHEN n > 8 THEN w[1:j-1] || w[j+1:n] ELSE w END
  ELSE w || w[n // 2 + 1 : n // 2 + 6] END, ' ') END), true, array_to_string(tags, '|') FROM d"""))
def augment_query(spark, folder):
    train = _train(spark, folder)
    threshold = max(10, int(train.count() * 0.06))
    out = S.augment_rare(train, threshold)
    return out.select("case_id", F.md5("summary").alias("text_md5"), "is_copy",
                      F.array_join("tags", "|").alias("tags"))


@query("undersample_dominant", sql(f"""
SELECT case_id FROM train WHERE NOT list_has_all(
  (SELECT coalesce(list(tag), []) FROM train_cnt WHERE cnt / (SELECT count(*) FROM train)::DOUBLE > 0.5), tags)
OR {u('undersample', 'case_id')} < 0.5"""))
def undersample_query(spark, folder):
    return S.undersample_dominant(_train(spark, folder)).select("case_id")


cte("inv_w", """
SELECT case_id, coalesce(sample_weight, 1) * (s + 1e-6::DOUBLE) AS weight FROM cases JOIN (
  SELECT case_id, list_reduce(list_sort(list(1.0::DOUBLE / (cnt + 1e-6::DOUBLE))), lambda a, b: a + b) AS s
  FROM labels_all JOIN cnt_all USING (tag) GROUP BY case_id) USING (case_id)""")


@query("inverse_freq_weights", sql("SELECT case_id, round(weight, 9) AS weight FROM inv_w"))
def weights_query(spark, folder):
    out = S.inverse_freq_weights(stage(I.cases(spark, folder), "cases"), "sample_weight")
    return out.withColumn("weight", F.round("weight", 9))


@query("weighted_resample", sql(f"""
WITH items AS (
  SELECT case_id, greatest(floor(steps * (4503599627370496::DOUBLE / (sum(steps::HUGEINT) OVER ())::DOUBLE)), 1)::BIGINT AS q,
         floor({u('block', 'case_id')} * 1024)::INT AS block
  FROM (SELECT case_id, greatest(floor(weight / (max(weight) OVER ()) * 1099511627776::DOUBLE), 1) AS steps FROM inv_w)),
placed AS (SELECT case_id, (sum(q) OVER (ORDER BY block, case_id) - q)::BIGINT AS lo FROM items),
draws AS (SELECT floor({u('draw', 'id')} * (SELECT sum(q) FROM items)::DOUBLE)::BIGINT AS x
  FROM (SELECT unnest(range((SELECT count(*) FROM items))) AS id))
SELECT p.case_id, count(*) AS copies FROM draws d ASOF JOIN placed p ON d.x >= p.lo GROUP BY p.case_id"""))
def resample_query(spark, folder):
    return S.weighted_resample(S.inverse_freq_weights(stage(I.cases(spark, folder), "cases"), "sample_weight"))

"""Queries of the human-review loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import case_buckets as B, evaluate as E, review as R
from ..plans.storage import fresh_path, stage
from . import inputs as I
from .registry import query
from .sql import cte, sql

cte("n_each", "SELECT greatest(5, least(100, greatest(20, n // 5)) // 3) AS k FROM n_kept")
cte("max_ps", "SELECT case_id, max(p) AS mp FROM preds GROUP BY case_id")
cte("pred_text", "SELECT case_id, coalesce(string_agg(tag, ', ' ORDER BY tag) FILTER (pred = 1), '') AS "
                 "model_predicted_tags FROM judged GROUP BY case_id")
cte("r_unc", f"""
SELECT case_id, model_predicted_tags, round(entropy, 3) AS model_confidence, '{R.UNCERTAIN}' AS review_reason FROM (
  SELECT *, row_number() OVER (ORDER BY entropy DESC, case_id) AS rn FROM entropies)
JOIN pred_text USING (case_id) WHERE rn <= (SELECT k FROM n_each)""")
cte("r_rare", f"""
SELECT case_id, model_predicted_tags, round(mp, 3) AS model_confidence, '{R.RARE}' AS review_reason FROM (
  SELECT case_id, row_number() OVER (ORDER BY case_id) AS rn
  FROM (SELECT DISTINCT case_id FROM judged WHERE category = 'rare' AND pred = 1))
JOIN pred_text USING (case_id) JOIN max_ps USING (case_id) WHERE rn <= (SELECT k FROM n_each)""")
cte("r_conf", f"""
SELECT case_id, model_predicted_tags, round(mp, 3) AS model_confidence, '{R.CONFIDENT}' AS review_reason FROM (
  SELECT *, row_number() OVER (ORDER BY mp DESC, case_id) AS rn FROM max_ps)
JOIN pred_text USING (case_id) WHERE rn <= (SELECT k FROM n_each)""")


@query("review_uncertain", sql("SELECT * FROM r_unc"))
def uncertain_query(spark, folder):
    s = I.scored(spark, folder)
    k = R.review_budget(s.n)
    return R.review_uncertain(E.judge(stage(R.most_uncertain(s.preds, k), "uncertain"), s.tag_info()), k)


@query("review_rare", sql("SELECT * FROM r_rare"))
def rare_query(spark, folder):
    s = I.scored(spark, folder)
    return R.review_rare(s.judged(), R.review_budget(s.n))


@query("review_confident", sql("SELECT * FROM r_conf"))
def confident_query(spark, folder):
    s = I.scored(spark, folder)
    k = R.review_budget(s.n)
    return R.review_confident(E.judge(stage(R.most_confident(s.preds, k), "confident"), s.tag_info()), k)


@query("active_learning_queue", sql("""
SELECT case_id, round(entropy, 6) AS entropy FROM entropies ORDER BY entropies.entropy DESC, case_id LIMIT 200"""))
def active_query(spark, folder):
    out = R.active_learning_queue(I.scored(spark, folder).preds)
    return out.withColumn("entropy", F.round("entropy", 6))


@query("review_export", sql("""
SELECT * EXCLUDE (s, rn), '' AS human_corrected_tags FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s) AS rn FROM (
    SELECT *, 0 AS s FROM r_unc UNION ALL SELECT *, 1 FROM r_rare UNION ALL SELECT *, 2 FROM r_conf))
WHERE rn = 1"""))
def export_query(spark, folder):
    s = I.scored(spark, folder)
    k, info = R.review_budget(s.n), s.tag_info()
    ranked = {"uncertain": R.most_uncertain(s.preds, k), "rare": R.first_raised(s.preds, info, k), "confident": R.most_confident(s.preds, k)}
    return R.review_export(s.judged(), s.n, **{name: E.judge(stage(rows, name), info) for name, rows in ranked.items()})


def corrections(cases):
    """Corrections derived from the cases: some blank, some repeated, some unknown."""
    cid = F.col("case_id")
    text = F.when(cid % 7 == 0, "  ").otherwise(F.concat(F.array_join(F.slice(
        "tags", 2, F.greatest(F.size("tags"), F.lit(1))), ", "), F.lit(" , fixed:"), (cid % 3).cast("string")))
    hit = cases.filter(F.col("quality") < 0.3).select(cid.alias("case_id"), F.lit(1).alias("seq"), text.alias("t"))
    again = hit.filter(F.col("case_id") % 5 == 0).select(
        "case_id", F.lit(2).alias("seq"), F.lit("second, look").alias("t"))
    unknown = hit.filter(F.col("case_id") % 4 == 0).select(
        (-F.col("case_id") - 1).alias("case_id"), F.lit(1).alias("seq"), F.lit("new, case").alias("t"))
    return hit.unionByName(again).unionByName(unknown).withColumnRenamed("t", "human_corrected_tags")


cte("corr_hit", """
SELECT case_id, 1 AS seq, CASE WHEN case_id % 7 = 0 THEN '  '
  ELSE array_to_string(tags[2:], ', ') || ' , fixed:' || (case_id % 3) END AS t FROM cases WHERE quality < 0.3""")
cte("corrections", """
SELECT case_id, arg_max(t, seq) AS t FROM (
  SELECT * FROM corr_hit UNION ALL SELECT case_id, 2, 'second, look' FROM corr_hit WHERE case_id % 5 = 0
  UNION ALL SELECT -case_id - 1, 1, 'new, case' FROM corr_hit WHERE case_id % 4 = 0)
WHERE trim(t) <> '' GROUP BY case_id""")
cte("fed_back", """
SELECT coalesce(c.case_id, f.case_id) AS case_id, c.service,
  CASE WHEN f.t IS NULL THEN array_to_string(c.tags, '|') ELSE array_to_string(list_filter(list_transform(
    string_split(f.t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS tags,
  CASE WHEN f.case_id IS NULL THEN 'kept' WHEN c.case_id IS NULL THEN 'inserted' ELSE 'updated' END AS change
FROM cases c FULL JOIN corrections f ON c.case_id = f.case_id""")


@query("apply_feedback", sql("SELECT * FROM fed_back"))
def feedback_query(spark, folder):
    cases = I.cases(spark, folder)
    out = R.apply_feedback(cases.select("case_id", "service", "tags"), corrections(cases))
    return out.withColumn("tags", F.array_join("tags", "|"))


@query("feedback_report", sql("SELECT change, count(*) AS cnt FROM fed_back GROUP BY change"))
def feedback_report_query(spark, folder):
    cases = I.cases(spark, folder)
    merged = R.apply_feedback(cases.select("case_id", "service", "tags"), corrections(cases))
    return R.feedback_report(merged)


@query("feedback_buckets", sql("SELECT case_id, service, tags FROM fed_back"))
def feedback_buckets_query(spark, folder):
    """Two batches of corrections, the later one merged first, into cases kept in buckets."""
    cases = I.cases(spark, folder)
    path = fresh_path(spark, "case-buckets")
    B.write_buckets(cases.select("case_id", "service", "tags"), path, buckets=32)
    every = corrections(cases)
    for seq in (2, 1):
        B.merge_batch(spark, path, every.where(F.col("seq") == seq))
    return B.read_cases(spark, path).withColumn("tags", F.array_join("tags", "|"))

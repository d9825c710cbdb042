"""Queries on predictions: thresholds, metrics, calibration, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import inputs as I
from .registry import query
from .sql import cte, sql


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


cte("tag_metrics", """
SELECT tag, any_value(category) AS category, any_value(threshold) AS threshold,
  count(*) FILTER (y = 1) AS support, count(*) FILTER (y = 1 AND pred = 1) AS tp,
  count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
  count(*) FILTER (y = 0 AND pred = 0) AS tn,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(avg(p * 100) FILTER (pred = 1), 0) AS avg_conf
FROM judged GROUP BY tag""")
cte("case_sets", """
SELECT case_id, sum(y)::BIGINT AS n_actual, sum(pred)::BIGINT AS n_predicted, sum(y * pred)::BIGINT AS n_correct,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1), '') AS actual,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (pred = 1), '') AS predicted,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1 AND pred = 1), '') AS correct,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1 AND pred = 0), '') AS missed,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 0 AND pred = 1), '') AS false_alarms
FROM judged GROUP BY case_id""")


@query("threshold_sweep", sql("""
SELECT tag, round(t, 6) AS threshold, tp, fp, fn,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM sweep"""))
def sweep_query(spark, folder):
    return _round(I.scored(spark, folder).sweep().drop("i"), "threshold", "f1")


@query("tune_thresholds", sql("""
SELECT tag, n_pos, round(freq, 6) AS freq, category, round(threshold, 6) AS threshold FROM tag_info"""))
def tune_query(spark, folder):
    return _round(I.scored(spark, folder).tag_info(), "freq", "threshold")


@query("attach_thresholds", sql("""
SELECT p.case_id, count(*) AS n_cells, md5(string_agg(concat_ws(':', tag, p.y, round(p.p * 1e6)::BIGINT,
  round(coalesce(t.threshold, 0.5) * 1e6)::BIGINT, coalesce(t.category, 'normal')), '|' ORDER BY tag)) AS cells_md5
FROM preds p LEFT JOIN (SELECT * FROM tag_info WHERE category <> 'normal') t USING (tag) GROUP BY p.case_id"""))
def attach_query(spark, folder):
    s = I.scored(spark, folder)
    known = s.tag_info().filter(F.col("category") != "normal")
    out = E.attach_thresholds(E.merged_cases(s.preds), known)
    micro = lambda c: F.round(c * 1e6).cast("bigint")
    said = lambda c: F.struct(c["tag"], F.concat_ws(":", c["tag"], c["y"], micro(c["p"]), micro(c["threshold"]), c["category"]).alias("said"))
    out = out.where(F.size("cells") > 0).withColumn("cells", F.array_sort(F.transform("cells", said)))
    return out.select("case_id", F.size("cells").cast("bigint").alias("n_cells"), F.md5(F.array_join("cells.said", "|")).alias("cells_md5"))


@query("per_tag_metrics", sql("""
SELECT tag, category, round(threshold, 6) AS threshold, support, tp, fp, fn, tn, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(avg_conf, 6) AS avg_conf FROM tag_metrics"""))
def metrics_query(spark, folder):
    return _round(I.scored(spark, folder).metrics(), "threshold", "precision", "recall", "f1", "avg_conf")


@query("global_metrics", sql("""
SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall,
  round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
  (SELECT round(avg(coalesce(2.0::DOUBLE * n_correct / nullif(n_actual + n_predicted, 0), 0)), 6)
   FROM case_sets) AS samples_f1 FROM tag_metrics"""))
def global_query(spark, folder):
    s = I.scored(spark, folder)
    out = E.global_metrics(s.judged(), s.metrics())
    return _round(out, *out.columns)


@query("classification_report", sql("""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT tag AS label, precision, recall, f1, support FROM tag_metrics
  UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp))::DOUBLE, sum(tp) / (sum(tp) + sum(fn))::DOUBLE,
    2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), sum(support)::BIGINT FROM tag_metrics
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM tag_metrics
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM tag_metrics
  UNION ALL SELECT 'samples avg', avg(coalesce(n_correct / nullif(n_predicted, 0)::DOUBLE, 0)),
    avg(coalesce(n_correct / nullif(n_actual, 0)::DOUBLE, 0)),
    avg(coalesce(2.0::DOUBLE * n_correct / nullif(n_actual + n_predicted, 0), 0)), sum(n_actual)::BIGINT FROM case_sets)"""))
def report_query(spark, folder):
    s = I.scored(spark, folder)
    return _round(E.classification_report(s.judged(), s.metrics()), "precision", "recall", "f1")


@query("case_outcomes", sql("""
SELECT case_id, actual, predicted, correct, missed, false_alarms, actual = predicted AS is_perfect,
  n_actual, n_predicted, n_correct, left(service, 200) AS snippet
FROM case_sets JOIN (SELECT case_id, service FROM cases) USING (case_id)"""))
def outcomes_query(spark, folder):
    out = E.case_outcomes(I.scored(spark, folder).judged(), snippet="service")
    return out.withColumns({c: F.array_join(c, "|") for c in (
        "actual", "predicted", "correct", "missed", "false_alarms")})


@query("match_summary", sql("""
SELECT count(*) AS n, count(*) FILTER (actual = predicted) AS perfect,
  round(avg((actual = predicted)::INT) * 100, 6) AS perfect_pct, round(avg(n_predicted), 6) AS avg_predicted,
  round(avg(n_actual), 6) AS avg_actual, round(avg(n_correct), 6) AS avg_correct FROM case_sets"""))
def match_query(spark, folder):
    out = E.match_summary(I.scored(spark, folder).judged())
    return _round(out, "perfect_pct", "avg_predicted", "avg_actual", "avg_correct")


@query("calibration", sql("""
SELECT band, count(*) AS predictions, count(*) FILTER (y = 1) AS correct,
  round(count(*) FILTER (y = 1) / count(*)::DOUBLE * 100, 1) AS accuracy_pct
FROM (SELECT y, CASE WHEN p * 100 < 30 THEN '< 30%' WHEN p * 100 < 50 THEN '30-50%' WHEN p * 100 < 70 THEN '50-70%'
  WHEN p * 100 < 90 THEN '70-90%' ELSE '90%+' END AS band FROM judged WHERE pred = 1) GROUP BY band"""))
def calibration_query(spark, folder):
    return E.calibration(I.scored(spark, folder).judged_cells())


@query("failure_modes", sql("""
SELECT rank, error_type, tag, cnt FROM (
  SELECT row_number() OVER (PARTITION BY error_type ORDER BY cnt DESC, tag) AS rank, * FROM (
    SELECT 'missed' AS error_type, tag, fn AS cnt FROM tag_metrics
    UNION ALL SELECT 'false alarm', tag, fp FROM tag_metrics) WHERE cnt > 0) WHERE rank <= 10"""))
def failure_query(spark, folder):
    return E.failure_modes(I.scored(spark, folder).metrics())


@query("confused_pairs", sql("""
SELECT least(m.tag, f.tag) AS tag_a, greatest(m.tag, f.tag) AS tag_b, count(*) AS cnt
FROM judged m JOIN judged f ON m.case_id = f.case_id AND m.y = 1 AND m.pred = 0 AND f.y = 0 AND f.pred = 1
GROUP BY 1, 2 ORDER BY cnt DESC, tag_a, tag_b LIMIT 10"""))
def pairs_query(spark, folder):
    return E.confused_pairs(I.scored(spark, folder).judged())


@query("f1_buckets", sql("""
SELECT CASE WHEN f1 = 0 THEN 'zero' WHEN f1 < 0.4 THEN 'below 0.4' ELSE '0.4 and above' END AS bucket,
  count(*) AS n_tags, round(avg(f1), 6) AS avg_f1 FROM tag_metrics GROUP BY 1"""))
def buckets_query(spark, folder):
    return _round(E.f1_buckets(I.scored(spark, folder).metrics()), "avg_f1")


@query("asymmetric_loss", sql("""
WITH l AS (SELECT tag, -(y * ln(greatest(p, 1e-8::DOUBLE)) * (1 - p)
  + (1 - y) * ln(greatest(least(1 - p + 0.05::DOUBLE, 1), 1e-8::DOUBLE)) * pow(p, (SELECT gamma_neg FROM settings))) AS v
  FROM preds)
SELECT tag, count(*) AS cells, round(avg(v), 6) AS loss FROM l GROUP BY tag
UNION ALL SELECT 'ALL', count(*), round(avg(v), 6) FROM l"""))
def loss_query(spark, folder):
    s = I.scored(spark, folder)
    return _round(E.asymmetric_loss(s.cells(), s.settings["gamma_neg"]), "loss")


cte("entropies", """
SELECT case_id, avg(-(q * ln(q) + (1 - q) * ln(1 - q))) AS entropy
FROM (SELECT case_id, least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS q FROM preds) GROUP BY case_id""")


@query("case_entropy", sql("SELECT case_id, round(entropy, 6) AS entropy FROM entropies"))
def entropy_query(spark, folder):
    return _round(E.case_entropy(I.scored(spark, folder).preds).select("case_id", "entropy"), "entropy")


@query("predict_tags", sql("""
WITH r AS (SELECT *, sum(pred) OVER (PARTITION BY case_id) AS n_pass,
  row_number() OVER (PARTITION BY case_id ORDER BY p DESC, tag) AS rn FROM (
    SELECT case_id, tag, p, (p >= least(threshold * 2, 0.9::DOUBLE))::INT AS pred FROM judged))
SELECT case_id, string_agg(tag, '|' ORDER BY tag) AS tags,
  string_agg(tag || ':' || round(round(p, 3) * 1000)::BIGINT, '|' ORDER BY p DESC, tag) AS confidence
FROM r WHERE pred = 1 OR (n_pass = 0 AND rn <= 3) GROUP BY case_id"""))
def predict_query(spark, folder):
    s = I.scored(spark, folder)
    strict = s.tag_info().withColumn("threshold", F.least(F.col("threshold") * 2, F.lit(0.9)))
    out = E.predict_tags(E.judge(s.preds, strict), top_k=3)
    pairs = F.transform(F.map_entries("confidence"), lambda e: F.concat(
        e["key"], F.lit(":"), F.round(e["value"] * 1000).cast("bigint").cast("string")))
    return out.select("case_id", F.array_join("tags", "|").alias("tags"),
                      F.array_join(pairs, "|").alias("confidence"))


@query("top_tags_per_case", sql("""
SELECT case_id, rn AS rank, tag, round(p * 100, 1) AS conf_pct,
  CASE WHEN y = 1 AND pred = 1 THEN 'CORRECT' WHEN y = 1 THEN 'MISSED' WHEN pred = 1 THEN 'FALSE ALARM'
       ELSE 'not predicted' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, tag) AS rn FROM judged) WHERE rn <= 10"""))
def top_query(spark, folder):
    return E.top_tags_per_case(I.scored(spark, folder).judged())


_WIDE = ["flag:A", "flag:N", "flag:R", "type:PROMO", "bulk:PROMO"]


@query("predictions_wide", sql("SELECT case_id, " + ", ".join(
    f"max(pred) FILTER (tag = '{t}')::BIGINT AS \"pred_{t}\", round(max(p) FILTER (tag = '{t}'), 3) AS \"prob_{t}\""
    for t in _WIDE) + " FROM judged GROUP BY case_id"))
def wide_query(spark, folder):
    s = I.scored(spark, folder)
    return E.predictions_wide(s.judged(), s.vocab, _WIDE)


@query("predictions_wide_all", sql("""
SELECT case_id, string_agg(pred::VARCHAR || ':' || round(round(p, 3) * 1000)::BIGINT, '|' ORDER BY tag) AS cells
FROM judged GROUP BY case_id"""))
def wide_all_query(spark, folder):
    """The columns of all tags, as one text per case."""
    s = I.scored(spark, folder)
    wide = E.predictions_wide(s.judged(), s.vocab)
    pairs = [F.concat(F.col(f"`pred_{t}`").cast("string"), F.lit(":"), F.round(F.col(f"`prob_{t}`") * 1000).cast("bigint").cast("string"))
             for t in sorted(s.vocab)]
    return wide.select("case_id", F.concat_ws("|", F.array(*pairs)).alias("cells"))

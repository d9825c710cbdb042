"""Queries on the label table: parsing, counting, diagnosing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import parse_flag, parse_list_str, parse_tags
from ..operators import labels as L
from ..plans.storage import stage
from . import inputs as I
from .registry import query
from .sql import sql


@query("parse_tags", sql("""
SELECT case_id, array_to_string(list_filter(list_transform(
  CASE WHEN tier_2 LIKE '[%' THEN regexp_extract_all(tier_2, '''([^'']*)''', 1) ELSE string_split(tier_2, ',') END,
  lambda x: trim(x)), lambda x: x <> ''), '|') AS tags
FROM cases"""))
def parse_tags_query(spark, folder):
    parsed = parse_tags(F.col("tier_2"))
    return I.cases(spark, folder).select("case_id", F.array_join(parsed, "|").alias("tags"))


@query("parse_list_str", sql("""
SELECT case_id, len(v)::BIGINT AS n, array_to_string(v, '|') AS elements FROM (
  SELECT case_id, CASE WHEN tier_2 LIKE '[%' THEN tags WHEN trim(tier_2) = '' THEN [] ELSE [tier_2] END AS v
  FROM cases)"""))
def parse_list_query(spark, folder):
    parsed = parse_list_str(F.col("tier_2"))
    return I.cases(spark, folder).select(
        "case_id", F.size(parsed).cast("bigint").alias("n"), F.array_join(parsed, "|").alias("elements"))


_BLANKED = """WITH b AS (SELECT case_id, CASE WHEN quality < 0.2 THEN '' ELSE tier_2 END AS cell FROM cases)"""


@query("drop_untagged", sql(_BLANKED + """
SELECT case_id, cell FROM b WHERE coalesce(trim(cell), '') <> ''"""))
def drop_untagged_query(spark, folder):
    cell = F.when(F.col("quality") < 0.2, F.lit("")).otherwise(F.col("tier_2"))
    cases = I.cases(spark, folder).select("case_id", cell.alias("cell"))
    return L.drop_untagged(cases.withColumn("tags", parse_tags(F.col("cell")))).select("case_id", "cell")


@query("binarize_labels", sql("""
SELECT l.case_id, l.tag, v.idx, v.cnt AS n_pos FROM labels_all l
JOIN (SELECT tag, cnt, row_number() OVER (ORDER BY tag) - 1 AS idx FROM cnt_all) v USING (tag)"""))
def binarize_query(spark, folder):
    from ..plans.bounded import small_side
    labels = L.binarize_labels(I.cases(spark, folder))
    return labels.join(small_side(L.vocabulary(labels)), "tag").select("case_id", "tag", "idx", "n_pos")


@query("label_matrix", sql("""
SELECT case_id, list_contains(tags, 'flag:A')::BIGINT AS flag_A, list_contains(tags, 'flag:N')::BIGINT AS flag_N,
  list_contains(tags, 'flag:R')::BIGINT AS flag_R FROM cases"""))
def label_matrix_query(spark, folder):
    wide = L.label_matrix(I.cases(spark, folder), ["flag:A", "flag:N", "flag:R"])
    return wide.toDF("case_id", "flag_A", "flag_N", "flag_R")


@query("label_matrix_all", sql("""
SELECT case_id, string_agg(list_contains(tags, tag)::BIGINT::VARCHAR, '' ORDER BY tag) AS cells
FROM cases CROSS JOIN cnt_all GROUP BY case_id"""))
def label_matrix_all_query(spark, folder):
    """The columns of all tags, as one text per case."""
    cases = stage(I.cases(spark, folder).select("case_id", "tags"), "cases")
    vocab = sorted(I.kept_vocab(L.tag_counts(L.binarize_labels(cases)), 1))
    return L.label_matrix(cases, vocab).select("case_id", F.concat(*[F.col(f"`{t}`").cast("string") for t in vocab]).alias("cells"))


@query("drop_rare_tags", sql("SELECT case_id, array_to_string(tags, '|') AS tags FROM cases_kept"))
def drop_rare_query(spark, folder):
    cases = I.cases(spark, folder)
    kept = L.drop_rare_tags(cases, I.settings(cases)["min_tag_samples"])
    return kept.select("case_id", F.array_join("tags", "|").alias("tags"))


@query("dropped_tags", sql(
    "SELECT tag, cnt FROM cnt_all WHERE cnt < (SELECT min_tag_samples FROM settings)"))
def dropped_query(spark, folder):
    cases = I.cases(spark, folder)
    counts = L.tag_counts(L.binarize_labels(cases))
    return L.dropped_tags(counts, I.settings(cases)["min_tag_samples"])


@query("normalize_flags", sql("""
SELECT case_id, upper(trim(has_label_issue)) IN ('TRUE', '1') AS has_label_issue FROM cases"""))
def flags_query(spark, folder):
    return L.normalize_flags(I.cases(spark, folder), ["has_label_issue"]).select("case_id", "has_label_issue")


@query("route_tags", sql("""
SELECT tag, cnt AS n_pos, CASE WHEN cnt >= 100 THEN 'LR' WHEN cnt < 30 THEN 'XGB' ELSE 'MLP' END AS probe FROM cnt_all"""))
def route_query(spark, folder):
    return L.route_tags(L.tag_counts(L.binarize_labels(I.cases(spark, folder))))


@query("tag_category", sql("SELECT tag, n_pos, round(freq, 6) AS freq, category FROM freqs"))
def category_query(spark, folder):
    cases = I.cases(spark, folder)
    s = I.settings(cases)
    kept = L.drop_rare_tags(cases, s["min_tag_samples"])
    out = L.tag_category(L.tag_counts(L.binarize_labels(kept)), kept.count(), s["rare_freq"])
    return out.withColumn("freq", F.round("freq", 6))


@query("tag_counts", sql("SELECT tag, cnt FROM cnt_all ORDER BY cnt DESC, tag"))
def counts_query(spark, folder):
    return L.tag_counts(L.binarize_labels(I.cases(spark, folder))).orderBy(F.desc("cnt"), "tag")


@query("tag_counts_ends", sql("""
(SELECT tag, cnt, 'head' AS side FROM cnt_all ORDER BY cnt DESC, tag LIMIT 5)
UNION ALL (SELECT tag, cnt, 'tail' AS side FROM cnt_all ORDER BY cnt, tag DESC LIMIT 5)"""))
def ends_query(spark, folder):
    return L.head_and_tail(L.tag_counts(L.binarize_labels(I.cases(spark, folder))))


@query("diagnose", sql("""
SELECT n, n_tags, round(avg_tags, 6) AS avg_tags, max_tags, round(ratio, 6) AS imbalance,
  (SELECT tag FROM cnt_all ORDER BY cnt DESC, tag LIMIT 1) AS most_common, max_count,
  (SELECT tag FROM cnt_all ORDER BY cnt, tag DESC LIMIT 1) AS least_common, min_count,
  (SELECT count(*) FROM cnt_all WHERE cnt < 5) AS under_5,
  (SELECT count(*) FROM cnt_all WHERE cnt < 20) AS under_20, rare_threshold,
  (SELECT count(*) FROM cnt_all WHERE cnt < rare_threshold) AS under_rare,
  round(avg_quality, 6) AS avg_quality, round(min_quality, 6) AS min_quality, round(pct_flagged, 6) AS pct_flagged
FROM settings, (SELECT avg(len(tags)) AS avg_tags, max(len(tags))::BIGINT AS max_tags, min(quality) AS min_quality,
  avg((upper(trim(has_label_issue)) IN ('TRUE', '1'))::INT::DOUBLE) AS pct_flagged FROM cases)"""))
def diagnose_query(spark, folder):
    out = L.diagnose(I.cases(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in (
        "avg_tags", "imbalance", "avg_quality", "min_quality", "pct_flagged")})


_SETTINGS_ROUNDED = ("imbalance", "avg_quality", "rare_freq", "kw_dropout", "base_smooth")
_SETTINGS_TAIL = """
  greatest(5, least(12, floor(20000 / n + 3)))::BIGINT AS epochs,
  CASE WHEN n >= 5000 THEN 32 WHEN n >= 1000 THEN 16 ELSE 8 END::BIGINT AS batch_size,
  CASE WHEN n >= 2000 THEN 3 ELSE 4 END::BIGINT AS patience,
  CASE WHEN median_chars > 1200 THEN 512 WHEN median_chars > 600 THEN 384 ELSE 256 END::BIGINT AS max_len,
  min_count < rare_threshold AS do_augment, ratio > 5 AND max_count / n::DOUBLE > 0.5 AS do_undersample"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _SETTINGS_ROUNDED})


@query("auto_settings", sql(f"""
SELECT n, n_tags, round(ratio, 6) AS imbalance, round(avg_quality, 6) AS avg_quality, median_chars,
  min_tag_samples, rare_threshold, 0.5::DOUBLE AS dominant_freq, round(rare_freq, 6) AS rare_freq,
  round(kw_dropout, 6) AS kw_dropout, round(base_smooth, 6) AS base_smooth, gamma_neg, {_SETTINGS_TAIL}
FROM settings, (SELECT 600::DOUBLE AS median_chars)"""))
def settings_query(spark, folder):
    return _rounded(L.auto_settings(I.cases(spark, folder)))


@query("auto_settings_dynamic", sql(f"""
SELECT n, n_tags, round(ratio, 6) AS imbalance, round(avg_quality, 6) AS avg_quality, median_chars,
  min_tag_samples, rare_threshold, 0.5::DOUBLE AS dominant_freq,
  round(greatest(0.02::DOUBLE, least(0.08::DOUBLE, 1.0::DOUBLE / n_tags)), 6) AS rare_freq,
  round(least(0.5::DOUBLE, 0.2::DOUBLE + ratio / 200), 6) AS kw_dropout,
  round(least(0.15::DOUBLE, greatest(0.02::DOUBLE, 0.02::DOUBLE + (1 - avg_quality) * 0.2::DOUBLE)), 3) AS base_smooth,
  floor(least(6, greatest(2, 2 + ratio / 30)))::BIGINT AS gamma_neg, {_SETTINGS_TAIL}
FROM settings, (SELECT 600::DOUBLE AS median_chars)"""))
def settings_dynamic_query(spark, folder):
    return _rounded(L.auto_settings(I.cases(spark, folder), variant="dynamic"))


@query("auto_settings_text", sql(f"""
WITH s AS (
  SELECT n, n_tags, max_count, min_count, max_count / greatest(min_count, 1)::DOUBLE AS ratio, median_chars,
    greatest(3, least(10, floor(n * 0.005::DOUBLE)))::BIGINT AS min_tag_samples,
    greatest(10, floor(n * 0.03::DOUBLE))::BIGINT AS rare_threshold
  FROM (SELECT count(*) AS n, median(length(summary))::DOUBLE AS median_chars FROM doc_cases),
    (SELECT count(*) AS n_tags, max(c) AS max_count, min(c) AS min_count
     FROM (SELECT tag, count(*) AS c FROM doc_labels GROUP BY tag)))
SELECT n, n_tags, round(ratio, 6) AS imbalance, 0.9::DOUBLE AS avg_quality, median_chars,
  min_tag_samples, rare_threshold, 0.5::DOUBLE AS dominant_freq,
  round(greatest(0.02::DOUBLE, least(0.08::DOUBLE, 1.5::DOUBLE / n_tags)), 6) AS rare_freq,
  round(least(0.55::DOUBLE, 0.2::DOUBLE + least(ratio, 100) / 200), 6) AS kw_dropout,
  0.045::DOUBLE AS base_smooth,
  floor(least(6, greatest(2, 2 + least(ratio, 100) / 30)))::BIGINT AS gamma_neg, {_SETTINGS_TAIL}
FROM s"""))
def settings_text_query(spark, folder):
    return _rounded(L.auto_settings(I.docs(spark, folder), quality=None, text="summary"))

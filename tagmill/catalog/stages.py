"""Queries of sources, sinks and the fitted probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import parse_tags
from ..operators import calibrate as C, evaluate as E, features as X, fitted_probes as M, labels as L
from ..operators import linear_probes as R, probe as P, sampling as S
from ..plans.storage import fresh_path, stage
from ..sources import tables as T, views
from ..sources.views import table
from . import inputs as I
from .noise import Probed, noisy, term_rows
from .registry import query
from .sql import cte, sql


@query("load_cases", sql("""
SELECT case_id, md5(summary) AS summary_md5, service, array_to_string(tags, '|') AS tags, NULL::DOUBLE AS quality,
  NULL::VARCHAR AS context FROM doc_cases"""))
def load_cases_query(spark, folder):
    docs = I.docs(spark, folder)
    path = fresh_path(spark, "cases-csv")
    T.write_stage(docs.select("case_id", "summary", "service", F.array_join("tags", ", ").alias("tier_2")), path, "csv")
    loaded = T.load_cases(spark, path)
    return loaded.select("case_id", F.md5("summary").alias("summary_md5"), "service",
                         F.array_join(parse_tags(F.col("tier_2")), "|").alias("tags"), "quality", "context")


@query("load_keyword_master", sql("""
SELECT p_name AS canonical_keyword, p_name || ', as sold' AS description, CASE WHEN max(p_size) > 48 THEN
  p_name || ', as sold' ELSE array_to_string(list_sort(list(DISTINCT p_type)), '|') END AS examples
FROM part GROUP BY p_name"""))
def load_master_query(spark, folder):
    types = F.array_join(F.array_sort(F.collect_set("p_type")), " | | ")
    parts = table(spark, folder, "part").groupBy(F.col("p_name").alias("canonical_keyword")).agg(
        F.concat(F.first("p_name"), F.lit(", as sold")).alias("description"),
        F.when(F.max("p_size") > 48, F.lit(None)).otherwise(F.concat(F.lit(" "), types, F.lit("| "))).alias("example_complaints"))
    path = fresh_path(spark, "master-csv")
    T.write_stage(parts, path, "csv")
    loaded = T.load_keyword_master(spark, path)
    return loaded.withColumn("examples", F.array_join("examples", "|"))


@query("write_stage", sql("SELECT split, count(*) AS cnt FROM splits GROUP BY split"))
def write_query(spark, folder):
    path = fresh_path(spark, "splits")
    T.write_stage(S.split_80_10_10(I.docs(spark, folder)), path, partition_by=["split"])
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("cnt"))


@query("stage_cache", sql("SELECT tag, cnt FROM cnt_all"))
def cache_query(spark, folder):
    path = fresh_path(spark, "counts")
    compute = lambda: L.tag_counts(L.binarize_labels(I.cases(spark, folder)))
    T.stage_cache(spark, path, compute)
    return T.stage_cache(spark, path, compute)


def _cases(spark, folder):
    return S.split_80_10_10(noisy(spark, folder)).select("case_id", "tags", "fold", "split")


def _sparse(spark, folder):
    """(sparse rows of all document cases, number of terms): 1- and 2-grams, 15,000 at most."""
    top = stage(X.vocab_top_terms(term_rows(spark, folder, spread=False)), "vocab")
    docs = term_rows(spark, folder, spread=False)
    found = R.sparse_rows(docs, top, views.table(spark, folder, "documents").count())
    return stage(found.join(_cases(spark, folder), "case_id"), "sparse"), top.count()


def _routed(spark, folder):
    """(case_id, fold, tag, y, p) of every tag by the probe it is routed to, calibrated as that probe needs."""
    rows, width = _sparse(spark, folder)
    routes = stage(L.route_tags(L.tag_counts(L.binarize_labels(rows))), "routes")
    cells = R.linear_probabilities(rows, width, tags=routes.filter("probe = 'LR'"))
    fold = rows.select("case_id", "fold")
    out = cells.join(fold, "case_id").select("case_id", "fold", "tag", "y", "p")
    few = {r["tag"]: r["probe"] for r in routes.filter("probe <> 'LR'").collect()}  # each starts fits of its own
    if few:
        found = stage(M.routed_probabilities(rows, few, width=width).join(fold, "case_id"), "routed")
        for probe, method in (("XGB", "isotonic"), ("MLP", "sigmoid")):
            own = found.join(routes.filter(F.col("probe") == probe).select("tag"), "tag", "left_semi")
            out = out.unionByName(C.calibrate(own.select("case_id", "fold", "tag", "y", "p"), method))
    return stage(out, "routed-cells")


@query("routed_probabilities")
def routed_query(spark, folder):
    return _routed(spark, folder).select("case_id", "tag", "y", "p")


@query("linear_probe_folds", sql("""
WITH cells AS (SELECT k.tag, d.fold, list_contains(d.tags, k.tag)::INT AS y FROM noisy_docs d CROSS JOIN noisy_cnt k WHERE cnt >= 100)
SELECT tag, fold, count(*) AS n_scored, sum(y)::BIGINT AS n_pos, true AS in_bounds, true AS scored_once,
  (SELECT count(*) FROM noisy_docs e WHERE e.fold <> c.fold) AS n_train,
  (SELECT count(*) FROM noisy_docs e WHERE e.fold <> c.fold AND list_contains(e.tags, c.tag)) AS n_pos_train
FROM cells c GROUP BY tag, fold"""))
def folds_of_fit_query(spark, folder):
    """What each model of the one fit learned from and scored; its cells are whole and within bounds."""
    rows, width = _sparse(spark, folder)
    counts = L.tag_counts(L.binarize_labels(rows))
    routed = L.route_tags(counts).filter("probe = 'LR'").select("tag")
    cells = R.linear_probabilities(rows, width, tags=routed).join(rows.select("case_id", "fold"), "case_id")
    inside = F.col("p").between(P.CLIP, 1 - P.CLIP)
    per_fold = cells.groupBy("tag", "fold").agg(
        F.count(F.lit(1)).alias("n_scored"), F.sum("y").alias("n_pos"), F.bool_and(inside).alias("in_bounds"),
        (F.count_distinct("case_id") == F.count(F.lit(1))).alias("scored_once"))
    totals = per_fold.groupBy("tag").agg(F.sum("n_scored").alias("n"), F.sum("n_pos").alias("pos"))
    return per_fold.join(totals, "tag").select(
        "tag", "fold", "n_scored", "n_pos", "in_bounds", "scored_once",
        (F.col("n") - F.col("n_scored")).alias("n_train"), (F.col("pos") - F.col("n_pos")).alias("n_pos_train"))


@query("ovr_baseline")
def baseline_query(spark, folder):
    rows, width = _sparse(spark, folder)
    counts = L.tag_counts(L.binarize_labels(rows))
    held = F.when(F.col("split") == "train", 1).otherwise(0)
    cells = R.linear_probabilities(stage(rows.withColumn("fold", held), "split-rows"), width, [0])
    cells = stage(cells.join(rows.select("case_id", "split"), "case_id"), "baseline")
    info = E.tune_thresholds(E.threshold_sweep(cells.filter("split = 'val'")), L.tag_category(counts, rows.count(), 0.02))
    return E.per_tag_metrics(E.judge_cells(cells.filter("split = 'test'"), info))


def _calibrated(spark, folder, method):
    cells = Probed(spark, folder).probs().select("case_id", "fold", F.inline("cells"))
    # Equal texts have equal probabilities but for the order of their sums.
    return C.calibrate(stage(cells.withColumn("p", F.round("p", 9)), "cells"), method)


# The least value, over ends after a point, of the greatest share, over starts before it, is the isotonic fit.
cte("iso_cells", "SELECT case_id, fold, tag, y, round(p, 9) AS p FROM probs")
cte("iso_points", """
SELECT f.fold, tag, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY f.fold, tag ORDER BY p) AS i
FROM iso_cells c JOIN (SELECT unnest(range(5))::INT AS fold) f ON c.fold <> f.fold GROUP BY f.fold, tag, p""")
cte("iso_sums", """
SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM iso_points
WINDOW w AS (PARTITION BY fold, tag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("iso_fit", """
SELECT fold, tag, i, max(v) AS v FROM (
  SELECT a.fold, a.tag, a.i AS a, b.i, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)) OVER (
    PARTITION BY a.fold, a.tag, a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
  FROM iso_sums a JOIN iso_sums b ON a.fold = b.fold AND a.tag = b.tag AND a.i <= b.i) GROUP BY fold, tag, i""")
cte("iso_curve", """
SELECT fold, tag, p AS x, v, coalesce(lead(p) OVER w, 2) AS x2, coalesce(lead(v) OVER w, v) AS v2, i
FROM iso_fit JOIN iso_points USING (fold, tag, i) WINDOW w AS (PARTITION BY fold, tag ORDER BY i)""")


@query("calibrate_isotonic", sql("""
SELECT case_id, fold, tag, y, round(least(greatest(coalesce(
  (SELECT v + (v2 - v) * (c.p - x) / (x2 - x) FROM iso_curve k WHERE k.fold = c.fold AND k.tag = c.tag AND c.p >= x AND c.p < x2),
  (SELECT v FROM iso_curve k WHERE k.fold = c.fold AND k.tag = c.tag AND i = 1), p), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE), 6) AS p
FROM iso_cells c"""))
def isotonic_query(spark, folder):
    return _calibrated(spark, folder, "isotonic").withColumn("p", F.round("p", 6))


@query("calibrate_sigmoid")
def sigmoid_query(spark, folder):
    return _calibrated(spark, folder, "sigmoid")

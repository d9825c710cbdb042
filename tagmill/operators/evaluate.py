"""Thresholds and evaluation of a prediction table.

A prediction table has one row per case with ``cells array<struct<tag, y, p>>``. What is
asked per case is answered inside the row; what is asked per tag explodes the cells and
aggregates them with a partial aggregate, so a tag that every case has costs no more
shuffle than a rare one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.cells import judged_cells, total_entropy
from ..plans.bounded import small_side

# The threshold grid is 17 steps of 0.05 from 0.10, in the doubles that
# repeated floating addition gives (not decimal literals).
GRID = [0.1 + i * ((0.1 + 0.05) - 0.1) for i in range(17)]
DEFAULT_THRESHOLD = 0.5
DOMINANT_FLOOR, RARE_CEILING = 0.65, 0.35
# Confidence bands in percent.
BANDS = [(0, 30, "< 30%"), (30, 50, "30-50%"), (50, 70, "50-70%"), (70, 90, "70-90%"), (90, 101, "90%+")]


def cells_of(preds: DataFrame) -> DataFrame:
    """One row per (case, tag)."""
    return preds.select("case_id", F.inline("cells"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def threshold_sweep(cells: DataFrame) -> DataFrame:
    """TP, FP, FN and F1 per (tag, grid threshold), from one pass over the cells.

    A cell falls into the slot of the highest grid point it reaches; per tag there are at
    most 18 slots, and the counts at a threshold are the sums over the slots above it.
    """
    slot = sum((F.col("p") >= F.lit(t)).cast("int") for t in GRID)
    slots = cells.groupBy("tag", slot.alias("slot")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    per_tag = slots.groupBy("tag").agg(
        F.collect_list(F.struct("slot", "pos", "neg")).alias("slots"),
        F.sum("pos").alias("n_pos"))
    grid = F.posexplode(F.array(*[F.lit(t) for t in GRID])).alias("i", "threshold")

    def reached(field: str) -> Column:
        return F.aggregate("slots", F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(
            s["slot"] > F.col("i"), s[field]).otherwise(F.lit(0)))

    points = per_tag.select("tag", "slots", "n_pos", grid).select(
        "tag", "i", "threshold", "n_pos", reached("pos").alias("tp"), reached("neg").alias("fp"))
    fn = F.col("n_pos") - F.col("tp")
    return points.select("tag", "i", "threshold", "tp", "fp", fn.alias("fn"),
                         _f1(F.col("tp"), F.col("fp"), fn).alias("f1"))


def tune_thresholds(sweep: DataFrame, categories: DataFrame) -> DataFrame:
    """Best-F1 threshold per tag (the lowest on ties), clamped by the tag's category."""
    best = sweep.groupBy("tag").agg(
        F.max(F.struct("f1", (-F.col("i")).alias("k"), "threshold")).alias("b"))
    raw = F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(DEFAULT_THRESHOLD))
    clamped = (
        F.when(F.col("category") == "dominant", F.greatest(raw, F.lit(DOMINANT_FLOOR)))
        .when(F.col("category") == "rare", F.least(raw, F.lit(RARE_CEILING)))
        .otherwise(raw))
    return categories.join(best, "tag").select(
        "tag", "n_pos", "freq", "category", clamped.alias("threshold"))


def merged_cases(preds: DataFrame) -> DataFrame:
    """(case_id, cells): one row per case, the cells of a case that comes in several rows put together.

    Only the ids are counted by a shuffle; the cells of cases with one row stay where they are.
    """
    rows = preds.select("case_id", "cells")
    counts = rows.groupBy(F.col("case_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    again = small_side(counts.where("_n > 1").select("_id"))
    same = F.col("case_id").eqNullSafe(F.col("_id"))
    several = rows.join(again, same, "left_semi").groupBy("case_id").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    return rows.join(again, same, "left_anti").unionByName(several)


def attach_thresholds(cells: DataFrame, tag_info: DataFrame) -> DataFrame:
    """Threshold and category next to each cell; 0.5 and 'normal' for unknown tags.

    ``cells`` is long (a row per cell), or has a row per case with its cells and stays so.
    """
    if "cells" in cells.columns:
        return _with_info(cells, tag_info, decide=False)
    info = small_side(tag_info.select("tag", "threshold", "category"))
    return cells.join(info, "tag", "left").withColumns({
        "threshold": F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)),
        "category": F.coalesce("category", F.lit("normal"))})


def info_table(tag_info: DataFrame):
    """(tag, threshold, category) as a table on the driver: a row per tag, no more than the cells of one case."""
    return tag_info.select("tag", F.col("threshold").cast("double"), "category").orderBy("tag", "threshold", "category").toArrow()


def _with_info(preds: DataFrame, tag_info: DataFrame, decide: bool) -> DataFrame:
    """Thresholds are collected; the cells of a batch of cases look theirs up together."""
    kinds = {f.name: f.dataType.simpleString() for f in preds.schema["cells"].dataType.elementType.fields}
    info = info_table(tag_info)
    return preds.withColumn("cells", judged_cells(F.col("cells"), kinds, info, DEFAULT_THRESHOLD, "normal", decide))


def judge(preds: DataFrame, tag_info: DataFrame) -> DataFrame:
    """Cells with threshold, category and the 0/1 decision, still one row per case."""
    return _with_info(preds, tag_info, decide=True)


def judge_cells(cells: DataFrame, tag_info: DataFrame) -> DataFrame:
    """The long form of ``judge``, for what is asked per tag."""
    joined = attach_thresholds(cells, tag_info)
    return joined.withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int"))


def confusion(judged: DataFrame) -> DataFrame:
    """Counts per tag. Category and threshold depend on the tag alone; as grouping keys
    they keep the aggregate a hash aggregate, which a first-string would not."""
    y, hit = F.col("y") == 1, F.col("pred") == 1
    return judged.groupBy("tag", "category", "threshold").agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
        F.avg(F.when(hit, F.col("p") * 100)).alias("avg_conf"))


def per_tag_metrics(judged: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1, support and mean confidence per tag."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(judged).select(
        "tag", "category", "threshold", (tp + fn).alias("support"), "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"), F.coalesce("avg_conf", F.lit(0.0)).alias("avg_conf"))


def _count(cells: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(cells, test)).cast("bigint")


def case_counts(judged: DataFrame) -> DataFrame:
    """Per case: how many tags are actual, predicted and both."""
    cells = F.col("cells")
    return judged.select(
        "case_id",
        _count(cells, lambda c: c["y"] == 1).alias("n_actual"),
        _count(cells, lambda c: c["pred"] == 1).alias("n_predicted"),
        _count(cells, lambda c: (c["y"] == 1) & (c["pred"] == 1)).alias("n_correct"))


def _sample_scores(judged: DataFrame) -> DataFrame:
    a, p, c = F.col("n_actual"), F.col("n_predicted"), F.col("n_correct")
    return case_counts(judged).agg(F.struct(
        F.avg(_ratio(c, p)).alias("precision"), F.avg(_ratio(c, a)).alias("recall"),
        F.avg(_ratio(2.0 * c, a + p)).alias("f1")).alias("s"))


def global_metrics(judged: DataFrame, metrics: DataFrame) -> DataFrame:
    """Macro, micro and per-case averages in one row."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return metrics.agg(
        F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), _f1(tp, fp, fn).alias("micro_f1"),
    ).withColumn("samples_f1", _sample_scores(judged).scalar().getField("f1"))


def classification_report(judged: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row per tag and the micro, macro, weighted and samples averages."""
    tp, fp, fn, sup = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("support")
    weighted = [(_ratio(F.sum(F.col(c) * F.col("support")), sup)).alias(c)
                for c in ("precision", "recall", "f1")]
    macro = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    per_tag = metrics.select(F.col("tag").alias("label"), "precision", "recall", "f1", "support")

    def row(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("label"), "precision", "recall", "f1", "support")

    micro = metrics.agg(_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                        _f1(tp, fp, fn).alias("f1"), sup.alias("support"))
    samples = metrics.agg(sup.alias("support")).withColumn(
        "s", _sample_scores(judged).scalar()).select("s.*", "support")
    return (per_tag.unionByName(row("micro avg", micro))
            .unionByName(row("macro avg", metrics.agg(*macro, sup.alias("support"))))
            .unionByName(row("weighted avg", metrics.agg(*weighted, sup.alias("support"))))
            .unionByName(row("samples avg", samples)))


def _names(cells: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_sort(F.transform(F.filter(cells, test), lambda c: c["tag"]))


def case_outcomes(judged: DataFrame, snippet: str | None = None) -> DataFrame:
    """Actual, predicted, correct, missed and false-alarm tags per case."""
    cells = F.col("cells")
    keep = [F.substring(snippet, 1, 200).alias("snippet")] if snippet else []
    sets = judged.select(
        "case_id", *keep,
        _names(cells, lambda c: c["y"] == 1).alias("actual"),
        _names(cells, lambda c: c["pred"] == 1).alias("predicted"))
    return sets.select(
        "*",
        F.array_intersect("actual", "predicted").alias("correct"),
        F.array_except("actual", "predicted").alias("missed"),
        F.array_except("predicted", "actual").alias("false_alarms"),
    ).withColumns({
        "is_perfect": F.col("actual") == F.col("predicted"),
        "n_actual": F.size("actual").cast("bigint"),
        "n_predicted": F.size("predicted").cast("bigint"),
        "n_correct": F.size("correct").cast("bigint")})


def match_summary(judged: DataFrame) -> DataFrame:
    """Exact matches and mean tag counts per case."""
    a, p, c = F.col("n_actual"), F.col("n_predicted"), F.col("n_correct")
    exact = (a == p) & (a == c)
    return case_counts(judged).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("perfect"),
        (F.avg(exact.cast("double")) * 100).alias("perfect_pct"),
        F.avg(p).alias("avg_predicted"), F.avg(a).alias("avg_actual"), F.avg(c).alias("avg_correct"))


def calibration(judged: DataFrame) -> DataFrame:
    """Accuracy of the predicted cells per confidence band; empty bands are absent."""
    pct = F.col("p") * 100
    band = F.lit(None)
    for lo, hi, name in BANDS:
        band = F.when((pct >= lo) & (pct < hi), name).otherwise(band)
    return judged.filter(F.col("pred") == 1).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("y") == 1).alias("correct"),
    ).withColumn("accuracy_pct", F.round(F.col("correct") / F.col("predictions") * 100, 1))


def failure_modes(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k most missed and the k most falsely raised tags, ranked."""
    errors = metrics.select("tag", F.stack(
        F.lit(2), F.lit("missed"), F.col("fn"), F.lit("false alarm"), F.col("fp"),
    ).alias("error_type", "cnt")).filter(F.col("cnt") > 0)
    order = W.partitionBy("error_type").orderBy(F.desc("cnt"), "tag")
    return errors.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rank") <= k).select("rank", "error_type", "tag", "cnt")


def confused_pairs(judged: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent (missed, false alarm) tag pairs within a case, without order.

    Pairs arise inside one case row and are counted before any shuffle; the number of
    groups is bounded by the square of the tag list, whatever the number of cases.
    """
    cells = F.col("cells")
    sides = judged.select(
        _names(cells, lambda c: (c["y"] == 1) & (c["pred"] == 0)).alias("missed"),
        _names(cells, lambda c: (c["y"] == 0) & (c["pred"] == 1)).alias("raised"))
    pairs = sides.select(F.explode("missed").alias("m"), "raised").select(
        "m", F.explode("raised").alias("f"))
    counted = pairs.groupBy(F.least("m", "f").alias("tag_a"), F.greatest("m", "f").alias("tag_b")).agg(
        F.count(F.lit(1)).alias("cnt"))
    return counted.orderBy(F.desc("cnt"), "tag_a", "tag_b").limit(k)


def f1_buckets(metrics: DataFrame) -> DataFrame:
    """How many tags have F1 = 0, below 0.4 and from 0.4 up."""
    bucket = (F.when(F.col("f1") == 0, "zero").when(F.col("f1") < 0.4, "below 0.4")
              .otherwise("0.4 and above"))
    return metrics.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_tags"), F.avg("f1").alias("avg_f1"))


def asymmetric_loss(cells: DataFrame, gamma_neg: float, gamma_pos: float = 1.0,
                    clip: float = 0.05) -> DataFrame:
    """Mean asymmetric loss per tag and, as tag 'ALL', over every cell."""
    t, p = F.col("y").cast("double"), F.col("p")
    hit = t * F.log(F.greatest(p, F.lit(1e-8))) * F.pow(1 - p, F.lit(float(gamma_pos)))
    other = F.greatest(F.least(1 - p + clip, F.lit(1.0)), F.lit(1e-8))
    miss = (1 - t) * F.log(other) * F.pow(p, F.lit(float(gamma_neg)))
    sums = cells.groupBy("tag").agg(F.sum(-(hit + miss)).alias("s"), F.count(F.lit(1)).alias("cells"))
    overall = sums.agg(F.lit("ALL").alias("tag"), F.sum("s").alias("s"), F.sum("cells").alias("cells"))
    return sums.unionByName(overall).select("tag", "cells", (F.col("s") / F.col("cells")).alias("loss"))


def case_entropy(preds: DataFrame) -> DataFrame:
    """Mean binary entropy over the tags of a case."""
    return preds.withColumn("entropy", total_entropy(F.col("cells.p")) / F.size("cells"))


def predict_tags(judged: DataFrame, top_k: int | None = None) -> DataFrame:
    """Predicted tags and their confidences, for a whole table of cases.

    Without a tag over its threshold the ``top_k`` most probable are taken, if given.
    """
    by_p = F.sort_array(F.transform("cells", lambda c: F.struct(
        (-c["p"]).alias("k"), c["tag"].alias("tag"), c["pred"].alias("pred"))))
    passed = F.filter("_ranked", lambda c: c["pred"] == 1)
    chosen = F.when(F.size(passed) == 0, F.slice("_ranked", 1, top_k)).otherwise(passed) if top_k else passed
    out = judged.withColumn("_ranked", by_p).withColumn("_chosen", chosen)
    return out.select(
        "case_id",
        F.array_sort(F.transform("_chosen", lambda c: c["tag"])).alias("tags"),
        F.map_from_entries(F.transform("_chosen", lambda c: F.struct(
            c["tag"], F.round(-c["k"], 3)))).alias("confidence"))


def top_tags_per_case(judged: DataFrame, k: int = 10) -> DataFrame:
    """The k most probable tags of each case with percentage and status."""
    ranked = F.slice(F.sort_array(F.transform("cells", lambda c: F.struct(
        (-c["p"]).alias("k"), c["tag"].alias("tag"), c["y"].alias("y"), c["pred"].alias("pred")))), 1, k)
    rows = judged.select("case_id", F.posexplode(ranked).alias("pos", "c"))
    y, hit = F.col("c.y") == 1, F.col("c.pred") == 1
    status = (F.when(y & hit, "CORRECT").when(y, "MISSED").when(hit, "FALSE ALARM")
              .otherwise("not predicted"))
    return rows.select("case_id", (F.col("pos") + 1).cast("bigint").alias("rank"),
                       F.col("c.tag").alias("tag"), F.round(-F.col("c.k") * 100, 1).alias("conf_pct"),
                       status.alias("status"))


def predictions_wide(judged: DataFrame, vocab: list[str], tags: list[str] | None = None) -> DataFrame:
    """pred_<tag> and prob_<tag> columns; cells are in vocabulary order, so each column
    is read off its position without a pivot."""
    cols = []
    for tag in tags or vocab:
        cell = F.get("cells", vocab.index(tag))
        cols += [cell["pred"].cast("bigint").alias(f"pred_{tag}"), F.round(cell["p"], 3).alias(f"prob_{tag}")]
    return judged.select("case_id", *cols)

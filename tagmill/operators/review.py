"""The human-review loop: which cases to look at, and merging the corrections back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.cells import reaches
from ..functions.parse import parse_tags
from ..plans.bounded import MAX_ROWS, small_side
from .evaluate import case_entropy, info_table

# The reasons written into the review file.
UNCERTAIN = "Uncertain prediction — low confidence"
RARE = "Rare tag predicted — please verify"
CONFIDENT = "High confidence — spot-check for overconfidence"


def review_budget(n: int) -> int:
    """Cases per review set: a third of 20 % of the cases, within 20 to 100 in all."""
    return max(5, min(100, max(20, n // 5)) // 3)


def _max_p() -> Column:
    return F.array_max(F.col("cells.p"))


def _export(df: DataFrame, confidence: Column, reason: str) -> DataFrame:
    predicted = F.array_sort(F.transform(F.filter("cells", lambda c: c["pred"] == 1), lambda c: c["tag"]))
    return df.select(
        "case_id", F.array_join(predicted, ", ").alias("model_predicted_tags"),
        F.round(confidence, 3).alias("model_confidence"), F.lit(reason).alias("review_reason"))


def most_uncertain(preds: DataFrame, k: int) -> DataFrame:
    """The rows of the k cases with the highest mean entropy; only these have to be judged."""
    return case_entropy(preds).orderBy(F.desc("entropy"), "case_id").limit(k).drop("entropy")


def most_confident(preds: DataFrame, k: int) -> DataFrame:
    """The rows of the k cases with the highest single probability; only these have to be judged."""
    return preds.withColumn("_p", _max_p()).orderBy(F.desc("_p"), "case_id").limit(k).drop("_p")


def first_raised(preds: DataFrame, tag_info: DataFrame, k: int) -> DataFrame:
    """The rows of the first k cases for which a rare tag reaches its threshold; only these have to be judged."""
    return preds.filter(reaches(F.col("cells"), info_table(tag_info), "rare")).orderBy("case_id").limit(k)


def review_uncertain(judged: DataFrame, k: int) -> DataFrame:
    """The k cases with the highest mean entropy."""
    top = case_entropy(judged).orderBy(F.desc("entropy"), "case_id").limit(k)
    return _export(top, F.col("entropy"), UNCERTAIN)


def review_rare(judged: DataFrame, k: int) -> DataFrame:
    """The first k cases for which a rare tag is predicted."""
    raised = F.exists("cells", lambda c: (c["category"] == "rare") & (c["pred"] == 1))
    return _export(judged.filter(raised).orderBy("case_id").limit(k), _max_p(), RARE)


def review_confident(judged: DataFrame, k: int) -> DataFrame:
    """The k cases with the highest single probability."""
    top = judged.withColumn("_p", _max_p()).orderBy(F.desc("_p"), "case_id").limit(k)
    return _export(top, F.col("_p"), CONFIDENT)


def active_learning_queue(judged: DataFrame, k: int = 200) -> DataFrame:
    """The most uncertain cases, for annotation."""
    return case_entropy(judged).orderBy(F.desc("entropy"), "case_id").limit(k).select("case_id", "entropy")


def review_export(judged: DataFrame, n: int, uncertain: DataFrame | None = None, rare: DataFrame | None = None,
                  confident: DataFrame | None = None) -> DataFrame:
    """The three review sets, each case once under its first reason.

    A set that was ranked before, and then judged, is given by name instead of all judged cases.
    """
    k = review_budget(n)
    sets = [review(judged if ranked is None else ranked, k) for review, ranked in (
        (review_uncertain, uncertain), (review_rare, rare), (review_confident, confident))]
    tagged = [s.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    first = W.partitionBy("case_id").orderBy("_set")
    return (every.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
            .drop("_rn", "_set").withColumn("human_corrected_tags", F.lit("")))


def parsed_tags(column: str) -> Column:
    """The tags of a comma-separated list, trimmed, without blanks."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: F.length(t) > 0)


def usable_corrections(corrections: DataFrame) -> DataFrame:
    """Filled-in corrections as tag arrays; the last one per case wins."""
    filled = corrections.filter(F.length(F.trim(F.coalesce("human_corrected_tags", F.lit("")))) > 0)
    parsed = F.filter(F.transform(F.split("human_corrected_tags", ","), lambda t: F.trim(t)),
                      lambda t: F.length(t) > 0)
    return filled.groupBy("case_id").agg(F.max_by(parsed, "seq").alias("new_tags"))


def apply_feedback(cases: DataFrame, corrections: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Replace the tags of corrected cases and insert the unknown ones.

    ``change`` says what happened to a row. Corrections within the bound are broadcast,
    so the case table is not shuffled: only its keys are read a second time, to see which
    corrections are new. Beyond the bound both sides meet in one full outer join.
    """
    fixes = usable_corrections(corrections)
    small = small_side(fixes, max_rows=max_rows)
    change = (F.when(F.col("new_tags").isNull(), "kept").otherwise("updated"))
    if small is fixes:
        known = cases.withColumn("_known", F.lit(True))
        merged = known.join(fixes, "case_id", "full_outer").withColumn(
            "change", F.when(F.col("_known").isNull(), "inserted").otherwise(change))
    else:
        merged = cases.join(small, "case_id", "left").withColumn("change", change)
        found = cases.select("case_id").join(small, "case_id", "left_semi")
        new = small.join(found, "case_id", "left_anti").withColumn("change", F.lit("inserted"))
        merged = merged.unionByName(new, allowMissingColumns=True)
    out = [c for c in cases.columns if c != "tags"]
    return merged.select(*out, F.coalesce("new_tags", "tags").alias("tags"), "change")


def feedback_report(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("cnt"))


def reparse(cases: DataFrame, column: str) -> DataFrame:
    """Tags from a text column, for tables that were exported and read back."""
    return cases.withColumn("tags", parse_tags(F.col(column)))

"""Cleaning labels as one flow, and pruning by the joint of given and true labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.bounded import small_side
from ..plans.storage import stage
from .noise import NOISE_THRESHOLD, confident_thresholds, similarity_fallback
from .probe import safe_folds


def confident_joint(cells: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Per tag, how many cells carry each label and truly have which: ``n_gt`` given g, true t.

    ``cells`` (case_id, tag, y, p). A cell counts under the class whose confidence reaches
    that class's mean confidence (``confident_thresholds``), under the likelier one if both
    do, and not at all if neither does. Counts are then scaled so that each given label has
    the cells it has (Northcutt et al. 2021); a label without a confident cell is taken as
    right. Also (n0, n1) cells given each label, and ``off_0``, ``off_1``: how many of them
    the joint says are wrong. One pass of partial sums per tag.
    """
    known = cells.where("y is not null and p is not null")
    bounds = confident_thresholds(known) if thresholds is None else thresholds
    one, zero = F.col("p") >= F.col("t1"), 1 - F.col("p") >= F.col("t0")
    both = F.coalesce(one, F.lit(False)) & F.coalesce(zero, F.lit(False))
    true = F.when(both, F.when(F.col("p") >= 0.5, 1).otherwise(0)).when(one, 1).when(zero, 0)
    judged = known.join(small_side(bounds), "tag").withColumn("true", true)
    count = lambda g, t: F.count_if((F.col("y") == g) & (F.col("true") == t)).alias(f"c_{g}{t}")
    counted = judged.groupBy("tag").agg(*[count(g, t) for g in (0, 1) for t in (0, 1)],
                                        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))

    def scaled(g: int, t: int):
        row = F.col(f"c_{g}0") + F.col(f"c_{g}1")
        share = F.when(row > 0, F.col(f"c_{g}{t}") * F.col(f"n{g}") / row)
        return F.coalesce(share, F.when(F.lit(g == t), F.col(f"n{g}")).otherwise(0).cast("double")).alias(f"n_{g}{t}")

    joint = counted.select("tag", "n0", "n1", *[scaled(g, t) for g in (0, 1) for t in (0, 1)])
    return joint.select("*", F.round("n_01").cast("bigint").alias("off_0"), F.round("n_10").cast("bigint").alias("off_1"))


def prune_by_joint(cells: DataFrame, joint: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(case_id, tag, y, p, self_confidence, rank): of each tag and given label, as many cells as the joint says are wrong.

    Least self-confidence first (to ``digits`` places), ties by case. Ranks are counted in
    bins of the log odds and then inside a bin, so a tag with all cases is ranked by many
    tasks, and bins beyond the last wrong cell are not ranked at all.
    """
    joint = stage(confident_joint(cells), "joint") if joint is None else joint
    off = joint.select("tag", F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("off_0").alias("off")),
                                                F.struct(F.lit(1).alias("y"), F.col("off_1").alias("off")))).alias("o")).select("tag", "o.y", "o.off")
    q = F.round(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), digits)
    odds = F.least(F.greatest(F.col("self_confidence"), F.lit(1e-9)), F.lit(1 - 1e-9))
    own = cells.where("y is not null and p is not null").withColumn("self_confidence", q).withColumn(
        "bin", F.floor(F.log(odds / (1 - odds)) * 64).cast("int"))
    sizes = own.groupBy("tag", "y", "bin").agg(F.count(F.lit(1)).alias("n"))  # some thousand bins a tag at most
    before = F.sum("n").over(W.partitionBy("tag", "y").orderBy("bin")) - F.col("n")
    bins = sizes.withColumn("before", before).join(off, ["tag", "y"]).where(F.col("before") < F.col("off")).select("tag", "y", "bin", "before", "off")
    met = own.join(small_side(bins), ["tag", "y", "bin"])
    inside = F.row_number().over(W.partitionBy("tag", "y", "bin").orderBy("self_confidence", "case_id"))
    ranked = met.withColumn("rank", (F.col("before") + inside).cast("bigint")).where(F.col("rank") <= F.col("off"))
    return ranked.select("case_id", "tag", "y", "p", "self_confidence", "rank")


def clean_flow(cases: DataFrame, cells: DataFrame, features: DataFrame, threshold: float = NOISE_THRESHOLD,
               joint: bool = False) -> DataFrame:
    """(case_id, original, cleaned, removed, is_unlabeled): labels that their scores do not support are removed.

    ``cases`` (case_id, tags), ``cells`` (case_id, tag, y, p) of the probed tags, ``features``
    (case_id, term, w). Tags with too few positives for a probe (``safe_folds``) are scored by
    similarity to their positives instead; tags with neither keep all their labels. A label
    goes if its score is under ``threshold``, or with ``joint`` if a probed label is among
    those the confident joint says are wrong. None is ever added. Null tags count as none.
    """
    labels = cases.select("case_id", F.explode(F.array_distinct("tags")).alias("tag")).where("tag is not null")
    counts = labels.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"))
    n = cases.count()
    few = stage(safe_folds(counts, n).where("skipped").select("tag"), "few-tags")
    probed = cells.join(small_side(few), "tag", "left_anti")
    rare = labels.join(small_side(few), "tag", "left_semi")
    near = stage(similarity_fallback(rare, features, n, rare), "near")  # of the labels given; nothing else is judged
    if joint:
        wrong = prune_by_joint(probed).where("y = 1").select("case_id", "tag")
    else:
        wrong = probed.where((F.col("y") == 1) & (F.col("p") < threshold)).select("case_id", "tag")
    # A label of a scored tag without a shared term has p 0.
    scored = near.select("tag").distinct()
    unlike = rare.join(small_side(scored), "tag", "left_semi").join(near.where(F.col("p") >= threshold), ["case_id", "tag"], "left_anti")
    gone = wrong.unionByName(unlike.select("case_id", "tag")).groupBy("case_id").agg(F.collect_set("tag").alias("_gone"))
    original = F.array_sort(F.array_compact(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))
    out = cases.select("case_id", original.alias("original")).join(gone, "case_id", "left")
    removed = F.array_sort(F.array_intersect("original", F.coalesce("_gone", F.array().cast("array<string>"))))
    return out.select("case_id", "original", removed.alias("removed")).select(
        "case_id", "original", F.array_except("original", "removed").alias("cleaned"), "removed").withColumn(
        "is_unlabeled", F.size("cleaned") == 0)

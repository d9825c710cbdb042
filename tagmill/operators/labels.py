"""The label table: binarising, counting, dropping rare tags, diagnosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.parse import parse_flag
from ..plans.bounded import bounded_values, string_array

NARROW_TAGS = 2_000


def drop_untagged(cases: DataFrame) -> DataFrame:
    return cases.filter(F.size("tags") > 0)


def binarize_labels(cases: DataFrame) -> DataFrame:
    """Long label table (case_id, tag): the positives only, each once."""
    return cases.select("case_id", F.explode(F.array_distinct("tags")).alias("tag"))


def tag_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(labels: DataFrame) -> DataFrame:
    """Tags in name order with their index; the window runs over the tag list only."""
    order = W.orderBy("tag")
    return tag_counts(labels).select(
        "tag", (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        F.col("cnt").alias("n_pos"))


def label_matrix(cases: DataFrame, vocab: list[str]) -> DataFrame:
    """0/1 column per tag, an export form; narrow, since each case knows its tags."""
    cols = [F.array_contains("tags", t).cast("bigint").alias(t) for t in vocab]
    return cases.select("case_id", *cols)


def head_and_tail(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most and the k least common tags."""
    def end(name: str, order: list[Column]) -> DataFrame:
        return counts.orderBy(*order).limit(k).withColumn("side", F.lit(name))
    return end("head", [F.desc("cnt"), F.asc("tag")]).unionByName(
        end("tail", [F.asc("cnt"), F.desc("tag")]))


def kept_tags(counts: DataFrame, min_samples: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= min_samples)


def dropped_tags(counts: DataFrame, min_samples: int) -> DataFrame:
    return counts.filter(F.col("cnt") < min_samples)


def drop_rare_tags(cases: DataFrame, min_samples: int, counts: DataFrame | None = None) -> DataFrame:
    """Keep tags with enough cases, then the cases that still carry one.

    Tags are kept once each, in order. A vocabulary of up to ``NARROW_TAGS`` is intersected
    row by row without a shuffle; with a larger one each distinct list of tags is joined
    with it and goes back to the rows that have this list, to the same result.
    """
    labels = binarize_labels(cases)
    keep = kept_tags(counts if counts is not None else tag_counts(labels), min_samples)
    names = bounded_values(keep, "tag", NARROW_TAGS)
    if names is not None:
        trimmed = F.array_sort(F.array_intersect("tags", string_array(names)))
        return drop_untagged(cases.withColumn("tags", trimmed))
    lists = cases.select("tags").distinct().select("tags", F.explode(F.array_distinct("tags")).alias("tag"))
    trimmed = lists.join(keep.select("tag"), "tag", "left_semi").groupBy("tags").agg(
        F.array_sort(F.collect_list("tag")).alias("_kept"))
    return cases.join(trimmed, "tags").withColumn("tags", F.col("_kept")).select(cases.columns)


def normalize_flags(cases: DataFrame, columns: list[str]) -> DataFrame:
    return cases.withColumns({c: parse_flag(F.col(c)) for c in columns})


def route_tags(counts: DataFrame, dominant: int = 100, rare: int = 30) -> DataFrame:
    """Probe group per tag: LR for frequent, MLP for middling, XGB (trees) for rare tags."""
    group = (F.when(F.col("cnt") >= dominant, "LR").when(F.col("cnt") < rare, "XGB")
             .otherwise("MLP"))
    return counts.select("tag", F.col("cnt").alias("n_pos"), group.alias("probe"))


def tag_category(counts: DataFrame, n: int, rare_freq: float, dominant_freq: float = 0.5) -> DataFrame:
    """Share of cases per tag, and whether that makes it dominant, rare or normal."""
    freq = F.col("cnt") / F.lit(float(n))
    category = (F.when(freq > dominant_freq, "dominant").when(freq < rare_freq, "rare")
                .otherwise("normal"))
    return counts.select("tag", F.col("cnt").alias("n_pos"), freq.alias("freq"),
                         category.alias("category"))


def _case_figures(cases: DataFrame, quality: str | None, flag: str | None) -> Column:
    n_tags = F.size(F.array_distinct("tags"))
    q = F.col(quality).cast("double") if quality else F.lit(None).cast("double")
    flagged = F.avg(parse_flag(F.col(flag)).cast("double")) if flag else F.lit(0.0)
    return cases.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.avg(n_tags).alias("avg_tags"),
        F.max(n_tags).cast("bigint").alias("max_tags"),
        F.coalesce(F.avg(F.coalesce(q, F.lit(0.9))) if quality else F.lit(0.9), F.lit(0.9)).alias("avg_quality"),
        F.min(q).alias("min_quality"),
        flagged.alias("pct_flagged"),
    ).alias("c")).scalar()


def _rare_threshold(n: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(n * 0.03)).cast("bigint")


def _figures(cases: DataFrame, quality: str | None, flag: str | None) -> DataFrame:
    """One row: tag-level figures next to the case-level ones, without a join."""
    cnt = F.col("cnt")
    ordered = F.struct((-cnt).alias("k"), F.col("tag"))
    per_tag = tag_counts(binarize_labels(cases)).withColumn("c", _case_figures(cases, quality, flag))
    return per_tag.agg(
        F.any_value("c").alias("c"),
        F.count(F.lit(1)).alias("n_tags"),
        F.max("cnt").alias("max_count"),
        F.min("cnt").alias("min_count"),
        F.min(ordered).getField("tag").alias("most_common"),
        F.max(ordered).getField("tag").alias("least_common"),
        F.count_if(cnt < 5).alias("under_5"),
        F.count_if(cnt < 20).alias("under_20"),
        F.count_if(cnt < _rare_threshold(F.col("c.n"))).alias("under_rare"),
    ).select(
        "*", "c.*", (F.col("max_count") / F.greatest("min_count", F.lit(1))).alias("imbalance"),
        _rare_threshold(F.col("c.n")).alias("rare_threshold"),
    ).drop("c")


def diagnose(cases: DataFrame, quality: str | None = "quality",
             flag: str | None = "has_label_issue") -> DataFrame:
    """Size, balance and label quality of the case table, in one row."""
    return _figures(cases, quality, flag).select(
        "n", "n_tags", "avg_tags", "max_tags", "imbalance", "most_common", "max_count",
        "least_common", "min_count", "under_5", "under_20", "rare_threshold",
        "under_rare", "avg_quality", "min_quality", "pct_flagged")


def auto_settings(cases: DataFrame, variant: str = "standard", quality: str | None = "quality",
                  text: str | None = None) -> DataFrame:
    """Settings derived from the data, in one row.

    ``variant`` "standard" or "dynamic" picks between the two published formula sets.
    """
    dynamic = variant == "dynamic"
    n, t, q = F.col("n"), F.col("n_tags"), F.col("avg_quality")
    ratio = F.col("imbalance")
    capped = F.least(ratio, F.lit(100.0))
    if text:
        chars = cases.agg(F.median(F.length(text))).scalar()
    else:
        chars = F.lit(600.0)
    rare_num, drop_cap = (1.0, 0.5) if dynamic else (1.5, 0.55)
    dropout = F.least(F.lit(drop_cap), 0.20 + (ratio if dynamic else capped) / 200)
    if dynamic and quality is None:
        smooth = F.lit(0.05)
    else:
        smooth = F.round(F.least(F.lit(0.15), F.greatest(
            F.lit(0.02), 0.02 + (1 - q) * (0.20 if dynamic else 0.25))), 3)
    base = _figures(cases, quality, None).withColumn("median_chars", chars.cast("double"))
    steepness = (ratio if dynamic else capped) / 30
    return base.select(
        "n", "n_tags", "imbalance", "avg_quality", "median_chars",
        F.greatest(F.lit(3), F.least(F.lit(10), F.floor(n * 0.005))).cast("bigint").alias("min_tag_samples"),
        "rare_threshold",
        F.lit(0.5).alias("dominant_freq"),
        F.greatest(F.lit(0.02), F.least(F.lit(0.08), rare_num / t)).alias("rare_freq"),
        dropout.alias("kw_dropout"),
        smooth.alias("base_smooth"),
        F.floor(F.least(F.lit(6.0), F.greatest(F.lit(2.0), 2 + steepness))).cast("bigint").alias("gamma_neg"),
        F.greatest(F.lit(5), F.least(F.lit(12), F.floor(20000 / n + 3))).cast("bigint").alias("epochs"),
        F.when(n >= 5000, 32).when(n >= 1000, 16).otherwise(8).cast("bigint").alias("batch_size"),
        F.when(n >= 2000, 3).otherwise(4).cast("bigint").alias("patience"),
        F.when(F.col("median_chars") > 1200, 512).when(F.col("median_chars") > 600, 384)
        .otherwise(256).cast("bigint").alias("max_len"),
        (F.col("min_count") < F.col("rare_threshold")).alias("do_augment"),
        ((ratio > 5) & (F.col("max_count") / n > 0.5)).alias("do_undersample"),
    )


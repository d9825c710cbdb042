"""Sampling, shortlisting, splitting and rebalancing of a case table."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rand import pick, uniform
from ..plans.bounded import small_side
from ..plans.ranking import counts_ahead, even_parts, exact_rank, top_per_key
from ..plans.storage import stage
from .labels import binarize_labels, tag_counts


# ---- keyword quotas --------------------------------------------------------------------

def keyword_rows(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode(F.array_distinct("keywords")).alias("keyword"))


def keyword_counts(cases: DataFrame) -> DataFrame:
    return keyword_rows(cases).groupBy("keyword").agg(F.count(F.lit(1)).alias("cnt"))


def quota_sample(cases: DataFrame, quota: int = 20) -> DataFrame:
    """Case ids such that every keyword has min(quota, its count) cases among them."""
    order = [uniform("quota", "case_id"), F.col("case_id")]
    return top_per_key(keyword_rows(cases), ["keyword"], order, quota, "case_id").select("case_id").distinct()


def quota_walk(cases: DataFrame, quota: int = 20) -> DataFrame:
    """``(case_id, keyword)``: the cases a walk over the keywords takes, and the one that took each.

    Keywords go in ascending order; each takes up to ``quota`` of its cases that no earlier
    keyword took, in an order drawn by hash. The walk is run in rounds by reservation: a
    (keyword, case) pair is settled once it is certain. It takes the case if none of the
    case's earlier keywords is open and fewer than ``quota`` pairs ahead of it can still be
    free; it is dropped if an earlier keyword took the case or ``quota`` free ones stand
    ahead for sure. The first open pair can always be settled, and after the first round a
    frequent keyword has little more than ``quota`` pairs left, whatever share of the rows
    it had. Null case ids and null keywords take no part; rows of one case_id are one case.
    """
    pairs = keyword_rows(cases).where("case_id is not null and keyword is not null").distinct()
    rows = stage(pairs.select("case_id", "keyword", uniform("quota-walk", "keyword", "case_id").alias("u"),
                              F.lit(False).alias("taken")), "quota-walk")
    earlier = W.partitionBy("case_id").orderBy("keyword").rowsBetween(W.unboundedPreceding, -1)
    while not rows.where("not taken").isEmpty():
        seen = rows.withColumns({"free": F.count(F.lit(1)).over(earlier) == 0,
                                 "gone": F.coalesce(F.bool_or("taken").over(earlier), F.lit(False))}).where("not gone")
        counted = counts_ahead(seen, "keyword", ["u", "case_id"], F.floor(F.col("u") * 256), sure=F.col("free"), maybe=F.lit(1))
        rows = stage(counted.where(F.col("taken") | (F.col("sure") < quota)).select(
            "case_id", "keyword", "u", (F.col("taken") | (F.col("free") & (F.col("maybe") < quota))).alias("taken")), "quota-walk")
    return rows.select("case_id", "keyword")


def rare_keyword_weight(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean inverse keyword frequency per case; 1/n for a case without keywords."""
    n = cases.agg(F.count(F.lit(1))).scalar()
    rows = cases.select("case_id", F.explode_outer(F.array_distinct("keywords")).alias("keyword"))
    weighted = rows.join(small_side(counts), "keyword", "left")
    return weighted.groupBy("case_id").agg(F.avg(1.0 / F.col("cnt")).alias("w")).select(
        "case_id", F.coalesce("w", 1.0 / n).alias("weight"))


def weighted_pick(weights: DataFrame, k: int) -> DataFrame:
    """k cases without replacement, in proportion to weight (exponential keys): one pass
    and a top-k, no sequential draws."""
    key = -F.log(F.greatest(uniform("fill", "case_id"), F.lit(1e-12))) / F.col("weight")
    return weights.withColumn("_key", key).orderBy("_key", "case_id").limit(k).drop("_key")


def inverse_freq_fill(cases: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """k cases, those with rare keywords preferred."""
    known = counts if counts is not None else keyword_counts(cases)
    return weighted_pick(rare_keyword_weight(cases, known), k)


def smart_sample(cases: DataFrame, target: int = 3500, quota: int = 20) -> DataFrame:
    """The keyword quotas, filled up to ``target`` cases by inverse frequency."""
    chosen = stage(quota_sample(cases, quota), "quota")
    missing = max(0, target - chosen.count())
    rest = cases.join(small_side(chosen), "case_id", "left_anti")
    n_rest_weight = inverse_freq_fill(rest, missing, keyword_counts(cases)).select("case_id")
    return chosen.withColumn("phase", F.lit("quota")).unionByName(
        n_rest_weight.withColumn("phase", F.lit("fill")))


def keyword_coverage(cases: DataFrame, sample: DataFrame, minimum: int = 10) -> DataFrame:
    """Cases per keyword before and after sampling, and whether the minimum is missed."""
    short = keyword_counts(cases.join(small_side(sample.select("case_id")), "case_id", "left_semi"))
    both = keyword_counts(cases).withColumnRenamed("cnt", "count_full").join(
        short.withColumnRenamed("cnt", "count_short"), "keyword", "full_outer")
    count_short = F.coalesce("count_short", F.lit(0))
    return both.select("keyword", F.coalesce("count_full", F.lit(0)).alias("count_full"),
                       count_short.alias("count_short"), (count_short < minimum).alias("below_min"))


# ---- shortlisting ----------------------------------------------------------------------

def _ordered_sum(values: Column) -> Column:
    """Sum in ascending order, so that it does not depend on how rows arrive."""
    return F.aggregate(F.sort_array(values), F.lit(0.0), lambda a, v: a + v)


def rarity(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum of inverse tag counts per case."""
    inverse = labels.join(small_side(counts), "tag").select("case_id", (1.0 / F.col("cnt")).alias("v"))
    return inverse.groupBy("case_id").agg(_ordered_sum(F.collect_list("v")).alias("rarity"))


def rarity_rank(labels: DataFrame, counts: DataFrame) -> DataFrame:
    return rarity(labels, counts).orderBy(F.desc("rarity"), "case_id")


def shortlist_min(labels: DataFrame, target_min: int) -> DataFrame:
    """Cases a greedy pass over the rarest-first list takes until every tag is covered.

    The pass keeps a case while one of its tags has been met fewer than ``target_min``
    times; up to that point all earlier cases with the tag were kept, so the coverage is
    the case's rank within the tag. That makes the pass a top-k per tag.
    """
    inverse = labels.join(small_side(tag_counts(labels)), "tag").withColumn("v", 1.0 / F.col("cnt"))
    score = _ordered_sum(F.collect_list("v").over(W.partitionBy("case_id")))
    order = [F.desc("rarity"), F.col("case_id")]
    scored = inverse.select("case_id", "tag", score.alias("rarity"))
    ranked = top_per_key(scored, ["tag"], order, target_min, "case_id")
    return ranked.select("case_id").distinct()


def shortlist_cap(labels: DataFrame, target_max: int) -> DataFrame:
    """Drop cases all of whose tags exceed ``target_max``; the remaining labels.

    Works in rounds: of the cases whose tags are all over the maximum, those whose rank
    lies within the excess of each of their tags go. No tag falls below the maximum, and
    the loop ends when nothing is left to drop. Each round drops at least the first
    candidate, and reads a table written by the round before.
    """
    current = stage(labels, "shortlist")
    while True:
        excess = tag_counts(current).select("tag", (F.col("cnt") - target_max).alias("excess")).filter(
            F.col("excess") > 0)
        marked = current.join(small_side(excess), "tag", "left")
        all_over = F.count_if(F.col("excess").isNull()).over(W.partitionBy("case_id")) == 0
        candidates = marked.withColumn("_all", all_over).filter("_all").drop("_all")
        ranked = exact_rank(candidates, "tag", uniform("cap", "case_id"), "case_id", "rk")
        drops = ranked.groupBy("case_id").agg(F.bool_and(F.col("rk") <= F.col("excess")).alias("go")).filter(
            "go").select("case_id")
        drops = stage(drops, "drops")
        if drops.isEmpty():
            return current
        current = stage(current.join(drops, "case_id", "left_anti"), "shortlist")


#: Cases of a part that one task walks, and parts at most.
PART_CASES, MAX_PARTS = 1 << 15, 4096


def cap_walk(labels: DataFrame, target_max: int, target_min: int = 0, part_cases: int = PART_CASES) -> DataFrame:
    """The case ids a walk in ascending case_id drops to bring tags down to ``target_max``.

    A case is dropped if at its turn all its tags are met more than ``target_max`` times and
    stay at ``target_min`` without it. Cases are cut into parts, ranges of about
    ``part_cases`` ids, and every part is walked at once, with bounds on what the parts ahead
    drop (see ``_walk_part``). Each round tells the next one how many cases a part drops for
    sure and how many are open, per tag. The first part with open cases is settled whole in
    a round, so there are no more rounds than parts; settled parts are not read again.
    Rows without case_id or tag take no part; repeated labels count once.
    """
    limit = max(target_max, target_min)
    cases = labels.where("case_id is not null and tag is not null").groupBy("case_id").agg(F.collect_set("tag").alias("tags"))
    cases = stage(cases, "cap-cases")
    marked = cases.select("case_id", F.explode("tags").alias("tag"))
    # Tags go by number, whatever they are written as.
    excess = stage(tag_counts(marked).select("tag", (F.col("cnt") - limit).alias("excess"), F.monotonically_increasing_id().alias("id")), "cap-tags")
    rows = marked.join(small_side(excess), "tag").groupBy("case_id").agg(F.collect_list("id").alias("ids"), F.min("excess").alias("least"))
    rows = stage(rows.where("least > 0").select("case_id", "ids"), "cap-walk")
    parts = min(MAX_PARTS, rows.count() // part_cases)
    part = even_parts(rows, "case_id", parts) if parts > 1 else F.lit(0)
    rows = rows.select(part.cast("int").alias("part"), "case_id", "ids", F.lit(False).alias("gone"))
    sums, settled, left = stage(_tag_sums(rows), "cap-sums"), [], None
    while True:
        bounds = _tag_bounds(sums, excess)
        if left is not None:
            rows, bounds = rows.where(F.col("part").isin(left)), bounds.where(F.col("part").isin(left))
        rows = stage(rows.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_walk_part, rows.schema), "cap-walk")
        before, left = left, [r["part"] for r in rows.where("not gone").select("part").distinct().collect()]  # MAX_PARTS at most
        settled.append(rows.where(~F.col("part").isin(left)).select("case_id"))
        if not left:
            return reduce(DataFrame.union, settled)
        counted = _tag_sums(rows)
        if before is not None:  # what settled parts drop still counts
            counted = counted.unionByName(sums.where(~F.col("part").isin(before)))
        sums = stage(counted, "cap-sums")


def _tag_sums(rows: DataFrame) -> DataFrame:
    """Per part and tag, the cases that go for sure and the open ones."""
    return rows.select("part", "gone", F.explode("ids").alias("id")).groupBy("part", "id").agg(
        F.count_if("gone").alias("dropped"), F.count_if(~F.col("gone")).alias("open"))


def _tag_bounds(sums: DataFrame, excess: DataFrame) -> DataFrame:
    """Per part and tag, how often a case could still be dropped at the start of the part: at least ``low``, at most ``high``."""
    ahead = W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    counted = sums.withColumns({"_dropped": before("dropped"), "_open": before("open")}).join(excess.select("id", "excess"), "id")
    high = F.col("excess") - F.col("_dropped")
    return counted.select("part", "id", (high - F.col("_open")).alias("low"), high.alias("high"))


def _walk_part(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    """The cases of a part that are dropped for sure, or open; those that stay for sure are left out.

    The walk keeps both bounds: a case goes if all its tags can be dropped from even if all
    open cases ahead went, and stays if one cannot though none of them went.
    """
    rows = rows.combine_chunks().sort_by("case_id")
    if not rows.num_rows:
        return rows
    order = np.argsort(bounds["id"].to_numpy())
    known = bounds["id"].to_numpy()[order]
    low, high = bounds["low"].to_numpy()[order].copy(), bounds["high"].to_numpy()[order].copy()
    lists = rows["ids"].combine_chunks()
    ids = np.searchsorted(known, lists.flatten().to_numpy(zero_copy_only=False))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    gone = rows["gone"].to_numpy().copy()
    kept = np.ones(len(gone), bool)
    at = 0
    for i, end in enumerate(ends.tolist()):
        own = ids[at:end]
        at = end
        if gone[i] or low[own].min() > 0:
            gone[i] = True
            high[own] -= 1
        elif high[own].min() <= 0:
            kept[i] = False
            continue
        low[own] -= 1
    return rows.set_column(rows.schema.get_field_index("gone"), "gone", pa.array(gone)).filter(pa.array(kept))


def shortlist_balanced(labels: DataFrame, target_min: int, target_max: int) -> DataFrame:
    """The labels of the cases that both passes of the shortlist leave: cover, then cap."""
    labels = stage(labels, "shortlist")
    chosen = stage(labels.join(shortlist_min(labels, target_min), "case_id", "left_semi"), "shortlist")
    return chosen.join(cap_walk(chosen, target_max, target_min), "case_id", "left_anti")


def shortlist_coverage(labels: DataFrame, target_min: int) -> DataFrame:
    """Fewest, most and mean cases per tag, and the tags under the target."""
    return tag_counts(labels).agg(
        F.min("cnt").alias("min_cases"), F.max("cnt").alias("max_cases"),
        F.floor(F.avg("cnt")).alias("mean_cases"), F.count_if(F.col("cnt") < target_min).alias("tags_under"))


# ---- splitting and rebalancing -----------------------------------------------------------

def split_80_10_10(cases: DataFrame) -> DataFrame:
    """train / val / test by a hash of the key: stable under any repartitioning."""
    u = uniform("split", "case_id")
    return cases.withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def perturb(text: Column, key: str) -> Column:
    """One random edit: swap two neighbours, drop an inner word, or repeat six words.

    Texts under six words, and drops on eight words or fewer, stay as they are.
    """
    words = words_of(text)
    n = F.size(words)
    op = pick(uniform("augment-op", key), 3)
    at = uniform("augment-at", key)
    i = pick(at, n - 1) + 1
    swapped = F.concat(F.slice(words, 1, i - 1), F.array(F.get(words, i), F.get(words, i - 1)),
                       F.slice(words, i + 2, n))
    j = pick(at, n - 2) + 2
    dropped = F.when(n > 8, F.concat(F.slice(words, 1, j - 1), F.slice(words, j + 1, n))).otherwise(words)
    repeated = F.concat(words, F.slice(words, F.floor(n / 2).cast("int") + 1, F.lit(6)))
    edited = F.when(op == 0, swapped).when(op == 1, dropped).otherwise(repeated)
    return F.when(n < 6, text).otherwise(F.array_join(edited, " "))


def rare_tags(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.filter(F.col("cnt") < threshold).select("tag")


def _tag_array(tags: DataFrame) -> Column:
    """A tag list as a scalar: a subquery row no larger than the vocabulary."""
    return F.coalesce(tags.agg(F.collect_list("tag")).scalar(), F.array().cast("array<string>"))


def augment_rare(train: DataFrame, threshold: int, text: str = "summary") -> DataFrame:
    """Add one perturbed copy of every case that carries a rare tag."""
    rare = _tag_array(rare_tags(tag_counts(binarize_labels(train)), threshold))
    copies = train.withColumn("_rare", rare).filter(F.arrays_overlap("tags", "_rare")).drop("_rare")
    copies = copies.withColumn(text, perturb(F.col(text), "case_id"))
    return train.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))


def undersample_dominant(train: DataFrame, dominant_freq: float = 0.5) -> DataFrame:
    """Drop about half of the cases that carry dominant tags only."""
    n = train.agg(F.count(F.lit(1))).scalar()
    counts = tag_counts(binarize_labels(train))
    dominant = _tag_array(counts.withColumn("n", n).filter(F.col("cnt") / F.col("n") > dominant_freq))
    only = F.size(F.array_except("tags", "_dom")) == 0
    return train.withColumn("_dom", dominant).filter(
        ~only | (uniform("undersample", "case_id") < 0.5)).drop("_dom")


def inverse_freq_weights(cases: DataFrame, weight: str | None = None) -> DataFrame:
    """Sampling weight per case from its tags' counts, times a given weight if any."""
    given = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    labels = cases.select("case_id", given.alias("g"), F.explode(F.array_distinct("tags")).alias("tag"))
    parts = labels.join(small_side(tag_counts(labels)), "tag").select(
        "case_id", "g", (1.0 / (F.col("cnt") + 1e-6)).alias("v"))
    sums = parts.groupBy("case_id").agg(F.max("g").alias("g"), _ordered_sum(F.collect_list("v")).alias("s"))
    return sums.select("case_id", (F.col("g") * (F.col("s") + (1e-6 if weight else 0.0))).alias("weight"))


BLOCKS, FAN = 1024, 32


STEPS, RANGE = float(1 << 40), float(1 << 52)


def weighted_resample(weights: DataFrame, n: int | None = None) -> DataFrame:
    """How often each case is drawn in n draws with replacement, in proportion to weight.

    Weights become integers, so positions do not depend on the order of additions: steps of
    the largest weight / 2^40, then their share of 2^52 positions, whatever the weights'
    unit. A weight below a step counts as one step; a null one or one of zero or less, too. Cases
    are hashed into blocks; a draw finds its block in the list of block offsets and its
    case by a forward fill inside the block. A block that a heavy case makes popular is
    cut into as many parts as its share of the weight asks for, each with a copy of the
    block's cases: in all at most two copies per case, and no part gets more than its
    share of the draws.
    """
    spark = weights.sparkSession
    most = weights.agg(F.max("weight")).first()[0]
    share = F.floor(F.col("weight") / F.lit(most) * STEPS) if most and most > 0 else F.lit(1.0)
    steps = weights.select("case_id", F.greatest(share, F.lit(1.0)).cast("double").alias("steps"),
                           pick(uniform("block", "case_id"), BLOCKS).alias("block"))
    steps = stage(steps, "resample")
    whole = steps.agg(F.sum(F.col("steps").cast("decimal(38,0)"))).first()[0] or 1
    items = steps.select("case_id", "block", F.greatest(F.floor(F.col("steps") * (RANGE / float(whole))), F.lit(1)).cast("bigint").alias("q"))
    mass = {r["block"]: (r["m"], r["c"]) for r in
            items.groupBy("block").agg(F.sum("q").alias("m"), F.count(F.lit(1)).alias("c")).collect()}
    offsets, parts, total = [], [], 0
    for b in range(BLOCKS):
        offsets.append(total)
        total += mass.get(b, (0, 0))[0]
    parts = [1 + (mass.get(b, (0, 0))[0] * BLOCKS) // max(total, 1) for b in range(BLOCKS)]
    draws_n = n if n is not None else sum(c for _, c in mass.values())

    def constant(values: list[int]) -> Column:
        return F.from_json(F.lit(json.dumps(values)), "array<bigint>")

    x = F.col("x")
    coarse = F.size(F.filter(constant(offsets[::FAN]), lambda o: o <= x)) - 1
    fine = F.size(F.filter(F.slice(constant(offsets), F.col("_c") * FAN + 1, FAN), lambda o: o <= x))
    draws = (
        spark.range(draws_n)
        .withColumn("x", F.floor(uniform("draw", "id") * float(total)))
        .withColumn("_c", coarse).withColumn("block", F.col("_c") * FAN + fine - 1)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.get(constant(parts), F.col("block")))))
    start = F.sum("q").over(W.partitionBy("block").orderBy("case_id")) - F.col("q")
    placed = items.withColumn("x", start + F.get(constant(offsets), F.col("block"))).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.get(constant(parts), F.col("block")) - 1)))
    both = placed.select("block", "part", "x", F.lit(0).alias("kind"), "case_id").unionByName(
        draws.select("block", "part", "x", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("case_id")))
    fill = W.partitionBy("block", "part").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0)
    hits = both.withColumn("hit", F.last("case_id", ignorenulls=True).over(fill)).filter(F.col("kind") == 1)
    return hits.groupBy(F.col("hit").alias("case_id")).agg(F.count(F.lit(1)).alias("copies"))

"""Out-of-fold label probabilities for all tags in one job.

A multinomial naive-Bayes probe: counts per (fold, term, tag) are taken once, and the
counts a fold may learn from are the totals minus its own. No model is refitted, no job
is started per tag, and no negative example is materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import pick, uniform
from ..plans.bounded import string_array
from ..plans.storage import stage
from .features import spread_by_case

FOLDS = 5
MIN_POSITIVES = 5
SHARPNESS = 4.0
CLIP = 1e-6
MAX_MODEL_BYTES = 256 << 20


def with_fold(cases: DataFrame, folds: int = FOLDS) -> DataFrame:
    return cases.withColumn("fold", pick(uniform("fold", "case_id"), folds))


def safe_folds(counts: DataFrame, n_cases: int, folds: int = FOLDS) -> DataFrame:
    """Folds each tag can support, and whether it has too few positives to be probed."""
    n_neg = F.lit(n_cases) - F.col("cnt")
    return counts.select(
        "tag", F.col("cnt").alias("n_pos"), n_neg.alias("n_neg"),
        F.greatest(F.lit(2), F.least(F.lit(folds), F.col("cnt"), n_neg)).cast("bigint").alias("folds"),
        (F.col("cnt") < MIN_POSITIVES).alias("skipped"))


def _per_fold(value: str, folds: int) -> Column:
    return F.array(*[F.sum(F.when(F.col("fold") == f, F.col(value)).otherwise(0)) for f in range(folds)])


def _without_own(counts: DataFrame, keys: list[str], folds: int, name: str) -> DataFrame:
    """Per key and fold, the count over all other folds."""
    arrays = counts.groupBy(*keys).agg(_per_fold("c", folds).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return arrays.select(*keys, total.alias("_t"), F.posexplode("a").alias("fold", "_own")).select(
        "fold", *keys, (F.col("_t") - F.col("_own")).alias(name))


LENGTH, TERM = -1, 0  # pseudo tags: number of terms in the case, and the part per term


class NaiveBayesProbe:
    """Term weights per (fold, term, tag), learnt from the other folds.

    ``bags``: (case_id, fold, tags, bag). A weight splits into a part per tag (``bias``),
    a part per term and a correction that is zero unless the term met the tag, so only
    (term, tag) pairs that occur are stored. Index 0 stands for "any tag", the others
    for the vocabulary from 1.
    """

    def __init__(self, bags: DataFrame, vocab: list[str], folds: int = FOLDS):
        if vocab is None:
            raise ValueError("the vocabulary passed the bound of bounded_values; give the probe a list of tags")
        self.vocab, self.folds = vocab, folds
        known = F.filter(F.transform("tags", lambda t: F.array_position(string_array(vocab), t).cast("int")),
                         lambda i: i > 0)
        rows = bags.select("fold", F.concat(known, F.array(F.lit(TERM))).alias("idxs"), F.inline("bag"))
        counts = rows.select("fold", "term", "tf", F.explode_outer("idxs").alias("idx")).groupBy(
            "fold", "term", "idx").agg(F.sum("tf").alias("c"))
        counts = stage(counts, "probe-counts")
        n_terms = counts.filter(F.col("idx") == TERM).select("term").distinct().count()

        sizes = _without_own(counts.groupBy("fold", "idx").agg(F.sum("c").alias("c")), ["idx"], folds, "n")
        every = sizes.filter(F.col("idx") == TERM).select("fold", F.col("n").alias("all"))
        bias = F.log(F.col("all") - F.col("n") + n_terms) - F.log(F.col("n") + n_terms)
        self.bias = stage(sizes.filter(F.col("idx") > TERM).join(every, "fold").select(
            "fold", "idx", bias.alias("bias")), "probe-bias")

        others = _without_own(counts, ["term", "idx"], folds, "c").filter(
            (F.col("c") > 0) | (F.col("idx") == TERM))
        per_term = others.groupBy("fold", "term").agg(
            F.collect_list(F.struct("idx", "c")).alias("met"),
            F.max(F.when(F.col("idx") == TERM, F.col("c"))).alias("c"))
        c = F.col("c")

        def gain(m: Column) -> Column:
            value = F.log(m["c"] + 1) - F.log(c - m["c"] + 1) + F.log(c + 1)
            return F.struct(m["idx"].alias("idx"), F.when(m["idx"] == TERM, -F.log(c + 1)).otherwise(value).alias("g"))

        length = F.array(F.struct(F.lit(LENGTH).alias("idx"), F.lit(1.0).alias("g")))
        self.weights = stage(per_term.select(
            "fold", "term", F.concat(length, F.transform("met", gain)).alias("gains")), "probe-weights")

    def _passes(self) -> list[DataFrame]:
        """The weights, cut into runs of tags that each fit the broadcast bound."""
        entries = self.weights.agg(F.sum(F.size("gains"))).first()[0] or 0
        runs = max(1, -(-entries * 16 // MAX_MODEL_BYTES))
        if runs == 1:
            return [F.broadcast(self.weights)]
        step = -(-len(self.vocab) // runs)
        bounds = [(lo if lo else LENGTH - 1, lo + step) for lo in range(0, len(self.vocab), step)]

        def run(lo: int, hi: int) -> DataFrame:
            inside = F.filter("gains", lambda e: (e["idx"] > lo) & (e["idx"] <= hi))
            return F.broadcast(self.weights.withColumn("gains", inside))

        return [run(lo, hi) for lo, hi in bounds]

    def sums(self, bags: DataFrame) -> DataFrame:
        """Per case, the summed term gains by index.

        The bags are hashed by case once; the broadcast join, the sums per (case, tag)
        and their list per case all run in that partitioning.
        """
        rows = spread_by_case(bags.select("case_id", "fold", "bag")).select("case_id", "fold", F.inline("bag"))
        parts = None
        for weights in self._passes():
            hit = rows.join(weights, ["fold", "term"]).select("case_id", "tf", F.inline("gains"))
            summed = hit.groupBy("case_id", "idx").agg(F.sum(F.col("tf") * F.col("g")).alias("s"))
            parts = summed if parts is None else parts.unionByName(summed)
        return parts.groupBy("case_id").agg(
            F.map_from_entries(F.collect_list(F.struct("idx", "s"))).alias("_sum"))

    def probabilities(self, bags: DataFrame, sharpness: float = SHARPNESS) -> DataFrame:
        """Prediction table: cells of (tag, y, p), p from folds that exclude the case."""
        per_fold = F.map_from_entries(F.collect_list(F.struct("idx", "bias")))
        table = self.bias.groupBy("fold").agg(per_fold.alias("b"))
        lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("fold", "b")))).scalar()
        scored = bags.drop("bag").join(self.sums(bags), "case_id", "left").withColumn("_biases", lookup)
        scored = scored.withColumns({
            "_bias": F.try_element_at("_biases", F.col("fold")),
            "_length": F.try_element_at("_sum", F.lit(LENGTH)),
            "_base": F.try_element_at("_sum", F.lit(TERM))})

        def cell(tag: Column, at: Column) -> Column:
            idx = (at + 1).cast("int")
            gain = F.coalesce(F.try_element_at(F.col("_sum"), idx), F.lit(0.0))
            bias = F.coalesce(F.try_element_at(F.col("_bias"), idx), F.lit(0.0))
            score = F.coalesce(bias + (F.col("_base") + gain) / F.col("_length"), F.lit(0.0))
            p = 1 / (1 + F.exp(-sharpness * score))
            return F.struct(tag.alias("tag"), F.array_contains("tags", tag).cast("int").alias("y"),
                            F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP)).alias("p"))

        keep = [c for c in bags.columns if c != "bag"]
        return scored.withColumn("cells", F.transform(string_array(self.vocab), cell)).select(*keep, "cells")

    def evidence(self, rows: DataFrame) -> DataFrame:
        """One row per case: ``terms array<struct<term, w, base, met>>`` and the fold's ``biases``.

        ``rows`` is (case_id, fold, wanted array<tag index>, bag array<struct<term, w>>). The weight of a (tag, term)
        pair is bias[tag] + base + gain, where only pairs that met have a gain; ``met`` holds
        those of the wanted tags. So terms and tags are never multiplied out, and a pair
        that never met is still given its weight.
        """
        spread = spread_by_case(rows).select("case_id", "fold", "wanted", F.inline("bag"))
        parts = None
        for weights in self._passes():
            hit = spread.join(weights, ["fold", "term"])
            met = F.filter("gains", lambda e: (e["idx"] == TERM) | F.array_contains("wanted", e["idx"]))
            part = hit.select("case_id", "fold", "term", "w", met.alias("met"))
            parts = part if parts is None else parts.unionByName(part)
        whole = parts.groupBy("case_id", "fold", "term").agg(F.max("w").alias("w"), F.flatten(F.collect_list("met")).alias("met"))
        base = F.get(F.filter("met", lambda e: e["idx"] == TERM), 0)["g"]
        terms = whole.select("case_id", "fold", F.struct(
            "term", "w", base.alias("base"), F.filter("met", lambda e: e["idx"] != TERM).alias("met")).alias("t"))
        per_fold = self.bias.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("idx", "bias"))).alias("b"))
        lookup = per_fold.agg(F.map_from_entries(F.collect_list(F.struct("fold", "b")))).scalar()
        return terms.groupBy("case_id", "fold").agg(F.collect_list("t").alias("terms")).withColumn("_all", lookup).select(
            "case_id", "terms", F.try_element_at("_all", F.col("fold")).alias("biases"))


def ensemble_probabilities(probes: list[DataFrame]) -> DataFrame:
    """Mean probability per (case, tag) over several prediction tables."""
    longs = [p.select("case_id", F.inline("cells")) for p in probes]
    every = longs[0]
    for more in longs[1:]:
        every = every.unionByName(more)
    return every.groupBy("case_id", "tag").agg(F.any_value("y").alias("y"), F.avg("p").alias("p"))

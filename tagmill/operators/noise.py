"""Label noise: quality of cells and rows, issues, cleaning, and the reports on it.

Works on prediction tables (one row per case, ``cells array<struct<tag, y, p>>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.bounded import small_side, string_array
from ..plans.storage import stage
from .labels import route_tags
from .similarity import greatest_cosines

NOISE_THRESHOLD = 0.3
NOISY, VERY_NOISY = 0.7, 0.4
ALPHA = 0.8


def self_confidence(c: Column) -> Column:
    return F.when(c["y"] == 1, c["p"]).otherwise(1 - c["p"])


def cell_quality(preds: DataFrame) -> DataFrame:
    """Each cell with q, the probability of the label it carries."""
    scored = F.transform("cells", lambda c: F.struct(
        c["tag"].alias("tag"), c["y"].alias("y"), c["p"].alias("p"), self_confidence(c).alias("q")))
    return preds.withColumn("cells", scored)


def row_quality(preds: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One score per case: cell scores from best to worst, exponentially averaged, so the
    worst tags weigh most. The plain mean and the minimum stand next to it."""
    ordered = F.sort_array(F.transform("cells", self_confidence), asc=False)
    moving = F.aggregate(F.slice("_q", 2, F.size("_q")), F.get("_q", 0),
                         lambda s, q: alpha * q + (1 - alpha) * s)
    mean = F.aggregate("_q", F.lit(0.0), lambda s, q: s + q) / F.size("_q")
    return preds.withColumn("_q", ordered).withColumns({
        "quality": moving, "mean_quality": mean, "min_quality": F.array_min("_q")}).drop("_q")


def confident_thresholds(cells: DataFrame) -> DataFrame:
    """Per tag, the mean confidence of the cases labelled 1 and of those labelled 0."""
    return cells.groupBy("tag").agg(
        F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("t1"),
        F.avg(F.when(F.col("y") == 0, 1 - F.col("p"))).alias("t0"))


def label_issues(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells whose opposite class is confident while the given one is not."""
    p, y = F.col("p"), F.col("y") == 1
    wrong = (y & (1 - p >= F.col("t0")) & (p < F.col("t1"))) | (~y & (p >= F.col("t1")) & (1 - p < F.col("t0")))
    found = cells.join(small_side(thresholds), "tag").filter(wrong)
    return found.select("case_id", "tag", "y", "p", F.when(y, p).otherwise(1 - p).alias("self_confidence"))


def ranked_issues(issues: DataFrame) -> DataFrame:
    """Issues from the least to the most confident label (a range-partitioned sort)."""
    return issues.orderBy("self_confidence", "case_id", "tag")


def clean_labels(preds: DataFrame, threshold: float = NOISE_THRESHOLD,
                 exempt: list[str] | None = None) -> DataFrame:
    """Original and cleaned tags per case: a positive label of low quality is removed,
    none is ever added. Tags without a usable score can be exempt."""
    spared = string_array(exempt or [])

    def keep(c: Column) -> Column:
        return (c["y"] == 1) & ((c["p"] >= threshold) | F.array_contains(spared, c["tag"]))

    names = lambda test: F.array_sort(F.transform(F.filter("cells", test), lambda c: c["tag"]))
    return preds.withColumns({"original": names(lambda c: c["y"] == 1), "cleaned": names(keep)})


def flag_unlabeled(cleaned: DataFrame, drop: bool = False) -> DataFrame:
    """Cases that lost every label are dropped, or kept under a flag."""
    if drop:
        return cleaned.filter(F.size("cleaned") > 0)
    return cleaned.withColumn("is_unlabeled", F.size("cleaned") == 0)


def label_diff(cleaned: DataFrame) -> DataFrame:
    """Cases whose tags changed, with what was removed and added."""
    return cleaned.filter(F.col("original") != F.col("cleaned")).withColumns({
        "removed": F.array_except("original", "cleaned"), "added": F.array_except("cleaned", "original")})


def tag_noise_breakdown(cleaned: DataFrame) -> DataFrame:
    """Per tag: probe group, labels before, labels dropped and their share."""
    marks = cleaned.select(F.explode("original").alias("tag"), "cleaned").select(
        "tag", F.array_contains("cleaned", F.col("tag")).alias("kept"))
    per_tag = marks.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(~F.col("kept")).alias("labels_dropped"))
    groups = route_tags(per_tag).select("tag", "probe")
    return per_tag.join(groups, "tag").select(
        "tag", "probe", F.col("cnt").alias("original_count"), "labels_dropped",
        F.round(F.col("labels_dropped") / (F.col("cnt") + 1e-9) * 100, 1).alias("pct_dropped"))


def noisiest_tags(breakdown: DataFrame, k: int = 15) -> DataFrame:
    return breakdown.orderBy(F.desc("pct_dropped"), "tag").limit(k)


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """Labels before, after and dropped, and the number of corrected cases."""
    before, after = F.sum(F.size("original")), F.sum(F.size("cleaned"))
    return cleaned.agg(
        before.alias("labels_before"), after.alias("labels_after"), (before - after).alias("dropped"),
        F.round((before - after) / before * 100, 1).alias("pct_dropped"),
        F.count_if(F.size("original") > F.size("cleaned")).alias("cases_corrected"))


def quality_summary(scored: DataFrame, threshold: float = NOISE_THRESHOLD) -> DataFrame:
    """Spread of the row scores, and the share of cells under the noise threshold."""
    q = F.col("quality")
    low = F.size(F.filter("cells", lambda c: self_confidence(c) < threshold))
    return scored.agg(
        F.avg(q).alias("mean_quality"), F.count_if(q < NOISY).alias("noisy"),
        (F.avg((q < NOISY).cast("double")) * 100).alias("noisy_pct"),
        F.count_if(q < VERY_NOISY).alias("very_noisy"), F.min(q).alias("min_quality"),
        F.max(q).alias("max_quality"), (F.sum(low) / F.sum(F.size("cells")) * 100).alias("low_cells_pct"))


def row_level_noise_filter(scored: DataFrame, mode: str = "flag") -> DataFrame:
    """Noisy cases flagged, removed, or given a smaller weight (their quality)."""
    q = F.col("quality")
    if mode == "remove":
        return scored.filter(q >= NOISY)
    flagged = scored.withColumns({"is_noisy": q < NOISY, "is_very_noisy": q < VERY_NOISY})
    if mode == "weigh":
        return flagged.withColumn("weight", F.when(q < NOISY, q).otherwise(F.lit(1.0)))
    return flagged


def keyword_noise(scored: DataFrame, keywords: str = "keywords") -> DataFrame:
    """Mean noise, flagged share and cases per keyword."""
    rows = scored.select(F.explode(F.array_distinct(keywords)).alias("keyword"), "quality")
    return rows.groupBy("keyword").agg(
        F.avg(1 - F.col("quality")).alias("mean_noise"),
        F.avg((F.col("quality") < NOISY).cast("double")).alias("flagged_share"),
        F.count(F.lit(1)).alias("cases"))


def noise_from_quality(cases: DataFrame, quality: str = "quality") -> DataFrame:
    """noise = 1 - quality, the mean quality standing in for a missing one."""
    mean = cases.agg(F.avg(F.coalesce(quality, F.lit(0.9)))).scalar()
    filled = F.coalesce(F.col(quality), mean)
    return cases.withColumn("noise", 1 - F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0)))


def noise_proxy_tagcount(cases: DataFrame) -> DataFrame:
    """Without a quality score: how unusual the number of tags is, capped at 0.5."""
    n = F.size("tags").cast("double")
    mean, std = cases.agg(F.avg(n)).scalar(), cases.agg(F.stddev_pop(n)).scalar()
    return cases.withColumn("noise", F.least(F.abs(n - mean) / (3 * (std + 1e-6)), F.lit(0.5)))


def smooth_labels(cells: DataFrame, base_smooth: float, noise: str = "noise") -> DataFrame:
    """Soft targets: the noisier the case, the closer to one half."""
    s = F.least(F.greatest(base_smooth + F.col(noise) * 0.10, F.lit(0.01)), F.lit(0.20))
    return cells.withColumn("target", F.col("y") * (1 - s) + s * 0.5)


def _bags(features: DataFrame) -> DataFrame:
    """(case_id, terms, ws): the features of a case in one row."""
    known = features.where("term is not null and w is not null")
    bags = known.groupBy("case_id").agg(F.collect_list(F.struct("term", "w")).alias("bag"))
    return stage(bags.select("case_id", F.col("bag.term").alias("terms"), F.col("bag.w").cast("array<double>").alias("ws")), "bags")


def _positives(labels: DataFrame, bags: DataFrame) -> DataFrame:
    """(case_id, tag, terms, ws); a label given twice counts twice."""
    given = labels.where("tag is not null").groupBy("case_id", "tag").agg(F.count(F.lit(1)).alias("given"))
    return given.join(bags, "case_id").select("case_id", "tag", "terms", F.transform("ws", lambda w: w * F.col("given")).alias("ws"))


def _scaled(cells: DataFrame, spans: DataFrame, n_cases: int) -> DataFrame:
    """Cells with ``p``: the similarity between the tag's least, 0 if a case has no shared term, and its greatest."""
    spans = spans.where("n > 0").select("tag", F.when(F.col("n") < n_cases, 0.0).otherwise(F.col("lo")).alias("lo"), "hi")
    return cells.join(small_side(spans), "tag").withColumn("p", (F.col("similarity") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9))


def similarity_fallback(labels: DataFrame, features: DataFrame, n_cases: int, asked: DataFrame | None = None) -> DataFrame:
    """(case_id, tag, similarity, p) for cells that share a term with a positive of the tag; all others have p 0.

    ``labels`` (case_id, tag) of the tags to score, ``features`` unit-length (case_id, term,
    w). The greatest cosine to any positive, itself included, scaled from the tag's least to
    its greatest over all ``n_cases``. With ``asked`` (case_id, tag) only those cells are
    returned, scaled over all cases as well. No row is made for a pair of case and positive, and
    no list of tags is held. A tag whose positives have no terms is absent.
    """
    bags = _bags(features)
    if asked is None:
        rows = bags.withColumns({"copies": F.lit(1).cast("long"), "asked": F.lit(None).cast("array<string>")})
    else:
        wanted = asked.groupBy("case_id").agg(F.collect_set("tag").alias("asked"))
        rows = bags.join(wanted, "case_id", "left").withColumn("copies", F.when(F.col("asked").isNotNull(), 1).cast("long"))
    cells, spans = greatest_cosines(rows, _positives(labels, bags))
    return _scaled(cells.where("similarity is not null"), spans, n_cases).select("case_id", "tag", "similarity", "p")


def max_similarity_to_positives(cases: DataFrame, features: DataFrame, tags: DataFrame) -> DataFrame:
    """Stand-in probability for tags too rare to probe: (case_id, tag, similarity, p), every case with every tag.

    ``tags`` is a table with a column tag, of any size. A case that shares no term with a
    positive has similarity 0; ``similarity_fallback`` gives the other cells alone.
    """
    wanted = tags.select("tag").distinct()
    labels = cases.select("case_id", F.explode(F.array_distinct("tags")).alias("tag")).join(small_side(wanted), "tag", "left_semi")
    bags = _bags(features)
    copies = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = copies.join(bags, "case_id", "full_outer").withColumn("asked", F.lit(None).cast("array<string>"))
    cells, spans = greatest_cosines(rows, _positives(labels, bags))
    zero = F.lit(0.0)
    near = _scaled(cells, spans, cases.count())
    if not copies.where("copies > 1").isEmpty():
        near = near.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    near = near.select("case_id", "tag", F.coalesce("similarity", zero).alias("similarity"), F.coalesce("p", zero).alias("p"))
    mute = wanted.join(small_side(spans.where("n > 0").select("tag")), "tag", "left_anti")
    rest = cases.select("case_id").crossJoin(small_side(mute)).select("case_id", "tag", zero.alias("similarity"), zero.alias("p"))
    return near.unionByName(rest)


def mismatch_tokens(preds: DataFrame, features: DataFrame, probe, k: int = 8) -> DataFrame:
    """The k tokens that speak most for each missed or falsely raised tag.

    Contribution = TF-IDF x |weight of (tag, term)|, as a share of the case's total over all
    its terms, whether or not a term ever met the tag. ``preds`` carries ``fold`` and judged
    cells; ``features`` (case_id, term, w); ``probe`` learnt the weights. Contributions that
    agree to nine digits go by the term. Cells, terms and weights meet inside the row of a
    case: nothing larger than its bag and its wrong cells is made. A case without features
    or without wrong cells has no rows.
    """
    wrong = F.transform(F.filter("cells", lambda c: c["y"] != c["pred"]), lambda c: F.struct(
        c["tag"].alias("tag"), c["y"].alias("y"), c["p"].alias("p"), F.array_position(string_array(probe.vocab), c["tag"]).cast("int").alias("idx")))
    cells = preds.select("case_id", "fold", wrong.alias("wrong")).where(F.size("wrong") > 0)
    bags = features.groupBy("case_id").agg(F.collect_list(F.struct("term", "w")).alias("bag"))
    asked = stage(cells.withColumn("wanted", F.col("wrong.idx")).join(bags, "case_id"), "mismatches")
    rows = probe.evidence(asked.select("case_id", "fold", "wanted", "bag")).join(asked.select("case_id", "wrong"), "case_id")

    def share(c: Column) -> Column:
        def weight(t: Column) -> Column:
            gain = F.coalesce(F.get(F.filter(t["met"], lambda e: e["idx"] == c["idx"]), 0)["g"], F.lit(0.0))
            v = t["w"] * F.abs(F.coalesce(F.try_element_at("biases", c["idx"]), F.lit(0.0)) + t["base"] + gain)
            return F.struct((-F.round(v, 9)).alias("key"), t["term"].alias("term"), v.alias("v"))
        return F.struct(c["tag"].alias("tag"), c["y"].alias("y"), c["p"].alias("p"), F.array_sort(F.transform("terms", weight)).alias("by"))

    told = rows.select("case_id", F.explode(F.transform("wrong", share)).alias("c")).select("case_id", "c.*")
    total = F.aggregate("by", F.lit(0.0), lambda s, e: s + e["v"])
    best = told.withColumn("total", total).select("case_id", "tag", "y", "p", "total", F.posexplode(F.slice("by", 1, k)).alias("at", "e"))
    return best.select("case_id", "tag", F.when(F.col("y") == 1, "MISSED").otherwise("FALSE ALARM").alias("direction"),
                       F.round(F.col("p") * 100, 1).alias("conf_pct"), (F.col("at") + 1).cast("bigint").alias("rank"),
                       F.col("e.term").alias("term"), (F.col("e.v") / F.col("total") * 100).alias("share_pct"))


def mismatch_token_freq(tokens: DataFrame, k: int = 20) -> DataFrame:
    """How often a token is among those behind a mismatch."""
    bare = F.btrim(F.lower("term"), F.lit(".,!?#"))
    return tokens.select(bare.alias("token")).filter(F.length("token") > 2).groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "token").limit(k)

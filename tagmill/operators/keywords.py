"""Keywords: matching typed ones to a master list, checking them against vectors and tone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fuzzy import indel_ratio, token_sort
from ..functions.text import normalize_keyword, tokens
from ..functions.vectors import cosine
from ..plans.bounded import small_side

# Verdict thresholds, weights and wording of the audit log.
KEEP_FROM, REVIEW_FROM = 0.50, 0.40
DESC_WEIGHT, EXAMPLE_WEIGHT = 0.4, 0.6
STRONG = "Strong match — desc_sim=%.3f, example_sim=%.3f"
BORDERLINE = "Borderline match — desc_sim=%.3f, example_sim=%.3f. Human review recommended."
LOW = "Low similarity — desc_sim=%.3f, example_sim=%.3f. Complaint text does not match this keyword."
UNKNOWN = "Keyword not in master list — check normalization"
POSITIVE_ABOVE, NEGATIVE_BELOW = 0.05, -0.05


def keywords_not_in_master(cases: DataFrame, master: DataFrame) -> DataFrame:
    """(case_id, keyword) for keywords the master list does not know."""
    rows = cases.select("case_id", F.explode(F.array_distinct("keywords")).alias("keyword"))
    known = small_side(master.select(F.col("canonical_keyword").alias("keyword")).distinct())
    return rows.join(known, "keyword", "left_anti").withColumn("verdict", F.lit("REVIEW"))


# ---- fuzzy matching ----------------------------------------------------------------------

def _pieces(text: Column, parts: Column) -> Column:
    """``text`` cut into ``parts`` runs of nearly equal length, with their positions."""
    n = F.length(text)

    def piece(i: Column) -> Column:
        lo, hi = F.floor(i * n / parts).cast("int"), F.floor((i + 1) * n / parts).cast("int")
        return F.struct(F.substring(text, lo + 1, hi - lo).alias("gram"), lo.alias("at"))

    return F.transform(F.sequence(F.lit(0), parts - 1), piece)


def _substrings(text: Column, longest: int) -> Column:
    """Every substring of up to ``longest`` characters, with its position."""
    n = F.length(text)

    def run(size: int) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(
            F.substring(text, i + 1, F.lit(size)).alias("gram"), i.alias("at")))
        return F.when(n >= size, cuts)

    runs = [run(size) for size in range(1, longest + 1)]
    return F.flatten(F.array_compact(F.array(*runs)))


def fuzzy_candidates(raws: DataFrame, masters: DataFrame, threshold: float) -> DataFrame:
    """Pairs that can reach the threshold, by an equi-join on text pieces.

    A score of ``threshold`` allows k insertions and deletions, k in proportion to the
    lengths. Cut into k + 1 pieces, a master keyword keeps at least one piece intact in
    any string that close, shifted by at most k. So joining pieces on equality loses no
    pair, and the list is never crossed with the other.
    """
    if threshold >= 100:  # no edit at all
        return raws.select("r").join(masters.select("m"), F.col("r") == F.col("m"))
    t = threshold / 100
    per_char = (1 - t) * 2 / t
    longest = math.ceil(1 / per_char)
    most = F.floor(F.length("m") * per_char + 1e-9).cast("int")
    m = masters.select("m", most.alias("k")).select(
        "m", "k", F.inline(_pieces(F.col("m"), F.col("k") + 1)).alias("gram", "m_at"))
    r = raws.select("r", F.inline(_substrings(F.col("r"), longest)).alias("gram", "r_at"))
    total = F.length("r") + F.length("m")
    allowed = F.floor(total * (1 - t) + 1e-9).cast("int")
    near = (F.abs(F.col("r_at") - F.col("m_at")) <= F.col("k")) & (
        F.abs(F.length("r") - F.length("m")) <= allowed)
    pairs = r.join(small_side(m), "gram").filter(near).select("r", "m").distinct().withColumn("allowed", allowed)
    return pairs.filter(F.expr("levenshtein(r, m, allowed) >= 0")).select("r", "m")


def fuzzy_match_keywords(raw: DataFrame, master: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Best master keyword per raw keyword: (keyword, matched, score), NULL without one.

    ``raw``: (keyword), ``master``: (canonical_keyword, ord). Every distinct spelling is
    scored once; equal scores go to the keyword that comes first in the master list.
    """
    spelled = raw.select("keyword").distinct().withColumn("r", token_sort(normalize_keyword(F.col("keyword"))))
    listed = master.withColumn("m", token_sort(normalize_keyword(F.col("canonical_keyword"))))
    first = listed.groupBy("m").agg(F.min(F.struct("ord", "canonical_keyword")).alias("best"))
    pairs = fuzzy_candidates(
        spelled.select("r").filter(F.length("r") > 0).distinct(),
        first.select("m").filter(F.length("m") > 0), threshold)
    scored = pairs.withColumn("score", indel_ratio("r", "m")).filter(F.col("score") >= threshold)
    best = scored.join(first, "m").groupBy("r").agg(
        F.max(F.struct("score", (-F.col("best.ord")).alias("k"), F.col("best.canonical_keyword").alias("name"))).alias("b"))
    return spelled.join(best, "r", "left").select(
        "keyword", F.col("b.name").alias("matched"), F.col("b.score").alias("score"))


def replace_keywords(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(case_id, keyword) rows with the master keyword they stand for."""
    return rows.join(small_side(matches), "keyword", "left")


def unmatched_keywords(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Keywords without an accepted match, with their number of occurrences; counting
    comes first, so the join sees each spelling once."""
    counted = rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.join(matches.filter(F.col("matched").isNotNull()), "keyword", "left_anti")


# ---- tone ----------------------------------------------------------------------------------

def lexicon_sentiment(cases: DataFrame, lexicon: DataFrame, text: str = "summary") -> DataFrame:
    """Tone of each text: s = sum of word valences, compound = s / sqrt(s^2 + 15).

    A text's words are summed where they are read; one row per case is shuffled.
    """
    words = cases.select("case_id", F.explode_outer(tokens(F.col(text))).alias("word"))
    total = F.sum(F.coalesce("valence", F.lit(0.0)))
    sums = words.join(small_side(lexicon), "word", "left").groupBy("case_id").agg(total.alias("s"))
    compound = F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)
    return sums.select("case_id", compound.alias("compound"), F.when(
        compound > POSITIVE_ABOVE, "positive").when(compound < NEGATIVE_BELOW, "negative")
        .otherwise("neutral").alias("polarity"))


def sentiment_conflicts(cases: DataFrame, sentiment: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases with tags whose expected tone, unless neutral, is not that of the text."""
    rows = cases.join(sentiment.select("case_id", "polarity"), "case_id").select(
        "case_id", "polarity", F.explode("tags").alias("tag"))
    against = rows.join(small_side(expected), "tag").filter(
        (F.col("expected") != "neutral") & (F.col("expected") != F.col("polarity")))
    return against.groupBy("case_id").agg(F.sort_array(F.collect_list(
        F.struct("tag", "expected", F.col("polarity").alias("actual")))).alias("conflicts"))


# ---- vectors -------------------------------------------------------------------------------

def keyword_centroids(examples: DataFrame) -> DataFrame:
    """Mean vector per keyword: positions are averaged in parallel, then put in order."""
    entries = examples.select("keyword", F.posexplode("vector").alias("pos", "v"))
    means = entries.groupBy("keyword", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("keyword").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("example_vec"))


def validate_keywords(cases: DataFrame, master: DataFrame) -> DataFrame:
    """Verdict, similarities and reason for every (case, keyword).

    ``cases``: (case_id, vector, keywords); ``master``: (keyword, desc_vec, example_vec).
    """
    rows = cases.select("case_id", "vector", F.explode(F.array_distinct("keywords")).alias("keyword"))
    both = rows.join(small_side(master), "keyword", "left")
    sims = both.select("case_id", "keyword",
                       F.when(F.col("desc_vec").isNotNull(), cosine(F.col("vector"), F.col("desc_vec"))).alias("d"),
                       F.when(F.col("desc_vec").isNotNull(), cosine(F.col("vector"), F.col("example_vec"))).alias("e"))
    combined = sims.withColumn("c", DESC_WEIGHT * F.col("d") + EXAMPLE_WEIGHT * F.col("e"))
    c = F.col("c")

    def said(pattern: str) -> Column:
        return F.format_string(pattern, F.col("d"), F.col("e"))

    return combined.select(
        "case_id", "keyword",
        F.when(c >= KEEP_FROM, "KEEP").when(c >= REVIEW_FROM, "REVIEW").when(c.isNull(), "REVIEW")
        .otherwise("REMOVE").alias("verdict"),
        F.round("d", 4).alias("desc_sim"), F.round("e", 4).alias("example_sim"), F.round("c", 4).alias("combined"),
        F.when(c.isNull(), F.lit(UNKNOWN)).when(c >= KEEP_FROM, said(STRONG))
        .when(c >= REVIEW_FROM, said(BORDERLINE)).otherwise(said(LOW)).alias("reason"))


def verdict_summary(audit: DataFrame, cases: DataFrame) -> DataFrame:
    """Keyword decisions per verdict, and cases with and without a verified keyword.

    ``cases`` is the whole case table; a case without keywords has no verified one.
    """
    verdicts = audit.groupBy("verdict").agg(F.count(F.lit(1)).alias("cnt"))
    kept = audit.filter(F.col("verdict") == "KEEP").select("case_id", F.lit(True).alias("any")).distinct()
    found = cases.select("case_id").distinct().join(kept, "case_id", "left")
    totals = found.groupBy(F.when(F.col("any"), "cases with verified").otherwise("cases without verified").alias(
        "verdict")).agg(F.count(F.lit(1)).alias("cnt"))
    return verdicts.unionByName(totals)


def keyword_outcomes(cases: DataFrame, audit: DataFrame) -> DataFrame:
    """Per case its ``verified``, ``removed`` and ``review`` keywords, in order; empty lists for a case without any."""
    def listed(verdict: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("verdict") == verdict, F.col("keyword"))))

    lists = audit.groupBy("case_id").agg(listed("KEEP").alias("verified"), listed("REMOVE").alias("removed"), listed("REVIEW").alias("review"))
    none = F.array().cast("array<string>")
    return cases.join(lists, "case_id", "left").withColumns({c: F.coalesce(c, none) for c in ("verified", "removed", "review")})


def validated_cases(cases: DataFrame, audit: DataFrame) -> DataFrame:
    """Cases with at least one verified keyword, and those keywords."""
    kept = audit.filter(F.col("verdict") == "KEEP").groupBy("case_id").agg(
        F.array_sort(F.collect_list("keyword")).alias("final_keywords"))
    return cases.join(kept, "case_id")


def review_queue_by_similarity(audit: DataFrame) -> DataFrame:
    """REVIEW decisions, least similar first, unknown keywords last."""
    return audit.filter(F.col("verdict") == "REVIEW").orderBy(F.asc_nulls_last("combined"), "case_id", "keyword")

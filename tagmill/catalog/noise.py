"""Queries on text features, out-of-fold probabilities and label noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import build_input_text, build_probe_text, tokens
from ..operators import cleaning as Q, evaluate as E, features as X, labels as L, noise as N, probe as P
from ..plans.bounded import bounded_values, string_array
from ..plans.storage import stage
from ..sources import views
from . import inputs as I
from .registry import query
from .sql import cte, sql, u


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- texts -------------------------------------------------------------------------------
cte("noisy_docs", f"""
SELECT * REPLACE (CASE WHEN {u('flip', 'case_id')} < 0.05 THEN list_sort(list_transform(tags, lambda t:
  CASE WHEN t = 'lang:en' THEN 'lang:fr' WHEN starts_with(t, 'lang:') THEN 'lang:en' ELSE t END)) ELSE tags END AS tags),
  {u('flip', 'case_id')} < 0.05 AS is_flipped, floor({u('fold', 'case_id')} * 5)::INT AS fold,
  trim(service) || ' | ' || array_to_string(keywords, ', ') || ' | ' || trim(summary) AS probe_text
FROM doc_cases""")
cte("noisy_labels", "SELECT case_id, fold, unnest(tags) AS tag FROM noisy_docs")
cte("noisy_cnt", "SELECT tag, count(*) AS cnt FROM noisy_labels GROUP BY tag")
cte("doc_tokens", "SELECT case_id, fold, regexp_extract_all(lower(probe_text), '[\\p{L}\\p{N}_]{2,}') AS w FROM noisy_docs")


def _term_ctes(prefix: str, terms: str) -> None:
    cte(f"{prefix}_terms", f"SELECT case_id, fold, unnest({terms}) AS term FROM doc_tokens")
    cte(f"{prefix}_tf_all", f"SELECT case_id, fold, term, count(*) AS tf FROM {prefix}_terms GROUP BY ALL")
    cte(f"{prefix}_vocab", f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM {prefix}_tf_all GROUP BY term "
                           "ORDER BY tf DESC, term LIMIT 15000")
    cte(f"{prefix}_tf", f"SELECT case_id, fold, term, a.tf, v.df FROM {prefix}_tf_all a JOIN {prefix}_vocab v USING (term)")
    # the probe, written densely: every (fold, term, tag) weight in full
    cte(f"{prefix}_probe", f"""
WITH pos AS (SELECT t.fold, term, tag, sum(tf) AS c FROM {prefix}_tf t JOIN noisy_labels l USING (case_id) GROUP BY ALL),
folds AS (SELECT unnest(range(5))::INT AS fold),
tot AS (SELECT f.fold, term, sum(tf) FILTER (t.fold <> f.fold) AS c FROM {prefix}_tf t CROSS JOIN folds f GROUP BY ALL),
grid AS (SELECT f.fold, v.term, k.tag FROM folds f CROSS JOIN {prefix}_vocab v CROSS JOIN noisy_cnt k),
cp AS (SELECT f.fold, term, tag, sum(c) FILTER (p.fold <> f.fold) AS cp FROM pos p CROSS JOIN folds f GROUP BY ALL),
full_ AS (SELECT g.fold, g.term, g.tag, coalesce(cp.cp, 0) AS cp, coalesce(tot.c, 0) - coalesce(cp.cp, 0) AS cn
  FROM grid g LEFT JOIN cp USING (fold, term, tag) LEFT JOIN tot USING (fold, term)),
sums AS (SELECT fold, tag, sum(cp) AS np, sum(cn) AS nn, count(*) AS v FROM full_ GROUP BY ALL),
weights AS (SELECT fold, term, tag, ln((cp + 1)::DOUBLE / (np + v)) - ln((cn + 1)::DOUBLE / (nn + v)) AS weight, cp
  FROM full_ JOIN sums USING (fold, tag))
SELECT * FROM weights""")
    cte(f"{prefix}_probs", f"""
SELECT d.case_id, d.fold, k.tag, list_contains(d.tags, k.tag)::INT AS y,
  least(greatest(1 / (1 + exp(-4.0::DOUBLE * coalesce(s.score, 0))), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p
FROM noisy_docs d CROSS JOIN noisy_cnt k LEFT JOIN (
  SELECT case_id, tag, sum(tf * weight) / sum(tf) AS score
  FROM {prefix}_tf JOIN {prefix}_probe USING (fold, term) GROUP BY case_id, tag) s USING (case_id, tag)""")


_term_ctes("bi", "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])")
_term_ctes("uni", "w")
cte("tfidf", """
SELECT case_id, fold, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY case_id)) AS w FROM (
  SELECT *, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM noisy_docs))::DOUBLE / (1 + df)) + 1) AS raw FROM bi_tf)""")
cte("probs", "SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM bi_probs")


def noisy(spark, folder):
    """Document cases with flipped languages and their fold."""
    return P.with_fold(views.flip_languages(I.docs(spark, folder)))


def probe_texts(spark, folder):
    text = build_probe_text(F.col("service"), F.array_join("keywords", ", "), F.col("summary"))
    return views.document_texts(spark, folder).select("case_id", text.alias("probe_text"))


def term_rows(spark, folder, bigrams=True, spread=True):
    """(case_id, terms), hashed by case unless only counts over all cases are wanted."""
    texts = probe_texts(spark, folder)
    return X.with_terms(X.spread_by_case(texts) if spread else texts, F.col("probe_text"), bigrams).select("case_id", "terms")


class Probed:
    """Bags, probe and probabilities of the document cases."""

    def __init__(self, spark, folder, bigrams: bool = True):
        self.docs = term_rows(spark, folder, bigrams)
        self.top = stage(X.vocab_top_terms(term_rows(spark, folder, bigrams, spread=False)), "vocab")
        cases = noisy(spark, folder).select("case_id", "tags", "fold", "keywords")
        self.vocab = bounded_values(L.tag_counts(L.binarize_labels(cases)), "tag")
        self.bags = stage(X.bags(self.docs, self.top, cases), "bags")
        self.probe = P.NaiveBayesProbe(self.bags, self.vocab)

    def probs(self):
        return self.probe.probabilities(self.bags)

    def features(self):
        counts = X.term_counts(self.docs, self.top.select("term", "df"))
        return X.tfidf(counts, self.bags.count())


@query("build_input_text", sql(f"""
SELECT case_id, md5('Service: ' || service || CASE WHEN lower(trim(summary)) IN ('', 'nan', 'none') THEN '' ELSE
  ' [SEP] Complaint: ' || trim(summary) END || CASE WHEN {u('kw-dropout', 'case_id')} > 0.4 THEN ' [SEP] Categories: '
  || array_to_string(keywords, ', ') ELSE '' END) AS text_md5 FROM doc_cases"""))
def input_text_query(spark, folder):
    docs = I.docs(spark, folder)
    return docs.select("case_id", F.md5(build_input_text(docs.columns, dropout=0.4)).alias("text_md5"))


@query("build_probe_text", sql("SELECT case_id, md5(probe_text) AS text_md5 FROM noisy_docs"))
def probe_text_query(spark, folder):
    return probe_texts(spark, folder).select("case_id", F.md5("probe_text").alias("text_md5"))


@query("vocab_top_terms", sql("SELECT term, tf, df FROM bi_vocab"))
def vocab_query(spark, folder):
    return X.vocab_top_terms(term_rows(spark, folder, spread=False))


@query("tfidf", sql("SELECT case_id, term, round(w, 6) AS w FROM tfidf"))
def tfidf_query(spark, folder):
    docs = term_rows(spark, folder)
    top = stage(X.vocab_top_terms(term_rows(spark, folder, spread=False)), "vocab")
    n = views.table(spark, folder, "documents").count()
    return _round(X.tfidf(X.term_counts(docs, top.select("term", "df")), n).select("case_id", "term", "w"), "w")


# ---- probabilities -----------------------------------------------------------------------

@query("safe_folds", sql("""
SELECT tag, cnt AS n_pos, n - cnt AS n_neg, greatest(2, least(5, cnt, n - cnt))::BIGINT AS folds, cnt < 5 AS skipped
FROM cnt_all CROSS JOIN (SELECT count(*) AS n FROM cases)"""))
def folds_query(spark, folder):
    cases = stage(I.cases(spark, folder), "cases")
    return P.safe_folds(L.tag_counts(L.binarize_labels(cases)), cases.count())


@query("oof_probabilities", sql("SELECT case_id, tag, y, round(p, 6) AS p FROM probs"))
def oof_query(spark, folder):
    return _round(E.cells_of(Probed(spark, folder).probs()), "p")


@query("ensemble_probabilities", sql("""
SELECT case_id, tag, any_value(y) AS y, round(avg(p), 6) AS p FROM (
  SELECT case_id, tag, y, p FROM bi_probs UNION ALL SELECT case_id, tag, y, p FROM uni_probs) GROUP BY case_id, tag"""))
def ensemble_query(spark, folder):
    probes = [Probed(spark, folder, bigrams).probs() for bigrams in (True, False)]
    return _round(P.ensemble_probabilities(probes), "p")


# ---- noise ---------------------------------------------------------------------------------
cte("row_q", """
SELECT case_id, sum(q * CASE WHEN rn = 1 THEN pow(0.2::DOUBLE, t - 1) ELSE 0.8::DOUBLE * pow(0.2::DOUBLE, t - rn) END) AS quality,
  avg(q) AS mean_quality, min(q) AS min_quality
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY q DESC) AS rn, count(*) OVER (PARTITION BY case_id) AS t
      FROM probs) GROUP BY case_id""")
cte("conf_t", "SELECT tag, avg(p) FILTER (y = 1) AS t1, avg(1 - p) FILTER (y = 0) AS t0 FROM probs GROUP BY tag")
cte("cleaned", """
SELECT case_id, coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1), '') AS original,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1 AND p >= 0.3), '') AS cleaned,
  coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (y = 1 AND p < 0.3), '') AS removed,
  count(*) FILTER (y = 1) AS n0, count(*) FILTER (y = 1 AND p >= 0.3) AS n1 FROM probs GROUP BY case_id""")
cte("tag_noise", """
SELECT tag, CASE WHEN c >= 100 THEN 'LR' WHEN c < 30 THEN 'XGB' ELSE 'MLP' END AS probe, c AS original_count,
  labels_dropped, round(labels_dropped / (c + 1e-9::DOUBLE) * 100, 1) AS pct_dropped
FROM (SELECT tag, count(*) AS c, count(*) FILTER (p < 0.3) AS labels_dropped FROM probs WHERE y = 1 GROUP BY tag)""")


@query("cell_quality", sql("SELECT case_id, tag, y, round(q, 6) AS q FROM probs"))
def cell_quality_query(spark, folder):
    return _round(E.cells_of(N.cell_quality(Probed(spark, folder).probs())).select("case_id", "tag", "y", "q"), "q")


@query("row_quality", sql("""
SELECT case_id, round(quality, 6) AS quality, round(mean_quality, 6) AS mean_quality,
  round(min_quality, 6) AS min_quality FROM row_q"""))
def row_quality_query(spark, folder):
    out = N.row_quality(Probed(spark, folder).probs())
    return _round(out.select("case_id", "quality", "mean_quality", "min_quality"), "quality", "mean_quality", "min_quality")


@query("confident_thresholds", sql("SELECT tag, round(t1, 6) AS t1, round(t0, 6) AS t0 FROM conf_t"))
def confident_query(spark, folder):
    return _round(N.confident_thresholds(E.cells_of(Probed(spark, folder).probs())), "t1", "t0")


@query("label_issues", sql("""
SELECT case_id, tag, y, round(p, 6) AS p, round(q, 6) AS self_confidence FROM probs JOIN conf_t USING (tag)
WHERE (y = 1 AND 1 - p >= t0 AND p < t1) OR (y = 0 AND p >= t1 AND 1 - p < t0)"""))
def issues_query(spark, folder):
    cells = E.cells_of(stage(Probed(spark, folder).probs(), "probs"))
    found = N.ranked_issues(N.label_issues(cells, N.confident_thresholds(cells)))
    return _round(found, "p", "self_confidence")


cte("judged", """
SELECT case_id, tag, y, p, CASE WHEN p >= t1 AND 1 - p >= t0 THEN (p >= 0.5)::INT WHEN p >= t1 THEN 1 WHEN 1 - p >= t0 THEN 0 END AS t
FROM probs JOIN conf_t USING (tag)""")
cte("joint", """
SELECT tag, n0, n1, n_00, n_01, n_10, n_11, round(n_01)::BIGINT AS off_0, round(n_10)::BIGINT AS off_1 FROM (
  SELECT tag, n0, n1, CASE WHEN c00 + c01 > 0 THEN c00 * n0 / (c00 + c01)::DOUBLE ELSE n0 END AS n_00,
    CASE WHEN c00 + c01 > 0 THEN c01 * n0 / (c00 + c01)::DOUBLE ELSE 0 END AS n_01,
    CASE WHEN c10 + c11 > 0 THEN c10 * n1 / (c10 + c11)::DOUBLE ELSE 0 END AS n_10,
    CASE WHEN c10 + c11 > 0 THEN c11 * n1 / (c10 + c11)::DOUBLE ELSE n1 END AS n_11
  FROM (SELECT tag, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0 AND t = 0) AS c00,
    count(*) FILTER (y = 0 AND t = 1) AS c01, count(*) FILTER (y = 1 AND t = 0) AS c10, count(*) FILTER (y = 1 AND t = 1) AS c11
    FROM judged GROUP BY tag))""")


@query("confident_joint", sql("""
SELECT tag, n0, n1, round(n_00, 6) AS n_00, round(n_01, 6) AS n_01, round(n_10, 6) AS n_10, round(n_11, 6) AS n_11, off_0, off_1 FROM joint"""))
def joint_query(spark, folder):
    cells = E.cells_of(stage(Probed(spark, folder).probs(), "probs"))
    return _round(Q.confident_joint(cells), "n_00", "n_01", "n_10", "n_11")


@query("prune_by_joint", sql("""
SELECT case_id, tag, y, round(p, 6) AS p, round(s, 6) AS self_confidence, rank FROM (
  SELECT case_id, tag, y, p, s, row_number() OVER (PARTITION BY tag, y ORDER BY s, case_id) AS rank
  FROM (SELECT *, round(q, 9) AS s FROM probs)) JOIN joint USING (tag)
WHERE rank <= CASE WHEN y = 1 THEN off_1 ELSE off_0 END"""))
def prune_query(spark, folder):
    cells = E.cells_of(stage(Probed(spark, folder).probs(), "probs"))
    return _round(Q.prune_by_joint(cells), "p", "self_confidence")


#: Three documents of every thousand share a tag of their own, too rare for a probe at any size of the table.
cte("trio", "SELECT case_id, 'trio:' || (case_id // 1000) AS tag FROM noisy_docs WHERE case_id % 1000 IN (1, 2, 3)")


def _with_trios(cases):
    trio = F.when((F.col("case_id") % 1000).isin(1, 2, 3), F.concat(F.lit("trio:"), F.expr("case_id div 1000")))
    return cases.withColumn("tags", F.array_compact(F.concat("tags", F.array(trio))))


@query("clean_pipeline", sql("""
WITH near_sims AS (SELECT case_id, tag, max(s) AS s FROM (SELECT v.case_id, l.tag, l.case_id AS pos, sum(v.w * q.w) AS s
  FROM tfidf v JOIN tfidf q USING (term) JOIN trio l ON l.case_id = q.case_id GROUP BY v.case_id, l.tag, pos) GROUP BY ALL),
near_spans AS (SELECT tag, CASE WHEN count(*) < (SELECT count(*) FROM noisy_docs) THEN 0 ELSE min(s) END AS lo, max(s) AS hi FROM near_sims GROUP BY tag),
near_scores AS (SELECT case_id, tag, p >= 0.3 AS kept FROM probs JOIN (SELECT tag FROM noisy_cnt WHERE cnt >= 5) USING (tag) WHERE y = 1
  UNION ALL SELECT case_id, tag, true FROM noisy_labels JOIN (SELECT tag FROM noisy_cnt WHERE cnt < 5) USING (tag)
  UNION ALL SELECT t.case_id, t.tag, hi IS NULL OR coalesce((s - lo) / (hi - lo + 1e-9::DOUBLE), 0) >= 0.3
  FROM trio t LEFT JOIN near_spans USING (tag) LEFT JOIN near_sims m ON m.case_id = t.case_id AND m.tag = t.tag),
marked AS (SELECT case_id, string_agg(tag, '|' ORDER BY tag) AS original, string_agg(tag, '|' ORDER BY tag) FILTER (kept) AS cleaned,
  string_agg(tag, '|' ORDER BY tag) FILTER (NOT kept) AS removed FROM near_scores GROUP BY case_id)
SELECT case_id, coalesce(original, '') AS original, coalesce(cleaned, '') AS cleaned, coalesce(removed, '') AS removed,
  cleaned IS NULL AS is_unlabeled FROM noisy_docs LEFT JOIN marked USING (case_id)"""))
def pipeline_query(spark, folder):
    """Probes where a tag has enough positives, similarity where it has not, then the cleaning."""
    probed = Probed(spark, folder)
    cases = stage(_with_trios(noisy(spark, folder).select("case_id", "tags")), "trio-cases")
    out = Q.clean_flow(cases, E.cells_of(stage(probed.probs(), "probs")), probed.features())
    return out.select("case_id", *[F.array_join(c, "|").alias(c) for c in ("original", "cleaned", "removed")], "is_unlabeled")


@query("clean_labels", sql("SELECT case_id, original, cleaned FROM cleaned"))
def clean_query(spark, folder):
    out = N.clean_labels(Probed(spark, folder).probs())
    return out.select("case_id", F.array_join("original", "|").alias("original"), F.array_join("cleaned", "|").alias("cleaned"))


@query("rebuild_tags", sql("SELECT case_id, cleaned AS tags, n1 AS n_tags FROM cleaned WHERE n1 > 0"))
def rebuild_query(spark, folder):
    out = N.flag_unlabeled(N.clean_labels(Probed(spark, folder).probs()), drop=True)
    return out.select("case_id", F.array_join("cleaned", "|").alias("tags"), F.size("cleaned").cast("bigint").alias("n_tags"))


@query("flag_unlabeled", sql("SELECT case_id, n1 = 0 AS is_unlabeled FROM cleaned"))
def unlabeled_query(spark, folder):
    out = N.flag_unlabeled(N.clean_labels(Probed(spark, folder).probs()))
    return out.select("case_id", "is_unlabeled")


@query("label_diff", sql("SELECT case_id, original, cleaned, removed, '' AS added FROM cleaned WHERE n0 <> n1"))
def diff_query(spark, folder):
    out = N.label_diff(N.clean_labels(Probed(spark, folder).probs()))
    return out.select("case_id", *[F.array_join(c, "|").alias(c) for c in ("original", "cleaned", "removed", "added")])


@query("tag_noise_breakdown", sql("SELECT * FROM tag_noise"))
def breakdown_query(spark, folder):
    return N.tag_noise_breakdown(N.clean_labels(Probed(spark, folder).probs()))


@query("noisiest_tags", sql("SELECT * FROM tag_noise ORDER BY pct_dropped DESC, tag LIMIT 15"))
def noisiest_query(spark, folder):
    return N.noisiest_tags(N.tag_noise_breakdown(N.clean_labels(Probed(spark, folder).probs())))


@query("cleaning_summary", sql("""
SELECT sum(n0)::BIGINT AS labels_before, sum(n1)::BIGINT AS labels_after, (sum(n0) - sum(n1))::BIGINT AS dropped,
  round((sum(n0) - sum(n1)) / sum(n0)::DOUBLE * 100, 1) AS pct_dropped, count(*) FILTER (n0 > n1) AS cases_corrected
FROM cleaned"""))
def cleaning_query(spark, folder):
    return N.cleaning_summary(N.clean_labels(Probed(spark, folder).probs()))


@query("quality_summary", sql("""
SELECT round(avg(quality), 6) AS mean_quality, count(*) FILTER (quality < 0.7) AS noisy,
  round(avg((quality < 0.7)::INT) * 100, 6) AS noisy_pct, count(*) FILTER (quality < 0.4) AS very_noisy,
  round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality,
  (SELECT round(avg((q < 0.3)::INT) * 100, 6) FROM probs) AS low_cells_pct FROM row_q"""))
def quality_summary_query(spark, folder):
    out = N.quality_summary(N.row_quality(Probed(spark, folder).probs()))
    return _round(out, "mean_quality", "noisy_pct", "min_quality", "max_quality", "low_cells_pct")


@query("row_level_noise_filter", sql("""
SELECT case_id, quality < 0.7 AS is_noisy, quality < 0.4 AS is_very_noisy,
  round(CASE WHEN quality < 0.7 THEN quality ELSE 1 END, 6) AS weight FROM row_q"""))
def noise_filter_query(spark, folder):
    out = N.row_level_noise_filter(N.row_quality(Probed(spark, folder).probs()), mode="weigh")
    return _round(out.select("case_id", "is_noisy", "is_very_noisy", "weight"), "weight")


@query("keyword_noise", sql("""
SELECT keyword, round(avg(1 - quality), 6) AS mean_noise, round(avg((quality < 0.7)::INT), 6) AS flagged_share,
  count(*) AS cases FROM row_q JOIN (SELECT case_id, unnest(keywords) AS keyword FROM noisy_docs) USING (case_id)
GROUP BY keyword"""))
def keyword_noise_query(spark, folder):
    return _round(N.keyword_noise(N.row_quality(Probed(spark, folder).probs())), "mean_noise", "flagged_share")


cte("case_noise", """
SELECT case_id, tags, 1 - least(greatest(coalesce(quality, (SELECT avg(coalesce(quality, 0.9::DOUBLE)) FROM cases)), 0), 1)
  AS noise FROM cases""")


@query("noise_from_quality", sql("SELECT case_id, round(noise, 6) AS noise FROM case_noise"))
def from_quality_query(spark, folder):
    out = N.noise_from_quality(stage(I.cases(spark, folder), "cases"))
    return _round(out.select("case_id", "noise"), "noise")


@query("noise_proxy_tagcount", sql("""
SELECT case_id, round(least(abs(len(tags) - m) / (3 * (s + 1e-6::DOUBLE)), 0.5), 6) AS noise
FROM cases CROSS JOIN (SELECT avg(len(tags)) AS m, stddev_pop(len(tags)) AS s FROM cases)"""))
def proxy_query(spark, folder):
    out = N.noise_proxy_tagcount(stage(I.cases(spark, folder), "cases"))
    return _round(out.select("case_id", "noise"), "noise")


@query("smooth_labels", sql("""
SELECT case_id, tag, round(1 - s + 0.5 * s, 6) AS target FROM (
  SELECT case_id, unnest(tags) AS tag,
    least(greatest((SELECT base_smooth FROM settings) + noise * 0.1::DOUBLE, 0.01::DOUBLE), 0.2::DOUBLE) AS s FROM case_noise)"""))
def smooth_query(spark, folder):
    cases = stage(I.cases(spark, folder), "cases")
    base = I.settings(cases)["base_smooth"]
    positives = N.noise_from_quality(cases).select("case_id", "noise", F.explode("tags").alias("tag"), F.lit(1).alias("y"))
    return _round(N.smooth_labels(positives, base).select("case_id", "tag", "target"), "target")


@query("smooth_labels_all", sql("""
SELECT case_id, tag, y, round(y * (1 - s) + 0.5 * s, 6) AS target FROM (
  SELECT case_id, tag, list_contains(tags, tag)::BIGINT AS y,
    least(greatest((SELECT base_smooth FROM settings) + noise * 0.1::DOUBLE, 0.01::DOUBLE), 0.2::DOUBLE) AS s
  FROM case_noise CROSS JOIN cnt_all)"""))
def smooth_all_query(spark, folder):
    """All cells, those of tags that a case does not have as well."""
    cases = stage(I.cases(spark, folder), "cases")
    vocab = I.kept_vocab(L.tag_counts(L.binarize_labels(cases)), 1)
    cells = N.noise_from_quality(cases).select("case_id", "noise", "tags", F.explode(string_array(vocab)).alias("tag"))
    cells = cells.withColumn("y", F.array_contains("tags", F.col("tag")).cast("bigint"))
    return _round(N.smooth_labels(cells, I.settings(cases)["base_smooth"]).select("case_id", "tag", "y", "target"), "target")


# ---- rare-tag fallback and mismatches --------------------------------------------------------
cte("ct_tf", """
SELECT case_id, term, count(*) AS tf FROM (SELECT case_id, unnest(regexp_extract_all(
  lower(trim(service) || ' | ' || array_to_string(keywords, ', ')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM cases) GROUP BY ALL""")
cte("ct_vocab", "SELECT term, count(*) AS df, sum(tf) AS tf FROM ct_tf GROUP BY term ORDER BY tf DESC, term LIMIT 15000")
cte("ct_vec", """
SELECT case_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY case_id)) AS w FROM (
  SELECT case_id, term, (1 + ln(t.tf)) * (ln((1 + (SELECT count(*) FROM cases))::DOUBLE / (1 + df)) + 1) AS raw
  FROM ct_tf t JOIN ct_vocab USING (term))""")


cte("few", "SELECT tag FROM cnt_all WHERE cnt < greatest(5, floor((SELECT count(*) FROM cases) * 0.0005::DOUBLE))")
cte("few_pos", "SELECT l.tag, l.case_id AS pos_id, term, w AS pw FROM labels_all l JOIN few USING (tag) "
               "JOIN ct_vec v ON v.case_id = l.case_id")


@query("max_similarity_to_positives", sql("""
WITH sims AS (SELECT case_id, tag, max(s) AS s FROM (SELECT v.case_id, tag, pos_id, sum(w * pw) AS s
  FROM ct_vec v JOIN few_pos USING (term) GROUP BY ALL) GROUP BY ALL),
cells AS (SELECT c.case_id, f.tag, coalesce(s, 0) AS s FROM cases c CROSS JOIN few f LEFT JOIN sims USING (case_id, tag))
SELECT case_id, tag, round(s, 6) AS similarity,
  round((s - min(s) OVER (PARTITION BY tag)) / (max(s) OVER (PARTITION BY tag) - min(s) OVER (PARTITION BY tag) + 1e-9::DOUBLE), 6) AS p
FROM cells"""))
def fallback_query(spark, folder):
    cases = stage(I.cases(spark, folder), "cases")
    n = cases.count()
    counts = L.tag_counts(L.binarize_labels(cases))
    few = counts.filter(F.col("cnt") < max(5, int(n * 0.0005)))
    text = build_probe_text(F.col("service"), F.array_join("keywords", ", "))
    docs = X.with_terms(X.spread_by_case(cases), text, bigrams=False)
    top = X.vocab_top_terms(docs)
    vectors = X.tfidf(X.term_counts(docs, top.select("term", "df")), n)
    return _round(N.max_similarity_to_positives(cases, vectors, few), "similarity", "p")


cte("mismatch", """
WITH wrong AS (SELECT case_id, fold, tag, p, CASE WHEN y = 1 THEN 'MISSED' ELSE 'FALSE ALARM' END AS direction FROM probs
  WHERE y <> (p >= 0.5)::INT),
c AS (SELECT x.case_id, x.tag, direction, p, t.term, w * abs(weight) AS v FROM wrong x JOIN tfidf t ON t.case_id = x.case_id
  JOIN bi_probe b ON b.fold = x.fold AND b.term = t.term AND b.tag = x.tag)
SELECT case_id, tag, direction, round(p * 100, 1) AS conf_pct, rn AS rank, term, v / total * 100 AS share_pct FROM (
  SELECT *, sum(v) OVER (PARTITION BY case_id, tag) AS total,
    row_number() OVER (PARTITION BY case_id, tag ORDER BY round(v, 9) DESC, term) AS rn FROM c) WHERE rn <= 8""")


def _mismatch_tokens(spark, folder):
    probed = Probed(spark, folder)
    cell = lambda c: F.struct(c["tag"].alias("tag"), c["y"].alias("y"), c["p"].alias("p"),
                              (c["p"] >= 0.5).cast("int").alias("pred"))
    judged = probed.probs().withColumn("cells", F.transform("cells", cell))
    return N.mismatch_tokens(judged, probed.features(), probed.probe)


@query("mismatch_tokens", sql("""
SELECT case_id, tag, direction, conf_pct, count(*) AS n_tokens, round(sum(share_pct), 5) AS share_pct,
  string_agg(term, '|' ORDER BY rank) AS terms
FROM mismatch GROUP BY ALL"""))
def mismatch_query(spark, folder):
    out = _mismatch_tokens(spark, folder)
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]), "|")
    return out.groupBy("case_id", "tag", "direction", "conf_pct").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("share_pct"), 5).alias("share_pct"), told.alias("terms"))


@query("mismatch_token_freq", sql("""
SELECT token, count(*) AS cnt FROM (SELECT trim(lower(term), '.,!?#') AS token FROM mismatch) WHERE length(token) > 2
GROUP BY token ORDER BY cnt DESC, token LIMIT 20"""))
def token_freq_query(spark, folder):
    return N.mismatch_token_freq(_mismatch_tokens(spark, folder))


@query("document_tokens", sql("""
SELECT case_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM doc_tokens"""))
def tokens_query(spark, folder):
    words = tokens(F.col("probe_text"))
    return probe_texts(spark, folder).select("case_id", F.size(words).cast("bigint").alias("n_tokens"),
                                       F.md5(F.array_join(words, " ")).alias("tokens_md5"))

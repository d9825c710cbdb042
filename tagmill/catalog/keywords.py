"""Queries on keywords: normalising, fuzzy matching, tone, vector checks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.rand import pick, uniform
from ..functions.text import normalize_keyword
from ..operators import features as X, keywords as K
from ..plans.storage import stage
from ..sources.views import table
from . import inputs as I
from .registry import query
from .sql import cte, sql, u


def typed_keywords(cases):
    """Keyword rows as people type them: doubled letters and blanks, swapped words, more."""
    rows = cases.select("case_id", F.explode("keywords").alias("k"))
    kind = pick(uniform("typo", F.concat_ws(":", F.col("case_id").cast("string"), F.col("k"))), 7)
    k = F.col("k")
    words = F.split(k, " ")
    typed = (
        F.when(kind == 1, F.concat(F.substring(k, 1, 3), F.expr("substring(k, 3)")))
        .when(kind == 2, F.regexp_replace(k, " ", "  "))
        .when(kind == 3, F.concat(F.element_at(words, -1), F.lit(" "), F.element_at(words, 1)))
        .when(kind == 4, F.concat(F.lit("#"), F.upper(k), F.lit("!")))
        .when(kind == 5, F.substring(k, 1, 5))
        .otherwise(k))
    return rows.select("case_id", typed.alias("keyword"))


def master_list(spark, folder):
    """Distinct part names in name order; the window runs over the list only."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("canonical_keyword")).distinct()
    return names.withColumn("ord", F.row_number().over(W.orderBy("canonical_keyword")))


cte("typed", f"""
SELECT case_id, CASE kind WHEN 1 THEN substr(k, 1, 3) || substr(k, 3) WHEN 2 THEN replace(k, ' ', '  ')
  WHEN 3 THEN string_split(k, ' ')[-1] || ' ' || string_split(k, ' ')[1] WHEN 4 THEN '#' || upper(k) || '!'
  WHEN 5 THEN substr(k, 1, 5) ELSE k END AS keyword
FROM (SELECT case_id, keyword AS k, floor({u('typo', "case_id||':'||keyword")} * 7)::INT AS kind FROM case_kw)""")
_NORM = r"regexp_replace(regexp_replace(trim(lower({0})), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')"
_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda x: x <> '')), ' ')"
cte("spelled", f"SELECT keyword, {_SORTED.format(_NORM.format('keyword'))} AS r FROM (SELECT DISTINCT keyword FROM typed)")
cte("listed", f"SELECT p_name AS name, row_number() OVER (ORDER BY p_name) AS ord, {_SORTED.format(_NORM.format('p_name'))} AS m "
              "FROM (SELECT DISTINCT p_name FROM part)")
# every spelling against every master keyword; longest common subsequence row by row
cte("lcs", """
WITH RECURSIVE pairs AS (SELECT DISTINCT r, m FROM spelled CROSS JOIN listed),
steps AS (
  SELECT r, m, 0 AS i, list_transform(range(0, length(m) + 1), lambda x: 0::BIGINT) AS row_ FROM pairs
  UNION ALL
  SELECT r, m, i + 1, list_prepend(0::BIGINT, list_transform(range(1, length(m) + 1), lambda j: list_max(c[1:j]))) FROM (
    SELECT r, m, i, list_transform(range(1, length(m) + 1), lambda j: CASE WHEN substr(r, i + 1, 1) = substr(m, j, 1)
      THEN greatest(row_[j + 1], row_[j] + 1) ELSE row_[j + 1] END) AS c FROM steps WHERE i < length(r)))
SELECT r, m, row_[length(m) + 1] AS n FROM steps WHERE i = length(r)""")
cte("matched", """
SELECT s.keyword, b.name AS matched, b.score FROM spelled s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, ord) AS rn FROM (
    SELECT r, name, ord, 100 * (1 - (length(r) + length(l.m) - 2 * n)::DOUBLE / (length(r) + length(l.m))) AS score
    FROM lcs JOIN listed l ON lcs.m = l.m) WHERE score >= 85) b ON s.r = b.r AND b.rn = 1""")


@query("normalize_keywords", sql(f"SELECT DISTINCT keyword, {_NORM.format('keyword')} AS normalized FROM typed"))
def normalize_query(spark, folder):
    rows = typed_keywords(I.cases(spark, folder)).select("keyword").distinct()
    return rows.select("keyword", normalize_keyword(F.col("keyword")).alias("normalized"))


@query("fuzzy_match_keywords", sql("SELECT keyword, matched, round(score, 6) AS score FROM matched"))
def fuzzy_query(spark, folder):
    out = K.fuzzy_match_keywords(typed_keywords(I.cases(spark, folder)), master_list(spark, folder))
    return out.withColumn("score", F.round("score", 6))


@query("unmatched_keywords", sql("""
SELECT keyword, count(*) AS cnt FROM typed JOIN matched USING (keyword) WHERE matched IS NULL GROUP BY keyword"""))
def unmatched_query(spark, folder):
    rows = typed_keywords(I.cases(spark, folder))
    return K.unmatched_keywords(rows, K.fuzzy_match_keywords(rows, master_list(spark, folder)))


@query("keywords_not_in_master", sql("""
SELECT DISTINCT case_id, keyword, 'REVIEW' AS verdict FROM typed WHERE keyword NOT IN (SELECT p_name FROM part)"""))
def not_in_master_query(spark, folder):
    typed = typed_keywords(I.cases(spark, folder)).groupBy("case_id").agg(F.collect_set("keyword").alias("keywords"))
    return K.keywords_not_in_master(typed, master_list(spark, folder))


# ---- tone ----------------------------------------------------------------------------------
EXPECTED = [("lang:en", "negative"), ("lang:fr", "positive"), ("lang:de", "positive"), ("lang:es", "negative"),
            ("quality", "positive"), ("toxic", "negative"), ("len:long", "neutral")]


def lexicon(docs):
    """The 200 most frequent words of the documents with hashed valences from -3 to 3."""
    top = X.vocab_top_terms(X.with_terms(docs, F.col("summary"), bigrams=False), 200)
    return top.select(F.col("term").alias("word"), (pick(uniform("valence", "term"), 7) - 3).cast("double").alias("valence"))


cte("sum_words", "SELECT case_id, unnest(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}_]{2,}')) AS word FROM doc_cases")
cte("lexicon", f"SELECT word, floor({u('valence', 'word')} * 7)::INT - 3 AS valence FROM ("
               "SELECT word FROM sum_words GROUP BY word ORDER BY count(*) DESC, word LIMIT 200)")
cte("tone", """
SELECT case_id, s / sqrt(s * s + 15) AS compound, CASE WHEN s / sqrt(s * s + 15) > 0.05 THEN 'positive'
  WHEN s / sqrt(s * s + 15) < -0.05 THEN 'negative' ELSE 'neutral' END AS polarity
FROM (SELECT c.case_id, coalesce(sum(valence), 0)::DOUBLE AS s FROM doc_cases c LEFT JOIN
  (SELECT case_id, valence FROM sum_words JOIN lexicon USING (word)) w ON c.case_id = w.case_id GROUP BY c.case_id)""")


@query("lexicon_sentiment", sql("SELECT case_id, round(compound, 6) AS compound, polarity FROM tone"))
def sentiment_query(spark, folder):
    docs = I.docs(spark, folder)
    return K.lexicon_sentiment(docs, lexicon(docs)).withColumn("compound", F.round("compound", 6))


@query("sentiment_conflicts", sql(f"""
SELECT case_id, string_agg(tag || '/' || expected || '/' || polarity, '|' ORDER BY tag) AS conflicts, count(*) AS n_conflicts
FROM (SELECT case_id, polarity, unnest(tags) AS tag FROM tone JOIN doc_cases USING (case_id))
JOIN (VALUES {", ".join(f"('{t}', '{p}')" for t, p in EXPECTED)}) e(tag, expected) USING (tag)
WHERE expected <> 'neutral' AND expected <> polarity GROUP BY case_id"""))
def conflicts_query(spark, folder):
    docs = I.docs(spark, folder)
    expected = spark.createDataFrame(EXPECTED, "tag string, expected string")
    found = K.sentiment_conflicts(docs, K.lexicon_sentiment(docs, lexicon(docs)), expected)
    text = F.transform("conflicts", lambda c: F.concat_ws("/", c["tag"], c["expected"], c["actual"]))
    return found.select("case_id", F.array_join(text, "|").alias("conflicts"),
                        F.size("conflicts").cast("bigint").alias("n_conflicts"))


# ---- vectors -------------------------------------------------------------------------------

def _vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    name = lambda c: F.concat(F.lit("kw:"), c.cast("string"))
    cases = rows.select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"),
                        F.array(name(F.col("label")), name(F.col("label") + 1)).alias("keywords"))
    examples = rows.select(name(F.col("label")).alias("keyword"), F.col("embedding").alias("vector"))
    described = rows.groupBy(name(F.col("label")).alias("keyword")).agg(F.min_by("embedding", "vec_id").alias("desc_vec"))
    return cases, described.join(K.keyword_centroids(examples), "keyword"), examples


cte("emb", "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings")
cte("centroid", "SELECT label, pos, avg(v) AS v FROM emb GROUP BY label, pos")
cte("audit", f"""
WITH described AS (SELECT e.label, pos, v FROM emb e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
kws AS (SELECT vec_id, label AS k FROM embeddings UNION ALL SELECT vec_id, label + 1 FROM embeddings),
d AS (SELECT w.vec_id, w.k, sum(e.v * x.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(x.v * x.v))) AS d
  FROM kws w JOIN emb e ON e.vec_id = w.vec_id JOIN described x ON x.label = w.k AND x.pos = e.pos GROUP BY ALL),
c AS (SELECT w.vec_id, w.k, sum(e.v * x.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(x.v * x.v))) AS e
  FROM kws w JOIN emb e ON e.vec_id = w.vec_id JOIN centroid x ON x.label = w.k AND x.pos = e.pos GROUP BY ALL),
s AS (SELECT vec_id, k, d, e, 0.4::DOUBLE * d + 0.6::DOUBLE * e AS c FROM kws LEFT JOIN d USING (vec_id, k) LEFT JOIN c USING (vec_id, k))
SELECT vec_id AS case_id, 'kw:' || k AS keyword, CASE WHEN c >= 0.5 THEN 'KEEP' WHEN c >= 0.4 OR c IS NULL THEN 'REVIEW'
  ELSE 'REMOVE' END AS verdict, round(d, 4) AS desc_sim, round(e, 4) AS example_sim, round(c, 4) AS combined,
  CASE WHEN c IS NULL THEN '{K.UNKNOWN}' WHEN c >= 0.5 THEN printf('{K.STRONG}', d, e)
    WHEN c >= 0.4 THEN printf('{K.BORDERLINE}', d, e) ELSE printf('{K.LOW}', d, e) END AS reason FROM s""")


@query("keyword_centroids", sql("""
SELECT 'kw:' || label AS keyword, pos - 1 AS pos, round(v, 6) AS v FROM centroid"""))
def centroids_query(spark, folder):
    out = K.keyword_centroids(_vectors(spark, folder)[2])
    rows = out.select("keyword", F.posexplode("example_vec").alias("pos", "v"))
    return rows.select("keyword", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v"))


def _audit(spark, folder):
    cases, master, _ = _vectors(spark, folder)
    return K.validate_keywords(cases, master)


@query("validate_keywords", sql("SELECT * FROM audit"))
def validate_query(spark, folder):
    return _audit(spark, folder)


@query("verdict_summary", sql("""
SELECT verdict, count(*) AS cnt FROM audit GROUP BY verdict
UNION ALL SELECT CASE WHEN k THEN 'cases with verified' ELSE 'cases without verified' END, count(*) FROM (
  SELECT vec_id, coalesce(bool_or(verdict = 'KEEP'), false) AS k FROM embeddings LEFT JOIN audit ON vec_id = case_id GROUP BY vec_id) GROUP BY 1"""))
def verdict_query(spark, folder):
    return K.verdict_summary(stage(_audit(spark, folder), "audit"), _vectors(spark, folder)[0])


@query("keyword_outcomes", sql("""
SELECT vec_id AS case_id, coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (verdict = 'KEEP'), '') AS verified,
  coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (verdict = 'REMOVE'), '') AS removed,
  coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (verdict = 'REVIEW'), '') AS review
FROM embeddings LEFT JOIN audit ON vec_id = case_id GROUP BY vec_id"""))
def outcomes_query(spark, folder):
    out = K.keyword_outcomes(_vectors(spark, folder)[0].select("case_id"), _audit(spark, folder))
    return out.select("case_id", *(F.array_join(c, "|").alias(c) for c in ("verified", "removed", "review")))


@query("validated_cases", sql("""
SELECT case_id, string_agg(keyword, '|' ORDER BY keyword) AS final_keywords FROM audit WHERE verdict = 'KEEP' GROUP BY case_id"""))
def validated_query(spark, folder):
    cases, master, _ = _vectors(spark, folder)
    out = K.validated_cases(cases.select("case_id"), K.validate_keywords(cases, master))
    return out.select("case_id", F.array_join("final_keywords", "|").alias("final_keywords"))


@query("review_queue_by_similarity", sql("""
SELECT case_id, keyword, combined, reason FROM audit WHERE verdict = 'REVIEW' ORDER BY combined NULLS LAST, case_id, keyword"""))
def queue_query(spark, folder):
    return K.review_queue_by_similarity(_audit(spark, folder)).select("case_id", "keyword", "combined", "reason")

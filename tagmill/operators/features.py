"""Bag-of-terms features: vocabulary, term counts, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import terms, tokens
from .frequent import frequent_terms

MAX_TERMS = 15_000


def spread_by_case(cases: DataFrame) -> DataFrame:
    """Hash the cases over the shuffle partitions, once and before texts are taken apart:
    everything later done per case (counts, norms, scores) then needs no shuffle."""
    n = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cases.repartition(n, "case_id")


def vocab_top_terms(docs: DataFrame, k: int = MAX_TERMS, min_df: int = 1) -> DataFrame:
    """The k terms with the highest total count, with total count and document count.

    ``docs`` has (case_id, terms). Bounded summaries of the tasks are shuffled, not every term.
    """
    return frequent_terms(docs, k, min_df)


def with_terms(cases: DataFrame, text: Column, bigrams: bool = True) -> DataFrame:
    found = cases.withColumn("terms", tokens(text))
    return found.withColumn("terms", terms(F.col("terms"))) if bigrams else found


def term_counts(docs: DataFrame, vocab: DataFrame, *carry: str) -> DataFrame:
    """(case_id, term, tf) over the vocabulary, which is bounded by its top-k.

    Carried case columns travel with each term, so later steps need no join for them.
    The outer explode keeps the optimizer from filtering on the size of the term array,
    which would tokenise every text again; the join drops the empty rows.
    """
    rows = docs.select("case_id", *carry, F.explode_outer("terms").alias("term"))
    kept = rows.join(F.broadcast(vocab), "term")
    extra = [F.any_value(c).alias(c) for c in vocab.columns if c != "term"]
    extra += [F.any_value(c).alias(c) for c in carry]
    return kept.groupBy("case_id", "term").agg(F.count(F.lit(1)).alias("n"), *extra)


def tfidf(counts: DataFrame, n_cases: int) -> DataFrame:
    """(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to unit length per case."""
    idf = F.log((1 + n_cases) / (1.0 + F.col("df"))) + 1
    raw = counts.withColumn("raw", (1 + F.log("n")) * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("case_id")))
    return raw.withColumn("w", F.col("raw") / norm).drop("raw")


def bags(docs: DataFrame, vocab: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case, empty ones included: its columns and bag array<(term, tf)>.

    ``docs`` has (case_id, terms), ``cases`` the columns to keep; the texts themselves do
    not take part in the join. At most one entry per vocabulary term and case.
    """
    counted = term_counts(docs, vocab.select("term")).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("term", F.col("n").alias("tf")))).alias("bag"))
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return cases.join(counted, "case_id", "left").withColumn("bag", F.coalesce("bag", empty))

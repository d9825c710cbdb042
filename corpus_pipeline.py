"""From crawled documents to token ids: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagmill.llm import bpe, language, minhash, mixing, pseudonyms
from tagmill.llm.queries import KEY, TRAINED, tokenizer_path
from tagmill.plans.storage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no text, or not one letter in it.

    The others keep their columns; ``lang`` becomes the predicted one, and stays as it was
    where the table has nothing to learn languages from.
    """
    profiles = language.learn(docs.where(f"{TRAINED} != 0"))
    if not profiles:
        return language.lettered(docs.select(*COLUMNS))
    judged = language.identify(docs.select(*COLUMNS), profiles).where(F.col("lang_pred") != language.UNKNOWN)
    return judged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs.select(*COLUMNS))


def without_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private numbers, dates and addresses become pseudonyms in the text."""
    return pseudonyms.pseudonymize(docs.select(*COLUMNS), KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold the words that the mix of sources takes of them; a text may be taken twice over."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests that a decoder's result can be held against."""
    tokens = bpe.tokenize(docs.select(*COLUMNS), tokenizer_path())
    return bpe.digested(tokens).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", in_language), ("near_duplicates", without_near_copies), ("pii", without_private_values),
          ("mixing", mixed), ("bpe", encoded)]

#: Rank profiles, keyed permutations and merges cannot be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

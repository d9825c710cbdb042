"""The queries ``opN_<name>``: each runs its operator over a whole table and returns its digest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, language, minhash, mixing, pieces, pseudonyms, search, substrings, urls, vectors, warc, whitening
from .captures import captures
from .registry import ORACLES, QUERIES, query
from .sql import BM25, NEAR_TEXTS, NEAR_VECTORS, REPEATS, REVISITS, URLS

#: The tokenizer files, on every machine; override them with these variables.
TOKENIZER = os.environ.get("TAGMILL_WORD_BPE")
PIECES = os.environ.get("TAGMILL_PIECES")
BYTES = os.environ.get("TAGMILL_BYTE_BPE")
#: The key of the registered query; a real run takes its own from a secret store.
KEY = b"tagmill pseudonyms"
TRAINED = "pmod(crc32(cast(doc_id as string)), 5)"


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces_path() -> str:
    if PIECES:
        return PIECES
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def bytes_path() -> str:
    if BYTES:
        return BYTES
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_substrings", REPEATS)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.digested(bpe.tokenize(_table(spark, folder, "documents"), tokenizer_path()))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op3_revisits", REVISITS)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve_revisits(captures(_table(spark, folder, "pages")))
    merged = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";")
    return found.select("record_id", "url", "response_id", "outcome", merged.alias("headers"))


@query("op4_urls", URLS)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("""SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)""")
    return urls.judge_urls(_table(spark, folder, "pages"), rules)


@query("op5_minhash", NEAR_TEXTS)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), words=2, threshold=(80, 100))


@query("op6_search", BM25)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_table(spark, folder, "documents"), F.col("doc_id") % 20 == 0)


@query("op7_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = mixing.mix_sources(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op8_embeddings", NEAR_VECTORS)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, folder, "embeddings"))


@query("op9_pii")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, KEY).select("doc_id", "text", F.size("pii").alias("n_values"), "pii")


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(f"{TRAINED} != 0"))
    judged = language.identify(docs.select("doc_id", "text"), profiles)
    held_out = F.coalesce(F.expr(f"{TRAINED} = 0"), F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op11_pieces")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.digested(pieces.encode_pieces(_table(spark, folder, "documents"), pieces_path()))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.align(_table(spark, folder, "documents").select("doc_id", "text"), bytes_path(), pieces_path())
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    counted = alignment.with_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", digest.alias("groups_sha256"), "pairs"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


__all__ = ["QUERIES", "ORACLES"]

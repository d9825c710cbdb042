"""Case tables derived from the star-schema and document tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.cells import synthetic_cells
from ..functions.rand import uniform
from ..plans.bounded import widen


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One case per order with line items: tags and keywords come from its parts.

    The aggregation key and the join key are both the order key, so the grouped line
    items meet the orders without a second shuffle of theirs. The tags of an item are kept
    as one value, so an order has two sets to fill and not six.
    """
    items = table(spark, folder, "lineitem").join(
        table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"),
        F.col("l_partkey") == F.col("p_partkey"))
    bulk = F.col("l_quantity") >= 50
    ultra = (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08)
    families = [
        F.concat(F.lit("flag:"), "l_returnflag"),
        F.concat(F.lit("type:"), "p_type"),
        F.concat(F.lit("brand:"), "p_brand"),
        F.when(bulk, F.concat(F.lit("bulk:"), "p_type")),
        F.when(ultra, F.concat(F.lit("ultra:"), "p_brand")),
    ]
    grouped = items.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*families)))))).alias("tags"),
        F.array_sort(F.collect_set("p_name")).alias("keywords"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("service"))
    cid = F.col("case_id")
    return orders.join(grouped, "case_id").select(
        "case_id", "service", "tags", "keywords",
        _render_tags(cid, F.col("tags")).alias("tier_2"),
        F.when(cid % 17 != 0, uniform("quality", "case_id")).alias("quality"),
        F.when(cid % 11 != 0, (1 + cid % 3).cast("double")).alias("sample_weight"),
        F.element_at(
            F.array(*[F.lit(v) for v in ("TRUE", " false ", "1", "0", "maybe")]),
            (cid % 5 + 1).cast("int")).alias("has_label_issue"),
    )


def _render_tags(cid: Column, tags: Column) -> Column:
    """The tags as text in one of three spellings, input for the parser."""
    return (
        F.when(cid % 3 == 0, F.concat(F.lit("['"), F.array_join(tags, "', '"), F.lit("']")))
        .when(cid % 3 == 1, F.array_join(tags, ", "))
        .otherwise(F.concat(F.lit(" "), F.array_join(tags, " ,, "), F.lit(" , ")))
    )


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as cases without tags, for steps that need the text alone."""
    return widen(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("summary"),
        F.col("source").alias("service"), F.array("lang").alias("keywords"))


def document_cases(spark: SparkSession, folder: str) -> DataFrame:
    """One case per document, tagged by language, length and the known labels."""
    docs = widen(table(spark, folder, "documents"))
    marks = table(spark, folder, "labels").select(
        F.col("doc_id"), F.col("quality").alias("is_quality"), F.col("toxic").alias("is_toxic"))
    tags = F.array(
        F.concat(F.lit("lang:"), "lang"),
        F.when(F.col("n_chars") < 850, F.lit("len:short")),
        F.when(F.col("n_chars") > 2700, F.lit("len:long")),
        F.when(F.col("is_quality") == 1, F.lit("quality")),
        F.when(F.col("is_toxic") == 1, F.lit("toxic")),
    )
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("summary"),
        F.col("source").alias("service"), F.array("lang").alias("keywords"),
        F.array_sort(F.array_compact(tags)).alias("tags"))


def flip_languages(cases: DataFrame, share: float = 0.05) -> DataFrame:
    """Swap the language tag of a hashed share of documents, as known label noise."""
    swapped = F.transform("tags", lambda t: F.when(
        t.startswith("lang:"),
        F.when(t == "lang:en", F.lit("lang:fr")).otherwise(F.lit("lang:en"))).otherwise(t))
    flip = uniform("flip", "case_id") < share
    return cases.select(
        *[c for c in cases.columns if c != "tags"],
        F.when(flip, F.array_sort(swapped)).otherwise(F.col("tags")).alias("tags"),
        flip.alias("is_flipped"))


def synthetic_predictions(cases: DataFrame, vocab: list[str]) -> DataFrame:
    """Predictions that depend on no model: p = 0.35 y + 0.65 u(case, tag).

    One row per case holding one cell per vocabulary tag, so everything asked per case
    is answered without a shuffle.
    """
    return cases.withColumn("cells", synthetic_cells(F.col("case_id"), F.col("tags"), vocab))

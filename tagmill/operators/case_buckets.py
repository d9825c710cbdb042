"""Cases kept in hashed buckets, so that a batch of corrections rewrites only the buckets it meets.

The table lies in ``of=<buckets>/bucket=<number>`` folders by a hash of the case. A batch
reads the buckets of its cases, by partition pruning, and puts them back by a dynamic
partition overwrite; all other files stay as they are. A case remembers the number of the
correction it has, and a batch changes it only by a later one. So batches can arrive in any
order, and a batch that was lost half-way is simply merged again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.storage import stage
from .review import parsed_tags

BUCKETS = 256
#: Columns of the table beside those of the cases.
OWN = ("corrected_seq", "of", "bucket")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("case_id").cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    # Rebalancing also cuts a bucket that is too large for a task into several files.
    (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("of", "bucket").parquet(path))


def write_buckets(cases: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``cases(case_id, tags, ..)`` to a new bucketed table; choose ``buckets`` so that one is a few GB.

    Cases without number are kept and never corrected; repeated rows stay rows of their own.
    The names in ``OWN`` are the table's and must not be columns of the cases.
    """
    taken = {c.lower() for c in cases.columns} & set(OWN)
    if taken:
        raise ValueError(f"columns {sorted(taken)} belong to the bucketed table")
    _write(cases.withColumns({"corrected_seq": F.lit(None).cast("long"), "of": F.lit(buckets), "bucket": _bucket(buckets)}), path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases as they are after all batches merged so far."""
    return spark.read.parquet(path).drop(*OWN)


def merge_batch(spark: SparkSession, path: str, corrections: DataFrame) -> list[int]:
    """Merge ``corrections(case_id, seq, human_corrected_tags)`` into the table; the buckets that were rewritten.

    Filled-in corrections replace the tags of their case unless it has one of a higher
    ``seq`` already (equal numbers: the list of tags that sorts last); unknown cases are
    inserted with their tags only. A list of commas only takes all tags away. Corrections that are blank, without case or without
    ``seq`` count for nothing, and a batch without any other rewrites nothing.
    """
    table = spark.read.parquet(path)
    first = table.select("of").first()
    if first is None:
        raise ValueError("the table holds no bucket")
    buckets = first["of"]
    usable = corrections.where("case_id is not null and seq is not null").withColumn("new", parsed_tags("human_corrected_tags"))
    filled = usable.where(F.length(F.trim(F.coalesce("human_corrected_tags", F.lit("")))) > 0)
    best = filled.groupBy(F.col("case_id").cast(table.schema["case_id"].dataType).alias("case_id")).agg(
        F.max(F.struct(F.col("seq").cast("long").alias("seq"), F.col("new").alias("tags"))).alias("fix"))
    fixes = stage(best.withColumn("bucket", _bucket(buckets)), "fixes")
    met = sorted(r["bucket"] for r in fixes.select("bucket").distinct().collect())  # numbers below ``buckets``
    if not met:
        return []
    own = table.where(F.col("of") == buckets).where(F.col("bucket").isin(met)).drop("of")
    merged = own.join(fixes, ["case_id", "bucket"], "full_outer")
    has = F.when(F.col("corrected_seq").isNotNull(), F.struct(F.col("corrected_seq").alias("seq"), F.col("tags")))
    newer = F.col("fix").isNotNull() & (has.isNull() | (F.col("fix") > has))
    out = merged.select(
        *[F.when(newer, F.col("fix.tags")).otherwise(F.col("tags")).alias("tags") if c == "tags"
          else F.when(newer, F.col("fix.seq")).otherwise(F.col("corrected_seq")).alias("corrected_seq") if c == "corrected_seq"
          else F.col(c) for c in table.columns if c not in ("of", "bucket")],
        F.lit(buckets).alias("of"), "bucket")
    # Written beside the table first: the overwrite then reads nothing that it replaces.
    _write(stage(out, "merged"), path)
    return met

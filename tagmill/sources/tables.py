"""Reading case and keyword tables, writing stages, and reusing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The case table: required columns first, then the ones that may be missing.
CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("summary", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("tier_2", T.StringType()),
    T.StructField("keyword_group", T.StringType()),
    T.StructField("keywords_list", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("sample_weight", T.DoubleType()),
    T.StructField("quality", T.DoubleType()),
    T.StructField("min_quality", T.DoubleType()),
    T.StructField("has_label_issue", T.StringType()),
])
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.options(**CSV_OPTIONS).csv(path)
    return spark.read.format(fmt).load(path)


def load_cases(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The case table under its fixed schema, whatever columns the file has.

    Nothing is inferred; a missing column is a typed NULL and a value that does not parse
    is NULL. CSV with line breaks inside cells is read a whole file per task, so large
    tables should come as many files or as Parquet.
    """
    raw = _read(spark, path, fmt)
    cols = []
    for f in CASE_SCHEMA.fields:
        value = F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
        cols.append(value.alias(f.name))
    return raw.select(*cols)


def load_keyword_master(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(canonical_keyword, description, examples): examples are split on '|', trimmed and
    rid of blanks; a keyword without any gets its description as the one example."""
    raw = _read(spark, path, fmt)
    parts = F.filter(F.transform(F.split("example_complaints", r"\|"), lambda e: F.trim(e)), lambda e: F.length(e) > 0)
    examples = F.when(F.size(parts) > 0, parts).otherwise(F.array("description"))
    return raw.select("canonical_keyword", "description", examples.alias("examples"))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a stage's table: Parquet between stages, CSV for people."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.format(fmt).save(path)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written completely (its success marker is there)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(conf).exists(marker)


def stage_cache(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stage at ``path`` if it is complete, else computed, written and read back.

    Scores are re-attached by key, so a cached stage does not depend on row order.
    """
    if not stage_exists(spark, path):
        write_stage(compute(), path)
    return spark.read.parquet(path)

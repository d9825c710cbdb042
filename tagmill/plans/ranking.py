"""Ranks inside a key when one key may hold a third of all rows.

``top_per_key`` keeps the first k rows of each key; ``exact_rank`` numbers every row of a
key. Neither sorts a whole key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SALTS = 256


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                spread: str, rank_name: str | None = None) -> DataFrame:
    """First ``k`` rows of each key under ``order``.

    A first ranking runs inside (key, salt), where the salt is a hash of ``spread``, so a
    hot key is sorted by many tasks; only k rows per salt reach the final ranking.
    """
    salted = (
        df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        .withColumn("_rk", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
        .filter(F.col("_rk") <= k)
    )
    name = rank_name or "_rk"
    ranked = (
        salted.drop("_salt", "_rk")
        .withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .filter(F.col(name) <= k)
    )
    return ranked if rank_name else ranked.drop("_rk")


def exact_rank(df: DataFrame, key: str, uniform: Column, tie: str, name: str,
               slices: int = 1024) -> DataFrame:
    """Row number of every row within ``key``, ordered by (``uniform``, ``tie``).

    ``uniform`` is spread evenly over [0, 1), so cutting it into slices cuts every key,
    hot or not, into equal parts. Rows are numbered inside (key, slice) and shifted by
    the number of rows in the key's earlier slices; the counts table holds at most
    ``slices`` rows per key.
    """
    sliced = df.withColumn("_u", uniform).withColumn("_slice", F.floor(F.col("_u") * slices))
    counts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(key, "_slice").orderBy("_u", tie)
    return (
        sliced.withColumn("_in", F.row_number().over(inside))
        .join(shifts, [key, "_slice"])
        .withColumn(name, F.col("_in") + F.col("_shift"))
        .drop("_u", "_slice", "_in", "_shift")
    )


def counts_ahead(df: DataFrame, key: str, order: list[str], part: Column, **flags: Column) -> DataFrame:
    """Per row, how many earlier rows of its key hold each flag.

    ``part`` grows with ``order`` and cuts a key into pieces (``even_parts`` for a column of
    any distribution). Rows are counted inside (key, part) and shifted by the key's earlier
    parts, so no task sorts a whole key.
    """
    cut = df.withColumns({"_part": part, **{f"_{name}": flag.cast("bigint") for name, flag in flags.items()}})
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_part").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in flags])
    shifts = sums.select(key, "_part", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_shift_{name}") for name in flags])
    inside = W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = cut.withColumns({name: F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in flags}).join(shifts, [key, "_part"])
    return counted.withColumns({name: F.col(name) + F.col(f"_shift_{name}") for name in flags}).drop(
        "_part", *[f"_{name}" for name in flags], *[f"_shift_{name}" for name in flags])


def even_parts(df: DataFrame, column: str, parts: int = 256) -> Column:
    """A part number that grows with a numeric column and holds about as many rows as any other."""
    cuts = sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.2 / parts)))
    fine = max(1, round(len(cuts) ** 0.5))
    whole, heads = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[::fine]))
    if not cuts:
        return F.lit(0)
    value = F.col(column).cast("double")
    at = F.greatest(F.size(F.filter(heads, lambda c: c <= value)) - 1, F.lit(0)) * fine
    return at + F.size(F.filter(F.slice(whole, at + 1, fine), lambda c: c <= value))

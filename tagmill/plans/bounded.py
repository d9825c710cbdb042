"""Small sides: a table is broadcast only after its size was looked at.

Tag, keyword and settings tables are small in practice, but nothing guarantees it. The
helpers here read at most one row beyond the allowed count; a table that fits travels as
a local relation under a broadcast hint, any other is handed back unhinted so the join is
shuffled (and, where a key is hot, split by adaptive execution).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

MAX_ROWS = 100_000
MAX_BYTES = 16 << 20


def small_side(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` as a broadcast local table if it fits the bound, else ``df`` unchanged."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows <= max_rows and table.nbytes <= max_bytes:
        return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))
    return df


def bounded_values(df: DataFrame, column: str, max_rows: int = MAX_ROWS) -> list | None:
    """Sorted values of a column, or None when there are more than ``max_rows``."""
    values = df.select(column).limit(max_rows + 1).toArrow().column(0).to_pylist()
    return sorted(values) if len(values) <= max_rows else None


def string_array(values: list[str]) -> Column:
    """A constant ``array<string>`` (folded to a literal by the optimizer)."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def widen(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    Only a small input in few files is moved; one with enough splits is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

"""Connected components of a link table, without bringing links or labels to the driver.

Each partition first replaces its links by a spanning forest, so that dense groups shrink
to as many links as they have members. Then every node is linked to the smallest node
known in its neighbourhood, towards larger and towards smaller neighbours in turn, until
each component is a star around its smallest member. Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.storage import stage

EDGE = "u long, v long"
FOREST_EDGES = 2_000_000


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs in any order, repeats and loops allowed; nulls are left out.

    Returns ``(id, component)`` for every node that has a link to another one; the
    component is its smallest id. No links give an empty table.
    """
    edges = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v")
    edges = stage(edges.mapInArrow(_forest, EDGE), "links")
    seen = None
    while True:
        edges = stage(_to_smaller(_to_larger(edges)), "links")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _to_larger(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _to_smaller(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hops = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hops.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join two trees of this partition; emptied when it has kept very many."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        us, vs = [], []
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                us.append(u)
                vs.append(v)
        if len(parent) > FOREST_EDGES:
            parent.clear()
        yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

"""Exact counts of the most frequent terms without shuffling every term.

Text has a long tail: most terms of a large corpus occur a few times, and a plain count
moves nearly all of them. Here each task keeps a Misra-Gries summary of at most ``capacity``
terms; whenever it holds more, the count that comes next in size is taken off all of them,
and the sum of what was taken off bounds the task's error. The merged summaries give a
threshold that the k-th term reaches for certain, and a second pass counts only the terms
that may reach it. Where no summary overflowed, its counts are exact and there is no second
pass. Where the error hides the threshold (a corpus without frequent terms), or too many
terms may reach it to be sent to all tasks, every term is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.bounded import small_side
from ..plans.storage import stage

CAPACITY = 1 << 19
#: Rows whose terms are counted at a time; a batch of Spark's may hold far more.
ROWS = 512
#: Summaries at most, as many times the cores of the cluster: they are what is shuffled.
TASKS_PER_CORE = 4


def summaries(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(term, tf, df) of each task's summary, lower bounds both; a row without term has the task's error as tf.

    ``docs`` has ``terms array<string>``; null arrays and null terms do not count.
    """
    most = docs.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE
    return docs.select("terms").coalesce(most).mapInArrow(_summarizer(capacity), "term string, tf long, df long")


def numbered(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, distinct terms, which of them) of the terms in ``lists``, nulls left out."""
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    if flat.null_count:
        known = pc.is_valid(flat)
        flat, row = flat.filter(known), row.filter(known)
    coded = flat.dictionary_encode()
    return row.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _summarizer(capacity: int):
    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
        return pa.table({"term": sums["term"], "tf": sums["tf_sum"], "df": sums["df_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, error = 0, [], 0
        for lists in (b.column(0).slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            row, names, code = numbered(lists)
            tf = np.bincount(code, minlength=len(names))
            df = np.bincount(np.unique(row * max(len(names), 1) + code) % max(len(names), 1), minlength=len(names))
            counts = pa.table({"term": names.cast(pa.string()), "tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64())})
            parts.append(counts)
            held += len(counts)
            if held > 2 * capacity:
                whole = merged(parts)
                if len(whole) > capacity:
                    cut = pc.take(whole["tf"], pc.array_sort_indices(whole["tf"], order="descending").slice(capacity, 1))[0].as_py()
                    error += cut
                    whole = whole.set_column(1, "tf", pc.subtract(whole["tf"], cut)).filter(pc.greater(whole["tf"], cut))
                parts, held = [whole], len(whole)
                pa.default_memory_pool().release_unused()
        if parts:
            yield from merged(parts).combine_chunks().to_batches()
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "tf": pa.array([error], pa.int64()), "df": pa.array([0], pa.int64())})

    return run


def count_terms(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(term, tf, df) of all terms, or of those in the small table ``among``; partial sums per term are shuffled."""
    if among is not None:
        names = docs.sparkSession.sparkContext.broadcast(among.select("term").toArrow().column(0).cast(pa.string()).combine_chunks())
        counted = docs.select("terms").mapInArrow(_counter(names), "term string, tf long, df long")
        return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    seen = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first")))
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first")))
    rows = docs.select(F.inline_outer(F.concat(seen, once))).filter(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.sum(1 - F.col("first")).alias("tf"), F.sum(F.col("first").cast("bigint")).alias("df"))


def _counter(shared):
    """A task's counts of the terms of ``shared``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        tf, df = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for lists in (b.column(0).slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            row, term, many = known_terms(lists, names)
            np.add.at(tf, term, many)
            df += np.bincount(term, minlength=len(names))
        met = np.flatnonzero(tf)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(met)), pa.array(tf[met]), pa.array(df[met])], names=["term", "tf", "df"])

    return run


def known_terms(lists: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``names``, how often) of the terms of each row that ``names`` holds, in this order."""
    row, distinct, code = numbered(lists)
    place = pc.fill_null(pc.index_in(distinct.cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False)
    term = place[code] if len(code) else np.empty(0, np.int64)
    hit = term >= 0
    pairs, many = np.unique(row[hit] * max(len(names), 1) + term[hit], return_counts=True)
    return pairs // max(len(names), 1), pairs % max(len(names), 1), many


def candidates(docs: DataFrame, k: int, min_df: int = 1, capacity: int = CAPACITY) -> tuple[DataFrame | None, bool]:
    """(table of lower bounds that holds the k most frequent terms, whether its counts are exact); None if it cannot be told."""
    rows = stage(summaries(docs, capacity).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "summaries")
    error = rows.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    known = rows.where("term is not null")
    if not error:
        return known, True
    top = known.where(F.col("df") >= min_df).orderBy(F.desc("tf")).limit(k).agg(F.min("tf"), F.count(F.lit(1))).first()
    if top[1] < k or top[0] <= error:
        return None, False
    return known.where(F.col("tf") + error >= top[0]), False


def frequent_terms(docs: DataFrame, k: int, min_df: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The k terms of ``docs(terms)`` with the highest total count, with total and document count; ties by term.

    Only terms in at least ``min_df`` documents count. Fewer than k terms are all returned;
    an empty table gives an empty one.
    """
    found, exact = candidates(docs, k, min_df, capacity)
    if exact:
        counted = found
    else:
        names = None if found is None else found.select("term")
        small = None if found is None else small_side(names)
        counted = count_terms(docs, None if small is names else small)
    return counted.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(k)

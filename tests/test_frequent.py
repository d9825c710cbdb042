"""The most frequent terms from summaries, against plain counting."""

import os
import random
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

from tagmill.operators import frequent


def corpus(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "case_id long, terms array<string>").repartition(3)


def plain(rows, k, min_df=1):
    tf = Counter(t for r in rows for t in (r or []) if t is not None)
    df = Counter(t for r in rows for t in {x for x in (r or []) if x is not None})
    return sorted(((t, n, df[t]) for t, n in tf.items() if df[t] >= min_df), key=lambda r: (-r[1], r[0].encode()))[:k]


def got(docs, *args):
    return [(r["term"], r["tf"], r["df"]) for r in frequent.frequent_terms(docs, *args).collect()]


def long_tailed(rng, n):
    rows = [[f"common{min(int(rng.expovariate(.3)), 30)}" if rng.random() < .5 else f"rare{rng.randrange(10**9)}" for _ in range(rng.randrange(60))]
            for _ in range(n)]
    return rows + [None, [], [None, "common0", None]] + [["burst"] * 400]


def test_terms_of_a_long_tail_need_only_bounded_summaries(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = long_tailed(random.Random(2), 900)
        docs, capacity = corpus(spark, rows), 200
        distinct = len({t for r in rows for t in (r or [])})
        for k, min_df in ((1, 1), (8, 1), (8, 2), (5, 30)):
            found, exact = frequent.candidates(docs, k, min_df, capacity)
            assert not exact and found is not None and found.count() < 100
            assert got(docs, k, min_df, capacity) == plain(rows, k, min_df)
        kept = frequent.summaries(docs, capacity)
        assert distinct > 10_000 and kept.count() <= 3 * (2 * capacity + 1)
        # Lower bounds, and the errors bound what is missing.
        low = {r["term"]: r["tf"] for r in kept.groupBy("term").agg(F.sum("tf").alias("tf")).collect()}
        error = low.pop(None)
        assert all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n, _ in plain(rows, 10**9))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_flat_small_and_empty_corpora_are_counted_exactly(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rng = random.Random(3)
        flat = [[f"t{rng.randrange(3000)}" for _ in range(20)] for _ in range(400)]
        assert frequent.candidates(corpus(spark, flat), 50, 1, 100) == (None, False)
        assert got(corpus(spark, flat), 50, 1, 100) == plain(flat, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    few = [["a", "b", "a"], ["b"], ["ä", None], None]
    assert frequent.candidates(corpus(spark, few), 50)[1]
    assert got(corpus(spark, few), 50) == plain(few, 50) and got(corpus(spark, few), 2, 2) == plain(few, 2, 2)
    assert got(corpus(spark, few).limit(0), 5) == []


def test_more_candidates_than_may_be_sent_are_counted_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(frequent, "small_side", lambda df: df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = long_tailed(random.Random(5), 500)
        assert got(corpus(spark, rows), 8, 1, 200) == plain(rows, 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_large_batch_is_counted_in_small_parts():
    script = """
import pyarrow as pa
from tagmill.operators import frequent
n, wide = 20_000, 100
terms = pa.array([f"t{i}" for i in range(1000)]).take(pa.array([i % 1000 for i in range(n * wide)]))
batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(range(0, n * wide + 1, wide), pa.int32()), terms)], ["terms"])
pool = pa.default_memory_pool()
held, before = pool.bytes_allocated(), pool.max_memory()
out = [r for b in frequent._summarizer(1 << 12)(iter([batch])) for r in b.to_pylist()]
assert {r["tf"] for r in out if r["term"]} == {n * wide // 1000} and len(out) == 1001, out[:3]
print((max(pool.max_memory(), before) - held) >> 20)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(done.stdout) < 40


def test_terms_are_counted_without_a_row_per_term(spark):
    rows = [["a", "b", "a", None], ["b", "x"], None, [], ["ä", "a"]]
    docs = corpus(spark, rows)
    counted = frequent.count_terms(docs, spark.createDataFrame([("a",), ("b",), ("none",)], "term string"))
    assert sorted(map(tuple, counted.collect())) == [("a", 3, 2), ("b", 2, 2)]
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()

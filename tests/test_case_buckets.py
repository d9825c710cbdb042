"""Corrections merged into buckets: any order of arrival, untouched files."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagmill.operators import case_buckets as B
from tagmill.operators.review import apply_feedback

CASES = "case_id long, service string, tags array<string>"
FIXES = "case_id long, seq int, human_corrected_tags string"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def rows(frame):
    return sorted((r["case_id"] if r["case_id"] is not None else -10**9, r["service"] or "", tuple(["<null>"] if r["tags"] is None else r["tags"])) for r in frame.collect())


def test_batches_in_any_order_equal_one_merge(spark, tmp_path):
    rng = random.Random(6)
    cases = spark.createDataFrame([(i, f"s{i % 3}", [f"t{i % 5}"] if i % 9 else None) for i in range(200)] + [(7, "again", ["t2"])], CASES)
    fixes = [(rng.randrange(-20, 200), seq, rng.choice(["a, b", " ", None, ",c,", "d,,e ", " , "])) for seq in range(60)]
    one, two = fixes[:30], fixes[30:]
    whole = apply_feedback(cases, spark.createDataFrame(fixes, FIXES))
    for name, batches in (("ab", (one, two)), ("ba", (two, one)), ("all", (fixes,)), ("twice", (two, one, two, fixes))):
        path = str(tmp_path / name)
        B.write_buckets(cases, path, buckets=16)
        for batch in batches:
            B.merge_batch(spark, path, spark.createDataFrame(batch, FIXES))
        got = B.read_cases(spark, path)
        assert set(got.columns) == set(cases.columns) and rows(got) == rows(whole), name


def test_only_met_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    cases = spark.createDataFrame([(i, "s", ["x"]) for i in range(300)] + [(None, "none", ["x"])], CASES)
    B.write_buckets(cases, path, buckets=32)
    before = files(path)
    met = B.merge_batch(spark, path, spark.createDataFrame([(5, 1, "y"), (999, 1, "z"), (None, 1, "q"), (8, None, "q"), (9, 1, "  ")], FIXES))
    after = files(path)
    touched = {f"bucket={b}" for b in met}
    assert 1 <= len(met) <= 2
    assert {f: t for f, t in before.items() if f.split("/")[1] not in touched} == {f: t for f, t in after.items() if f.split("/")[1] not in touched}
    assert not {f for f in before if f.split("/")[1] in touched} & set(after)
    got = {r["case_id"]: (r["service"], r["tags"]) for r in B.read_cases(spark, path).collect()}
    assert got[5] == ("s", ["y"]) and got[999] == (None, ["z"]) and got[8] == got[9] == ("s", ["x"]) and got[None] == ("none", ["x"]) and len(got) == 302
    # Equal numbers: the list that sorts last, whatever comes first.
    for text in ("k", "m", "l"):
        B.merge_batch(spark, path, spark.createDataFrame([(6, 4, text)], FIXES))
    assert B.read_cases(spark, path).where("case_id = 6").first()["tags"] == ["m"]
    unmoved = files(path)
    assert B.merge_batch(spark, path, spark.createDataFrame([], FIXES)) == [] and files(path) == unmoved


def test_reserved_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        B.write_buckets(spark.range(2).select(F.col("id").alias("case_id"), F.lit(1).alias("Bucket")), str(tmp_path / "r"))

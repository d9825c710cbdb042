import pytest
from pyspark.sql import functions as F

from tagmill.functions.parse import parse_flag, parse_list_str, parse_tags
from tagmill.operators import labels as L


@pytest.mark.parametrize("text,want", [
    ("['a', 'b']", ["a", "b"]), ('["a", \'b\']', ["a", "b"]), ("['a', ' b ', '']", ["a", "b"]),
    ("a, b", ["a", "b"]), (" a ,, b , ", ["a", "b"]), ("[]", []), ("", []), (None, []),
    ("[a, b", ["[a", "b"]), ("a", ["a"]),
])
def test_parse_tags(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_tags(F.col("t"))).first()[0] == want


def test_parse_tags_pipe(spark):
    df = spark.createDataFrame([("a | b,c",)], "t string")
    assert df.select(parse_tags(F.col("t"), pipe=True)).first()[0] == ["a", "b", "c"]


@pytest.mark.parametrize("text,want", [
    ("['a', 'b']", ["a", "b"]), ("a, b", ["a, b"]), ("", []), ("  ", []), (None, []),
])
def test_parse_list_str(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_list_str(F.col("t"))).first()[0] == want


def test_parse_flag(spark):
    rows = [("TRUE",), (" true ",), ("1",), ("0",), ("no",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(parse_flag(F.col("t"))).collect()]
    assert got == [True, True, True, False, False, False]


def _cases(spark):
    rows = [(i, ["common"] + (["mid"] if i % 2 else []) + (["rare"] if i == 3 else [])) for i in range(10)]
    return spark.createDataFrame(rows, "case_id long, tags array<string>")


def test_drop_rare_both_ways(spark, monkeypatch):
    cases = _cases(spark)
    narrow = {r["case_id"]: r["tags"] for r in L.drop_rare_tags(cases, 3).collect()}
    monkeypatch.setattr(L, "bounded_values", lambda *a: None)
    joined = {r["case_id"]: r["tags"] for r in L.drop_rare_tags(cases, 3).collect()}
    assert narrow == joined
    assert narrow[3] == ["common", "mid"] and len(narrow) == 10


def test_small_table_settings(spark):
    row = L.auto_settings(_cases(spark), quality=None).first()
    assert (row["min_tag_samples"], row["rare_threshold"], row["batch_size"], row["epochs"]) == (3, 10, 8, 12)
    assert row["max_len"] == 256 and row["avg_quality"] == 0.9


def test_routes_cover_every_tag(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 99), ("c", 30), ("d", 29)], "tag string, cnt long")
    assert {r["tag"]: r["probe"] for r in L.route_tags(counts).collect()} == {
        "a": "LR", "b": "MLP", "c": "MLP", "d": "XGB"}


def test_rare_tags_do_not_depend_on_the_vocabulary_size(spark, monkeypatch):
    rows = [(1, ["a", "b"]), (1, ["b", "c"]), (2, ["a", "b"])]
    cases = spark.createDataFrame(rows, "case_id long, tags array<string>")
    one = sorted((r["case_id"], r["tags"]) for r in L.drop_rare_tags(cases, 2).collect())
    monkeypatch.setattr(L, "NARROW_TAGS", 0)
    assert one == sorted((r["case_id"], r["tags"]) for r in L.drop_rare_tags(cases, 2).collect())
    assert one == [(1, ["a", "b"]), (1, ["b"]), (2, ["a", "b"])]

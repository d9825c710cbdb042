import pytest
from pyspark.sql import functions as F

from tagmill.plans import bounded, storage
from tagmill.sources import tables as T


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'said "no", twice', " padded "), (2, "two\nlines", None), (3, "plain", "a, b")]
    T.write_stage(spark.createDataFrame(rows, "case_id long, summary string, tier_2 string"), str(tmp_path / "c"), "csv")
    loaded = T.load_cases(spark, str(tmp_path / "c"))
    assert loaded.schema == T.CASE_SCHEMA
    got = {r["case_id"]: (r["summary"], r["tier_2"], r["quality"]) for r in loaded.collect()}
    assert got == {i: (s, t, None) for i, s, t in rows}


def test_unparsable_values_are_null(spark, tmp_path):
    spark.createDataFrame([("7", "0.5"), ("x", "high")], "case_id string, quality string").write.parquet(str(tmp_path / "p"))
    got = T.load_cases(spark, str(tmp_path / "p"), "parquet").select("case_id", "quality").collect()
    assert sorted(map(tuple, got), key=str) == [(7, 0.5), (None, None)]


def test_keyword_master(spark, tmp_path):
    rows = [("a", "about a", " x | | y "), ("b", "about b", " | "), ("c", "about c", None)]
    spark.createDataFrame(rows, "canonical_keyword string, description string, example_complaints string").write.parquet(
        str(tmp_path / "m"))
    got = {r[0]: r["examples"] for r in T.load_keyword_master(spark, str(tmp_path / "m"), "parquet").collect()}
    assert got == {"a": ["x", "y"], "b": ["about b"], "c": ["about c"]}


def test_stage_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)
    for _ in range(2):
        assert T.stage_cache(spark, str(tmp_path / "s"), compute).count() == 5
    assert len(calls) == 1


def test_split_partitions(spark, tmp_path):
    df = spark.range(6).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test"))
    T.write_stage(df, str(tmp_path / "s"), partition_by=["split"])
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]


def test_small_side_checks_the_size(spark):
    df = spark.range(100)
    assert bounded.small_side(df, max_rows=99) is df
    assert bounded.small_side(df, max_rows=100) is not df
    assert bounded.small_side(df, max_bytes=10) is df
    assert bounded.bounded_values(df, "id", 50) is None and len(bounded.bounded_values(df, "id", 100)) == 100


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = storage.shared_dir(spark)
    staged = storage.stage(spark.range(3), "t")
    assert all(folder.rstrip("/") in f for f in staged.inputFiles())
    assert staged.schema == spark.range(3).schema or staged.count() == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_input_text(spark, parts):
    from tagmill.functions.text import build_input_text, normalize_keyword
    rows = [(1, "Loans", " late fee ", "None", ["a", "b"]), (2, "nan", "", None, [])]
    df = spark.createDataFrame(rows, "case_id long, service string, summary string, context string, keywords array<string>")
    got = {r[0]: r[1] for r in df.repartition(parts).select("case_id", build_input_text(df.columns)).collect()}
    assert got == {1: "Service: Loans [SEP] Complaint: late fee [SEP] Categories: a, b", 2: ""}
    raw = spark.createDataFrame([("  Billing-- Issue!! ",)], "k string")
    assert raw.select(normalize_keyword(F.col("k"))).first()[0] == "billing issue"

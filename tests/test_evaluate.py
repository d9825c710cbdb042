import pytest
from pyspark.sql import functions as F

from tagmill.operators import evaluate as E, review as R

CELLS = "case_id long, cells array<struct<tag:string,y:int,p:double>>"


@pytest.fixture(scope="module")
def preds(spark):
    rows = [
        (1, [("a", 1, 0.9), ("b", 0, 0.2), ("c", 1, 0.1)]),
        (2, [("a", 1, 0.6), ("b", 1, 0.7), ("c", 0, 0.8)]),
        (3, [("a", 0, 0.3), ("b", 0, 0.1), ("c", 0, 0.05)]),
    ]
    return spark.createDataFrame(rows, CELLS)


@pytest.fixture(scope="module")
def info(spark):
    return spark.createDataFrame(
        [("a", 0.5, "normal"), ("b", 0.5, "rare"), ("c", 0.5, "normal")], "tag string, threshold double, category string")


def test_sweep_counts_by_hand(preds):
    sweep = {(r["tag"], round(r["threshold"], 2)): (r["tp"], r["fp"], r["fn"]) for r in
             E.threshold_sweep(E.cells_of(preds)).collect()}
    assert len(sweep) == 51
    assert sweep["a", 0.3] == (2, 1, 0) or sweep["a", 0.3] == (2, 0, 0)  # the grid is not decimal
    assert sweep["a", 0.5] == (2, 0, 0) and sweep["c", 0.1] == (1, 1, 0) and sweep["b", 0.75] == (0, 0, 1)


def test_lowest_threshold_wins_and_zero_f1_gives_half(spark):
    rows = [(1, [("a", 1, 0.95), ("z", 0, 0.9)]), (2, [("a", 0, 0.05), ("z", 0, 0.1)])]
    cells = E.cells_of(spark.createDataFrame(rows, CELLS))
    kinds = spark.createDataFrame([("a", 1, 0.5, "normal"), ("z", 0, 0.0, "normal")],
                                  "tag string, n_pos long, freq double, category string")
    got = {r["tag"]: r["threshold"] for r in E.tune_thresholds(E.threshold_sweep(cells), kinds).collect()}
    assert got == {"a": 0.1, "z": 0.5}


def test_metrics_agree_with_multilabel_metrics(spark, preds, info):
    judged = E.judge(preds, info)
    row = E.global_metrics(judged, E.per_tag_metrics(E.judge_cells(E.cells_of(preds), info))).first()
    # by hand: a (2,0,0), b (1,0,0), c (0,1,1); cases (1,0,1), (2,1,0), empty
    assert row["macro_f1"] == pytest.approx(2 / 3)
    assert row["micro_f1"] == pytest.approx(6 / 8)
    assert row["samples_f1"] == pytest.approx((2 / 3 + 4 / 5 + 0) / 3)


def test_judge_finds_thresholds_out_of_order(spark, info):
    rows = [(1, [("c", 1, 0.6), ("x", 1, 0.55), ("a", 0, 0.4)])]
    cells = E.judge(spark.createDataFrame(rows, CELLS), info.withColumn(
        "threshold", F.when(F.col("tag") == "c", 0.65).otherwise(0.35))).first()["cells"]
    assert [(c["tag"], c["threshold"], c["pred"]) for c in cells] == [("c", 0.65, 0), ("x", 0.5, 1), ("a", 0.35, 1)]


def test_empty_sets_stay_empty(preds, info):
    out = {r["case_id"]: r for r in E.case_outcomes(E.judge(preds, info)).collect()}
    assert out[3]["missed"] == [] and out[3]["is_perfect"]
    assert out[1]["missed"] == ["c"] and out[2]["false_alarms"] == ["c"]


def test_top_k_when_nothing_passes(preds, info):
    out = {r["case_id"]: r["tags"] for r in E.predict_tags(E.judge(preds, info), top_k=2).collect()}
    assert out[3] == ["a", "b"] and out[1] == ["a"]


def test_review_budget():
    assert [R.review_budget(n) for n in (10, 100, 400, 10_000)] == [6, 6, 26, 33]


def test_feedback_both_ways(spark):
    cases = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "case_id long, tags array<string>")
    fixes = spark.createDataFrame(
        [(1, 1, "x, y"), (1, 2, "z"), (2, 1, "  "), (9, 1, "new")], "case_id long, seq int, human_corrected_tags string")
    want = {1: (["z"], "updated"), 2: (["b"], "kept"), 3: (["c"], "kept"), 9: (["new"], "inserted")}
    for bound in (100, 0):
        got = {r["case_id"]: (r["tags"], r["change"]) for r in R.apply_feedback(cases, fixes, max_rows=bound).collect()}
        assert got == want


def test_stream_tags_like_the_batch(spark, preds, info, tmp_path):
    from tagmill.streaming.scoring import tag_stream
    source = str(tmp_path / "in")
    preds.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tag_stream(stream, info, str(tmp_path / "out"), str(tmp_path / "ck"), top_k=1).awaitTermination(60)
    got = {r["case_id"]: r["tags"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["case_id"]: r["tags"] for r in E.predict_tags(E.judge(preds, info), 1).collect()}


def test_review_sets_ranked_before_judging_are_those_of_all_judged(spark):
    from tagmill.operators import evaluate as E, review as R
    from tagmill.functions.cells import reaches
    cells = lambda i: [(t, i % 2, ((i * 37 + j * 11) % 100) / 100 if (i + j) % 9 else None) for j, t in enumerate(("a", "b", None, "c"))]
    preds = spark.createDataFrame([(i, cells(i)) for i in range(200)] + [(200, None), (201, []), (202, [("c", 0, float("nan"))])],
                                  "case_id long, cells array<struct<tag:string,y:int,p:double>>")
    info = spark.createDataFrame([("a", 0.4, "normal"), ("b", 0.97, "rare"), ("c", 0.35, "rare"), (None, 0.0, "rare")],
                                 "tag string, threshold double, category string")
    raised = preds.where(reaches(F.col("cells"), E.info_table(info), "rare"))
    judged = E.judge(preds, info)
    want = judged.where(F.exists("cells", lambda c: (c["category"] == "rare") & (c["pred"] == 1)))
    ids = sorted(r["case_id"] for r in raised.collect())
    assert ids == sorted(r["case_id"] for r in want.collect()) and 202 in ids and 20 < len(ids) < 200
    k, some = R.review_budget(203), preds.where("case_id < 200")
    sets = {"uncertain": R.most_uncertain(some, k), "rare": R.first_raised(some, info, k), "confident": R.most_confident(some, k)}
    all_judged = E.judge(some, info)
    got = R.review_export(None, 203, **{n: E.judge(d, info) for n, d in sets.items()})
    assert sorted(got.collect()) == sorted(R.review_export(all_judged, 203).collect())

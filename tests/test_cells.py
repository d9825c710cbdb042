import math
from hashlib import md5

from pyspark.sql import functions as F

from tagmill.functions.cells import synthetic_cells, total_entropy
from tagmill.operators import evaluate as E, review as R
from tagmill.sources import views

CELLS = "case_id long, cells array<struct<tag string, y int, p double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_synthetic_cells_are_hashes_of_case_and_tag(spark):
    rows = [(7, ["b", "a"]), (8, []), (None, ["b"]), (9, None), (10, ["a", None])] + [(i, ["b"]) for i in range(100, 400)]
    got = spark.createDataFrame(rows, "id long, tags array<string>").repartition(3).select(
        "id", "tags", synthetic_cells(F.col("id"), F.col("tags"), ["a", "b"]).alias("cells")).collect()
    assert len(got) == len(rows)
    for r in got:
        for c, tag in zip(r["cells"], ["a", "b"], strict=True):
            u = int(md5(":".join(["42", "pred", *([] if r["id"] is None else [str(r["id"])]), tag]).encode()).hexdigest()[:13], 16) / 2.0 ** 52
            has = None if r["tags"] is None else True if tag in r["tags"] else None if None in r["tags"] else False
            assert c["tag"] == tag and (c["y"], c["p"]) == ((None, None) if has is None else (int(has), 0.35 * has + 0.65 * u))


def test_odd_cells_are_judged_as_by_the_plain_expressions(spark):
    info = spark.createDataFrame([("a", 0.3, "rare"), ("b", None, None)], "tag string, threshold double, category string")
    rows = [(1, [("b", 1, 0.5), None, (None, 0, 0.7), ("a", 0, float("nan")), ("a", 1, None)]), (2, []), (3, None), (4, [("a", 1, 0.3)])]
    got = {r["case_id"]: r["cells"] for r in E.judge(spark.createDataFrame(rows, CELLS).coalesce(1), info).collect()}
    told = [(c["threshold"], c["category"], c["pred"]) for c in got[1]]
    assert told == [(0.5, "normal", 1), (0.5, "normal", None), (0.5, "normal", 1), (0.3, "rare", 1), (0.3, "rare", None)]
    assert got[2] == [] and got[3] is None and got[4][0]["pred"] == 1
    sums = [r[0] for r in spark.createDataFrame([([0.5, 0.0],), ([0.5, None],), (None,), ([],), ([float("nan")],)], "p array<double>").coalesce(1).select(
        total_entropy(F.col("p"))).collect()]
    near = -(1e-9 * math.log(1e-9) + (1 - 1e-9) * math.log(1 - 1e-9))
    assert abs(sums[0] - math.log(2) - near) < 1e-12 and sums[1:4] == [None, None, 0.0] and abs(sums[4] - near) < 1e-12


def test_thresholds_are_attached_without_moving_cells(spark):
    info = spark.createDataFrame([("a", 0.3, "rare")], "tag string, threshold double, category string")
    rows = [(1, [("a", 1, 0.5)]), (1, [("b", 1, 0.4)]), (2, [("b", 0, 0.1)]), (None, [("a", 0, 0.2)]), (None, [("a", 0, 0.9)])]
    preds = spark.createDataFrame(rows, CELLS)
    merged = E.merged_cases(preds)
    out = {r["case_id"]: sorted((c["tag"], c["p"], c["threshold"], c["category"]) for c in r["cells"]) for r in E.attach_thresholds(merged, info).collect()}
    assert out == {1: [("a", 0.5, 0.3, "rare"), ("b", 0.4, 0.5, "normal")], 2: [("b", 0.1, 0.5, "normal")],
                   None: [("a", 0.2, 0.3, "rare"), ("a", 0.9, 0.3, "rare")]}
    long = plan(E.attach_thresholds(preds, info))
    assert "Exchange" not in long and "Generate" not in long


def test_review_sets_are_ranked_before_they_are_judged(spark):
    rows = [(i, [("a", 0, i / 200), ("b", 1, 0.1)]) for i in range(200)]
    preds = spark.createDataFrame(rows, CELLS)
    assert sorted(r["case_id"] for r in R.most_confident(preds, 3).collect()) == [197, 198, 199]
    assert sorted(r["case_id"] for r in R.most_uncertain(preds, 3).collect()) == [99, 100, 101]
    assert "Python" not in plan(R.most_confident(preds, 3)) and R.most_confident(preds, 3).columns == preds.columns


def test_an_order_fills_two_sets(spark, folder):
    cases = views.order_cases(spark, folder)
    assert cases._jdf.queryExecution().analyzed().toString().count("collect_set(") == 2
    r = cases.orderBy("case_id").first()
    assert r["tags"] == sorted(set(r["tags"])) and None not in r["tags"] and r["keywords"] == sorted(set(r["keywords"]))

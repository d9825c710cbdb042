import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.operators import calibrate as C, features as X, fitted_probes as M, noise as N, probe as P
from tagmill.plans.storage import stage

CELLS = "case_id long, cells array<struct<tag:string,y:int,p:double>>"
WORDS = {"fruit": "apple pear plum fig cherry", "metal": "iron zinc lead tin copper"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(120):
        kind = "fruit" if i % 2 else "metal"
        words = WORDS[kind].split()
        text = " ".join(words[(i * 7 + j * 3) % 5] for j in range(8)) + f" item{i % 3}"
        tags = [kind if i % 20 else ("metal" if kind == "fruit" else "fruit")]  # every 20th is wrong
        rows.append((i, text, tags))
    return spark.createDataFrame(rows, "case_id long, text string, tags array<string>")


@pytest.fixture(scope="module")
def probed(docs):
    d = X.with_terms(P.with_fold(X.spread_by_case(docs)), F.col("text"))
    vocab = X.vocab_top_terms(d)
    bags = stage(X.bags(d.select("case_id", "terms"), vocab, d.select("case_id", "tags", "fold")), "t-bags")
    probe = P.NaiveBayesProbe(bags, ["fruit", "metal"])
    return probe, bags


def test_wrong_labels_rank_first(probed):
    probe, bags = probed
    cells = probe.probabilities(bags).select("case_id", F.inline("cells"))
    assert cells.count() == 240
    own = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    worst = cells.withColumn("q", own).orderBy("q").limit(12).select("case_id").distinct()
    assert {r[0] for r in worst.collect()} == {i for i in range(120) if i % 20 == 0}
    issues = N.label_issues(cells, N.confident_thresholds(cells)).select("case_id").distinct()
    assert {r[0] for r in issues.collect()} <= {i for i in range(120) if i % 20 == 0}
    cleaned = N.clean_labels(probe.probabilities(bags))
    assert {r["case_id"] for r in N.flag_unlabeled(cleaned).filter("is_unlabeled").collect()} == {
        i for i in range(120) if i % 20 == 0}


def test_probe_in_tag_runs_is_the_same(probed, monkeypatch):
    probe, bags = probed
    whole = {(r[0], r[1]): r[2] for r in probe.probabilities(bags).select("case_id", F.inline("cells")).select(
        "case_id", "tag", "p").collect()}
    monkeypatch.setattr(P, "MAX_MODEL_BYTES", 64)
    runs = {(r[0], r[1]): r[2] for r in probe.probabilities(bags).select("case_id", F.inline("cells")).select(
        "case_id", "tag", "p").collect()}
    assert runs.keys() == whole.keys() and all(abs(runs[k] - whole[k]) < 1e-12 for k in whole)


def test_case_without_terms_gets_one_half(spark, docs):
    extra = docs.unionByName(spark.createDataFrame([(999, "", ["fruit"])], docs.schema))
    d = X.with_terms(P.with_fold(X.spread_by_case(extra)), F.col("text"))
    bags = stage(X.bags(d.select("case_id", "terms"), X.vocab_top_terms(d), d.select("case_id", "tags", "fold")), "t-bags")
    cells = P.NaiveBayesProbe(bags, ["fruit", "metal"]).probabilities(bags).filter("case_id = 999").first()["cells"]
    assert [c["p"] for c in cells] == [0.5, 0.5]


def test_row_quality_by_hand(spark):
    rows = [(1, [("a", 1, 0.9), ("b", 0, 0.2), ("c", 1, 0.1)])]
    row = N.row_quality(spark.createDataFrame(rows, CELLS)).first()
    s = 0.9
    for q in (0.8, 0.1):
        s = 0.8 * q + 0.2 * s
    assert row["quality"] == pytest.approx(s) and row["min_quality"] == pytest.approx(0.1)


def test_exempt_tags_are_kept(spark):
    df = spark.createDataFrame([(1, [("a", 1, 0.1), ("b", 1, 0.1)])], CELLS)
    assert N.clean_labels(df, exempt=["a"]).first()["cleaned"] == ["a"]


def test_quality_never_adds_labels(spark):
    df = spark.createDataFrame([(1, [("a", 0, 0.99)])], CELLS)
    assert N.clean_labels(df).first()["cleaned"] == []


def test_calibration_is_monotone_and_close(spark):
    rng = np.random.default_rng(3)
    p = rng.random(4000)
    rows = [(i, i % 5, "a", int(rng.random() < v * v), float(v)) for i, v in enumerate(p)]
    cells = spark.createDataFrame(rows, "case_id long, fold int, tag string, y int, p double")
    for method, tol in (("isotonic", 0.08), ("sigmoid", 0.15)):
        out = {r["case_id"]: r["p"] for r in C.calibrate(cells, method).collect()}
        assert len(out) == 4000 and all(0 < v < 1 for v in out.values())
        assert np.mean([abs(out[i] - v * v) for i, v in enumerate(p)]) < tol
        one_fold = sorted((p[i], out[i]) for i in range(0, 4000, 5))
        assert all(b[1] >= a[1] - 1e-9 for a, b in zip(one_fold, one_fold[1:]))


def test_calibration_tells_close_probabilities_apart(spark):
    rows = [(i, i % 5, "a", int(i >= 100), 0.001 + 0.0049 * i) for i in range(200)]
    close = [(1000, 0, "a", 0, 0.40011), (1001, 0, "a", 0, 0.40022), (1002, 0, "a", 0, 0.4005)]
    cells = spark.createDataFrame(rows + close, "case_id long, fold int, tag string, y int, p double")
    out = {r["case_id"]: r["p"] for r in C.calibrate(cells, "sigmoid").collect()}
    assert out[1000] < out[1001] < out[1002]


def test_a_probe_without_a_vocabulary_is_an_error(docs):
    with pytest.raises(ValueError):
        P.NaiveBayesProbe(docs, None)


@pytest.mark.parametrize("probe", ["LR", "MLP", "XGB"])
def test_fitted_probes_score_out_of_fold(docs, probe):
    d = X.with_terms(P.with_fold(docs, 2), F.col("text"), bigrams=False)
    vocab = [r["term"] for r in X.vocab_top_terms(d).collect()]
    rows = M.features(d, vocab, "tags", "fold")
    out = M.routed_probabilities(rows, {"fruit": probe}, folds=2, max_iter=30 if probe == "MLP" else 5).collect()
    assert sorted(r["case_id"] for r in out) == list(range(120))
    assert all(0 < r["p"] < 1 for r in out)
    right = [r for r in out if r["case_id"] % 20]
    assert sum((r["p"] >= 0.5) == bool(r["y"]) for r in right) > 0.9 * len(right)


def test_asymmetric_loss_by_hand(spark):
    from tagmill.operators.evaluate import asymmetric_loss
    cells = spark.createDataFrame([("a", 1, 0.8), ("a", 0, 0.3)], "tag string, y int, p double")
    got = {r["tag"]: r["loss"] for r in asymmetric_loss(cells, 4).collect()}
    want = -(math.log(0.8) * 0.2 + math.log(0.75) * 0.3 ** 4) / 2
    assert got["a"] == pytest.approx(want) and got["ALL"] == pytest.approx(want)


def min_max(points):
    """The isotonic fit of (pos, n) in order, by its definition."""
    share = lambda a, b: sum(p for p, _ in points[a:b + 1]) / sum(n for _, n in points[a:b + 1])
    last = len(points)
    return [max(min(share(a, b) for b in range(i, last)) for a in range(i + 1)) for i in range(last)]


def test_isotonic_curves_are_exact_however_a_tag_is_dealt(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(240), 3)
    rows = [(i, i % 5, "hot" if i % 6 else "small", int(rng.random() < v), float(v)) for i, v in enumerate(p)]
    cells = spark.createDataFrame(rows, "case_id long, fold int, tag string, y int, p double")
    got = {r["case_id"]: r["p"] for r in C.calibrate(cells).collect()}
    for f in range(5):
        for tag in ("hot", "small"):
            others = [r for r in rows if r[1] != f and r[2] == tag]
            xs = sorted({r[4] for r in others})
            fit = min_max([(sum(r[3] for r in others if r[4] == x), sum(r[4] == x for r in others)) for x in xs])
            for r in rows:
                if r[1] == f and r[2] == tag:
                    want = min(max(np.interp(r[4], xs, fit), P.CLIP), 1 - P.CLIP)
                    assert got[r[0]] == pytest.approx(want, abs=1e-12)


def test_pooling_parts_and_then_their_blocks_is_pooling_all():
    rng = np.random.default_rng(6)
    points = [(float(rng.integers(0, 3)), 2.0, float(x), float(x)) for x in range(200)]
    parts = [b for at in range(0, 200, 17) for b in C.pooled(points[at:at + 17])]
    assert C.pooled(parts) == C.pooled(points)


def test_calibration_of_nothing_and_of_a_single_fold(spark):
    schema = "case_id long, fold int, tag string, y int, p double"
    assert C.calibrate(spark.createDataFrame([], schema)).collect() == []
    alone = spark.createDataFrame([(1, 0, "a", 1, 0.3), (2, 0, "a", 0, 0.6)], schema)
    assert {r["case_id"]: r["p"] for r in C.calibrate(alone).collect()} == {1: 0.3, 2: 0.6}

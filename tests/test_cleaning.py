"""The confident joint, pruning by it, and the cleaning flow."""

import numpy as np
import pytest

from tagmill.operators import cleaning as Q

CELLS = "case_id long, tag string, y int, p double"


def cells_of(rng, n=400):
    for tag in ("a", "b"):
        for i in range(n):
            true = rng.random() < 0.3
            y = int(true if rng.random() > 0.1 else not true)
            yield i, tag, y, float(np.clip(rng.normal(0.8 if true else 0.2, 0.15), 0.01, 0.99))


def joint_of(rows):
    """Given and true classes by the published definition."""
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    conf = np.column_stack([1 - p, p])
    bound = [conf[y == g, g].mean() for g in (0, 1)]
    count = np.zeros((2, 2))
    for g, c in zip(y, conf):
        over = [j for j in (0, 1) if c[j] >= bound[j]]
        if over:
            count[g, max(over, key=lambda j: c[j])] += 1
    return count / count.sum(axis=1, keepdims=True) * np.bincount(y, minlength=2)[:, None]


def test_the_joint_and_what_it_prunes(spark):
    rows = list(cells_of(np.random.default_rng(3)))
    table = spark.createDataFrame(rows, CELLS)
    got = {r["tag"]: r for r in Q.confident_joint(table).collect()}
    pruned = Q.prune_by_joint(table).collect()
    for tag in ("a", "b"):
        own = [r for r in rows if r[1] == tag]
        want = joint_of(own)
        assert [[got[tag][f"n_{g}{t}"] for t in (0, 1)] for g in (0, 1)] == pytest.approx(want)
        for g in (0, 1):
            worst = sorted((round(p if y else 1 - p, 9), i) for i, _, y, p in own if y == g)[:int(np.floor(want[g, 1 - g] + 0.5))]
            assert [r["case_id"] for r in sorted(pruned, key=lambda r: r["rank"]) if r["tag"] == tag and r["y"] == g] == [i for _, i in worst]


def test_a_label_without_a_confident_cell_is_taken_as_right(spark):
    rows = [(1, "only", 1, 0.9), (2, "only", 1, 0.8), (3, "odd", 0, None), (4, "odd", None, 0.5)]
    table = spark.createDataFrame(rows, CELLS)
    (joint,) = Q.confident_joint(table).collect()
    assert (joint["tag"], joint["n0"], joint["n1"], joint["off_0"], joint["off_1"]) == ("only", 0, 2, 0, 0)
    assert Q.prune_by_joint(table).collect() == [] and Q.prune_by_joint(table.limit(0)).collect() == []


def test_the_flow_spares_rare_tags(spark):
    """Three positives are too few for a probe: they keep their label by similarity, those without any text by exemption."""
    cases = [(i, ["big"] if i < 12 else ["big", "trio"] if i < 15 else ["mute"] if i < 17 else None) for i in range(20)]
    cells = [(i, tag, int(tag in (tags or [])), 0.01 if i in (2, 13) else 0.9) for i, tags in cases for tag in ("big", "trio", "mute")]
    features = [(i, f"t{i % 2}", 1.0) for i in range(15)]
    flow = Q.clean_flow(spark.createDataFrame(cases, "case_id long, tags array<string>"), spark.createDataFrame(cells, CELLS),
                        spark.createDataFrame(features, "case_id long, term string, w double"))
    got = {r["case_id"]: r for r in flow.collect()}
    assert len(got) == 20 and all("trio" in got[i]["cleaned"] for i in (12, 13, 14)) and all(got[i]["cleaned"] == ["mute"] for i in (15, 16))
    assert got[2]["removed"] == ["big"] and got[2]["is_unlabeled"] and got[13]["removed"] == ["big"] and not got[13]["is_unlabeled"]
    assert got[19]["original"] == [] and sum(bool(r["removed"]) for r in got.values()) == 2


def test_the_flow_by_the_joint_never_adds(spark):
    rows = list(cells_of(np.random.default_rng(4), 120))
    cases = [(i, [t for j, t, y, _ in rows if j == i and y]) for i in range(120)]
    features = spark.createDataFrame([], "case_id long, term string, w double")
    flow = Q.clean_flow(spark.createDataFrame(cases, "case_id long, tags array<string>"), spark.createDataFrame(rows, CELLS), features, joint=True)
    removed = {(r["case_id"], t) for r in flow.collect() for t in r["removed"]}
    assert removed == {(r["case_id"], r["tag"]) for r in Q.prune_by_joint(spark.createDataFrame(rows, CELLS)).collect() if r["y"] == 1}


def test_similarity_takes_any_number_of_tags(spark):
    """More tags than any list on the driver was allowed to hold; none is lost."""
    from pyspark.sql import functions as F
    from tagmill.operators import noise as N
    cases = spark.createDataFrame([(1, ["t7", "t150000"]), (2, ["t7"]), (3, None)], "case_id long, tags array<string>")
    features = spark.createDataFrame([(1, "x", 0.6), (1, "y", 0.8), (2, "x", 1.0), (3, "z", 1.0)], "case_id long, term string, w double")
    tags = spark.range(150_001).select(F.concat(F.lit("t"), F.col("id")).alias("tag"))
    cells = N.max_similarity_to_positives(cases, features, tags)
    assert cells.count() == 3 * 150_001
    got = {(r["case_id"], r["tag"]): r["similarity"] for r in cells.where("similarity > 0").collect()}
    assert got == pytest.approx({(1, "t7"): 1.0, (2, "t7"): 1.0, (1, "t150000"): 1.0, (2, "t150000"): 0.6})


def table_of_similarities(seed, spark, negative=False):
    rng = np.random.default_rng(seed)
    bags = {i: {f"t{j}": float(rng.random() - 0.3 * negative) for j in rng.choice(12, rng.integers(1, 5), replace=False)} for i in range(60)}
    labels = [(i, f"g{rng.integers(0, 4)}") for i in range(0, 60, 4)] + [(4, "twice"), (4, "twice"), (200, "mute"), (None, "g0"), (8, None)]
    want = {}
    for pos, tag in labels:
        for i, bag in bags.items() if pos in bags and tag else ():
            if shared := bag.keys() & bags[pos].keys():
                s = sum(bag[t] * bags[pos][t] for t in shared) * (2 if tag == "twice" else 1)
                want[i, tag] = max(want.get((i, tag), -np.inf), s)
    features = spark.createDataFrame([(i, t, w) for i, bag in bags.items() for t, w in bag.items()], "case_id long, term string, w double")
    return spark.createDataFrame(labels, "case_id long, tag string"), features, want


@pytest.mark.parametrize("entries, negative", [(1 << 20, False), (1 << 20, True), (9, False), (9, True)])
def test_similarities_in_runs_and_tiles_are_those_of_all_pairs(spark, monkeypatch, entries, negative):
    """No pair of case and positive leaves a task; tags cut over runs, tiles and rare terms give the same cells."""
    from tagmill.operators import noise as N, similarity as S
    labels, features, want = table_of_similarities(7, spark, negative)
    cosines = S.greatest_cosines
    monkeypatch.setattr(N, "greatest_cosines", lambda rows, positives: cosines(rows, positives, entries))
    dense = S._DENSE
    try:
        S._DENSE, S._WIDE, S._TALL = 2, 3, 7
        got = {(r["case_id"], r["tag"]): r for r in N.similarity_fallback(labels, features, 61).collect()}
        asked = N.similarity_fallback(labels, features, 61, labels).collect()
    finally:
        S._DENSE, S._WIDE, S._TALL = dense, 2048, 256
    assert {k: r["similarity"] for k, r in got.items()} == pytest.approx(want)
    for (_, tag), r in got.items():
        own = [s for (_, t), s in want.items() if t == tag]
        assert r["p"] == pytest.approx(r["similarity"] / (max(own) + 1e-9), abs=1e-9)
    given = {(r["case_id"], r["tag"]) for r in labels.collect()}
    assert {(r["case_id"], r["tag"]): r["p"] for r in asked} == pytest.approx({k: r["p"] for k, r in got.items() if k in given})
    assert len(asked) == len(set(given) & set(want))


def test_products_of_pairs_are_not_shuffled(spark):
    """The plan of the cells has no exchange between the product and the greatest value per case and tag."""
    from tagmill.operators import noise as N
    labels, features, _ = table_of_similarities(8, spark)
    plan = N.similarity_fallback(labels, features, 61)._jdf.queryExecution().executedPlan().toString()
    assert "pos_id" not in plan and "hashpartitioning(case_id" not in plan


def test_every_row_of_a_case_has_every_tag(spark):
    from tagmill.operators import noise as N
    cases = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (2, None), (3, []), (None, ["a"])], "case_id long, tags array<string>")
    features = spark.createDataFrame([(1, "x", 1.0), (2, "x", 0.6), (2, "y", 0.8), (9, "x", 1.0)], "case_id long, term string, w double")
    tags = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "tag string")
    got = sorted((r["case_id"] or 0, r["tag"], round(r["similarity"], 6)) for r in N.max_similarity_to_positives(cases, features, tags).collect())
    near = {(1, "a"): 1.0, (2, "a"): 1.0, (1, "b"): 0.6, (2, "b"): 1.0}
    assert got == sorted((i, t, near.get((i, t), 0.0)) for i in (1, 2, 2, 3, 0) for t in "abc")

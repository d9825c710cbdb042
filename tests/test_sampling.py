import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagmill.functions.rand import uniform
from tagmill.operators import labels as L, sampling as S
from tagmill.plans.ranking import exact_rank, top_per_key


def _labels(spark, seed, n=300, hot=0.6):
    rng = random.Random(seed)
    rows = [(i, sorted({"hot"} if rng.random() < hot else set()) + sorted(
        {f"t{min(int(rng.expovariate(0.6)), 6)}" for _ in range(rng.randint(1, 3))})) for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, tags array<string>"), dict(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shortlist_min_is_the_greedy_pass(spark, seed):
    cases, tags = _labels(spark, seed)
    counts = Counter(t for ts in tags.values() for t in ts)
    score = {c: sum(sorted(1 / counts[t] for t in ts)) for c, ts in tags.items()}
    covered, want = Counter(), set()
    for c in sorted(tags, key=lambda c: (-score[c], c)):
        if any(covered[t] < 20 for t in tags[c]):
            want.add(c)
            covered.update(tags[c])
    got = {r[0] for r in S.shortlist_min(L.binarize_labels(cases), 20).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_shortlist_cap_guarantees(spark, seed):
    cases, tags = _labels(spark, seed)
    before = Counter(t for ts in tags.values() for t in ts)
    left = {}
    for r in S.shortlist_cap(L.binarize_labels(cases), 40).collect():
        left.setdefault(r["case_id"], []).append(r["tag"])
    after = Counter(t for ts in left.values() for t in ts)
    assert all(after[t] >= min(40, n) for t, n in before.items())
    assert all(set(ts) == set(tags[c]) for c, ts in left.items())
    assert not any(all(after[t] > 40 for t in ts) for ts in left.values())


def test_ranks_split_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, case_id long")
    ranked = exact_rank(df, "key", uniform("t", "case_id"), "case_id", "rk", slices=16).collect()
    by_key = {}
    for r in ranked:
        by_key.setdefault(r["key"], []).append(r["rk"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_key.values())
    top = top_per_key(df, ["key"], [F.col("case_id")], 7, "case_id").collect()
    assert {r["case_id"] for r in top if r["key"] == "hot"} == {i for i in range(2000) if i % 3 and i < 11}


def test_resample_draws_n_in_proportion(spark):
    w = spark.createDataFrame([(i, 1000.0 if i == 7 else 1.0) for i in range(2001)], "case_id long, weight double")
    copies = {r["case_id"]: r["copies"] for r in S.weighted_resample(w, n=9000).collect()}
    assert sum(copies.values()) == 9000
    assert 2700 < copies[7] < 3300 and max(v for c, v in copies.items() if c != 7) < 30


def test_sampling_ignores_partitioning(spark):
    cases = spark.range(500).select(F.col("id").alias("case_id"), F.array(
        F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("keywords"))
    one = {tuple(r) for r in S.smart_sample(cases.repartition(1), 120, 5).collect()}
    many = {tuple(r) for r in S.smart_sample(cases.repartition(7), 120, 5).collect()}
    assert one == many and len(one) == 120
    per = Counter(c % 13 for c, phase in one if phase == "quota")
    assert all(per[k] == 5 for k in range(13))


def test_split_shares(spark):
    got = Counter(r["split"] for r in S.split_80_10_10(spark.range(5000).withColumnRenamed("id", "case_id")).collect())
    assert abs(got["train"] - 4000) < 120 and abs(got["val"] - 500) < 80


def test_perturb_keeps_short_texts_and_words(spark):
    texts = ["one two three", " ".join(f"w{i}" for i in range(7)), " ".join(f"w{i}" for i in range(30))]
    rows = [(i, texts[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id long, t string")
    lengths = {0: set(), 1: set(), 2: set()}
    for r in df.select("case_id", "t", S.perturb(F.col("t"), "case_id").alias("p")).collect():
        lengths[r["case_id"] % 3].add(len(r["p"].split()))
        assert set(r["p"].split()) <= set(r["t"].split())
    assert lengths[0] == {3} and lengths[1] == {7, 11} and lengths[2] == {29, 30, 36}


@pytest.mark.parametrize("unit", [1e-9, 1.0, 1e9])
def test_resample_any_unit(spark, unit):
    rows = [(i, unit * (0.6 if i % 2 else 1.4)) for i in range(400)]
    drawn = S.weighted_resample(spark.createDataFrame(rows, "case_id long, weight double"), 20_000).collect()
    assert sum(r["copies"] for r in drawn) == 20_000 and all(r["case_id"] is not None for r in drawn)
    light = sum(r["copies"] for r in drawn if r["case_id"] % 2)
    assert abs(light / 20_000 - 0.3) < 0.02


def _walked(rows, quota, order):
    """The plain walk: keywords in order, each takes what is fresh."""
    taken, by_keyword = {}, {}
    for case, keywords in rows:
        for k in set(keywords or []):
            by_keyword.setdefault(k, []).append(case)
    for k in sorted(by_keyword):
        fresh = sorted((c for c in by_keyword[k] if c not in taken), key=lambda c: (order[k, c], c))
        taken.update((c, k) for c in fresh[:quota])
    return taken


@pytest.mark.parametrize("seed,quota", [(1, 3), (2, 20), (3, 7)])
def test_quota_walk_is_the_sequential_walk(spark, seed, quota):
    rng = random.Random(seed)
    names = ["all"] + [f"k{i:02}" for i in range(25)]
    rows = [(i, [k for k in names if rng.random() < (0.5 if k in ("all", "k03") else 0.08)]) for i in range(400)]
    cases = spark.createDataFrame(rows, "case_id long, keywords array<string>")
    order = {(r["keyword"], r["case_id"]): r["u"] for r in S.keyword_rows(cases).select(
        "case_id", "keyword", uniform("quota-walk", "keyword", "case_id").alias("u")).collect()}
    got = {r["case_id"]: r["keyword"] for r in S.quota_walk(cases, quota).collect()}
    assert got == _walked(rows, quota, order)


def test_quota_walk_edges(spark):
    schema = "case_id long, keywords array<string>, keyword string"
    assert S.quota_walk(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, ["a", None, "a"], "x"), (1, ["b"], "x"), (None, ["a"], "x"), (2, None, "x"), (3, [], "x")]
    got = S.quota_walk(spark.createDataFrame(rows, schema), 1).collect()
    assert [(r["case_id"], r["keyword"]) for r in got] == [(1, "a")]


def _capped(tags, most, least):
    covered, gone = Counter(t for ts in tags.values() for t in set(ts)), set()
    for c in sorted(tags):
        own = set(tags[c])
        if own and all(covered[t] > most for t in own) and all(covered[t] - 1 >= least for t in own):
            gone.add(c)
            covered.subtract(own)
    return gone


@pytest.mark.parametrize("seed,most,least", [(1, 20, 18), (2, 40, 40), (3, 15, 30), (4, 5, 0), (5, 60, 20)])
def test_cap_walk_is_the_sequential_walk(spark, seed, most, least):
    cases, tags = _labels(spark, seed, n=500)
    got = {r[0] for r in S.cap_walk(L.binarize_labels(cases), most, least).collect()}
    assert got == _capped(tags, most, least)


@pytest.mark.parametrize("seed,most,least,part", [(1, 20, 18, 40), (2, 40, 40, 7), (4, 5, 0, 1000)])
def test_cap_walk_takes_no_more_rounds_than_parts(spark, monkeypatch, seed, most, least, part):
    cases, tags = _labels(spark, seed, n=500)
    rounds, plain = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df, name: (rounds.append(name), plain(df, name))[1])
    got = {r[0] for r in S.cap_walk(L.binarize_labels(cases), most, least, part).collect()}
    assert got == _capped(tags, most, least)
    assert rounds.count("cap-walk") - 1 <= max(1, 500 // part)


def test_balanced_shortlist_is_both_walks(spark):
    cases, tags = _labels(spark, 9)
    counts = Counter(t for ts in tags.values() for t in ts)
    score = {c: sum(sorted(1 / counts[t] for t in ts)) for c, ts in tags.items()}
    covered, chosen = Counter(), {}
    for c in sorted(tags, key=lambda c: (-score[c], c)):
        if any(covered[t] < 20 for t in tags[c]):
            chosen[c] = tags[c]
            covered.update(tags[c])
    want = set(chosen) - _capped(chosen, 20, 20)
    got = {r["case_id"] for r in S.shortlist_balanced(L.binarize_labels(cases), 20, 20).collect()}
    assert got == want


def test_cap_walk_edges(spark):
    schema = "case_id long, tag string, excess int"
    assert S.cap_walk(spark.createDataFrame([], schema), 1).count() == 0
    rows = [(1, "a", 0), (1, "a", 0), (2, "a", 0), (None, "a", 0), (3, None, 0), (3, "a", 0)]
    assert [r[0] for r in S.cap_walk(spark.createDataFrame(rows, schema), 2).collect()] == [1]

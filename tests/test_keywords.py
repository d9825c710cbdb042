import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.functions.fuzzy import _common_length
from tagmill.operators import keywords as K, neighbours as N


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert _common_length(a, b) == _lcs(a, b)


@pytest.mark.parametrize("threshold", [70.0, 85.0, 95.0])
def test_no_candidate_is_lost(spark, threshold):
    rng = random.Random(int(threshold))
    masters = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 16))).strip() for _ in range(40)} - {""})
    masters = [m for m in masters if "  " not in m]
    raws = set()
    for m in masters:
        for _ in range(4):
            s = list(m)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(s))
                if rng.random() < 0.5 and at < len(s):
                    del s[at]
                else:
                    s.insert(at, rng.choice("abcde"))
            raws.add("".join(s))
    raws.discard("")
    r = spark.createDataFrame([(x,) for x in sorted(raws)], "r string")
    m = spark.createDataFrame([(x,) for x in masters], "m string")
    got = {tuple(x) for x in K.fuzzy_candidates(r, m, threshold).collect()}
    for a in raws:
        for b in masters:
            score = 100 * 2 * _lcs(a, b) / (len(a) + len(b))
            if score >= threshold:
                assert (a, b) in got


def test_best_match_and_ties(spark):
    raw = spark.createDataFrame([("billingg issue",), ("Issue,  billing",), ("refund",), ("",)], "keyword string")
    master = spark.createDataFrame([("billing issue", 1), ("issue billing", 2), ("refund request", 3)],
                                   "canonical_keyword string, ord int")
    got = {r["keyword"]: r["matched"] for r in K.fuzzy_match_keywords(raw, master).collect()}
    assert got == {"billingg issue": "billing issue", "Issue,  billing": "billing issue", "refund": None, "": None}


def test_validate_unknown_keyword(spark):
    cases = spark.createDataFrame([(1, [1.0, 0.0], ["k", "x"]), (2, [0.0, 1.0], ["k"])],
                                  "case_id long, vector array<double>, keywords array<string>")
    master = spark.createDataFrame([("k", [1.0, 0.0], [1.0, 0.0])],
                                   "keyword string, desc_vec array<double>, example_vec array<double>")
    got = {(r["case_id"], r["keyword"]): (r["verdict"], r["combined"]) for r in K.validate_keywords(cases, master).collect()}
    assert got == {(1, "k"): ("KEEP", 1.0), (1, "x"): ("REVIEW", None), (2, "k"): ("REMOVE", 0.0)}


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "PIVOTS", 6)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(90, 3)) * 0.05 + 4, np.zeros((8, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in N.nearest_neighbours(df, 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == order


def test_enn_modes(spark):
    rows = [(i, 0, [i * 0.01, 0.0]) for i in range(5)] + [(9, 1, [0.015, 0.0])]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    assert {r["id"] for r in N.enn_filter(df).collect()} == {0, 1, 2, 3, 4}
    assert 9 not in {r["id"] for r in N.enn_filter(df, strict=True).collect()}


def test_lexicon_tone(spark):
    cases = spark.createDataFrame([(1, "Good good day", ["x"]), (2, "bad", ["x"]), (3, "", ["x"])],
                                  "case_id long, summary string, tags array<string>")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], "word string, valence double")
    tone = K.lexicon_sentiment(cases, lexicon)
    got = {r["case_id"]: (r["polarity"], r["compound"]) for r in tone.collect()}
    assert got[1][0] == "positive" and got[2][0] == "negative" and got[3] == ("neutral", 0.0)
    assert got[1][1] == pytest.approx(4 / (16 + 15) ** 0.5)
    expected = spark.createDataFrame([("x", "positive")], "tag string, expected string")
    assert {r["case_id"] for r in K.sentiment_conflicts(cases, tone, expected).collect()} == {2, 3}


def test_cases_without_keywords_are_counted(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    audit = spark.createDataFrame([(1, "b", "KEEP"), (1, "a", "KEEP"), (1, "c", "REVIEW"), (2, "d", "REMOVE")],
                                  "case_id long, keyword string, verdict string")
    counts = {r["verdict"]: r["cnt"] for r in K.verdict_summary(audit, cases).collect()}
    assert counts["cases with verified"] == 1 and counts["cases without verified"] == 2
    lists = {r["case_id"]: (r["verified"], r["removed"], r["review"]) for r in K.keyword_outcomes(cases, audit).collect()}
    assert lists == {1: (["a", "b"], [], ["c"]), 2: ([], ["d"], []), 3: ([], [], [])}

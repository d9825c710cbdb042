"""Queries against their SQL at the smallest scale (tools/check.py runs them all)."""

import pytest

import check
from tagmill import catalog

SAMPLE = """parse_tags parse_list_str drop_rare_tags binarize_labels diagnose auto_settings auto_settings_text
threshold_sweep per_tag_metrics global_metrics classification_report case_outcomes predict_tags confused_pairs
review_export apply_feedback quota_sample smart_sample shortlist_min augment_rare undersample_dominant
weighted_resample tfidf oof_probabilities row_quality label_issues tag_noise_breakdown max_similarity_to_positives
mismatch_tokens fuzzy_match_keywords sentiment_conflicts validate_keywords knn_minority smote enn_filter
load_cases load_keyword_master""".split()


@pytest.fixture(scope="module")
def duck(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, folder, duck, name):
    got = catalog.queries()[name](spark, folder).toArrow()
    assert check.compare(got, duck.execute(catalog.oracles()[name]).to_arrow_table()).startswith("ok")


@pytest.mark.parametrize("name", ["predictions_wide_all", "label_matrix_all", "smooth_labels_all", "shortlist_cap_drops"])
def test_whole_outputs_match_sql(spark, folder, duck, name):
    got = catalog.queries()[name](spark, folder).toArrow()
    assert check.compare(got, duck.execute(catalog.oracles()[name]).to_arrow_table()).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

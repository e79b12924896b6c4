"""Every query that SQL can express agrees with DuckDB on the small tables."""

import pytest
from check_queries import compare
from conftest import SMALL

from echotrail.plans.catalog import ORACLES, QUERIES

UNCHECKED: set[str] = set()
# queries whose work runs through the group operators of operators/skew.py
SPLIT = ["w1_percent_rank", "w2_min_rank", "w3_first_rank", "w4_neighbour_ids", "w5_neighbour_deltas",
         "w8_baseline_margins", "w10_live_features", "w11_candidate_classes", "w16_suspicious_regions",
         "a22_equal_error_rate", "a23_evaluation_by_group", "a32_calibration_summary", "a33_score_distribution",
         "a35_band_cutpoints", "a36_feature_summary", "a38_group_effects", "a42_chunk_metrics", "a47_trimmed_mean",
         "a48_median_vector", "a49_segment_profile", "a51_cascade_grid", "a55_holdout_metrics",
         "a72_outcome_distribution", "j15_boundary_segments", "j20_positional_join", "x1_speaker_split",
         "x7_group_folds", "f19_counterfactual", "v9_rank_integrity", "a5_manifest_statistics"]


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == UNCHECKED


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ok, note = compare(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_match_sql(spark, duck, tiny_groups, name):
    ok, note = compare(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    assert ok, note

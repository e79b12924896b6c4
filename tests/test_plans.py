"""Plan shapes that must hold at any scale."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from echotrail.operators import skew
from echotrail.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "j10_match_by_any_key", "j11_overlap_labels", "j16_holdout_overlap", "j18_overlap_status", "j9_match_by_levels",
    "a25_threshold_grid", "a51_cascade_grid", "a55_holdout_metrics", "a64_threshold_sweep", "a9_file_balance",
    "f19_counterfactual", "f20_threshold_sensitivity", "m9_nearest_group", "j15_boundary_segments"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["p2_origin_label", "p14_file_targets", "f3_multi_axis_fusion", "a22_equal_error_rate",
                                  "w11_candidate_classes", "a51_cascade_grid"])
def test_expressions_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "MapInPandas" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["s3_pruned_scan"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["w14_top_segments"](spark, SMALL))
    assert "PushedFilters" in text


def test_localisation_shuffles_recordings_once(spark):
    text = plan(QUERIES["w11_candidate_classes"](spark, SMALL))
    assert text.count("Exchange hashpartitioning") <= 2


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["w14_top_segments"](spark, SMALL))


@pytest.mark.parametrize("name", ["f19_counterfactual", "x8_fold_groups"])
def test_branches_read_one_written_table(spark, name):
    assert "l_orderkey" not in plan(QUERIES[name](spark, SMALL))


def test_tasks_of_localisation_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    rows = skew.spread(spark.range(5_000).withColumn("k", F.col("id") % 1_000), ["k"])
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.rdd.getNumPartitions() == 50 and max(sizes) < 300
    for name in ("w9_combined_scores", "w11_candidate_classes", "w13_top_candidates"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SMALL))

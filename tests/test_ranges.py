"""Ranking metrics by ranges and quantiles by brackets against plain Python, and their plans."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from echotrail.operators import ranges
from echotrail.plans import inputs
from echotrail.plans.catalog import QUERIES


def brute_ranking(rows):
    """Area, average precision and equal error rate of (score, truth) rows from the whole curve."""
    p, q = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not p or not q:
        return None, None, None
    order = sorted({s for s, _ in rows}, reverse=True)
    steps = [(sum(y for t, y in rows if t == s), sum(1 - y for t, y in rows if t == s)) for s in order]
    tp = fp = area = ap = 0
    points = [(1.0, 0, 0, 0.5)]
    for k, (pos, neg) in enumerate(steps):
        tp, fp = tp + pos, fp + neg
        area += neg * (tp - pos + pos / 2)
        ap += pos * (tp / (tp + fp))
        if not (k and k + 1 < len(steps) and steps[k + 1] == (pos, neg)):
            points.append((abs(1 - tp / p - fp / q), fp, tp, (1 - tp / p + fp / q) / 2))
    return area / (p * q), ap / p, min(points)[3]


def shapes():
    rng = np.random.default_rng(3)
    yield "continuous", [(float(s), int(s + rng.normal() * 0.3 > 0.5)) for s in rng.random(700)]
    yield "ties", [(float(s) / 7, int(y)) for s, y in zip(rng.integers(0, 8, 500), rng.integers(0, 2, 500), strict=True)]
    yield "separated", [(float(s), int(s > 0.5)) for s in rng.random(300)]
    yield "reversed", [(float(s), int(s < 0.5)) for s in rng.random(300)]
    yield "narrow", [(0.9 + 1e-9 * float(s), int(y)) for s, y in zip(rng.random(400), rng.integers(0, 2, 400), strict=True)] + [(-1e6, 0), (1e6, 1)]
    yield "one score", [(0.3, k % 2) for k in range(50)]
    yield "one class", [(float(s), 1) for s in rng.random(20)]
    yield "two rows", [(0.1, 1), (0.2, 0)]
    yield "endless", [(float("inf"), 1), (float("-inf"), 0), (0.0, 1), (1.0, 0), (5e-324, 1)]


@pytest.mark.parametrize("fine", [2, 512])
def test_ranking_metrics_match_the_whole_curve(spark, monkeypatch, fine):
    monkeypatch.setattr(ranges, "FINE", fine)
    data = dict(shapes())
    df = spark.createDataFrame([(k, s, y) for k, rows in data.items() for s, y in rows], "k string, s double, y int")
    both = [ranges.ranking_metrics(df, ["k"], "s", "y")] + [ranges.ranking_metrics(df.where(F.col("k") == k), ["k"], "s", "y") for k in ("narrow", "endless")]
    for frame in both:
        for r in frame.collect():
            want = brute_ranking(data[r["k"]])
            for got, w in zip((r["roc_auc"], r["average_precision"], r["eer"]), want, strict=True):
                assert (got is None) == (w is None) and (w is None or abs(got - w) < 1e-12), r


def test_ranking_of_nothing_and_null_keys(spark):
    schema = "k string, s double, y int"
    assert ranges.ranking_metrics(spark.createDataFrame([], schema), ["k"], "s", "y").count() == 0
    df = spark.createDataFrame([(None, 0.1, 1), (None, None, 0), (None, 0.4, 0), ("a", None, 1), ("a", None, 0)], schema)
    got = {r["k"]: (r["roc_auc"], r["eer"]) for r in ranges.ranking_metrics(df, ["k"], "s", "y").collect()}
    assert got == {None: (0.5, 0.75), "a": (0.5, 0.5)}  # two points are equally near: the one of the higher threshold


def test_slots_follow_the_order_of_values(spark):
    rng = np.random.default_rng(4)
    x = sorted([float(v) for v in rng.normal(size=3000) ** 5] + [0.0, -0.0, 1e300, -1e300, 5e-324])
    df = spark.createDataFrame([(v,) for v in x], "x double")
    slots = [r["_slot"] for r in ranges.slotted(df, "x", ranges.splitters(df, "x")).orderBy("x").collect()]
    assert slots == sorted(slots) and min(slots) >= 0 and len(set(slots)) > 1000


@pytest.mark.parametrize("small", [0, 10_000])
def test_brackets_give_exact_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL", small)
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=40_000), "ties": rng.integers(0, 5, 30_000) / 3, "heavy": rng.standard_cauchy(25_000), "flat": np.full(20_000, 2.5)}
    if small:
        groups |= {"few": rng.normal(size=3), "one": np.array([7.0])}
    rows = [(k, float(v), None if n % 3 else float(-v)) for k, vs in groups.items() for n, v in enumerate(vs)]
    rows += [("normal", None, None)] + [("nothing", None, None)] * bool(small)
    df = spark.createDataFrame(rows, "k string, x double, z double")
    probs = {"a": ("x", 0.0), "b": ("x", 0.1), "c": ("x", 0.5), "d": ("x", 0.937), "e": ("x", 1.0), "f": ("z", 0.25)}
    got = {r["k"]: r for r in ranges.bracket_stats(df, ["k"], [F.count("*").alias("n")], probs).collect()}
    for k, vs in groups.items():
        sets = {"x": vs, "z": -vs[::3]}
        assert got[k]["n"] == len(vs) + (k == "normal")
        for n, (c, p) in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(sets[c], p), rel=1e-12, abs=1e-12)
    if small:
        assert got["nothing"]["c"] is None and got["nothing"]["n"] == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a19_classification_metrics", "a20_roc_auc", "a22_equal_error_rate", "a23_evaluation_by_group",
                                  "a32_calibration_summary"])
def test_ranking_reads_no_written_copy(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "settled" not in text and "Scan ExistingRDD" not in text and "SortAggregate" not in text


def test_large_groups_are_never_held_for_a_quantile(spark):
    for name in ("a33_score_distribution", "a36_feature_summary", "a38_group_effects", "a35_band_cutpoints"):
        assert " percentile(" not in plan(QUERIES[name](spark, SMALL))
    df = inputs.predictions(spark, SMALL)
    rows = ranges.bracket_stats(df.unionByName(df).unionByName(df), ["task_name"], [], {"m": ("prob", 0.5)})
    assert rows.count() == 3


def test_rows_of_few_groups_are_not_sent_to_one_task_each(spark):
    """The sketches are one row a group and small: they go to the rows, not the rows to them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 100_003 / 2.0).alias("x"))
        out = ranges.bracket_stats(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("x", 0.5)})
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [x for x in lines if "SortMergeJoin" in x and "Inner" in x]  # the last join, of one row a group, is an outer one
        want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
        assert {r["k"]: r["m"] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

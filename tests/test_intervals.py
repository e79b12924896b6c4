"""Interval overlap against all pairs, with wrong and endless times."""

import math

import pytest
from pyspark.sql import functions as F

from echotrail.operators import intervals

INF = float("inf")


def test_overlap_pairs_match_all_pairs(spark):
    seg = [("a", k, k * 25.0 % 977, k * 25.0 % 977 + [4.0, 70.0, 961.0, 3_600.0, 40_000.0][k % 5]) for k in range(150)]
    seg += [("b", 200, 0.0, 1e12), ("b", 201, 5.0, 5.0), ("b", 202, None, 4.0), ("b", 203, float("nan"), 4.0), ("b", 204, 2.0, float("nan")),
            ("b", 205, -INF, INF), ("c", 206, 1e20, 2e20), ("c", 207, -500.0, -100.0), ("d", 208, 0.0, 60.0), ("a", 209, 100.0, INF)]
    ann = [("a", k * 31.0 % 800, k * 31.0 % 800 + [0.5, 61.0, 5_000.0, 200_000.0][k % 4]) for k in range(60)]
    ann += [("a", 10_000.0, 10_000_000.0), ("b", 3.0, 9.0), ("b", 1e11, 1e15), ("b", -INF, 1.0), ("c", 1.5e20, 1.6e20), ("c", -120.0, 0.0),
            ("d", 60.0, 61.0), ("d", 59.0, 1e300), ("e", 0.0, 1.0), ("b", 7.0, 3.0)]
    left = spark.createDataFrame(seg, "r string, id int, start_sec double, end_sec double")
    right = spark.createDataFrame(ann, "r string, ann_start double, ann_end double")
    want = []
    for r, i, s, e in seg:
        for q, a, b in ann:
            if r == q and None not in (s, e) and not any(map(math.isnan, (s, e))) and e > s and b > a and min(e, b) > max(s, a):
                want.append((i, a, b, min(e, b) - max(s, a)))
    got = intervals.overlap_pairs(left, right, "r")
    assert sorted(tuple(x) for x in got.select("id", "ann_start", "ann_end", "overlap_sec").collect()) == sorted(want)


@pytest.mark.parametrize("factor", [1.0, 1e3, 1e12, 1e300])
def test_one_wrong_end_time_makes_few_cells(spark, monkeypatch, factor):
    rows = [("x", k, 10.0 * k, 10.0 * k + 20.0) for k in range(2_000)]
    rows[7] = ("x", 7, 70.0, 90.0 * factor)
    left = spark.createDataFrame(rows, "r string, id int, start_sec double, end_sec double")
    right = spark.createDataFrame([("x", 100.0, 200.0), ("x", 5_000.0, 5_010.0)], "r string, ann_start double, ann_end double")
    seen = []
    explode = F.explode
    monkeypatch.setattr(intervals.F, "explode", lambda c: seen.append(c) or explode(c))
    got = intervals.overlap_pairs(left, right, "r")
    assert {r["id"] for r in got.where("ann_start = 5000").collect()} >= ({7, 499, 500} if factor > 1 else {499, 500})
    level = intervals.level_of(F.col("end_sec") - F.col("start_sec"), 60.0)
    own = left.select(F.size(F.sequence(intervals.cell_at(F.col("start_sec"), level, 60.0), intervals.cell_at(F.col("end_sec"), level, 60.0))).alias("n"))
    assert own.agg(F.max("n")).first()[0] <= intervals.STEP + 1 and len(seen) == 2

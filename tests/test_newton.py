"""Models fitted together by Newton steps against a plain fit of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrail.operators import newton

FEATURES = ["a", "b", "flat", "gone"]


def rows(n=400, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        a, b = float(rng.normal()), float(rng.normal() * 3 + 10)
        y = int(a + 0.2 * b + rng.normal() > 2)
        out.append((k // 4, None if k % 11 == 0 else a, b, 4.0, None, y, k % 3))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "g long, a double, b double, flat double, gone double, y int, part int")


def plain_fit(data, k_best, steps, ridge):
    """The same pipeline on one training list, written out."""
    y = np.array([r[5] for r in data], float)
    cols = {}
    for name, at in (("a", 1), ("b", 2)):
        x = np.array([np.nan if r[at] is None else r[at] for r in data])
        m = np.nanmedian(x)
        x = np.where(np.isnan(x), m, x)
        parts = [x[y == c] for c in (0, 1)]
        between = sum(len(p) * (p.mean() - x.mean()) ** 2 for p in parts)
        within = sum(((p - p.mean()) ** 2).sum() for p in parts)
        cols[name] = (between / (within / (len(x) - 2)), m, x.mean(), x.std(ddof=1), x)
    best = sorted(cols, key=lambda n: -cols[n][0])[:k_best]
    z = np.stack([np.ones(len(y)), *[(cols[n][4] - cols[n][2]) / cols[n][3] for n in best]], 1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, pen = np.zeros(z.shape[1]), np.array([0.0] + [ridge] * len(best))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (w * (p - y)) / len(y) + pen * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z / len(y) + np.diag(pen)
        beta = beta - np.linalg.solve(h, g)
    return best, [cols[n][1:4] for n in best], beta, np.abs(g).max()


@pytest.mark.parametrize("k_best", [1, 2, 4])
def test_models_of_one_scan_equal_models_of_their_own(spark, k_best):
    data = rows()
    masks = {"all": F.lit(True), "0": F.col("part") != 0, "2": F.col("part") != 2}
    odd = [(500, 1.0, 2.0, 4.0, None, None, 0), (501, 1.0, 2.0, 4.0, None, 7, 0), (502, 1.0, 2.0, 4.0, None, 1, None)]
    got = newton.fit(frame(spark, data + odd), FEATURES, "y", masks, k_best)
    for name, keep in (("all", lambda r: True), ("0", lambda r: r[6] not in (0, None)), ("2", lambda r: r[6] not in (2, None))):
        train = [r for r in data + odd if r[5] in (0, 1) and keep(r)]
        best, stats, beta, slope = plain_fit(train, k_best, newton.STEPS, newton.RIDGE)
        m = got[name]
        assert m.features == best  # features that are constant or missing are never chosen
        assert np.allclose(m.weights, beta, rtol=0, atol=1e-9) and slope < 1e-9  # and the steps have converged
        assert np.allclose(list(zip(m.medians, m.means, m.deviations, strict=True)), stats, rtol=1e-12)


def test_held_out_rows_do_not_teach_their_model(spark):
    data = rows()
    keep = ["g", "y"]
    args = (FEATURES, "y", "g", keep, 3, 2, 42)
    first = {(r["g"], r["probability"]) for r in newton.out_of_fold(frame(spark, data), *args).where("fold = 1").collect()}
    folds = {r["g"]: r["fold"] for r in newton.out_of_fold(frame(spark, data), *args).select("g", "fold").distinct().collect()}
    assert len(folds) == 100 and set(folds.values()) == {0, 1, 2}
    # other features of the rows of fold 1 change their scores, not the model: rows left alone keep theirs
    changed = [(*r[:1], None if folds[r[0]] == 1 and k % 2 else r[1], *r[2:]) for k, r in enumerate(data)]
    after = newton.out_of_fold(frame(spark, changed), *args).where("fold = 1").collect()
    same = [r for r in after if any(abs(r["probability"] - p) < 1e-12 for g, p in first if g == r["g"])]
    assert len(after) // 2 <= len(same) < len(after)


def test_no_scan_has_more_sums_than_spark_compiles(spark, monkeypatch):
    plans, agg = [], type(spark.range(1)).agg
    monkeypatch.setattr(type(spark.range(1)), "agg", lambda self, *a: plans.append(agg(self, *a)) or plans[-1])
    masks = {str(k): F.col("part") != k for k in range(3)}
    newton.fit(frame(spark, rows()), ["a", "b", "flat", "g"], "y", masks, 2)
    widths = [plan._jdf.queryExecution().sparkPlan().children().head().output().size() for plan in plans]
    assert len(widths) > newton.STEPS and max(widths) <= 100


def test_folds_group_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    data = rows()
    newton.out_of_fold(frame(spark, data).withColumn("g", count("g")), FEATURES, "y", "g", ["g"], 3, 2, 42).collect()
    assert seen.value == 2 * len(data)


def test_too_few_rows_or_classes_are_refused(spark):
    with pytest.raises(ValueError, match="too few rows"):
        newton.out_of_fold(frame(spark, rows(5)), FEATURES, "y", "g", ["g"], 3, 2, 42)
    with pytest.raises(ValueError, match="lack a class"):
        newton.fit(frame(spark, [(*r[:5], 1, 0) for r in rows(20)]), FEATURES, "y", {"all": F.lit(True)}, 2)


def test_fold_metrics(spark):
    made = [(0, 0.9, 1), (0, 0.2, 0), (0, 0.6, 0), (0, 0.4, 1), (1, 0.7, 1), (1, 0.8, 1), (1, 0.1, 1)]
    got = {r["fold"]: r for r in newton.fold_metrics(spark.createDataFrame(made, "fold int, p double, y int"), "y", "p").collect()}
    zero, one, mean = got["0"], got["1"], got["mean"]
    assert (zero["tn"], zero["fp"], zero["fn"], zero["tp"]) == (1, 1, 1, 1) and zero["accuracy"] == zero["f1"] == 0.5
    assert zero["roc_auc"] == 0.75 and zero["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert zero["brier_score"] == pytest.approx((0.01 + 0.04 + 0.36 + 0.36) / 4)
    assert one["roc_auc"] is None and one["specificity"] is None and one["recall"] == pytest.approx(2 / 3)  # one class
    assert mean["roc_auc"] == 0.75 and mean["recall"] == pytest.approx((0.5 + 2 / 3) / 2) and mean["tp"] == 3
    assert newton.fold_metrics(spark.createDataFrame([], "fold int, p double, y int"), "y", "p").count() == 0

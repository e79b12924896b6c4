"""Logistic models fitted together by Newton steps: one scan of the rows a step, whatever the number of models.

A model is a mask over the rows: a training split, all rows, or all folds but one. Its pipeline is that of the detectors: median
imputation, constant features dropped, standardising, the k features with the largest ANOVA F, balanced class weights and
a ridge penalty. Everything it needs is a sum over its rows, so every scan returns the sums of all models at once, a few
numbers for each feature and model; the rows stay where they are. The number of steps is fixed, hence the coefficients are
defined to the last digits and can be compared with any other engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.operators.metrics import with_rates
from echotrail.operators.ranges import bracket_stats, ranking_metrics
from echotrail.operators.sampling import folds_by_mix, folds_to_use
from echotrail.operators.skew import join_keys, settled

STEPS, RIDGE = 8, 0.01
#: Buffer columns of one aggregation: Spark compiles no aggregation of more than 100 (spark.sql.codegen.maxFields).
BUFFERS = 96


@dataclass
class Linear:
    """A fitted model: its features with their medians, means and deviations, and the weights, the intercept first."""

    features: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    weights: list[float]

    def inputs(self) -> list[Column]:
        parts = zip(self.features, self.medians, self.means, self.deviations, strict=True)
        return [(F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(s) for f, m, a, s in parts]

    def probability(self) -> Column:
        return chance(self.weights, self.inputs())


def chance(weights: Sequence[float], inputs: Sequence[Column]) -> Column:
    line = F.lit(float(weights[0]))
    for w, z in zip(weights[1:], inputs, strict=True):
        line = line + z * float(w)
    return 1 / (1 + F.exp(-line))


def compiled(rows: DataFrame, sums: Sequence[tuple[int, Column]]) -> dict:
    """Values of aggregates, given with their numbers of buffer columns, in as many scans as Spark needs to compile each."""
    scans, width = [[]], 0
    for n, a in sums:
        if width + n > BUFFERS and scans[-1]:
            scans.append([])
            width = 0
        scans[-1].append(a)
        width += n
    return {k: v for scan in scans for k, v in rows.agg(*scan).first().asDict().items()}


def screened(rows: DataFrame, features: Sequence[str], label: str, masks: Sequence[str], k_best: int) -> list[tuple[Linear, list[int]]]:
    """For every mask column the chosen features with their statistics, and the sizes of the two classes."""
    spots = [(i, j) for i in range(len(masks)) for j in range(len(features))]
    values = [F.when(F.col(masks[i]), F.col(features[j]).cast("double")).alias(f"v{i}_{j}") for i, j in spots]
    medians = bracket_stats(rows.select(F.lit("all").alias("scope"), *values), ["scope"], [],
                            {f"m{i}_{j}": (f"v{i}_{j}", 0.5) for i, j in spots}).first()
    known = [(i, j) for i, j in spots if medians is not None and medians[f"m{i}_{j}"] is not None]
    sides = [(i, y, F.col(m) & (F.col(label) == y)) for i, m in enumerate(masks) for y in (0, 1)]
    sums = [(1, F.count_if(side).alias(f"n{i}_{y}")) for i, y, side in sides]
    for i, y, side in sides:
        for j in (j for k, j in known if k == i):
            x = F.when(side, F.coalesce(F.col(features[j]).cast("double"), F.lit(medians[f"m{i}_{j}"])))
            sums += [(2, F.avg(x).alias(f"a{i}_{j}_{y}")), (3, F.var_samp(x).alias(f"s{i}_{j}_{y}"))]
    found = compiled(rows, sums)
    out = []
    for i, m in enumerate(masks):
        n = [found[f"n{i}_{y}"] for y in (0, 1)]
        if not all(n):
            raise ValueError(f"the training rows of model {m} lack a class: {n}")
        rated = []
        for j in (j for k, j in known if k == i):
            a, s = ([found[f"{c}{i}_{j}_{y}"] for y in (0, 1)] for c in "as")
            mean = (n[0] * a[0] + n[1] * a[1]) / sum(n)
            within = sum((c - 1) * (v or 0.0) for c, v in zip(n, s, strict=True))
            between = sum(c * (v - mean) ** 2 for c, v in zip(n, a, strict=True))
            if within + between > 0:
                f = between / (within / (sum(n) - 2)) if within > 0 else float("inf")
                rated.append((-f, j, mean, ((within + between) / (sum(n) - 1)) ** 0.5))
        best = sorted(rated)[:k_best]
        out.append((Linear([features[j] for _, j, _, _ in best], [medians[f"m{i}_{j}"] for _, j, _, _ in best],
                           [a for _, _, a, _ in best], [s for *_, s in best], [0.0] * (len(best) + 1)), n))
    return out


def fit(df: DataFrame, features: Sequence[str], label: str, masks: dict[str, Column], k_best: int,
        steps: int = STEPS, ridge: float = RIDGE) -> dict[str, Linear]:
    """One model for every mask, fitted on the rows where the mask holds; rows without a label 0 or 1 are left out."""
    names = [f"_mask{i}" for i in range(len(masks))]
    known = df.where(F.col(label).isin(0, 1))
    rows = known.select(label, *features, *[F.coalesce(m, F.lit(False)).alias(n) for n, m in zip(names, masks.values(), strict=True)])
    models = screened(rows, features, label, names, k_best)
    y = F.col(label).cast("double")
    wide = rows.select(y.alias("_y"), *[F.when(F.col(n), F.when(F.col(label) == 1, sum(c) / (2 * c[1])).otherwise(sum(c) / (2 * c[0])))
                                        .otherwise(0.0).alias(f"_w{i}") for i, (n, (_, c)) in enumerate(zip(names, models, strict=True))],
                       *[z.alias(f"_z{i}_{j}") for i, (m, _) in enumerate(models) for j, z in enumerate(m.inputs())])
    for _ in range(steps):
        inputs = [[F.col(f"_z{i}_{j}") for j in range(len(m.features))] for i, (m, _) in enumerate(models)]
        # a column of its own for every chance, so that it is worked out once a row
        scan = wide.withColumns({f"_p{i}": chance(m.weights, z) for i, ((m, _), z) in enumerate(zip(models, inputs, strict=True))})
        sums = []
        for i, z in enumerate(inputs):
            w, p, ones = F.col(f"_w{i}"), F.col(f"_p{i}"), [F.lit(1.0), *z]
            sums += [F.sum(w * (p - F.col("_y")) * a).alias(f"g{i}_{j}") for j, a in enumerate(ones)]
            sums += [F.sum(w * p * (1 - p) * a * b).alias(f"h{i}_{j}_{k}") for j, a in enumerate(ones) for k, b in enumerate(ones) if j <= k]
        found = scan.agg(*sums).first()
        for i, (m, c) in enumerate(models):
            d, n = len(m.weights), sum(c)
            penalty = np.array([0.0] + [ridge] * (d - 1))
            slope = np.array([found[f"g{i}_{j}"] for j in range(d)]) / n + penalty * m.weights
            bend = np.array([[found[f"h{i}_{min(j, k)}_{max(j, k)}"] for k in range(d)] for j in range(d)]) / n + np.diag(penalty)
            m.weights = (np.array(m.weights) - np.linalg.solve(bend, slope)).tolist()
    return dict(zip(masks, [m for m, _ in models], strict=True))


def score(model: Linear, df: DataFrame, keep: Sequence[str], threshold: float) -> DataFrame:
    """Probability of class 1 and the decision at a threshold."""
    p = model.probability()
    return df.select(*keep, p.alias("probability")).withColumn("prediction_at_threshold", (F.col("probability") >= threshold).cast("int"))


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, group: str, keep: Sequence[str], folds: int, k_best: int,
                seed: int, threshold: float = 0.5, steps: int = STEPS) -> DataFrame:
    """Held-out predictions (keep, fold, probability, prediction_at_threshold): groups stay whole, and selection and weights are
    fitted inside each fold, all folds in the same scans.

    The number of folds is lowered to the groups of the smallest class; every model must see both classes.
    """
    counts = settled(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n")))  # the rows are grouped once: all about folds is read from it
    folds = folds_to_use(counts, label, folds)
    y = F.col(label).cast("double")
    mix = counts.groupBy(group).agg((F.sum(y * F.col("_n")) / F.sum(F.when(y.isNotNull(), F.col("_n")))).alias("_m"))
    fold = folds_by_mix(mix, group, folds, seed).select(group, "fold")
    data = settled(join_keys(df.select(*dict.fromkeys([*keep, group, label, *features])), fold, [group]))
    models = fit(data, features, label, {str(f): F.col("fold") != f for f in range(folds)}, k_best, steps)
    p = F.coalesce(*[F.when(F.col("fold") == int(f), m.probability()) for f, m in models.items()])
    return data.select(*dict.fromkeys([*keep, "fold"]), p.alias("probability")).withColumn(
        "prediction_at_threshold", (F.col("probability") >= threshold).cast("int"))


def fold_metrics(predictions: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, rates, ranking metrics and Brier score of every fold, and a row `mean` with their unweighted means
    (null metrics are left out of a mean; counts are summed)."""
    x, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    flag = x >= threshold
    cells = {"tn": F.when(flag, 0).otherwise(neg), "fp": F.when(flag, neg).otherwise(0), "fn": F.when(flag, 0).otherwise(pos),
             "tp": F.when(flag, pos).otherwise(0)}
    ranking = ranking_metrics(predictions, ["fold"], score, label, [
        *[F.sum(v).alias(k) for k, v in cells.items()],
        (F.sum(pos * (x - 1) * (x - 1) + neg * x * x) / F.nullif(F.sum(pos + neg), F.lit(0))).alias("brier_score")]).drop("eer")
    rates = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity"]
    numbers = [*rates, "roc_auc", "average_precision", "brier_score"]
    each = with_rates(ranking, rates).select(F.col("fold").cast("string").alias("fold"), *cells, *numbers)
    mean = each.agg(*[F.sum(k).alias(k) for k in cells], *[F.avg(n).alias(n) for n in numbers])
    return each.unionByName(mean.where("tn IS NOT NULL").withColumn("fold", F.lit("mean")))

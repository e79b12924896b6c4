"""Detection metrics from labels and scores: counts, rates, ranking metrics, thresholds.

Labels are 0/1, scores are doubles.  Anything that depends on thresholds is read
off a score histogram, so its cost is rows + buckets, not rows x thresholds.
Ranking metrics are in `ranges`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.operators.ranges import bracket_stats, ranking_metrics
from echotrail.operators.skew import join_keys, settled

COUNTS = ["tn", "fp", "fn", "tp"]


def confusion_counts(truth: Column, predicted: Column) -> list[Column]:
    """TN, FP, FN, TP as aggregates (two-class, 0/1)."""
    return [
        F.count_if((truth == 0) & (predicted == 0)).alias("tn"),
        F.count_if((truth == 0) & (predicted == 1)).alias("fp"),
        F.count_if((truth == 1) & (predicted == 0)).alias("fn"),
        F.count_if((truth == 1) & (predicted == 1)).alias("tp"),
    ]


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0."""
    return F.when(den > 0, num / den)


def rate_columns() -> dict[str, Column]:
    """Rates over columns tn, fp, fn, tp; zero division gives 0 for precision, recall, F1."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": F.coalesce((recall + spec) / 2, recall, spec),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(recall, zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        "specificity": spec,
        "false_positive_rate": ratio(fp, tn + fp),
        "false_negative_rate": ratio(fn, tp + fn),
    }


def with_rates(counts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    rates = rate_columns()
    return counts.select("*", *[rates[n].alias(n) for n in (names or rates)])


def metric_rows(df: DataFrame, scope: str, truth: str, predicted: str,
                scopes: Sequence[str]) -> DataFrame:
    """One metric row per requested scope; a scope without rows has n=0 and null metrics.

    A scope with one class has null balanced accuracy; specificity, FPR and FNR
    divide by at least 1.
    """
    ok = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    counts = ok.groupBy(scope).agg(F.count(F.lit(1)).alias("n"),
                                   *confusion_counts(F.col(truth), F.col(predicted)))
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    one = F.lit(1)
    rates = rate_columns()
    both = (tp + fn > 0) & (tn + fp > 0)
    named = df.sparkSession.createDataFrame([(s,) for s in scopes], f"{scope} string")
    full = F.col("n").isNotNull()
    return named.join(counts, scope, "left").select(
        scope, F.coalesce("n", F.lit(0)).alias("n"), *COUNTS,
        rates["accuracy"].alias("accuracy"),
        F.when(both, rates["balanced_accuracy"]).alias("balanced_accuracy"),
        F.when(full, rates["precision"]).alias("precision"),
        F.when(full, rates["recall"]).alias("recall"),
        F.when(full, tn / F.greatest(tn + fp, one)).alias("specificity"),
        F.when(full, fp / F.greatest(tn + fp, one)).alias("fpr"),
        F.when(full, fn / F.greatest(tp + fn, one)).alias("fnr"),
        F.when(full, rates["f1"]).alias("f1"),
    )


# Threshold grids -----------------------------------------------------------------------


def grid_slot(score: Column, start: int, stop: int, step: int) -> Column:
    """How many grid thresholds (hundredths start..stop) are <= score, exactly.

    The arithmetic guess is corrected against the same doubles k/100 the grid uses.
    """
    count = (stop - start) // step + 1
    guess = F.floor((score * 100 - start) / step)
    at = lambda k: (F.lit(start) + k * step) / F.lit(100.0)
    slot = (F.when(score < at(guess), guess).when(score >= at(guess + 1), guess + 2)
            .otherwise(guess + 1))
    return F.least(F.greatest(slot, F.lit(0)), F.lit(count)).cast("int")


def threshold_counts(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                     start: int, stop: int, step: int) -> DataFrame:
    """TN/FP/FN/TP for every (key, threshold) of the grid; thresholds are hundredths.

    One pass builds a histogram with a bucket per threshold; the grid is its
    reverse cumulative sum (keys x thresholds rows).
    """
    hist = (df.select(*keys, truth, grid_slot(F.col(score), start, stop, step).alias("_slot"))
            .groupBy(*keys, "_slot")
            .agg(F.count_if(F.col(truth) == 1).alias("_pos"),
                 F.count_if(F.col(truth) == 0).alias("_neg")))
    hist = settled(hist)  # keys x thresholds rows
    count = (stop - start) // step + 1
    totals = hist.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("_slot"))
    filled = join_keys(grid, hist, [*keys, "_slot"], "left")
    above = (Window.partitionBy(*keys).orderBy(F.col("_slot").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tp, fp = (F.sum(F.coalesce(c, F.lit(0))).over(above) for c in ("_pos", "_neg"))
    return filled.select(
        *keys, ((F.col("_slot") - 1) * step + start).alias("threshold_pct"),
        tp.alias("tp"), fp.alias("fp"), "_p", "_q",
    ).select(*keys, (F.col("threshold_pct") / F.lit(100.0)).alias("threshold"), "threshold_pct",
             (F.col("_q") - F.col("fp")).alias("tn"), "fp",
             (F.col("_p") - F.col("tp")).alias("fn"), "tp")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recommend_threshold(grid: DataFrame, keys: Sequence[str], max_fpr: float) -> DataFrame:
    """Best balanced accuracy, then F1, among thresholds within the FPR cap.

    Keys with no qualifying threshold keep a row that asks for manual review.
    """
    ok = grid.where(F.col("false_positive_rate") <= max_fpr)
    best = best_row(ok, keys, [F.col("balanced_accuracy").desc(), F.col("f1").desc(),
                               F.col("threshold_pct").asc()])
    out = join_keys(grid.select(*keys).distinct(), best.select(
        *keys, F.col("threshold").alias("recommended_threshold"),
        F.col("false_positive_rate").alias("fpr_at_threshold"),
        F.col("recall").alias("recall_at_threshold"),
        F.col("balanced_accuracy").alias("balanced_accuracy_at_threshold"),
        F.col("f1").alias("f1_at_threshold")), keys, "left")
    return out.withColumn("recommended_use", F.when(
        F.col("recommended_threshold").isNotNull(), "candidate_for_review")
        .otherwise("manual_review_only"))


def choose_by_specificity(grid: DataFrame, keys: Sequence[str], min_spec: float) -> DataFrame:
    """Highest recall among thresholds with enough specificity; all thresholds if none has it."""
    meets = (F.col("specificity") >= min_spec).cast("int")
    return best_row(grid, keys, [meets.desc(), *[F.col(c).desc() for c in (
        "recall", "specificity", "balanced_accuracy", "f1", "threshold_pct")]])


def recall_at_max_fpr(grid: DataFrame, keys: Sequence[str], max_fpr: float) -> DataFrame:
    """Best recall over grid thresholds whose FPR stays within the cap."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    ok = (tn + fp > 0) & (fp / (tn + fp) <= max_fpr)
    return grid.groupBy(*keys).agg(
        F.max(F.when(ok, ratio(tp, tp + fn))).alias("recall_at_max_fpr"))


# Calibration ---------------------------------------------------------------------------


def calibration_bin(score: Column, bins: int) -> Column:
    """Equal-width bin of a score; null outside 0..1."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return F.when((score >= 0) & (score <= 1), reduce(lambda a, b: a + b, [(score >= e).cast("int") for e in edges]))


def calibration_error(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                      bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins; the last bin includes 1."""
    binned = df.where(calibration_bin(F.col(score), bins).isNotNull()).groupBy(
        *keys, calibration_bin(F.col(score), bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"),
        F.sum(F.col(truth).cast("double")).alias("_y"))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    n, s, y, total = (F.col(c) for c in ("_n", "_s", "_y", "_total"))
    return join_keys(binned, totals, keys).groupBy(*keys).agg(
        F.sum(n / total * F.abs(s / n - y / n)).alias("ece"),
        F.sum(s / total).alias("mean_predicted_probability"),
        F.sum(y / total).alias("observed_positive_rate"))


def calibration_summary(df: DataFrame, keys: Sequence[str], score: str,
                        truth: str) -> DataFrame:
    """Brier score, AUC, AP, ECE and confident-error counts per key, in one pass over the distinct scores."""
    x, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    slot = calibration_bin(x, 10)
    n = pos + neg
    known = F.when(x.isNotNull(), n)
    sums = [F.sum(F.when(slot == b, c)).alias(f"_{name}{b}") for b in range(10) for name, c in (
        ("n", n), ("s", x * n), ("y", pos.cast("double")))]
    ranking = ranking_metrics(df, keys, score, truth, [
        F.sum(pos * (x - 1) * (x - 1) + neg * x * x).alias("_squares"), F.sum(known).alias("_known"), F.sum(n).alias("_total"),
        F.sum(F.when(x >= 0.8, neg).otherwise(0)).alias("high_confidence_error_count"),
        F.sum(F.when(x <= 0.2, neg).otherwise(0)).alias("low_confidence_correct_count"), *sums])
    total = F.col("_total")

    def added(part) -> Column:
        """Sum over the bins that hold rows; null if none does."""
        bins = [F.when(F.col(f"_n{b}") > 0, part(F.col(f"_n{b}"), F.col(f"_s{b}"), F.col(f"_y{b}"))) for b in range(10)]
        return F.when(F.coalesce(*bins).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(b, F.lit(0.0)) for b in bins]))

    return ranking.select(
        *keys, (F.col("_squares") / F.col("_known")).alias("brier_score"), "high_confidence_error_count", "low_confidence_correct_count",
        "roc_auc", "average_precision", added(lambda n, s, y: n / total * F.abs(s / n - y / n)).alias("ece"),
        added(lambda n, s, y: s / total).alias("mean_predicted_probability"),
        added(lambda n, s, y: y / total).alias("observed_positive_rate"))


def score_distribution(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """count, min, q10..q90, max, mean and population std per key."""
    return bracket_stats(df, keys, [
        F.count(F.lit(1)).alias("count"), F.min(score).alias("min_probability"),
        F.max(score).alias("max_probability"), F.avg(score).alias("mean_probability"),
        F.stddev_pop(score).alias("std_probability")], {
        f"{name}_probability": (score, p) for name, p in (("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))})


def band_cutpoints(df: DataFrame, keys: Sequence[str], score: str, truth: str,
                   threshold: float) -> DataFrame:
    """Low/medium band edges: q90 of negatives and q25 of positives, with count guards."""
    split = df.select(*keys, truth, F.when(F.col(truth) == 0, F.col(score)).alias("clear_score"),
                      F.when(F.col(truth) == 1, F.col(score)).alias("hit_score"))
    j = bracket_stats(split, keys, [F.count_if(F.col(truth) == 0).alias("neg"), F.count_if(F.col(truth) == 1).alias("pos")],
                      {"q90": ("clear_score", 0.9), "q25": ("hit_score", 0.25)})
    low = F.when(F.col("neg") >= 5, F.col("q90")).otherwise(
        F.greatest(F.lit(0.33), F.lit(threshold * 0.5)))
    medium = F.when((F.col("pos") >= 3) & (F.col("neg") >= 3), F.col("q25")).otherwise(
        F.lit(float(threshold)))
    medium = F.greatest(low + 0.05, F.least(medium, F.lit(0.99)))
    return j.select(*keys, F.round(low, 4).alias("low_max"), F.round(medium, 4).alias("medium_max"),
                    F.round(F.lit(float(threshold)), 4).alias("threshold"))

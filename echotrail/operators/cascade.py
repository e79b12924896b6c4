"""Two-stage detection: a file gate and localized segment evidence, with its grids and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.operators.metrics import ratio
from echotrail.operators.ranges import bracket_stats
from echotrail.operators.skew import by_halves, join_ids, top_rows

PARTIAL = ["ai_fabricated", "human_fabricated"]
DIRECT = ["ai_direct", "human_direct", "human_clean"]
REPLAY = ["ai_replay", "human_replay", "ai_repeat", "human_repeat"]
MIXER = ["ai_mixer", "human_mixer"]

# Cascade parameter grid, accepted thresholds and acceptance limits (fixed values).
GATE_THRESHOLDS = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80]
SEGMENT_THRESHOLDS = [0.50, 0.60, 0.70, 0.80, 0.85, 0.90]
CONTRAST_THRESHOLDS = [0.15, 0.25, 0.35]
BROAD_LIMITS = [0.25, 0.35, 0.45]
ACCEPTED = {"file_gate_threshold": 0.50, "segment_threshold": 0.90,
            "contrast_threshold": 0.25, "broad_limit": 0.45}
BROAD_FLAG = 0.40
ACCEPTANCE = [  # metric, direction, limit, value used when the metric is missing
    ("direct_false_partial_rate", "max", 0.20, 1.0),
    ("replay_false_partial_rate", "max", 0.05, 1.0),
    ("mixer_false_partial_rate", "max", 0.05, 1.0),
    ("broad_activation_rate_when_positive", "max", 0.10, 1.0),
    ("file_gate_threshold", "min", 0.50, 0.0),
]


def segment_profile(seg: DataFrame, key: str, prob: str, order: Sequence[Column],
                    thresholds: Sequence[float], k: int = 5, truth: str | None = None) -> DataFrame:
    """One row per recording: counts over each threshold, max, mean, std, top-k against the rest.

    Missing scores count as 0.  The contrast is rounded to 9 places so the order in
    which partial sums arrive cannot move it across a threshold.
    """
    p = F.coalesce(F.col(prob), F.lit(0.0))
    s = seg.select(key, *order, p.alias("_p"), *([truth] if truth else []))
    return by_halves(s, [key], lambda part, size: _profile(part, key, order, thresholds, k, truth, size))


def _profile(s: DataFrame, key: str, order: Sequence[Column], thresholds: Sequence[float], k: int, truth: str | None, size) -> DataFrame:
    hit = lambda n: F.coalesce(F.max(F.when(F.col("_r") <= n, F.col(truth) == 1)), F.lit(False)).alias(f"top{n}_hit")
    if size is None:
        # one shuffle: number the segments, then aggregate on the same partitioning
        w = Window.partitionBy(key).orderBy(F.col("_p").desc(), *order)
        top = F.col("_r") <= k
        aggs = [F.sum(F.when(top, F.col("_p"))).alias("_topsum"), F.count_if(top).alias("_topn")]
        if truth:
            aggs += [*[hit(n) for n in (1, 3, k)], F.count_if(top & (F.col(truth) == 1)).alias("topk_inside_count")]
        j = s.withColumn("_r", F.row_number().over(w)).groupBy(key).agg(*_profile_aggs(thresholds), *aggs)
        return _contrast(j)
    base = s.groupBy(key).agg(*_profile_aggs(thresholds))
    top = top_rows(s, [key], [F.col("_p").desc(), *order], k, "_r")
    aggs = [F.sum("_p").alias("_topsum"), F.count(F.lit(1)).alias("_topn")]
    if truth:
        aggs += [*[hit(n) for n in (1, 3, k)], F.count_if(F.col(truth) == 1).alias("topk_inside_count")]
    return _contrast(join_ids(base, top.groupBy(key).agg(*aggs), [key]))


def _profile_aggs(thresholds: Sequence[float]) -> list[Column]:
    return [F.count(F.lit(1)).alias("segment_count"), F.max("_p").alias("max_probability"),
            F.avg("_p").alias("mean_probability"), F.stddev_pop("_p").alias("probability_std"),
            F.sum("_p").alias("_sum"), *[F.count_if(F.col("_p") >= t).alias(_high(t)) for t in thresholds]]


def _contrast(j: DataFrame) -> DataFrame:
    rest_n = F.col("segment_count") - F.col("_topn")
    top_mean = F.col("_topsum") / F.col("_topn")
    rest_mean = F.when(rest_n > 0, (F.col("_sum") - F.col("_topsum")) / rest_n)
    return (j.withColumn("topk_mean_probability", top_mean).withColumn("rest_mean_probability", rest_mean)
            .withColumn("topk_minus_rest", F.round(top_mean - F.coalesce(rest_mean, F.lit(0.0)), 9))
            .drop("_sum", "_topsum", "_topn"))


def _high(threshold: float) -> str:
    return f"high_{round(threshold * 100)}"


def high_fraction(threshold: float) -> Column:
    return F.col(_high(threshold)) / F.col("segment_count")


def cascade_rule(gate: Column, th: dict[str, float] | None = None) -> dict[str, Column]:
    """The cascade's flags over a profile row; recordings without segments are never positive."""
    th = th or ACCEPTED
    frac = high_fraction(th["segment_threshold"])
    known = lambda c: F.coalesce(c, F.lit(False))
    gate_ok = known(gate >= th["file_gate_threshold"])
    has_high = known(F.col(_high(th["segment_threshold"])) > 0)
    contrast = known(F.col("topk_minus_rest") >= th["contrast_threshold"])
    return {
        "file_gate_positive": gate_ok, "segment_threshold_positive": has_high,
        "high_segment_fraction": frac, "contrast_positive": contrast,
        "partial_evidence_positive": gate_ok & has_high & known(frac <= th["broad_limit"]) & contrast,
        "broad_activation_flag": known(frac >= BROAD_FLAG),
    }


def _slot(value: Column, levels: Sequence[float]) -> Column:
    """How many ascending levels are <= value."""
    return reduce(lambda a, b: a + b, [F.coalesce(value >= v, F.lit(False)).cast("int") for v in levels])


def cascade_grid(profiles: DataFrame, gate: str, category: str,
                 gates: Sequence[float] = GATE_THRESHOLDS, segs: Sequence[float] = SEGMENT_THRESHOLDS,
                 contrasts: Sequence[float] = CONTRAST_THRESHOLDS,
                 broads: Sequence[float] = BROAD_LIMITS) -> DataFrame:
    """Rates of the cascade for every parameter combination.

    Recordings are first reduced to a histogram over (category, which thresholds they
    reach); only that small histogram is spread over the combinations it passes.
    """
    cat = F.col(category)
    broad_slot = lambda frac: reduce(lambda a, b: a + b, [F.coalesce(frac > b, F.lit(True)).cast("int") for b in broads])
    per_seg = F.array(*[F.struct(
        F.lit(i + 1).alias("si"), broad_slot(high_fraction(t)).alias("bs"),
        F.coalesce(F.col(_high(t)) > 0, F.lit(False)).alias("hh")) for i, t in enumerate(segs)])
    hits = ["top1_hit", "top3_hit", "top5_hit"]
    hist = (profiles.select(
        cat.alias("cat"), _slot(F.col(gate), gates).alias("gs"),
        _slot(F.col("topk_minus_rest"), contrasts).alias("cs"),
        *[F.coalesce(h, F.lit(False)).alias(h) for h in hits], F.explode(per_seg).alias("s"))
        .where(F.col("s.hh")).groupBy("cat", "gs", "cs", "s.si", "s.bs", *hits)
        .agg(F.count(F.lit(1)).alias("n")))
    upto = lambda c: F.explode(F.sequence(F.lit(1), F.col(c)))
    passed = (hist.where((F.col("gs") > 0) & (F.col("cs") > 0) & (F.col("bs") < len(broads)))
              .withColumn("gi", upto("gs")).withColumn("ci", upto("cs"))
              .withColumn("bi", F.explode(F.sequence(F.col("bs") + 1, F.lit(len(broads))))))
    is_partial = F.col("cat").isin(PARTIAL)
    n = F.col("n")
    count = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    pos = passed.groupBy("gi", "si", "ci", "bi").agg(
        count(is_partial).alias("p_partial"), count(~is_partial).alias("p_other"),
        count(F.col("cat").isin(DIRECT)).alias("p_direct"), count(F.col("cat").isin(REPLAY)).alias("p_replay"),
        count(F.col("cat").isin(MIXER)).alias("p_mixer"),
        *[count(is_partial & F.col(h)).alias(f"p_{h}") for h in hits])
    totals = profiles.groupBy(cat.alias("cat")).agg(F.count(F.lit(1)).alias("n")).agg(
        count(is_partial).alias("t_partial"), count(~is_partial).alias("t_other"),
        count(F.col("cat").isin(DIRECT)).alias("t_direct"), count(F.col("cat").isin(REPLAY)).alias("t_replay"),
        count(F.col("cat").isin(MIXER)).alias("t_mixer"))
    # one totals row carries the whole parameter grid
    levels = lambda name, vals: F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(vals)])).alias(name)
    grid = totals.select("*", levels("g", gates)).select("*", levels("s", segs)) \
        .select("*", levels("c", contrasts)).select("*", levels("b", broads)) \
        .select("*", F.col("g.i").alias("gi"), F.col("s.i").alias("si"), F.col("c.i").alias("ci"), F.col("b.i").alias("bi"))
    j = join_ids(grid, pos, ["gi", "si", "ci", "bi"], "left")
    got = lambda c: F.coalesce(F.col(c), F.lit(0))
    pp = got("p_partial")
    return j.select(
        F.col("g.v").alias("file_gate_threshold"), F.col("s.v").alias("segment_threshold"),
        F.col("c.v").alias("contrast_threshold"), F.col("b.v").alias("broad_limit"),
        ratio(pp, F.col("t_partial")).alias("partial_file_recall"),
        ratio(got("p_other"), F.col("t_other")).alias("non_partial_false_alarm_rate"),
        ratio(got("p_direct"), F.col("t_direct")).alias("direct_false_partial_rate"),
        ratio(got("p_replay"), F.col("t_replay")).alias("replay_false_partial_rate"),
        ratio(got("p_mixer"), F.col("t_mixer")).alias("mixer_false_partial_rate"),
        *[ratio(got(f"p_{h}"), pp).alias(f"{h}_rate_when_positive") for h in hits],
        # a positive recording is within the broad limit by rule
        F.when(pp > 0, F.lit(0.0)).alias("broad_activation_rate_when_positive"),
        pp.alias("gated_partial_file_count"))


def acceptance_failures(limits=ACCEPTANCE) -> Column:
    """Texts of the limits a metric row breaks."""
    checks = []
    for name, way, limit, missing in limits:
        v = F.coalesce(F.col(name), F.lit(missing))
        bad = v > limit if way == "max" else v < limit
        sign = ">" if way == "max" else "<"
        checks.append(F.when(bad, F.format_string(f"{name} %.4f {sign} {limit:.4f}", F.bround(v, 4))))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def candidate_score() -> Column:
    part = lambda w, c: w * F.coalesce(F.col(c), F.lit(0.0))
    return F.round(part(0.35, "partial_file_recall") + part(0.30, "top5_hit_rate_when_positive")
                   - part(0.20, "non_partial_false_alarm_rate") - part(0.15, "direct_false_partial_rate"), 9)


GRID_ORDER = ["file_gate_threshold", "segment_threshold", "contrast_threshold", "broad_limit"]


def recommend(grid: DataFrame) -> DataFrame:
    """The feasible combination with the best score; no row when none is feasible."""
    scored = grid.withColumn("candidate_score", candidate_score()).withColumn(
        "failures", acceptance_failures())
    return (scored.where(F.size("failures") == 0)
            .orderBy(F.col("candidate_score").desc(), *GRID_ORDER).limit(1).drop("failures"))


def acceptance_diagnostics(grid: DataFrame) -> DataFrame:
    """Minima over the grid, best recall among rows safe on replay, mixer and breadth, best accepted score."""
    safe = reduce(lambda a, b: a & b, [F.coalesce(F.col(n) <= lim, F.lit(False)) for n, way, lim, _ in ACCEPTANCE
                                       if n.startswith(("replay", "mixer", "broad"))])
    ok = F.size(acceptance_failures()) == 0
    return grid.withColumn("_score", candidate_score()).agg(
        F.min("direct_false_partial_rate").alias("min_direct_false_partial_rate"),
        F.min("non_partial_false_alarm_rate").alias("min_non_partial_false_alarm_rate"),
        F.max(F.when(safe, F.col("partial_file_recall"))).alias("best_recall_safe"),
        F.count_if(ok).alias("passing_count"), F.max(F.when(ok, F.col("_score"))).alias("best_accepted_score"),
        (F.count_if(ok) == 0).alias("manual_review_only"))


# Hold-out metrics and diagnostics ------------------------------------------------------


def rate(cond: Column, flag: Column) -> Column:
    """Mean of a flag over rows where cond holds; null when none does."""
    return F.avg(F.when(cond, flag.cast("int")))


def failed_gates(gate: Column, th: dict[str, float] | None = None) -> Column:
    """Names of the gates a recording fails, in checking order."""
    th = th or ACCEPTED
    return F.filter(F.array(
        F.when(gate < th["file_gate_threshold"], "file_gate_miss"),
        F.when(F.col("max_probability") < th["segment_threshold"], "segment_threshold_miss"),
        F.when(high_fraction(th["segment_threshold"]) > th["broad_limit"], "broad_activation_block"),
        F.when(F.col("topk_minus_rest") < th["contrast_threshold"], "contrast_miss")), lambda x: x.isNotNull())


def near_misses(gate: Column, th: dict[str, float] | None = None) -> Column:
    """Gates missed by at most 0.10."""
    th = th or ACCEPTED
    near = lambda margin: (F.round(margin, 9) >= -0.10) & (margin < 0)
    return F.array_join(F.filter(F.array(
        F.when(near(gate - th["file_gate_threshold"]), "near_file_gate"),
        F.when(near(F.col("max_probability") - th["segment_threshold"]), "near_segment_threshold"),
        F.when(near(F.col("topk_minus_rest") - th["contrast_threshold"]), "near_contrast"),
        F.when(near(th["broad_limit"] - high_fraction(th["segment_threshold"])), "near_broad_limit")),
        lambda x: x.isNotNull()), ";")


def relaxed_thresholds(gate: Column) -> dict[str, Column]:
    """The threshold each failed gate would need for this recording to pass it."""
    frac = high_fraction(ACCEPTED["segment_threshold"])
    return {
        "required_file_gate": F.least(gate, F.lit(ACCEPTED["file_gate_threshold"])),
        "required_segment": F.least(F.col("max_probability"), F.lit(ACCEPTED["segment_threshold"])),
        "required_contrast": F.least(F.col("topk_minus_rest"), F.lit(ACCEPTED["contrast_threshold"])),
        "required_broad_limit": F.greatest(frac, F.lit(ACCEPTED["broad_limit"])),
    }


def outcome_distribution(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """count and median/min/max of the cascade's numbers per outcome group."""
    return bracket_stats(df, [group], [
        F.count(F.lit(1)).alias("count"), *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns]], {f"median_{c}": (c, 0.5) for c in columns})

"""Pooling segments to files, the two-stage cascade, its grids, gates and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.operators import cascade as C
from echotrail.operators import localize as Z
from echotrail.operators.metrics import best_row, ratio
from echotrail.operators.profile import issue_rows
from echotrail.operators.ranges import bracket_stats
from echotrail.operators.skew import (
    group_medians, join_ids, numbered, running, settled, top_rows,
)
from echotrail.plans import inputs as I
from echotrail.plans.localization_queries import RANGES
from echotrail.plans.metric_queries import rounded
from echotrail.plans.registry import query
from echotrail.plans.window_queries import SEG

c = F.col
ORDER = ["start_sec", "segment_id"]
G = f"WITH g AS ({I.SEGMENTS_SQL})"
RK = "rk AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, start_sec, segment_id) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM g)"


@query("a45_file_probability", f"WITH p AS ({I.PREDICTIONS_SQL}) SELECT task_name, feature_set, file_id, round(avg(prob), 6) AS probability FROM p GROUP BY ALL")
def file_probability(spark, sf):
    return I.predictions(spark, sf).groupBy("task_name", "feature_set", "file_id").agg(F.round(F.avg("prob"), 6).alias("probability"))


@query("a46_pooled_probability", f"""{G}, {RK} SELECT file_id, count(*) AS n_segments, max(prob) AS max_probability, round(avg(prob) FILTER (r <= 3), 6) AS top3_mean, round(1 - product(1 - least(1, greatest(0, prob * 0.9731::DOUBLE + 0.0117::DOUBLE))), 6) AS noisy_or FROM rk GROUP BY file_id""")
def pooled_probability(spark, sf):
    s = I.segments(spark, sf)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("prob") * 0.9731 + 0.0117))
    base = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("prob").alias("max_probability"),
                                    F.round(1 - F.product(1 - p), 6).alias("noisy_or"))
    top = top_rows(s, ["file_id"], [c("prob").desc(), *ORDER], 3, "_r").groupBy("file_id").agg(F.round(F.avg("prob"), 6).alias("top3_mean"))
    return join_ids(base, top, ["file_id"])


@query("a47_trimmed_mean", f"""{G}, {RK}, t AS (SELECT *, CAST(round_even(n * 0.1, 0) AS BIGINT) AS k FROM (SELECT file_id, prob, n, row_number() OVER (PARTITION BY file_id ORDER BY prob, start_sec, segment_id) AS r FROM rk))
SELECT file_id, round(avg(CASE WHEN k = 0 OR n <= 2 * k OR (r > k AND r <= n - k) THEN prob END), 6) AS trimmed_mean FROM t GROUP BY file_id""")
def trimmed_mean(spark, sf):
    s = I.segments(spark, sf)
    pos = numbered(s, ["file_id"], [c("prob").asc(), *ORDER], "r")
    n = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.bround(c("n") * 0.1, 0).cast("long")
    keep = (k == 0) | (c("n") <= 2 * k) | ((c("r") > k) & (c("r") <= c("n") - k))
    return join_ids(pos, n, ["file_id"]).groupBy("file_id").agg(F.round(F.avg(F.when(keep, c("prob"))), 6).alias("trimmed_mean"))


@query("a48_median_vector", f"{G} SELECT file_id, " + ", ".join(f"round(quantile_cont({k}, 0.5), 6) AS median_{k}" for k in I.FEATURES) + " FROM g GROUP BY file_id")
def median_vector(spark, sf):
    return rounded(group_medians(I.segments(spark, sf), ["file_id"], I.FEATURES, "median_"))


PROF = f"""{SEG}, {RK}, pr AS (SELECT file_id, count(*) AS segment_count, max(prob) AS mx, avg(prob) AS mean_p, stddev_pop(prob) AS sd, quantile_cont(prob, 0.5) AS med, {', '.join(f'count(*) FILTER (prob >= {t}) AS h{round(t * 100)}' for t in C.SEGMENT_THRESHOLDS)},
  count(*) FILTER (prob >= 0.55) AS h55, avg(prob) FILTER (r <= 5) AS tk, avg(prob) FILTER (r > 5) AS rest, round(avg(prob) FILTER (r <= 5) - coalesce(avg(prob) FILTER (r > 5), 0), 9) AS contrast,
  coalesce(bool_or(y_true = 1) FILTER (r <= 1), false) AS hit1, coalesce(bool_or(y_true = 1) FILTER (r <= 3), false) AS hit3, coalesce(bool_or(y_true = 1) FILTER (r <= 5), false) AS hit5 FROM rk GROUP BY file_id)"""


def profile(spark, sf, thresholds=C.SEGMENT_THRESHOLDS):
    return C.segment_profile(I.segments(spark, sf), "file_id", "prob", ORDER, thresholds, 5, "y_true")


@query("a49_segment_profile", f"""{PROF} SELECT file_id, segment_count, h55 AS high_segment_count, round(h55 / segment_count, 6) AS high_segment_fraction, round(mx, 6) AS max_segment_probability, round(mean_p, 6) AS mean_segment_probability,
  round(med, 6) AS median_segment_probability, round(tk, 6) AS top_k_mean_probability, round(coalesce(rest, 0), 6) AS rest_mean_probability, round(contrast, 6) AS topk_minus_rest_probability, round(sd, 6) AS probability_std, round(contrast + sd, 6) AS localized_pattern_score FROM pr""")
def segment_profile(spark, sf):
    p = profile(spark, sf, [0.55])
    med = group_medians(I.segments(spark, sf), ["file_id"], ["prob"], "_med_").withColumnRenamed("_med_prob", "_med")
    j = join_ids(p, med, ["file_id"])
    return j.select("file_id", "segment_count", c("high_55").alias("high_segment_count"), F.round(C.high_fraction(0.55), 6).alias("high_segment_fraction"),
                    F.round("max_probability", 6).alias("max_segment_probability"), F.round("mean_probability", 6).alias("mean_segment_probability"),
                    F.round("_med", 6).alias("median_segment_probability"), F.round("topk_mean_probability", 6).alias("top_k_mean_probability"),
                    F.round(F.coalesce("rest_mean_probability", F.lit(0.0)), 6).alias("rest_mean_probability"),
                    F.round("topk_minus_rest", 6).alias("topk_minus_rest_probability"), F.round("probability_std", 6).alias("probability_std"),
                    F.round(c("topk_minus_rest") + c("probability_std"), 6).alias("localized_pattern_score"))


def profiled_files(spark, sf, how="left"):
    return join_ids(I.files(spark, sf), profile(spark, sf), ["file_id"], how)


# looser than the accepted thresholds, so that a share of the test recordings is positive
LOOSE = {"file_gate_threshold": 0.50, "segment_threshold": 0.80, "contrast_threshold": 0.15, "broad_limit": 0.45}
RULE = """ru AS (SELECT f.*, pr.* EXCLUDE (file_id), gate_prob >= 0.5 AS gate_ok, coalesce(h80 > 0, false) AS high_ok, h80 / segment_count AS hf, coalesce(contrast >= 0.15, false) AS contrast_ok,
  gate_prob >= 0.5 AND coalesce(h80 > 0, false) AND coalesce(h80 / segment_count <= 0.45, false) AND coalesce(contrast >= 0.15, false) AS pos, coalesce(h80 / segment_count >= 0.4, false) AS broad FROM f LEFT JOIN pr USING (file_id))"""


def ruled_files(spark, sf):
    flags = C.cascade_rule(c("gate_prob"), LOOSE)
    return profiled_files(spark, sf).select("*", *[v.alias(k) for k, v in flags.items()])


@query("a50_cascade_rule", f"{PROF}, {RULE} SELECT file_id, gate_ok AS file_gate_positive, high_ok AS segment_threshold_positive, round(hf, 6) AS high_segment_fraction, contrast_ok AS contrast_positive, pos AS partial_evidence_positive, broad AS broad_activation_flag FROM ru")
def cascade_rule(spark, sf):
    return rounded(ruled_files(spark, sf).select("file_id", "file_gate_positive", "segment_threshold_positive", "high_segment_fraction",
                                                 "contrast_positive", "partial_evidence_positive", "broad_activation_flag"))


def values(name, xs):
    return f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in xs)}) {name}(v)"


PARTIAL = "('ai_fabricated', 'human_fabricated')"
GRID = f"""{PROF}, sg AS (SELECT f.file_id, file_category AS cat, gate_prob, contrast, hit1, hit3, hit5, t.st, t.h, segment_count FROM f LEFT JOIN pr USING (file_id), LATERAL (VALUES {', '.join(f'({t}::DOUBLE, h{round(t * 100)})' for t in C.SEGMENT_THRESHOLDS)}) t(st, h)),
gr AS (SELECT gt.v AS file_gate_threshold, st AS segment_threshold, ct.v AS contrast_threshold, bl.v AS broad_limit, cat, hit1, hit3, hit5,
  coalesce(gate_prob >= gt.v AND h > 0 AND h / segment_count <= bl.v AND contrast >= ct.v, false) AS pos FROM sg, {values('gt', C.GATE_THRESHOLDS)}, {values('ct', C.CONTRAST_THRESHOLDS)}, {values('bl', C.BROAD_LIMITS)}),
grid AS (SELECT file_gate_threshold, segment_threshold, contrast_threshold, broad_limit, avg(pos::INT) FILTER (cat IN {PARTIAL}) AS partial_file_recall, avg(pos::INT) FILTER (cat NOT IN {PARTIAL}) AS non_partial_false_alarm_rate,
  avg(pos::INT) FILTER (cat = 'ai_direct') AS direct_false_partial_rate, avg(pos::INT) FILTER (cat = 'ai_replay') AS replay_false_partial_rate, avg(pos::INT) FILTER (cat = 'ai_mixer') AS mixer_false_partial_rate,
  avg(hit1::INT) FILTER (pos AND cat IN {PARTIAL}) AS top1_hit_rate_when_positive, avg(hit3::INT) FILTER (pos AND cat IN {PARTIAL}) AS top3_hit_rate_when_positive, avg(hit5::INT) FILTER (pos AND cat IN {PARTIAL}) AS top5_hit_rate_when_positive,
  CASE WHEN count(*) FILTER (pos AND cat IN {PARTIAL}) > 0 THEN 0::DOUBLE END AS broad_activation_rate_when_positive, count(*) FILTER (pos AND cat IN {PARTIAL}) AS gated_partial_file_count FROM gr GROUP BY ALL)"""
RATES = ["partial_file_recall", "non_partial_false_alarm_rate", "direct_false_partial_rate", "replay_false_partial_rate", "mixer_false_partial_rate",
         "top1_hit_rate_when_positive", "top3_hit_rate_when_positive", "top5_hit_rate_when_positive", "broad_activation_rate_when_positive"]


def cascade_grid_frame(spark, sf):
    return C.cascade_grid(profiled_files(spark, sf), "gate_prob", "file_category")


@query("a51_cascade_grid", GRID + " SELECT file_gate_threshold, segment_threshold, contrast_threshold, broad_limit, " + ", ".join(f"round({r}, 6) AS {r}" for r in RATES) + ", gated_partial_file_count FROM grid")
def cascade_grid(spark, sf):
    return rounded(cascade_grid_frame(spark, sf))


def fail_sql():
    out = []
    for name, way, limit, missing in C.ACCEPTANCE:
        v = f"coalesce({name}, {missing})"
        sign = ">" if way == "max" else "<"
        out.append(f"CASE WHEN {v} {sign} {limit} THEN printf('{name} %.4f {sign} {limit:.4f}', {v}::DOUBLE) END")
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


SCORE = """round(0.35::DOUBLE * coalesce(partial_file_recall, 0) + 0.30::DOUBLE * coalesce(top5_hit_rate_when_positive, 0) - 0.20::DOUBLE * coalesce(non_partial_false_alarm_rate, 0) - 0.15::DOUBLE * coalesce(direct_false_partial_rate, 0), 9)"""
ACC = GRID + f", ac AS (SELECT *, {fail_sql()} AS fl, {SCORE} AS candidate_score FROM grid)"


@query("a52_cascade_acceptance", ACC + " SELECT file_gate_threshold, segment_threshold, contrast_threshold, broad_limit, len(fl) = 0 AS accepted, array_to_string(fl, '; ') AS failures FROM ac")
def cascade_acceptance(spark, sf):
    g = cascade_grid_frame(spark, sf).withColumn("_f", C.acceptance_failures())
    return g.select(*C.GRID_ORDER, (F.size("_f") == 0).alias("accepted"), F.array_join("_f", "; ").alias("failures"))


@query("a53_cascade_recommendation", ACC + " SELECT file_gate_threshold, segment_threshold, contrast_threshold, broad_limit, round(candidate_score, 6) AS candidate_score, round(partial_file_recall, 6) AS partial_file_recall FROM ac WHERE len(fl) = 0 ORDER BY ac.candidate_score DESC, file_gate_threshold, segment_threshold, contrast_threshold, broad_limit LIMIT 1")
def cascade_recommendation(spark, sf):
    return rounded(C.recommend(cascade_grid_frame(spark, sf)).select(*C.GRID_ORDER, "candidate_score", "partial_file_recall"))


@query("a84_acceptance_diagnostics", ACC + """ SELECT round(min(direct_false_partial_rate), 6) AS min_direct_false_partial_rate, round(min(non_partial_false_alarm_rate), 6) AS min_non_partial_false_alarm_rate,
  round(max(partial_file_recall) FILTER (replay_false_partial_rate <= 0.05 AND mixer_false_partial_rate <= 0.05 AND broad_activation_rate_when_positive <= 0.10), 6) AS best_recall_safe,
  count(*) FILTER (len(fl) = 0) AS passing_count, round(max(candidate_score) FILTER (len(fl) = 0), 6) AS best_accepted_score, count(*) FILTER (len(fl) = 0) = 0 AS manual_review_only FROM ac""")
def acceptance_diagnostics(spark, sf):
    return rounded(C.acceptance_diagnostics(cascade_grid_frame(spark, sf)))


# Hold-out evaluation -------------------------------------------------------------------

HOLD = f"""{PROF}, {RULE}, cs AS (SELECT file_id, start_sec AS cs, end_sec AS ce, prob AS cp FROM rk WHERE r = 1),
h AS (SELECT ru.*, cs, ce, cp, CASE WHEN ru.file_id % 101 = 0 THEN 'load_failure' ELSE 'ok' END AS error_status, (file_category IN {PARTIAL})::INT AS expected,
  CASE file_category WHEN 'ai_direct' THEN 'direct' WHEN 'ai_replay' THEN 'replay' WHEN 'ai_mixer' THEN 'mixer' ELSE 'partial' END AS cond, CASE WHEN file_category = 'human_fabricated' THEN 'fabricated_20pct' ELSE 'testing' END AS test_group,
  region_end IS NOT NULL AS has_ts, CASE WHEN region_end IS NOT NULL AND cs IS NOT NULL THEN abs((cs + ce) / 2 - (region_start + region_end) / 2) END AS ts_error FROM ru LEFT JOIN cs ON cs.file_id = ru.file_id)"""


def holdout(spark, sf):
    top = top_rows(I.segments(spark, sf), ["file_id"], [c("prob").desc(), *ORDER], 1, "_r").select(
        "file_id", c("start_sec").alias("candidate_start"), c("end_sec").alias("candidate_end"), c("prob").alias("candidate_probability"))
    j = join_ids(ruled_files(spark, sf), top, ["file_id"], "left")
    cat = c("file_category")
    err = F.abs((c("candidate_start") + c("candidate_end")) / 2 - (c("region_start") + c("region_end")) / 2)
    return (j.withColumn("error_status", F.when(c("file_id") % 101 == 0, "load_failure").otherwise("ok"))
            .withColumn("expected", cat.isin(C.PARTIAL).cast("int"))
            .withColumn("condition", F.when(cat == "ai_direct", "direct").when(cat == "ai_replay", "replay").when(cat == "ai_mixer", "mixer").otherwise("partial"))
            .withColumn("test_group", F.when(cat == "human_fabricated", "fabricated_20pct").otherwise("testing"))
            .withColumn("has_timestamp", c("region_end").isNotNull()).withColumn("timestamp_error", err))


@query("f21_timestamp_error", f"{HOLD} SELECT file_id, round(ts_error, 6) AS timestamp_error FROM h")
def timestamp_error(spark, sf):
    return rounded(holdout(spark, sf).select("file_id", "timestamp_error"))


HM = """count(*) AS total_files, count(*) FILTER (error_status = 'ok') AS evaluated_files, count(*) FILTER (error_status <> 'ok') AS failed_files, count(*) FILTER (error_status = 'ok' AND expected = 1) AS partial_file_count,
  round(avg(pos::INT) FILTER (error_status = 'ok' AND expected = 1), 6) AS partial_evidence_recall, round(avg(pos::INT) FILTER (error_status = 'ok' AND expected = 0), 6) AS non_partial_false_alarm_rate,
  round(avg(pos::INT) FILTER (error_status = 'ok' AND cond = 'direct'), 6) AS direct_false_partial_rate, round(avg(pos::INT) FILTER (error_status = 'ok' AND cond = 'replay'), 6) AS replay_false_partial_rate,
  round(avg(pos::INT) FILTER (error_status = 'ok' AND cond = 'mixer'), 6) AS mixer_false_partial_rate, round(avg(pos::INT) FILTER (error_status = 'ok' AND cond = 'unknown'), 6) AS unknown_condition_positive_rate,
  count(*) FILTER (error_status = 'ok' AND pos) AS positive_file_count, round(avg(broad::INT) FILTER (error_status = 'ok' AND pos), 6) AS broad_activation_rate_when_positive,
  round(avg(hit1::INT) FILTER (error_status = 'ok' AND pos AND has_ts), 6) AS top1_hit_rate_when_positive, round(avg(hit3::INT) FILTER (error_status = 'ok' AND pos AND has_ts), 6) AS top3_hit_rate_when_positive,
  round(avg(hit5::INT) FILTER (error_status = 'ok' AND pos AND has_ts), 6) AS top5_hit_rate_when_positive, count(*) FILTER (error_status = 'ok' AND pos AND has_ts) AS timestamp_positive_count,
  round(quantile_cont(CASE WHEN error_status = 'ok' AND pos AND has_ts THEN ts_error END, 0.5), 6) AS median_timestamp_error,
  round(avg(pos::INT) FILTER (error_status = 'ok' AND test_group = 'fabricated_20pct'), 6) AS new_partial_recall, count(*) FILTER (error_status = 'ok' AND test_group = 'fabricated_20pct' AND NOT pos) AS new_partial_false_negative_count"""


def holdout_metrics_frame(spark, sf):
    ok, pos, exp = c("error_status") == "ok", c("partial_evidence_positive"), c("expected") == 1
    h = holdout(spark, sf).withColumn("scope", F.lit("all")).withColumn("_err", F.when(ok & pos & c("has_timestamp"), c("timestamp_error")))
    r = C.rate
    stamped = ok & pos & c("has_timestamp")
    new = ok & (c("test_group") == "fabricated_20pct")
    m = bracket_stats(settled(h), ["scope"], [
        F.count(F.lit(1)).alias("total_files"), F.count_if(ok).alias("evaluated_files"), F.count_if(~ok).alias("failed_files"),
        F.count_if(ok & exp).alias("partial_file_count"), r(ok & exp, pos).alias("partial_evidence_recall"), r(ok & ~exp, pos).alias("non_partial_false_alarm_rate"),
        *[r(ok & (c("condition") == k), pos).alias(n) for k, n in (("direct", "direct_false_partial_rate"), ("replay", "replay_false_partial_rate"),
                                                                 ("mixer", "mixer_false_partial_rate"), ("unknown", "unknown_condition_positive_rate"))],
        F.count_if(ok & pos).alias("positive_file_count"), r(ok & pos, c("broad_activation_flag")).alias("broad_activation_rate_when_positive"),
        *[r(stamped, c(f"top{n}_hit")).alias(f"top{n}_hit_rate_when_positive") for n in (1, 3, 5)],
        F.count_if(stamped).alias("timestamp_positive_count"), r(new, pos).alias("new_partial_recall"), F.count_if(new & ~pos).alias("new_partial_false_negative_count")], {"median_timestamp_error": ("_err", 0.5)})
    return rounded(m.drop("scope"))


@query("a55_holdout_metrics", f"{HOLD} SELECT {HM} FROM h")
def holdout_metrics(spark, sf):
    return holdout_metrics_frame(spark, sf)


# Release gates: metric, direction, limit (fixed values).
GATES = [("failed_files", "max", 0.0), ("partial_file_count", "min", 5.0), ("timestamp_positive_count", "min", 5.0), ("direct_false_partial_rate", "max", 0.20),
         ("replay_false_partial_rate", "max", 0.05), ("mixer_false_partial_rate", "max", 0.05), ("partial_evidence_recall", "min", 0.65), ("non_partial_false_alarm_rate", "max", 0.20),
         ("broad_activation_rate_when_positive", "max", 0.10), ("top5_hit_rate_when_positive", "min", 0.80), ("new_partial_recall", "min", 0.80),
         ("new_partial_false_negative_count", "max", 0.0), ("unknown_condition_positive_rate", "max", 0.20)]
GATE_VALUES = ", ".join(f"('{n}', '{w}', {lim}::DOUBLE, {n}::DOUBLE)" for n, w, lim in GATES)


@query("a54_release_gates", f"""{HOLD}, m AS (SELECT {HM} FROM h) SELECT g.criterion, g.value, g.limit_value, CASE WHEN g.value IS NULL THEN false WHEN g.way = 'max' THEN g.value <= g.limit_value ELSE g.value >= g.limit_value END AS passed,
  CASE WHEN g.value IS NULL THEN 'unavailable' WHEN g.way = 'max' AND g.value > g.limit_value THEN 'above limit' WHEN g.way = 'min' AND g.value < g.limit_value THEN 'below limit' ELSE '' END AS reason FROM m, LATERAL (VALUES {GATE_VALUES}) g(criterion, way, limit_value, value)""")
def release_gates(spark, sf):
    return check_limits(holdout_metrics_frame(spark, sf), GATES)


def check_limits(metrics, gates):
    """One row per criterion: value, limit, passed and why not; a missing metric fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(w).alias("way"), F.lit(float(lim)).alias("limit_value"),
                              c(n).cast("double").alias("value")) for n, w, lim in gates])
    v, lim, top = c("value"), c("limit_value"), c("way") == "max"
    ok = F.coalesce(F.when(top, v <= lim).otherwise(v >= lim), F.lit(False))
    return metrics.select(F.explode(rows).alias("g")).select("g.*").select(
        "criterion", "value", "limit_value", ok.alias("passed"),
        F.when(v.isNull(), "unavailable").when(ok, "").when(top, "above limit").otherwise("below limit").alias("reason"))


# Per-file localisation -----------------------------------------------------------------

LOCF = f"""{PROF}, lf AS (SELECT rk.file_id, file_category, file_category IN {PARTIAL} AS par, any_value(pr.segment_count) AS segment_count, any_value(h50 / pr.segment_count) AS hf, any_value(hit1) AS hit1, any_value(hit3) AS hit3, any_value(hit5) AS hit5,
  count(*) FILTER (r <= 5 AND y_true = 1) AS top5_inside_count, min(r) FILTER (y_true = 1) AS best_rank, max(prob) FILTER (y_true = 1) AS max_in, avg(prob) FILTER (y_true = 1) AS mean_in, max(prob) FILTER (y_true = 0) AS max_out, avg(prob) FILTER (y_true = 0) AS mean_out,
  any_value(h50) AS h50 FROM rk JOIN pr USING (file_id) JOIN f USING (file_id) GROUP BY ALL)"""


def localized_files(spark, sf):
    s = I.segments(spark, sf)
    y = c("y_true")
    pos = numbered(s, ["file_id"], [c("prob").desc(), *ORDER], "r")
    inner = pos.groupBy("file_id").agg(
        F.min(F.when(y == 1, c("r"))).alias("best_rank_inside"),
        F.max(F.when(y == 1, c("prob"))).alias("max_prob_inside"), F.avg(F.when(y == 1, c("prob"))).alias("mean_prob_inside"),
        F.max(F.when(y == 0, c("prob"))).alias("max_prob_outside"), F.avg(F.when(y == 0, c("prob"))).alias("mean_prob_outside"))
    prof = profile(spark, sf, [0.50])
    return (join_ids(join_ids(prof, inner, ["file_id"]), I.files(spark, sf).select("file_id", "file_category"), ["file_id"])
            .withColumn("is_partial", c("file_category").isin(C.PARTIAL)).withColumn("high_fraction", C.high_fraction(0.50)))


@query("a56_file_localization", f"""{LOCF} SELECT file_id, par AS is_partial, segment_count, round(hf, 6) AS high_fraction, CASE WHEN par THEN hit1 END AS top1_inside, CASE WHEN par THEN hit3 END AS top3_inside, CASE WHEN par THEN hit5 END AS top5_inside,
  CASE WHEN par THEN top5_inside_count END AS top5_inside_count, CASE WHEN par THEN best_rank END AS best_rank_inside, round(max_in, 6) AS max_prob_inside, round(mean_in, 6) AS mean_prob_inside, round(max_out, 6) AS max_prob_outside, round(mean_out, 6) AS mean_prob_outside,
  round(mean_in - mean_out, 6) AS inside_minus_outside_mean, hf >= 0.4 AS broad_activation, CASE WHEN par THEN hit5 AND hf < 0.4 END AS localized_pattern_supported, CASE WHEN NOT par THEN h50 END AS false_high_segment_count FROM lf""")
def file_localization(spark, sf):
    t = localized_files(spark, sf)
    par, hf = c("is_partial"), c("high_fraction")
    only = lambda x: F.when(par, x)
    return rounded(t.select(
        "file_id", "is_partial", "segment_count", "high_fraction", only(c("top1_hit")).alias("top1_inside"), only(c("top3_hit")).alias("top3_inside"),
        only(c("top5_hit")).alias("top5_inside"), only(c("topk_inside_count")).alias("top5_inside_count"), only(c("best_rank_inside")).alias("best_rank_inside"),
        "max_prob_inside", "mean_prob_inside", "max_prob_outside", "mean_prob_outside", (c("mean_prob_inside") - c("mean_prob_outside")).alias("inside_minus_outside_mean"),
        (hf >= C.BROAD_FLAG).alias("broad_activation"), only(c("top5_hit") & (hf < C.BROAD_FLAG)).alias("localized_pattern_supported"),
        F.when(~par, c("high_50")).alias("false_high_segment_count")))


@query("a57_broad_activation", f"""{LOCF} SELECT count(*) AS partial_file_count, count(*) FILTER (hf >= 0.4) AS broad_activation_count, count(*) FILTER (hit5 AND hf < 0.4) AS localized_pattern_supported_count, count(*) FILTER (hit1) AS top1_hit_count,
  count(*) FILTER (hit3) AS top3_hit_count, count(*) FILTER (hit5) AS top5_hit_count FROM lf WHERE par""")
def broad_activation(spark, sf):
    t = localized_files(spark, sf).where("is_partial")
    hf = c("high_fraction")
    return t.agg(F.count(F.lit(1)).alias("partial_file_count"), F.count_if(hf >= C.BROAD_FLAG).alias("broad_activation_count"),
                 F.count_if(c("top5_hit") & (hf < C.BROAD_FLAG)).alias("localized_pattern_supported_count"),
                 *[F.count_if(c(f"top{n}_hit")).alias(f"top{n}_hit_count") for n in (1, 3, 5)])


@query("a58_precision_at_k", f"""{G}, {RK} SELECT round(avg(p), 6) AS precision_at_5 FROM (SELECT file_id, count(*) FILTER (r <= 5 AND y_true = 1) / 5 AS p FROM rk GROUP BY file_id HAVING max(y_true) = 1)""")
def precision_at_k(spark, sf):
    s = I.segments(spark, sf)
    positive = s.groupBy("file_id").agg(F.max("y_true").alias("_any")).where("_any = 1").select("file_id")
    top = top_rows(s, ["file_id"], [c("prob").desc(), *ORDER], 5, "_r").groupBy("file_id").agg((F.count_if(c("y_true") == 1) / 5).alias("p"))
    return join_ids(top, positive, ["file_id"]).agg(F.round(F.avg("p"), 6).alias("precision_at_5"))


@query("a59_topk_summary", f"""{G}, {RK} SELECT file_id, count(*) AS total_segments, count(*) FILTER (y_true = 1) AS true_inside_segments, string_agg(segment_id, ';' ORDER BY r) FILTER (r <= 5) AS top_k_segments, coalesce(bool_or(y_true = 1) FILTER (r <= 5), false) AS top_k_hit,
  round(avg(y_true) FILTER (r <= 5), 6) AS top_k_hit_rate FROM rk GROUP BY file_id""")
def topk_summary(spark, sf):
    s = I.segments(spark, sf)
    base = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_segments"), F.count_if(c("y_true") == 1).alias("true_inside_segments"))
    top = top_rows(s, ["file_id"], [c("prob").desc(), *ORDER], 5, "_r").groupBy("file_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "segment_id"))), lambda x: x["segment_id"]), ";").alias("top_k_segments"),
        (F.max("y_true") == 1).alias("top_k_hit"), F.round(F.avg("y_true"), 6).alias("top_k_hit_rate"))
    return join_ids(base, top, ["file_id"])


TH60 = list(range(20, 100, 5))


@query("a60_segment_threshold_choice", f"""{PROF}, t AS (SELECT k / 100::DOUBLE AS threshold FROM range(20, 96, 5) r(k)), fr AS (SELECT g.file_id, threshold, avg((prob >= threshold)::INT) AS hf FROM g JOIN f USING (file_id), t WHERE file_category IN {PARTIAL} GROUP BY ALL),
s AS (SELECT threshold, count(*) AS n_partial_files, round(avg(hit5::INT), 6) AS top5_hit_rate, count(*) FILTER (hf >= 0.4) AS broad_activation_files, round(avg((hf >= 0.4)::INT), 6) AS broad_activation_rate FROM fr JOIN pr USING (file_id) GROUP BY threshold)
SELECT *, row_number() OVER (ORDER BY (broad_activation_rate <= 0.35) DESC, top5_hit_rate DESC, broad_activation_rate, threshold DESC) = 1 AS chosen FROM s""")
def segment_threshold_choice(spark, sf):
    ths = [k / 100.0 for k in range(20, 96, 5)]
    p = join_ids(profile(spark, sf, ths), I.files(spark, sf).where(c("file_category").isin(C.PARTIAL)).select("file_id"), ["file_id"])
    long = p.select("top5_hit", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (C.high_fraction(t) >= 0.40).alias("broad")) for t in ths])).alias("t"))
    s = long.groupBy(c("t.threshold").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n_partial_files"), F.round(F.avg(c("top5_hit").cast("int")), 6).alias("top5_hit_rate"),
        F.count_if(c("t.broad")).alias("broad_activation_files"), F.round(F.avg(c("t.broad").cast("int")), 6).alias("broad_activation_rate"))
    one = s.withColumn("_k", F.lit(1))
    best = best_row(one, ["_k"], [(c("broad_activation_rate") <= 0.35).desc(), c("top5_hit_rate").desc(), c("broad_activation_rate").asc(), c("threshold").desc()])
    chosen = best.select("threshold", F.lit(True).alias("_c"))
    return join_ids(s, chosen, ["threshold"], "left").withColumn("chosen", F.coalesce("_c", F.lit(False))).drop("_c")


@query("a61_oracle_localization", f"""{LOCF} SELECT count(*) FILTER (par) AS n_partial_files, count(*) FILTER (NOT par) AS n_clean_files, round(avg(hit5::INT) FILTER (par), 6) AS top5_hit_rate, round(avg((hit5 AND hf < 0.4)::INT) FILTER (par), 6) AS localized_rate,
  round(avg((hf >= 0.4)::INT) FILTER (NOT par), 6) AS clean_broad_activation_rate FROM lf""")
def oracle_localization(spark, sf):
    t = localized_files(spark, sf)
    par, broad = c("is_partial"), c("high_fraction") >= C.BROAD_FLAG
    return rounded(t.agg(F.count_if(par).alias("n_partial_files"), F.count_if(~par).alias("n_clean_files"), C.rate(par, c("top5_hit")).alias("top5_hit_rate"),
                         C.rate(par, c("top5_hit") & ~broad).alias("localized_rate"), C.rate(~par, broad).alias("clean_broad_activation_rate")))


@query("a79_partial_rollup", f"""{G}, rng AS ({RANGES}), b AS (SELECT file_id, round(max(prob), 6) AS partial_max_probability, round(avg(prob), 6) AS partial_mean_probability, count(*) FILTER (prob >= 0.7) AS partial_predicted_count, count(*) AS partial_candidate_count FROM g GROUP BY file_id)
SELECT * FROM b JOIN rng USING (file_id)""")
def partial_rollup(spark, sf):
    s = I.segments(spark, sf)
    b = s.groupBy("file_id").agg(F.round(F.max("prob"), 6).alias("partial_max_probability"), F.round(F.avg("prob"), 6).alias("partial_mean_probability"),
                                 F.count_if(c("prob") >= 0.7).alias("partial_predicted_count"), F.count(F.lit(1)).alias("partial_candidate_count"))
    return join_ids(b, Z.top_ranges(s, "file_id", "segment_id", "prob"), ["file_id"])


# Diagnostics ---------------------------------------------------------------------------

GATEFAIL = """list_filter([CASE WHEN gate_prob < 0.5 THEN 'file_gate_miss' END, CASE WHEN mx < 0.8 THEN 'segment_threshold_miss' END, CASE WHEN hf > 0.45 THEN 'broad_activation_block' END, CASE WHEN contrast < 0.15 THEN 'contrast_miss' END], lambda x: x IS NOT NULL)"""
NEAR = """array_to_string(list_filter([CASE WHEN round(gate_prob - 0.5, 9) >= -0.1 AND gate_prob < 0.5 THEN 'near_file_gate' END, CASE WHEN round(mx - 0.8::DOUBLE, 9) >= -0.1 AND mx < 0.8::DOUBLE THEN 'near_segment_threshold' END,
  CASE WHEN round(contrast - 0.15::DOUBLE, 9) >= -0.1 AND contrast < 0.15::DOUBLE THEN 'near_contrast' END, CASE WHEN round(0.45::DOUBLE - hf, 9) >= -0.1 AND hf > 0.45::DOUBLE THEN 'near_broad_limit' END], lambda x: x IS NOT NULL), ';')"""


@query("f16_failed_gates", f"""{HOLD}, x AS (SELECT *, {GATEFAIL} AS fl FROM h WHERE expected = 1 AND NOT pos) SELECT file_id, coalesce(fl[1], 'unknown_cascade_failure') AS primary_failure, coalesce(fl[2], '') AS secondary_failure, array_to_string(fl, ';') AS failure_flags, {NEAR} AS near_misses FROM x""")
def failed_gates(spark, sf):
    h = holdout(spark, sf).where((c("expected") == 1) & ~c("partial_evidence_positive"))
    fl = C.failed_gates(c("gate_prob"), LOOSE)
    return h.select("file_id", F.coalesce(F.try_element_at(fl, F.lit(1)), F.lit("unknown_cascade_failure")).alias("primary_failure"),
                    F.coalesce(F.try_element_at(fl, F.lit(2)), F.lit("")).alias("secondary_failure"), F.array_join(fl, ";").alias("failure_flags"),
                    C.near_misses(c("gate_prob"), LOOSE).alias("near_misses"))


FPWHY = """CASE WHEN gate_prob >= 0.95 AND mx >= 0.95 THEN 'strong_file_gate_plus_strong_segment' WHEN broad OR hf > 0.45 THEN 'broad_activation_false_alarm' WHEN contrast_ok AND mx >= 0.8 THEN 'high_contrast_artifact_like_pattern'
  WHEN mx >= 0.8 AND hf <= 0.45 THEN 'localized_high_segment_false_alarm' ELSE 'unknown_false_positive_pattern' END"""


@query("f17_case_summary", f"""{HOLD} SELECT 'fabricated_20pct_false_negative' AS case_type, file_id, coalesce({GATEFAIL}[1], 'unknown_cascade_failure') AS primary_failure, coalesce({GATEFAIL}[2], '') AS secondary_failure FROM h WHERE error_status = 'ok' AND expected = 1 AND test_group = 'fabricated_20pct' AND NOT pos
UNION ALL SELECT 'nonpartial_false_positive', file_id, {FPWHY}, cond FROM h WHERE error_status = 'ok' AND expected = 0 AND pos""")
def case_summary(spark, sf):
    h = holdout(spark, sf).where(c("error_status") == "ok")
    fl = C.failed_gates(c("gate_prob"), LOOSE)
    mx, hf = c("max_probability"), c("high_segment_fraction")
    why = (F.when((c("gate_prob") >= 0.95) & (mx >= 0.95), "strong_file_gate_plus_strong_segment")
           .when(c("broad_activation_flag") | (hf > LOOSE["broad_limit"]), "broad_activation_false_alarm")
           .when(c("contrast_positive") & (mx >= LOOSE["segment_threshold"]), "high_contrast_artifact_like_pattern")
           .when((mx >= LOOSE["segment_threshold"]) & (hf <= LOOSE["broad_limit"]), "localized_high_segment_false_alarm")
           .otherwise("unknown_false_positive_pattern"))
    pos = c("partial_evidence_positive")
    missed = (c("expected") == 1) & (c("test_group") == "fabricated_20pct") & ~pos
    alarm = (c("expected") == 0) & pos
    kind = F.when(missed, "fabricated_20pct_false_negative").when(alarm, "nonpartial_false_positive")
    return h.where(missed | alarm).select(
        kind.alias("case_type"), "file_id",
        F.when(missed, F.coalesce(F.try_element_at(fl, F.lit(1)), F.lit("unknown_cascade_failure"))).otherwise(why).alias("primary_failure"),
        F.when(missed, F.coalesce(F.try_element_at(fl, F.lit(2)), F.lit(""))).otherwise(c("condition")).alias("secondary_failure"))


@query("f18_timestamp_localization", f"""{HOLD}, s AS (SELECT rk.*, h.region_start AS fs, h.region_end AS fe FROM rk JOIN h USING (file_id) WHERE h.error_status = 'ok' AND h.test_group = 'fabricated_20pct' AND h.has_ts),
o AS (SELECT *, greatest(0::DOUBLE, least(end_sec, fe) - greatest(start_sec, fs)) / 4 >= 0.5 AS inside FROM s), a AS (SELECT file_id, coalesce(max(prob) FILTER (inside), 0) AS max_inside, coalesce(max(prob) FILTER (NOT inside), 0) AS max_outside, min(r) FILTER (inside) AS best_rank FROM o GROUP BY file_id)
SELECT h.file_id, round(max_inside, 6) AS max_inside, round(max_outside, 6) AS max_outside, round(max_inside - max_outside, 6) AS inside_minus_outside, best_rank, CASE WHEN pos THEN CASE WHEN hit1 THEN 'detected_top1_localized' WHEN hit3 THEN 'detected_top3_localized'
  WHEN hit5 THEN 'detected_top5_localized' ELSE 'detected_but_not_top5' END WHEN max_inside >= 0.8 AND max_inside > max_outside THEN 'missed_but_timestamp_region_has_signal' ELSE 'missed_no_timestamp_region_signal' END AS localization_status
FROM h JOIN a USING (file_id) WHERE h.error_status = 'ok' AND h.test_group = 'fabricated_20pct' AND h.has_ts""")
def timestamp_localization(spark, sf):
    from echotrail.operators.intervals import overlap_label
    h = holdout(spark, sf).where((c("error_status") == "ok") & (c("test_group") == "fabricated_20pct") & c("has_timestamp"))
    keep = h.select("file_id", "region_start", "region_end", "partial_evidence_positive", "top1_hit", "top3_hit", "top5_hit")
    pos = numbered(I.segments(spark, sf), ["file_id"], [c("prob").desc(), *ORDER], "r").select("file_id", "start_sec", "end_sec", "prob", "r")
    inside = overlap_label(c("start_sec"), c("end_sec"), c("region_start"), c("region_end"), 0.5)["region_label"] == "inside_fabricated_region"
    flags = ["partial_evidence_positive", "top1_hit", "top3_hit", "top5_hit"]
    a = join_ids(pos, keep, ["file_id"]).groupBy("file_id", *flags).agg(
        F.coalesce(F.max(F.when(inside, c("prob"))), F.lit(0.0)).alias("max_inside"),
        F.coalesce(F.max(F.when(~inside, c("prob"))), F.lit(0.0)).alias("max_outside"), F.min(F.when(inside, c("r"))).alias("best_rank"))
    status = (F.when(c("partial_evidence_positive"), F.when(c("top1_hit"), "detected_top1_localized").when(c("top3_hit"), "detected_top3_localized")
                     .when(c("top5_hit"), "detected_top5_localized").otherwise("detected_but_not_top5"))
              .when((c("max_inside") >= LOOSE["segment_threshold"]) & (c("max_inside") > c("max_outside")), "missed_but_timestamp_region_has_signal")
              .otherwise("missed_no_timestamp_region_signal"))
    return rounded(a.select("file_id", "max_inside", "max_outside", (c("max_inside") - c("max_outside")).alias("inside_minus_outside"),
                            "best_rank", status.alias("localization_status")))


SENS = {"gates": [0.40, 0.45, 0.50], "segs": [0.80, 0.85, 0.90], "contrasts": [0.15, 0.20, 0.25], "broads": [0.45]}


@query("f20_threshold_sensitivity", f"""{HOLD}, sg AS (SELECT h.*, t.st, t.hh FROM h, LATERAL (VALUES (0.80::DOUBLE, h80), (0.85::DOUBLE, h85), (0.90::DOUBLE, h90)) t(st, hh) WHERE error_status = 'ok'),
x AS (SELECT gt.v AS file_gate_threshold, st AS segment_threshold, ct.v AS contrast_threshold, expected, test_group, cond, pos AS base, coalesce(gate_prob >= gt.v AND hh > 0 AND hh / segment_count <= 0.45 AND contrast >= ct.v, false) AS now FROM sg, {values('gt', SENS['gates'])}, {values('ct', SENS['contrasts'])})
SELECT file_gate_threshold, segment_threshold, contrast_threshold, round(avg(now::INT) FILTER (expected = 1), 6) AS partial_recall, round(avg(now::INT) FILTER (test_group = 'fabricated_20pct'), 6) AS new_partial_recall, round(avg(now::INT) FILTER (expected = 0), 6) AS non_partial_false_alarm_rate,
  round(avg(now::INT) FILTER (cond = 'direct'), 6) AS direct_false_partial_rate, count(*) FILTER (expected = 0 AND now) AS false_positive_count, count(*) FILTER (expected = 1 AND NOT now) AS false_negative_count,
  count(*) FILTER (test_group = 'fabricated_20pct' AND now AND NOT base) AS recovered_count, count(*) FILTER (expected = 0 AND now AND NOT base) AS new_false_positive_count FROM x GROUP BY ALL""")
def threshold_sensitivity(spark, sf):
    h = holdout(spark, sf).where(c("error_status") == "ok")
    gates, contrasts = SENS["gates"], SENS["contrasts"]
    slot = C._slot
    seg = F.array(*[F.struct(F.lit(t).alias("t"), F.coalesce((c(C._high(t)) > 0) & (C.high_fraction(t) <= 0.45), F.lit(False)).alias("ok")) for t in SENS["segs"]])
    # recordings collapse to a histogram before they meet the parameter grid
    hist = h.select("expected", "test_group", "condition", c("partial_evidence_positive").alias("base"), slot(c("gate_prob"), gates).alias("gs"),
                    slot(c("topk_minus_rest"), contrasts).alias("cs"), F.explode(seg).alias("s")).groupBy(
        "expected", "test_group", "condition", "base", "gs", "cs", "s.t", "s.ok").agg(F.count(F.lit(1)).alias("n"))
    levels = lambda vals: F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(vals)]))
    g = hist.select("*", levels(gates).alias("g")).select("*", levels(contrasts).alias("k"))
    now = c("ok") & (c("g.i") <= c("gs")) & (c("k.i") <= c("cs"))
    total = lambda cond: F.sum(F.when(cond, c("n")).otherwise(0))
    share = lambda cond: F.round(ratio(total(cond & now), total(cond)), 6)
    exp, new = c("expected") == 1, c("test_group") == "fabricated_20pct"
    return g.groupBy(c("g.v").alias("file_gate_threshold"), c("t").alias("segment_threshold"), c("k.v").alias("contrast_threshold")).agg(
        share(exp).alias("partial_recall"), share(new).alias("new_partial_recall"), share(~exp).alias("non_partial_false_alarm_rate"),
        share(c("condition") == "direct").alias("direct_false_partial_rate"), total(~exp & now).alias("false_positive_count"), total(exp & ~now).alias("false_negative_count"),
        total(new & now & ~c("base")).alias("recovered_count"), total(~exp & now & ~c("base")).alias("new_false_positive_count"))


OUTCOME_COLS = ["gate_prob", "max_probability", "high_segment_fraction", "topk_minus_rest"]


@query("a72_outcome_distribution", f"""{HOLD}, o AS (SELECT CASE WHEN expected = 1 AND test_group = 'fabricated_20pct' AND NOT pos THEN 'fabricated_20pct_false_negative' WHEN expected = 0 AND pos THEN 'nonpartial_false_positive' WHEN expected = 1 AND pos THEN 'true_partial_detected'
  WHEN expected = 0 THEN 'nonpartial_true_negative' END AS grp, gate_prob, mx AS max_probability, hf AS high_segment_fraction, contrast AS topk_minus_rest FROM h WHERE error_status = 'ok')
SELECT grp AS outcome, count(*) AS count, """ + ", ".join(f"round(min({k}), 6) AS min_{k}, round(max({k}), 6) AS max_{k}, round(quantile_cont({k}, 0.5), 6) AS median_{k}" for k in OUTCOME_COLS) + " FROM o WHERE grp IS NOT NULL GROUP BY grp")
def outcome_distribution(spark, sf):
    pos, exp = c("partial_evidence_positive"), c("expected") == 1
    h = holdout(spark, sf).where(c("error_status") == "ok").withColumn("outcome", F.when(
        exp & (c("test_group") == "fabricated_20pct") & ~pos, "fabricated_20pct_false_negative").when(~exp & pos, "nonpartial_false_positive")
        .when(exp & pos, "true_partial_detected").when(~exp, "nonpartial_true_negative")).where(c("outcome").isNotNull())
    return rounded(C.outcome_distribution(settled(h.select("outcome", *OUTCOME_COLS)), "outcome", OUTCOME_COLS))


# Counterfactuals: what one relaxed gate would change -----------------------------------------

OTHER = {"file_gate": ["segment", "contrast", "broad"], "segment": ["file_gate", "contrast"],
         "contrast": ["file_gate", "segment", "broad"], "broad": ["file_gate", "segment", "contrast"]}


def segment_limit(spark, sf, broad_limit):
    """Per file the highest segment score that would make the fraction of high segments too broad.

    That is the (m + 1)-th score from the top with m = floor(broad_limit * segments): the
    file stays within the limit for thresholds above it.
    """
    s = I.segments(spark, sf).select("file_id", "segment_id", "start_sec", "prob")
    pos = numbered(s, ["file_id"], [c("prob").desc(), *ORDER], "r")
    n = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.floor(c("n") * broad_limit + 1e-9) + 1
    return join_ids(pos, n, ["file_id"]).where(c("r") == at).select("file_id", c("prob").alias("crowded"))


F19_TAIL = """, lim AS (SELECT file_id, prob AS crowded FROM rk WHERE r = floor(n * 0.45 + 1e-9) + 1), z AS (SELECT h.*, crowded FROM h LEFT JOIN lim USING (file_id) WHERE error_status = 'ok' AND segment_count IS NOT NULL),
fn AS (SELECT * FROM z WHERE expected = 1 AND test_group = 'fabricated_20pct' AND NOT pos), np AS (SELECT * FROM z WHERE expected = 0 AND NOT pos),
v AS (SELECT file_id, 'file_gate' AS gate, gate_prob AS val, mx >= 0.8 AND contrast >= 0.15 AND hf <= 0.45 AS recovered FROM fn WHERE gate_prob < 0.5 UNION ALL SELECT file_id, 'segment', mx, gate_prob >= 0.5 AND contrast >= 0.15 AND (crowded IS NULL OR mx > crowded) FROM fn WHERE mx < 0.8
  UNION ALL SELECT file_id, 'contrast', contrast, gate_prob >= 0.5 AND mx >= 0.8 AND hf <= 0.45 FROM fn WHERE contrast < 0.15 UNION ALL SELECT file_id, 'broad', hf, gate_prob >= 0.5 AND mx >= 0.8 AND contrast >= 0.15 FROM fn WHERE hf > 0.45)
SELECT v.file_id, v.gate, round(v.val, 6) AS required_value, recovered, CASE gate WHEN 'file_gate' THEN (SELECT count(*) FROM np WHERE gate_prob >= v.val AND mx >= 0.8 AND contrast >= 0.15 AND hf <= 0.45) WHEN 'segment' THEN (SELECT count(*) FROM np WHERE gate_prob >= 0.5 AND contrast >= 0.15 AND mx >= v.val AND (crowded IS NULL OR crowded < v.val))
  WHEN 'contrast' THEN (SELECT count(*) FROM np WHERE gate_prob >= 0.5 AND mx >= 0.8 AND hf <= 0.45 AND contrast >= v.val) ELSE (SELECT count(*) FROM np WHERE gate_prob >= 0.5 AND mx >= 0.8 AND contrast >= 0.15 AND hf <= v.val) END AS new_false_positives FROM v"""


@query("f19_counterfactual", HOLD + F19_TAIL)
def counterfactual(spark, sf):
    """Per missed file and failed gate: the value that would pass it, and the false alarms that value brings.

    The alarms are a count of other files at or beyond the value, read off running
    counts over both sets of values; files are never paired.
    """
    lim = segment_limit(spark, sf, LOOSE["broad_limit"])
    h = join_ids(holdout(spark, sf).where((c("error_status") == "ok") & c("segment_count").isNotNull()), lim, ["file_id"], "left")
    h = settled(h.select("file_id", "expected", "test_group", "partial_evidence_positive", "gate_prob", "max_probability",
                         "topk_minus_rest", "high_segment_fraction", "crowded"))  # read by four branches below
    gate, mx, con, hf, crowded = c("gate_prob"), c("max_probability"), c("topk_minus_rest"), c("high_segment_fraction"), c("crowded")
    ok = {"file_gate": gate >= LOOSE["file_gate_threshold"], "segment": mx >= LOOSE["segment_threshold"],
          "contrast": con >= LOOSE["contrast_threshold"], "broad": hf <= LOOSE["broad_limit"]}
    others = {g: ok[o[0]] & ok[o[1]] & (ok[o[2]] if len(o) > 2 else F.lit(True)) for g, o in OTHER.items()}
    value = {"file_gate": gate, "segment": mx, "contrast": con, "broad": -hf}  # larger is always easier to pass
    pos, exp = c("partial_evidence_positive"), c("expected") == 1
    # a missed file asks at its own value; a quiet file adds one alarm from its value down,
    # and for the segment gate takes it away again once the threshold reaches its crowded score
    ask = lambda g: F.struct(F.lit(g).alias("gate"), value[g].alias("v"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("ask"))
    add = lambda g, v, w: F.struct(F.lit(g).alias("gate"), v.alias("v"), F.lit(w).cast("long").alias("w"), F.lit(False).alias("ask"))
    missed = exp & (c("test_group") == "fabricated_20pct") & ~pos
    quiet = ~exp & ~pos
    marks = [F.when(missed & ~ok[g], ask(g)) for g in OTHER] + [F.when(quiet & others[g], add(g, value[g], 1)) for g in OTHER]
    marks.append(F.when(quiet & others["segment"] & crowded.isNotNull(), add("segment", crowded, -1)))
    m = h.select("file_id", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("m")).select("file_id", "m.*")
    per_value = settled(m.groupBy("gate", "v").agg(F.sum("w").alias("w")))
    reach = running(per_value, ["gate"], [c("v").desc()], {"new_false_positives": ("sum", c("w"))})
    asked = join_ids(m.where("ask").select("file_id", "gate", "v"), reach.select("gate", "v", "new_false_positives"), ["gate", "v"])
    recover = F.when(c("gate") == "segment", others["segment"] & F.coalesce(mx > crowded, F.lit(True)))
    for g in ("file_gate", "contrast", "broad"):
        recover = recover.when(c("gate") == g, others[g])
    j = join_ids(asked, h.select("file_id", "gate_prob", "max_probability", "topk_minus_rest", "high_segment_fraction", "crowded"), ["file_id"])
    return rounded(j.select("file_id", "gate", F.abs("v").alias("required_value"), recover.alias("recovered"), "new_false_positives"))

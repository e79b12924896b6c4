"""Rule-based fusion, statuses, decisions and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from echotrail.functions import rules as R
from echotrail.operators import cascade as C
from echotrail.operators import reporting as P
from echotrail.operators import timeline as T
from echotrail.operators.metrics import best_row, ratio
from echotrail.operators.profile import unpivot, value_counts
from echotrail.operators.skew import join_ids, numbered, top_rows
from echotrail.plans import inputs as I
from echotrail.plans.cascade_queries import GATEFAIL, PROF, check_limits, localized_files, profile, profiled_files
from echotrail.plans.join_queries import AXES, SEG, THREE, star, three_models
from echotrail.plans.metric_queries import rounded
from echotrail.plans.registry import query

c = F.col
TH = {"origin": 0.55, "replay": 0.60, "mixer": 0.50, "partial": 0.70}


def strength_sql(p, th):
    return f"CASE WHEN {p} IS NULL THEN 'not_evaluated' WHEN {p} < greatest(0::DOUBLE, {th}::DOUBLE - 0.1::DOUBLE) THEN 'low' WHEN abs({p} - {th}::DOUBLE) <= 0.1::DOUBLE THEN 'borderline' WHEN {p} >= {th}::DOUBLE + 0.2::DOUBLE THEN 'high' ELSE 'moderate' END"


# probabilities are rounded so that both engines see the same numbers at a threshold
FUSE = f"""{SEG}, {AXES}, ax AS (SELECT f.file_id, f.dataset, f.file_category, f.gate_prob, round(origin_p, 6) AS origin_p, round(replay_p, 6) AS replay_p, round(mixer_p, 6) AS mixer_p, round(partial_p, 6) AS partial_p FROM f LEFT JOIN o USING (file_id) LEFT JOIN pa USING (file_id)),
st AS (SELECT *, {', '.join(f"{strength_sql(a + '_p', t)} AS {a}_s" for a, t in TH.items())} FROM ax),
k AS (SELECT *, {' + '.join(f"({a}_s IN ('moderate', 'high'))::INT" for a in TH)} AS n_up, {' + '.join(f"({a}_s NOT IN ('not_evaluated', 'unknown'))::INT" for a in TH)} AS n_ev, {' OR '.join(f"{a}_s = 'borderline'" for a in TH)} AS edge FROM st),
fu AS (SELECT *, CASE WHEN n_ev = 0 OR (n_up = 0 AND edge) THEN 'inconclusive_manual_review_experimental' WHEN n_up = 0 AND origin_s = 'low' AND replay_s IN ('low', 'not_evaluated') AND mixer_s IN ('low', 'not_evaluated') AND partial_s IN ('low', 'not_evaluated') THEN 'accept_human_clean_experimental'
  WHEN n_up > 1 THEN 'suspicious_mixed_evidence_experimental' WHEN partial_s IN ('moderate', 'high') THEN 'suspicious_partial_fabrication_experimental' WHEN replay_s IN ('moderate', 'high') THEN 'suspicious_replay_experimental' WHEN mixer_s IN ('moderate', 'high') THEN 'suspicious_mixer_channel_experimental'
  WHEN origin_s IN ('moderate', 'high') THEN 'suspicious_origin_experimental' ELSE 'inconclusive_manual_review_experimental' END AS status FROM k),
fr AS (SELECT *, CASE status WHEN 'inconclusive_manual_review_experimental' THEN 'inconclusive' WHEN 'accept_human_clean_experimental' THEN 'low' WHEN 'suspicious_mixed_evidence_experimental' THEN 'high' WHEN 'suspicious_partial_fabrication_experimental' THEN CASE partial_s WHEN 'high' THEN 'high' ELSE 'medium' END
  WHEN 'suspicious_replay_experimental' THEN CASE replay_s WHEN 'high' THEN 'high' ELSE 'medium' END WHEN 'suspicious_mixer_channel_experimental' THEN CASE mixer_s WHEN 'high' THEN 'high' ELSE 'medium' END ELSE CASE origin_s WHEN 'high' THEN 'high' ELSE 'medium' END END AS risk, CASE WHEN status = 'accept_human_clean_experimental' THEN 'false' ELSE 'true' END AS review FROM fu)"""
REASON = """coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([""" + ", ".join(
    f"CASE WHEN {a}_s = 'borderline' THEN '{a}_borderline' END, CASE WHEN {a}_s IN ('moderate', 'high') THEN '{n}' END" for a, n in (
        ("origin", "origin_ai_evidence_review"), ("replay", "replay_rerecording_evidence_review"), ("mixer", "mixer_channel_evidence_review"), ("partial", "partial_segment_evidence_review"))) + """,
  CASE WHEN status = 'suspicious_mixed_evidence_experimental' THEN 'multi_axis_evidence_review' END, CASE WHEN status = 'inconclusive_manual_review_experimental' THEN 'insufficient_evidence_review' END], lambda x: x IS NOT NULL))), ';'), ''), 'none')"""
TRACE = "'origin=' || origin_s || '|replay=' || replay_s || '|mixer=' || mixer_s || '|partial=' || partial_s || '|status=' || status || '|risk=' || risk"


def axes(spark, sf):
    s = star(spark, sf)
    return s.select("file_id", "dataset", "file_category", "gate_prob", *[F.round(f"{a}_p", 6).alias(f"{a}_p") for a in TH])


def fused(spark, sf):
    t = axes(spark, sf)
    for a, th in TH.items():
        ev = R.axis_evidence(a, c(f"{a}_p").isNotNull(), c(f"{a}_p"), F.lit(th))
        t = t.select("*", *[v.alias(k) for k, v in ev.items()])
    strength = {a: c(f"{a}_evidence_strength") for a in TH}
    t = t.select("*", *[v.alias(k) for k, v in R.fuse_axes(strength).items()])
    status, risk = c("experimental_fusion_status"), c("forensic_risk_level")
    return t.select("*", R.review_reasons(strength, status).alias("manual_review_reason"), R.fusion_trace(strength, status, risk).alias("fusion_trace"))


@query("f1_evidence_strength", f"{FUSE} SELECT file_id, origin_s AS origin_strength, partial_s AS partial_strength FROM st")
def evidence_strength(spark, sf):
    return axes(spark, sf).select("file_id", R.evidence_strength(c("origin_p"), F.lit(TH["origin"])).alias("origin_strength"),
                                  R.evidence_strength(c("partial_p"), F.lit(TH["partial"])).alias("partial_strength"))


@query("f2_axis_labels", f"{FUSE} SELECT file_id, " + ", ".join(f"CASE WHEN {a}_p IS NULL THEN 'not_evaluated' WHEN {a}_p >= {t} THEN '{R.AXIS_LABELS[a]}' ELSE 'low_indicator' END AS {a}_evidence_label" for a, t in TH.items()) + " FROM st")
def axis_labels(spark, sf):
    return fused(spark, sf).select("file_id", *[f"{a}_evidence_label" for a in TH])


@query("f3_multi_axis_fusion", f"{FUSE} SELECT file_id, status AS experimental_fusion_status, risk AS forensic_risk_level, review AS manual_review_required FROM fr")
def multi_axis_fusion(spark, sf):
    return fused(spark, sf).select("file_id", "experimental_fusion_status", "forensic_risk_level", "manual_review_required")


@query("f4_review_reasons", f"{FUSE} SELECT file_id, {REASON} AS manual_review_reason, {TRACE} AS fusion_trace FROM fr")
def review_reasons(spark, sf):
    return fused(spark, sf).select("file_id", "manual_review_reason", "fusion_trace")


@query("f5_fusion_records", f"{FUSE} SELECT file_id, dataset, file_category, origin_p, replay_p, mixer_p, partial_p, status AS experimental_fusion_status, risk AS forensic_risk_level, review AS manual_review_required, {REASON} AS manual_review_reason, 'Experimental status `' || status || '` from multi-axis evidence indicators.' AS forensic_summary FROM fr")
def fusion_records(spark, sf):
    return fused(spark, sf).select(
        "file_id", "dataset", "file_category", *[f"{a}_p" for a in TH], "experimental_fusion_status", "forensic_risk_level", "manual_review_required", "manual_review_reason",
        F.concat(F.lit("Experimental status `"), "experimental_fusion_status", F.lit("` from multi-axis evidence indicators.")).alias("forensic_summary"))


@query("f6_threshold_lookup", f"""WITH p AS ({I.PREDICTIONS_SQL}), t AS (SELECT task_name, feature_set, round(avg(prob), 6) AS th FROM p WHERE NOT (task_name = 'mixer_file_model' AND feature_set = 'ssl') GROUP BY ALL)
SELECT task_name, feature_set, count(*) AS n, count(*) FILTER (prob >= coalesce(th, 0.5)) AS positives, max(coalesce(th, 0.5::DOUBLE)) AS threshold FROM p LEFT JOIN t USING (task_name, feature_set) GROUP BY ALL""")
def threshold_lookup(spark, sf):
    p = I.predictions(spark, sf)
    keys = ["task_name", "feature_set"]
    listed = p.where(~((c("task_name") == "mixer_file_model") & (c("feature_set") == "ssl"))).groupBy(*keys).agg(F.round(F.avg("prob"), 6).alias("th"))
    j = join_ids(p, listed, keys, "left").withColumn("threshold", F.coalesce("th", F.lit(0.5)))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("prob") >= c("threshold")).alias("positives"), F.max("threshold").alias("threshold"))


@query("a78_fusion_summary", f"""{FUSE} SELECT 'total_files' AS metric_name, CAST(count(*) AS VARCHAR) AS metric_value FROM fr
UNION ALL SELECT 'status_distribution', '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' FROM (SELECT status, count(*) AS n FROM fr GROUP BY 1) UNION ALL SELECT 'risk_distribution', '{{' || string_agg('"' || risk || '":' || n, ',' ORDER BY risk) || '}}' FROM (SELECT risk, count(*) AS n FROM fr GROUP BY 1)
UNION ALL SELECT 'manual_review_required_count', CAST(count(*) FILTER (review = 'true') AS VARCHAR) FROM fr UNION ALL SELECT 'high_partial_candidate_count', CAST(count(*) FILTER (partial_s = 'high') AS VARCHAR) FROM fr
UNION ALL SELECT 'inconclusive_count', CAST(count(*) FILTER (status = 'inconclusive_manual_review_experimental') AS VARCHAR) FROM fr """ + " ".join(f"UNION ALL SELECT '{a}_evidence_available_count', CAST(count({a}_p) AS VARCHAR) FROM fr" for a in TH))
def fusion_summary(spark, sf):
    f = fused(spark, sf).select("experimental_fusion_status", "forensic_risk_level", "manual_review_required", c("partial_evidence_strength").alias("ps"), *[f"{a}_p" for a in TH])
    status = c("experimental_fusion_status")
    one = f.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(c("manual_review_required") == "true").alias("manual_review_required_count"),
                F.count_if(c("ps") == "high").alias("high_partial_candidate_count"),
                F.count_if(status == "inconclusive_manual_review_experimental").alias("inconclusive_count"),
                *[F.count(f"{a}_p").alias(f"{a}_evidence_available_count") for a in TH])
    flat = unpivot(one, one.columns, (), "metric_name", "metric_value")

    def spread(col, name):
        n = f.groupBy(c(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n"))))).alias("metric_value")).select(
            F.lit(name).alias("metric_name"), "metric_value")

    return flat.unionByName(spread("experimental_fusion_status", "status_distribution")).unionByName(spread("forensic_risk_level", "risk_distribution"))


# Localisation gate and live fusion -------------------------------------------------------

GATE = f"""{PROF}, gt AS (SELECT file_id, segment_count, h80 / segment_count AS hf, mx, contrast, sd, CASE WHEN segment_count < 3 THEN 'insufficient_segments' WHEN h80 / segment_count >= 0.60 THEN 'global_activation_not_localized' WHEN mx >= 0.8 AND contrast >= 0.15 THEN 'localized_pattern_supported'
  WHEN mx >= 0.8 THEN 'weak_localization_contrast' ELSE 'low_partial_indicator' END AS gate FROM pr), gg AS (SELECT *, gate = 'localized_pattern_supported' AS eligible, CASE gate WHEN 'insufficient_segments' THEN 'not_evaluated' WHEN 'localized_pattern_supported' THEN CASE WHEN mx >= 0.8::DOUBLE + 0.2::DOUBLE THEN 'high' ELSE 'moderate' END
  WHEN 'low_partial_indicator' THEN 'low' ELSE 'borderline' END AS strength, CASE WHEN gate IN ('localized_pattern_supported', 'low_partial_indicator') THEN 'none' ELSE gate END AS why FROM gt)"""


def gated(spark, sf):
    p = profile(spark, sf, [0.80])
    g = R.localization_gate(c("segment_count"), C.high_fraction(0.80), c("max_probability"), c("topk_minus_rest"), 0.80)
    return p.withColumn("gate", g).withColumn("hf", C.high_fraction(0.80))


@query("f7_localization_gate", f"{GATE} SELECT file_id, gate, eligible, strength, why AS block_reason FROM gg")
def localization_gate(spark, sf):
    return gated(spark, sf).select("file_id", "gate.*")



def arb_cte():
    """The fusion CTEs followed by the gate CTEs (the shared file and segment CTEs come once)."""
    tail = GATE[GATE.index(", rk AS"):]
    return FUSE + tail + """, ar AS (SELECT fr.*, gg.gate, CASE WHEN NOT ctx THEN eligible WHEN loc THEN true ELSE false END AS eligible2, CASE WHEN NOT ctx THEN strength WHEN loc THEN CASE WHEN strength IN ('', 'not_evaluated', 'low') THEN 'borderline' ELSE strength END ELSE 'borderline' END AS strength2,
  CASE WHEN NOT ctx THEN why WHEN loc THEN 'coexists_with_replay_or_mixer_context' ELSE 'blocked_by_replay_or_mixer_context' END AS why2 FROM (SELECT gg.*, fr.file_id AS fid, replay_s IN ('moderate', 'high') OR mixer_s IN ('moderate', 'high') AS ctx, gate = 'localized_pattern_supported' AND hf <= 0.35 AND contrast >= 0.20 AS loc FROM gg JOIN fr USING (file_id)) gg JOIN fr ON fr.file_id = gg.fid)"""


def arbitrated(spark, sf):
    j = join_ids(fused(spark, sf), gated(spark, sf).select("file_id", "gate", "hf", "topk_minus_rest"), ["file_id"])
    arb = R.arbitrate(c("gate"), c("hf"), c("topk_minus_rest"), c("replay_evidence_strength"), c("mixer_evidence_strength"))
    return j.withColumn("arb", arb)


@query("f8_partial_arbitration", f"{arb_cte()} SELECT file_id, gate, eligible2 AS eligible, strength2 AS strength, why2 AS block_reason FROM ar")
def partial_arbitration(spark, sf):
    return arbitrated(spark, sf).select("file_id", "arb.*")


LIVE = """, lv AS (SELECT *, (origin_s IN ('moderate', 'high'))::INT + (replay_s IN ('moderate', 'high'))::INT + (mixer_s IN ('moderate', 'high'))::INT + (eligible2 AND strength2 IN ('moderate', 'high'))::INT AS n2 FROM ar),
ls AS (SELECT *, CASE WHEN n2 >= 2 THEN 'suspicious_mixed_evidence_experimental' WHEN eligible2 AND strength2 IN ('moderate', 'high') THEN 'suspicious_partial_fabrication_experimental' WHEN replay_s IN ('moderate', 'high') THEN 'suspicious_replay_experimental'
  WHEN mixer_s IN ('moderate', 'high') THEN 'suspicious_mixer_channel_experimental' WHEN origin_s IN ('moderate', 'high') THEN 'suspicious_origin_experimental' ELSE status END AS live FROM lv)"""


@query("f9_live_status", f"{arb_cte()}{LIVE} SELECT file_id, live AS status, CASE WHEN live = 'accept_human_clean_experimental' THEN 'low' WHEN live = 'suspicious_mixed_evidence_experimental' THEN 'high' WHEN starts_with(live, 'suspicious_') THEN CASE WHEN strength2 = 'high' THEN 'high' ELSE 'medium' END ELSE 'inconclusive' END AS risk FROM ls")
def live_status(spark, sf):
    t = arbitrated(spark, sf)
    up = c("arb.eligible") & c("arb.strength").isin(R.ELEVATED)
    status = R.live_status({a: c(f"{a}_evidence_strength") for a in TH}, up, c("experimental_fusion_status"))
    t = t.withColumn("status", status)
    return t.select("file_id", "status", R.live_risk(c("status"), c("arb.strength")).alias("risk"))


@query("f10_evidence_bands", f"""WITH p AS ({I.PREDICTIONS_SQL}), b AS (SELECT task_name, round(quantile_cont(CASE WHEN y_true = 0 THEN prob END, 0.9), 4) AS lo, round(quantile_cont(CASE WHEN y_true = 1 THEN prob END, 0.25), 4) AS q FROM p GROUP BY 1),
k AS (SELECT task_name, lo, round(greatest(lo + 0.05::DOUBLE, least(q, 0.99::DOUBLE)), 4) AS hi FROM b) SELECT p.task_name, CASE WHEN prob <= lo THEN 'Low evidence' WHEN prob <= hi THEN 'Medium evidence' ELSE 'High evidence' END AS band, count(*) AS n FROM p JOIN k USING (task_name) GROUP BY ALL""")
def evidence_bands(spark, sf):
    from echotrail.operators.metrics import band_cutpoints
    p = I.predictions(spark, sf)
    j = join_ids(p, band_cutpoints(p, ["task_name"], "prob", "y_true", 0.55), ["task_name"])
    return j.groupBy("task_name", R.evidence_band(c("prob"), c("low_max"), c("medium_max")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# Statuses and decisions over models --------------------------------------------------------


def status_sql(p="", vote="0.7", seg="0.95", rat="0.3"):
    fake, edge = f"{p}decision_score >= {vote}", f"abs({p}decision_score - {vote}::DOUBLE) <= 0.05::DOUBLE"
    hot, found = f"({p}max_chunk_spoof >= {seg} OR {p}suspicious_chunk_ratio >= {rat})", f"({p}decision_score >= {vote} OR {p}decision_score >= 0.65)"
    sg = lambda hit, n: f"CASE WHEN {hit} THEN '{n}_detected' WHEN {hot} THEN '{n}_file_level_missed_but_segment_suspicious' ELSE '{n}_missed' END"
    m, o = f"{p}manipulation_type", f"{p}ground_truth_origin"
    return f"""CASE WHEN coalesce({p}error, '') <> '' THEN 'unknown_review_required' WHEN {m} = 'partial_ai_insert' THEN CASE WHEN NOT coalesce({p}suspicious_end_time > {p}suspicious_start_time, false) THEN 'partial_fabrication_not_evaluable' WHEN {p}partial_region_detected THEN 'partial_fabrication_detected' ELSE 'partial_fabrication_missed' END
  WHEN {m} = 'clean_direct' AND {o} = 'human' THEN CASE WHEN {edge} THEN 'clean_human_borderline' WHEN {fake} THEN 'clean_human_false_alarm' ELSE 'clean_human_accepted' END WHEN {m} = 'clean_direct' AND {o} = 'ai' THEN {sg(fake, 'direct_ai')}
  WHEN {m} = 'human_replay' THEN CASE WHEN {found} THEN 'human_replay_manipulation_detected' ELSE 'human_replay_missed' END WHEN {m} = 'ai_replay' THEN {sg(found, 'ai_replay')} WHEN {m} = 'mixer_processed' AND {o} = 'human' THEN CASE WHEN {found} THEN 'human_mixer_manipulation_detected' ELSE 'human_mixer_missed' END
  WHEN {m} = 'mixer_processed' AND {o} = 'ai' THEN {sg(found, 'ai_mixer')} WHEN {edge} THEN 'borderline_needs_review' ELSE 'unknown_review_required' END"""


BST = f"WITH b AS ({I.RESULTS_SQL['baseline']}), s AS (SELECT b.*, {status_sql()} AS status FROM b)"


def with_status(spark, sf, variant="baseline"):
    rows = I.model_results(spark, sf, variant).withColumn("partial_fabrication_binary", F.lit(None).cast("string"))
    return rows.withColumn("status", R.baseline_status()).drop("partial_fabrication_binary")


def gap_status_sql(vote="0.7", seg="0.95", rat="0.3"):
    """The status rule over results with gaps, stated by what is known: p is the prediction that counts."""
    return f"""CASE
  WHEN trim(coalesce(error, '')) <> '' THEN 'unknown_review_required'
  WHEN flagged OR manipulation_type = 'partial_ai_insert' THEN CASE
    WHEN suspicious_end_time IS NULL OR suspicious_start_time IS NULL OR suspicious_end_time <= suspicious_start_time THEN 'partial_fabrication_not_evaluable'
    WHEN partial_region_detected THEN 'partial_fabrication_detected' ELSE 'partial_fabrication_missed' END
  WHEN manipulation_type = 'clean_direct' AND ground_truth_origin = 'human' THEN CASE
    WHEN decision_score IS NOT NULL AND abs(decision_score - {vote}::DOUBLE) <= 0.05::DOUBLE THEN 'clean_human_borderline'
    WHEN p = 'REAL' THEN 'clean_human_accepted' WHEN p = 'FAKE' THEN 'clean_human_false_alarm' ELSE 'borderline_needs_review' END
  WHEN manipulation_type = 'clean_direct' AND ground_truth_origin = 'ai' THEN CASE
    WHEN p = 'FAKE' THEN 'direct_ai_detected' WHEN p IS NULL THEN 'borderline_needs_review'
    WHEN max_chunk_spoof >= {seg} OR suspicious_chunk_ratio >= {rat} THEN 'direct_ai_file_level_missed_but_segment_suspicious' ELSE 'direct_ai_missed' END
  WHEN manipulation_type = 'human_replay' THEN CASE WHEN coalesce(p, '') = 'FAKE' OR coalesce(decision_score, 0) >= 0.65 THEN 'human_replay_manipulation_detected' ELSE 'human_replay_missed' END
  WHEN manipulation_type = 'mixer_processed' AND ground_truth_origin = 'human' THEN CASE WHEN coalesce(p, '') = 'FAKE' OR coalesce(decision_score, 0) >= 0.65 THEN 'human_mixer_manipulation_detected' ELSE 'human_mixer_missed' END
  WHEN manipulation_type = 'ai_replay' OR (manipulation_type = 'mixer_processed' AND ground_truth_origin = 'ai') THEN
    CASE WHEN manipulation_type = 'ai_replay' THEN 'ai_replay' ELSE 'ai_mixer' END || CASE
      WHEN coalesce(p, '') = 'FAKE' OR coalesce(decision_score, 0) >= 0.65 THEN '_detected'
      WHEN p = 'REAL' AND (max_chunk_spoof >= {seg} OR suspicious_chunk_ratio >= {rat}) THEN '_file_level_missed_but_segment_suspicious' ELSE '_missed' END
  WHEN decision_score IS NOT NULL AND abs(decision_score - {vote}::DOUBLE) <= 0.05::DOUBLE THEN 'borderline_needs_review' ELSE 'unknown_review_required' END"""


def gap_rows_sql(src, vote="0.7"):
    return f"""SELECT *, lower(trim(coalesce(partial_fabrication_binary, ''))) IN ('true', '1', 'yes', 'y', 't') AS flagged,
  CASE WHEN decision_score IS NOT NULL THEN CASE WHEN decision_score >= {vote} THEN 'FAKE' ELSE 'REAL' END
       WHEN upper(trim(prediction)) IN ('FAKE', 'REAL') THEN upper(trim(prediction)) END AS p FROM {src}"""


@query("f11_baseline_status", f"WITH b AS ({I.GAP_RESULTS_SQL}), g AS ({gap_rows_sql('b')}) SELECT sample_id, {gap_status_sql()} AS status FROM g")
def baseline_status(spark, sf):
    return I.gap_results(spark, sf).select("sample_id", R.baseline_status().alias("status"))


J3 = f"{THREE}, j AS (SELECT b.sample_id, b.manipulation_type AS m, b.ground_truth_origin AS o, b.suspicious_start_time AS rs, b.suspicious_end_time AS re, " + ", ".join(
    f"{k}.decision_score AS score_{k}, {k}.max_chunk_spoof AS spoof_{k}, {k}.suspicious_chunk_ratio AS ratio_{k}, {k}.prediction AS pred_{k}, {k}.partial_region_detected AS hit_{k}, {status_sql(k + '.')} AS st_{k}" for k in "bpl") + " FROM b JOIN p USING (sample_id) JOIN l USING (sample_id))"
RISK = """CASE WHEN calibrated_status = 'clean_human_accepted' THEN 'low' WHEN ends_with(calibrated_status, '_detected') OR ends_with(calibrated_status, 'segment_suspicious') OR calibrated_status = 'clean_human_false_alarm' THEN 'high' ELSE 'medium' END AS calibrated_risk_level,
 calibrated_status IN ('clean_human_false_alarm', 'clean_human_borderline', 'unknown_review_required') AS needs_manual_review"""
PART = "CASE WHEN NOT coalesce(re > rs, false) THEN 'partial_fabrication_not_evaluable' WHEN {hit} THEN 'partial_fabrication_detected' ELSE 'partial_fabrication_missed' END"
AI1 = "CASE WHEN pred_b = 'FAKE' OR greatest(score_b, score_p, score_l) >= 0.65 THEN '{n}_detected' WHEN greatest(spoof_b, spoof_p, spoof_l) >= 0.95 THEN '{n}_file_level_missed_but_segment_suspicious' ELSE '{n}_missed' END"
HU1 = "CASE WHEN pred_b = 'FAKE' OR score_b >= 0.65 OR score_l >= 0.55 THEN '{n}_manipulation_detected' ELSE '{n}_missed' END"
V1 = f"""d1 AS (SELECT *, CASE WHEN m = 'clean_direct' AND o = 'human' THEN CASE WHEN score_p < 0.65 AND spoof_b < 0.98 THEN 'clean_human_accepted' WHEN pred_b = 'FAKE' OR pred_p = 'FAKE' THEN 'clean_human_false_alarm' ELSE 'clean_human_borderline' END
  WHEN m = 'clean_direct' AND o = 'ai' THEN CASE WHEN pred_b = 'FAKE' THEN 'direct_ai_detected' WHEN spoof_b >= 0.95 OR ratio_b >= 0.20 OR score_l >= 0.55 THEN 'direct_ai_file_level_missed_but_segment_suspicious' ELSE 'direct_ai_missed' END
  WHEN m = 'human_replay' AND o = 'human' THEN {HU1.format(n='human_replay')} WHEN m = 'mixer_processed' AND o = 'human' THEN {HU1.format(n='human_mixer')} WHEN m = 'ai_replay' AND o = 'ai' THEN {AI1.format(n='ai_replay')} WHEN m = 'mixer_processed' AND o = 'ai' THEN {AI1.format(n='ai_mixer')}
  WHEN m = 'partial_ai_insert' THEN {PART.format(hit='hit_b OR hit_p OR hit_l')} ELSE 'unknown_review_required' END AS calibrated_status FROM j)"""
HU2 = "CASE WHEN pred_b = 'FAKE' OR score_b >= 0.65 OR score_l >= 0.55 THEN '{n}_manipulation_detected' ELSE '{n}_missed' END"
V2 = f"""d0 AS (SELECT *, pred_p = 'REAL' OR score_p < 0.70 AS lowp, pred_l = 'REAL' OR score_l < 0.75 AS lowl, spoof_b >= 0.995 OR ratio_b >= 0.50 AS ext, pred_b = 'FAKE' OR score_b >= 0.65 AS fnd, spoof_b >= 0.95 OR ratio_b >= 0.20 AS hot FROM j),
d2 AS (SELECT *, CASE WHEN m = 'clean_direct' AND o = 'human' THEN CASE WHEN lowp AND lowl AND NOT ext THEN 'clean_human_accepted' WHEN NOT lowp AND NOT lowl AND (ext OR fnd) THEN 'clean_human_false_alarm' ELSE 'clean_human_borderline' END
  WHEN m = 'clean_direct' AND o = 'ai' THEN CASE WHEN hot THEN 'direct_ai_file_level_missed_but_segment_suspicious' WHEN score_l >= 0.55 OR score_p >= 0.55 THEN 'direct_ai_detected' ELSE 'direct_ai_missed' END WHEN m = 'human_replay' THEN {HU2.format(n='human_replay')}
  WHEN m = 'ai_replay' THEN CASE WHEN fnd THEN 'ai_replay_detected' WHEN hot THEN 'ai_replay_file_level_missed_but_segment_suspicious' WHEN score_l >= 0.55 THEN 'ai_replay_detected' ELSE 'ai_replay_missed' END WHEN m = 'mixer_processed' AND o = 'human' THEN {HU2.format(n='human_mixer')}
  WHEN m = 'mixer_processed' AND o = 'ai' THEN CASE WHEN fnd OR score_l >= 0.55 THEN 'ai_mixer_detected' WHEN hot THEN 'ai_mixer_file_level_missed_but_segment_suspicious' ELSE 'ai_mixer_missed' END WHEN m = 'partial_ai_insert' THEN {PART.format(hit='hit_b OR hit_l')} ELSE 'unknown_review_required' END AS calibrated_status FROM d0)"""


def decided(spark, sf, layer):
    t = three_models(spark, sf)
    return t.select("*", *[v.alias(k) for k, v in layer(t.columns).items()])


@query("f12_decision_first", f"{J3}, {V1} SELECT sample_id, calibrated_status, {RISK} FROM d1")
def decision_first(spark, sf):
    return decided(spark, sf, R.decision_first).select("sample_id", "calibrated_status", "calibrated_risk_level", "needs_manual_review")


@query("f12_decision_second", f"{J3}, {V2} SELECT sample_id, calibrated_status, {RISK} FROM d2")
def decision_second(spark, sf):
    return decided(spark, sf, R.decision_second).select("sample_id", "calibrated_status", "calibrated_risk_level", "needs_manual_review")


CAUGHT = "('human_replay_manipulation_detected', 'human_mixer_manipulation_detected')"


def three_status(spark, sf):
    out = None
    for v in I.VARIANTS:
        t = with_status(spark, sf, v).select("sample_id", c("status").alias(f"st_{v}"), c("decision_score").alias(f"score_{v}"))
        out = t if out is None else join_ids(out, t, ["sample_id"])
    return out


@query("f13_disagreement", f"""{J3} SELECT sample_id, CASE WHEN st_b = st_p AND st_p = st_l THEN 'agreement' WHEN st_b = 'clean_human_accepted' AND st_p <> 'clean_human_accepted' THEN 'clean_human_disagreement' WHEN st_b IN {CAUGHT} AND st_p NOT IN {CAUGHT} THEN 'replay_mixer_disagreement'
  WHEN st_b = 'partial_fabrication_detected' AND st_p <> 'partial_fabrication_detected' THEN 'partial_disagreement' WHEN contains(st_b, 'direct_ai') OR contains(st_p, 'direct_ai') THEN 'direct_ai_disagreement' ELSE 'mixed_disagreement' END AS disagreement,
  array_to_string(list_filter([CASE WHEN st_b <> st_p THEN 'baseline_vs_r2_product_status_mismatch' END, CASE WHEN score_b >= 0.65 AND score_p < 0.5 THEN 'baseline_high_r2_low_file' END, CASE WHEN score_b < 0.5 AND score_p >= 0.65 THEN 'baseline_low_r2_high_file' END, CASE WHEN st_p <> st_l THEN 'r2_product_vs_r2_loss_mismatch' END], lambda x: x IS NOT NULL), ',') AS flags FROM j""")
def disagreement(spark, sf):
    b, p, lo = (c(f"st_{v}") for v in I.VARIANTS)
    flags = R.disagreement_flags(b, p, lo, c("score_baseline"), c("score_product"))
    return three_status(spark, sf).select("sample_id", R.disagreement(b, p, lo).alias("disagreement"), F.array_join(flags, ",").alias("flags"))


@query("f14_two_stage_labels", f"""{J3} SELECT sample_id, CASE WHEN pred_b = 'FAKE' THEN coalesce(nullif(CASE WHEN sample_id % 13 = 0 THEN '' WHEN score_p >= 0.55 THEN m ELSE 'unknown_channel_artifact' END, ''), 'unknown_channel_artifact') ELSE 'clean' END AS final_type FROM j""")
def two_stage_labels(spark, sf):
    t = three_models(spark, sf)
    rep = F.when(c("sample_id") % 13 == 0, "").otherwise(R.confident_label(c("manipulation_type_baseline"), c("decision_score_product"), 0.55))
    return t.select("sample_id", R.two_stage_label((c("prediction_baseline") == "FAKE").cast("int"), rep).alias("final_type"))


DIAG = f"""{PROF}, bd AS (SELECT rk.file_id, bool_and(greatest(0::DOUBLE, least(end_sec, region_end) - greatest(start_sec, region_start)) > 0 AND greatest(0::DOUBLE, least(end_sec, region_end) - greatest(start_sec, region_start)) / 4 < 0.5) FILTER (r <= 5) AS bonly, count(*) FILTER (r <= 5 AND y_true = 1) AS i5 FROM rk JOIN f USING (file_id) WHERE region_end IS NOT NULL GROUP BY 1),
dl AS (SELECT f.file_id, f.file_category, pr.hit5, h50 / segment_count >= 0.4 AS broad, CASE WHEN f.file_id % 101 = 0 THEN 'inference_error' WHEN h50 / segment_count >= 0.4 THEN CASE WHEN hit5 THEN 'topk_hits_but_broad_activation' ELSE 'broad_activation_not_localized' END WHEN hit1 THEN 'localized_success' WHEN hit5 THEN 'topk_hits_but_broad_activation'
  WHEN coalesce(bonly, false) AND i5 = 0 THEN 'boundary_only_signal' ELSE 'no_timestamp_hit' END AS label FROM f JOIN pr USING (file_id) JOIN bd USING (file_id))"""


def diagnosed(spark, sf):
    from echotrail.operators.intervals import overlap_label
    f = I.files(spark, sf).where(c("region_end").isNotNull()).select("file_id", "file_category", "region_start", "region_end")
    top = top_rows(I.segments(spark, sf), ["file_id"], [c("prob").desc(), "start_sec", "segment_id"], 5, "_r")
    lab = overlap_label(c("start_sec"), c("end_sec"), c("region_start"), c("region_end"), 0.5)["region_label"]
    edge = join_ids(top, f, ["file_id"]).groupBy("file_id").agg(F.min(lab == "boundary_overlap").alias("boundary_only"), F.count_if(c("y_true") == 1).alias("inside5"))
    j = join_ids(join_ids(profile(spark, sf, [0.50]), f, ["file_id"]), edge, ["file_id"]).withColumn("broad", C.high_fraction(0.50) >= 0.40)
    return j.withColumn("label", R.localization_diagnosis(c("file_id") % 101 == 0, F.lit("none"), c("broad"), c("top1_hit"), c("top5_hit"), c("inside5"), c("boundary_only")))


@query("f15_localization_diagnosis", f"{DIAG} SELECT file_id, label FROM dl")
def localization_diagnosis(spark, sf):
    return diagnosed(spark, sf).select("file_id", "label")


@query("a71_diagnostic_summary", f"""{DIAG}, s AS (SELECT count(*) AS total_partial_files, count(*) FILTER (file_category = 'ai_fabricated') AS ai_files, count(*) FILTER (file_category = 'human_fabricated') AS human_files, count(*) FILTER (label = 'localized_success') AS localized_success_count, count(*) FILTER (hit5) AS top5_hit_count,
  count(*) FILTER (broad OR label IN ('broad_activation_not_localized', 'topk_hits_but_broad_activation')) AS broad_activation_count, count(*) FILTER (label = 'no_timestamp_hit') AS no_timestamp_hit_count, count(*) FILTER (label = 'boundary_only_signal') AS b,
  count(*) FILTER (label IN ('broad_activation_not_localized', 'topk_hits_but_broad_activation')) AS bl, round(avg(hit5::INT) FILTER (file_category = 'ai_fabricated'), 6) AS ai_top5_hit_rate, round(avg(hit5::INT) FILTER (file_category = 'human_fabricated'), 6) AS human_top5_hit_rate FROM dl)
SELECT total_partial_files, ai_files, human_files, localized_success_count, top5_hit_count, broad_activation_count, no_timestamp_hit_count, ai_top5_hit_rate, human_top5_hit_rate, CASE WHEN total_partial_files = 0 THEN 'insufficient_data_rerun_diagnostics' WHEN localized_success_count >= total_partial_files * 0.4 THEN 'gate_tuning_may_be_sufficient_review_thresholds'
  WHEN b >= total_partial_files * 0.3 THEN 'investigate_splice_boundary_indicator_model' WHEN bl >= total_partial_files * 0.5 THEN 'segment_retraining_with_non_partial_negatives_and_file_level_partial_candidate' WHEN no_timestamp_hit_count >= total_partial_files * 0.5 THEN 'segment_model_redesign_and_file_level_partial_candidate'
  ELSE 'combine_gate_tuning_with_file_level_partial_candidate_and_segment_retraining' END AS recommendation FROM s""")
def diagnostic_summary(spark, sf):
    d = diagnosed(spark, sf)
    wide = c("label").isin("broad_activation_not_localized", "topk_hits_but_broad_activation")
    ai, human = c("file_category") == "ai_fabricated", c("file_category") == "human_fabricated"
    s = d.agg(F.count(F.lit(1)).alias("total_partial_files"), F.count_if(ai).alias("ai_files"), F.count_if(human).alias("human_files"),
              F.count_if(c("label") == "localized_success").alias("localized_success_count"), F.count_if(c("top5_hit")).alias("top5_hit_count"),
              F.count_if(c("broad") | wide).alias("broad_activation_count"), F.count_if(c("label") == "no_timestamp_hit").alias("no_timestamp_hit_count"),
              F.count_if(c("label") == "boundary_only_signal").alias("_b"), F.count_if(wide).alias("_w"),
              C.rate(ai, c("top5_hit")).alias("ai_top5_hit_rate"), C.rate(human, c("top5_hit")).alias("human_top5_hit_rate"))
    n = c("total_partial_files")
    rec = (F.when(n == 0, "insufficient_data_rerun_diagnostics")
           .when(c("localized_success_count") >= n * 0.4, "gate_tuning_may_be_sufficient_review_thresholds")
           .when(c("_b") >= n * 0.3, "investigate_splice_boundary_indicator_model")
           .when(c("_w") >= n * 0.5, "segment_retraining_with_non_partial_negatives_and_file_level_partial_candidate")
           .when(c("no_timestamp_hit_count") >= n * 0.5, "segment_model_redesign_and_file_level_partial_candidate")
           .otherwise("combine_gate_tuning_with_file_level_partial_candidate_and_segment_retraining"))
    return rounded(s.withColumn("recommendation", rec).drop("_b", "_w"))


@query("f22_origin_failures", f"""WITH b AS ({I.RESULTS_SQL['baseline']}), k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'no' WHEN abs(decision_score - 0.7::DOUBLE) <= 0.05::DOUBLE AND manipulation_type <> 'partial_ai_insert' THEN 'borderline' WHEN ground_truth_origin = 'human' THEN CASE WHEN prediction = 'REAL' THEN 'yes' ELSE 'no' END
  WHEN ground_truth_origin = 'ai' THEN CASE WHEN prediction = 'FAKE' THEN 'yes' ELSE 'no' END WHEN NOT coalesce(suspicious_end_time > suspicious_start_time, false) THEN 'borderline' WHEN partial_region_detected OR prediction = 'FAKE' THEN 'yes' WHEN abs(decision_score - 0.7::DOUBLE) <= 0.05::DOUBLE THEN 'borderline' ELSE 'no' END AS correct FROM b)
SELECT sample_id, correct AS correct_origin, CASE WHEN error IS NOT NULL THEN error WHEN correct = 'borderline' THEN 'borderline' WHEN correct = 'yes' THEN '' WHEN manipulation_type = 'partial_ai_insert' AND NOT coalesce(suspicious_end_time > suspicious_start_time, false) THEN 'partial_not_evaluated_missing_timestamp'
  WHEN ground_truth_origin = 'human' AND prediction = 'FAKE' THEN CASE WHEN manipulation_type IN ('mixer_processed', 'human_replay') THEN 'fp_processed_human' ELSE 'fp_human' END WHEN ground_truth_origin = 'ai' AND prediction = 'REAL' THEN CASE WHEN manipulation_type IN ('ai_replay', 'mixer_processed') THEN 'fn_ai_replay' ELSE 'fn_direct_ai' END
  WHEN ground_truth_origin = 'mixed' THEN 'missed_partial_insert' WHEN partial_region_detected THEN 'false_partial_alarm' ELSE 'wrong_origin' END AS failure_type FROM k""")
def origin_failures(spark, sf):
    b = I.model_results(spark, sf).withColumn("effective_threshold", F.lit(None).cast("double"))
    b = b.withColumn("correct_origin", R.origin_correctness())
    return b.select("sample_id", "correct_origin", R.failure_type(c("correct_origin")).alias("failure_type"))


@query("a88_failure_patterns", f"""WITH b AS ({I.RESULTS_SQL['baseline']}), x AS (SELECT manipulation_type, CASE WHEN error IS NOT NULL THEN error WHEN ground_truth_origin = 'human' AND prediction = 'FAKE' THEN 'fp_' || manipulation_type WHEN ground_truth_origin = 'ai' AND prediction = 'REAL' THEN 'fn_' || manipulation_type WHEN suspicious_chunk_ratio > 0.5 THEN 'hot' END AS ft FROM b),
n AS (SELECT manipulation_type, ft, count(*) AS n FROM x WHERE ft IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY manipulation_type ORDER BY n DESC, ft) AS r FROM n)
SELECT manipulation_type, string_agg(ft || ' (' || CAST(n AS VARCHAR) || ')', '; ' ORDER BY r) AS patterns FROM k WHERE r <= 3 GROUP BY 1""")
def failure_patterns(spark, sf):
    o, p, m = c("ground_truth_origin"), c("prediction"), c("manipulation_type")
    ft = (F.when(c("error").isNotNull(), c("error")).when((o == "human") & (p == "FAKE"), F.concat(F.lit("fp_"), m))
          .when((o == "ai") & (p == "REAL"), F.concat(F.lit("fn_"), m)).when(c("suspicious_chunk_ratio") > 0.5, "hot"))
    return P.top_texts(I.model_results(spark, sf).withColumn("ft", ft), ["manipulation_type"], "ft", 3, "patterns")


PRODUCT = """CASE WHEN m = 'clean_direct' AND o = 'human' THEN CASE WHEN edge THEN 'clean_human_borderline' WHEN pred = 'REAL' THEN 'clean_human_accepted' ELSE 'clean_human_false_alarm' END WHEN m = 'clean_direct' AND o = 'ai' THEN CASE WHEN edge THEN 'direct_ai_borderline' WHEN fnd THEN 'direct_ai_detected' WHEN hot THEN 'direct_ai_file_level_missed_but_segment_suspicious' ELSE 'direct_ai_missed' END
  WHEN o = 'human' AND m IN ('human_replay', 'mixer_processed') THEN CASE WHEN fnd THEN 'processed_human_manipulation_detected' ELSE 'processed_human_missed' END WHEN o = 'ai' AND m IN ('ai_replay', 'mixer_processed') THEN CASE WHEN fnd THEN 'ai_replay_or_processed_detected' WHEN hot THEN CASE WHEN m = 'ai_replay' THEN 'ai_replay_file_level_missed_but_segment_suspicious' ELSE 'processed_ai_file_level_missed_but_segment_suspicious' END ELSE 'ai_replay_or_processed_missed' END
  WHEN m = 'partial_ai_insert' THEN CASE WHEN NOT reg THEN 'partial_not_evaluated_missing_timestamp' WHEN hit THEN 'partial_fabrication_detected' ELSE 'partial_fabrication_missed' END WHEN edge THEN 'borderline_needs_review' ELSE 'unknown_review_required' END"""


@query("f23_product_status", f"""WITH b AS ({I.RESULTS_SQL['baseline']}), t AS ({I.TIMELINE_SQL}), cm AS (SELECT sample_id, max(spoof_probability) AS mx, count(*) FILTER (spoof_probability >= 0.65) / count(*) AS rt FROM (SELECT * FROM t QUALIFY evaluated OR NOT bool_or(evaluated) OVER (PARTITION BY sample_id)) GROUP BY 1),
x AS (SELECT b.sample_id, manipulation_type AS m, ground_truth_origin AS o, prediction AS pred, abs(decision_score - 0.7::DOUBLE) <= 0.05::DOUBLE AS edge, prediction = 'FAKE' OR decision_score >= 0.65 AS fnd, coalesce(mx >= 0.95 OR rt >= 0.30, false) AS hot, coalesce(suspicious_end_time > suspicious_start_time, false) AS reg, partial_region_detected AS hit, mx IS NOT NULL AS has_timeline FROM b LEFT JOIN cm USING (sample_id))
SELECT sample_id, {PRODUCT} AS product_status, hot AS segment_suspicious, has_timeline FROM x""")
def product_status(spark, sf):
    cm = T.chunk_metrics(I.timeline(spark, sf)).select("sample_id", "max_chunk_spoof", "suspicious_chunk_ratio")
    b = I.model_results(spark, sf).drop("max_chunk_spoof", "suspicious_chunk_ratio").withColumn("effective_threshold", F.lit(None).cast("double"))
    j = join_ids(b, cm, ["sample_id"], "left")
    hot = R.known(c("max_chunk_spoof") >= 0.95) | R.known(c("suspicious_chunk_ratio") >= 0.30)
    return j.select("sample_id", R.product_status().alias("product_status"), hot.alias("segment_suspicious"), c("max_chunk_spoof").isNotNull().alias("has_timeline"))


def wstat_sql():
    hot, found = "(max_chunk_spoof >= 0.95 OR suspicious_chunk_ratio >= 0.3)", "(decision_score >= 0.65 OR max_chunk_spoof >= 0.95 OR suspicious_chunk_ratio >= 0.3)"
    sg = lambda hit, n: f"CASE WHEN {hit} THEN '{n}_detected' WHEN {hot} THEN '{n}_file_level_missed_but_segment_suspicious' ELSE '{n}_missed' END"
    pr = lambda n, g="manipulation_detected": f"CASE WHEN {found} THEN '{n}_{g}' ELSE '{n}_missed' END"
    st = "decision_score >= 0.6 OR decision_score >= 0.65"
    return f"""CASE WHEN error IS NOT NULL THEN 'unknown_review_required' WHEN m = 'partial_ai_insert' THEN CASE WHEN NOT coalesce(suspicious_end_time > suspicious_start_time, false) THEN 'partial_fabrication_not_evaluable' WHEN partial_region_detected THEN 'partial_fabrication_detected' ELSE 'partial_fabrication_missed' END
  WHEN m = 'clean_direct' AND o = 'human' THEN CASE WHEN abs(decision_score - 0.6::DOUBLE) <= 0.05::DOUBLE THEN 'clean_human_borderline' WHEN decision_score >= 0.6 THEN 'clean_human_false_alarm' ELSE 'clean_human_accepted' END WHEN m = 'clean_direct' AND o = 'ai' THEN {sg('decision_score >= 0.6', 'direct_ai')}
  WHEN m = 'human_replay' THEN {pr('human_replay')} WHEN m = 'ai_replay' THEN {sg(st, 'ai_replay')} WHEN m = 'mixer_processed' AND o = 'human' THEN {pr('human_mixer')} WHEN m = 'mixer_processed' AND o = 'ai' THEN {sg(st, 'ai_mixer')}
  WHEN m IN ('whatsapp_compressed', 'phone_recorded') AND o = 'human' THEN {pr('human_processed', 'detected')} WHEN m IN ('whatsapp_compressed', 'phone_recorded') AND o = 'ai' THEN {sg(st, 'ai_processed')} WHEN abs(decision_score - 0.6::DOUBLE) <= 0.05::DOUBLE THEN 'borderline_needs_review' ELSE 'unknown_review_required' END"""


KIND = "CASE WHEN sample_id % 6 = 0 THEN 'whatsapp_compressed' WHEN sample_id % 6 = 1 THEN 'phone_recorded' WHEN sample_id % 6 = 2 THEN 'odd_kind' ELSE manipulation_type END"
WST = f"WITH b AS ({I.RESULTS_SQL['baseline']}), w0 AS (SELECT * EXCLUDE (manipulation_type, ground_truth_origin), {KIND} AS m, ground_truth_origin AS o FROM b), w AS (SELECT *, {wstat_sql()} AS status FROM w0)"


def window_scored(spark, sf):
    k = c("sample_id") % 6
    kind = F.when(k == 0, "whatsapp_compressed").when(k == 1, "phone_recorded").when(k == 2, "odd_kind").otherwise(c("manipulation_type"))
    return (I.model_results(spark, sf).withColumn("manipulation_type", kind).withColumn("mean_spoof_score", c("decision_score")).withColumn("threshold_used", F.lit(0.6))
            .withColumn("max_spoof_score", c("max_chunk_spoof")).withColumn("suspicious_window_ratio", c("suspicious_chunk_ratio")))


@query("f24_window_status", f"{WST} SELECT sample_id, status FROM w")
def window_status(spark, sf):
    return window_scored(spark, sf).select("sample_id", R.window_status().alias("status"))


@query("a87_status_metrics", f"""{WST} SELECT CASE WHEN sample_id % 2 = 0 THEN 'set_a' ELSE 'set_b' END AS dataset, count(*) AS total_files, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (status = 'clean_human_false_alarm') AS clean_human_false_alarm,
  count(*) FILTER (status IN ('direct_ai_detected', 'direct_ai_file_level_missed_but_segment_suspicious')) AS direct_ai_detected_or_segment, count(*) FILTER (status = 'human_replay_manipulation_detected') AS human_replay_detected, count(*) FILTER (status = 'human_processed_detected') AS human_processed_detected,
  count(*) FILTER (status IN ('ai_processed_detected', 'ai_processed_file_level_missed_but_segment_suspicious')) AS ai_processed_detected_or_segment, count(*) FILTER (status = 'partial_fabrication_detected') AS partial_fabrication_detected FROM w GROUP BY 1""")
def status_metrics(spark, sf):
    w = window_scored(spark, sf).withColumn("status", R.window_status()).withColumn("dataset", F.when(c("sample_id") % 2 == 0, "set_a").otherwise("set_b"))
    s = c("status")
    hit = lambda n, *extra: F.count_if(s.isin(n, *extra))
    return w.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(c("error").isNotNull()).alias("errors"), hit("clean_human_false_alarm").alias("clean_human_false_alarm"),
        hit("direct_ai_detected", "direct_ai_file_level_missed_but_segment_suspicious").alias("direct_ai_detected_or_segment"),
        hit("human_replay_manipulation_detected").alias("human_replay_detected"), hit("human_processed_detected").alias("human_processed_detected"),
        hit("ai_processed_detected", "ai_processed_file_level_missed_but_segment_suspicious").alias("ai_processed_detected_or_segment"), hit("partial_fabrication_detected").alias("partial_fabrication_detected"))


REP_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in P.STATUS_REPORT)
REPORT = f"""{J3}, {V2}, rp AS (SELECT d2.sample_id, d2.calibrated_status, ratio_b, CASE WHEN d2.calibrated_status IN {CAUGHT} AND ratio_b >= 0.5 THEN 'high' ELSE v.risk END AS risk, v.overall_status, v.origin_hint, v.manipulation_hint, v.confidence FROM d2 JOIN (VALUES {REP_VALUES}) v(k, risk, overall_status, origin_hint, manipulation_hint, confidence) ON v.k = d2.calibrated_status)"""


def reported(spark, sf):
    return P.report_fields(decided(spark, sf, R.decision_second), "suspicious_chunk_ratio_baseline")


@query("f25_report_fields", f"{REPORT} SELECT sample_id, calibrated_status, risk, overall_status, origin_hint, manipulation_hint, confidence FROM rp")
def report_fields(spark, sf):
    return reported(spark, sf).select("sample_id", *P.STATUS_REPORT_COLUMNS)


@query("f26_nested_reports", f"""{REPORT}, t AS ({I.TIMELINE_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY spoof_probability DESC, chunk_id) AS r FROM t), sg AS (SELECT sample_id, to_json(list({{'chunk_id': chunk_id, 'score': round(spoof_probability, 4)}} ORDER BY r)) AS segments FROM k WHERE r <= 5 AND spoof_probability >= 0.65 GROUP BY 1)
SELECT sample_id, '{{"sample_id":' || CAST(sample_id AS VARCHAR) || ',"status":"' || calibrated_status || '","risk":"' || risk || '","hints":{{"origin":"' || origin_hint || '","manipulation":"' || manipulation_hint || '"}}}}' AS report, coalesce(CAST(segments AS VARCHAR), '[]') AS segments FROM rp LEFT JOIN sg USING (sample_id)""")
def nested_reports(spark, sf):
    top = top_rows(I.timeline(spark, sf), ["sample_id"], [c("spoof_probability").desc(), c("chunk_id").asc()], 5, "r").where(c("spoof_probability") >= 0.65)
    seg = P.nested_segments(top.select("sample_id", "r", "chunk_id", F.round("spoof_probability", 4).alias("score")), "sample_id", "r", ["chunk_id", "score"])
    j = join_ids(reported(spark, sf), seg, ["sample_id"], "left")
    doc = F.struct("sample_id", c("calibrated_status").alias("status"), "risk",
                   F.struct(c("origin_hint").alias("origin"), c("manipulation_hint").alias("manipulation")).alias("hints"))
    return j.select("sample_id", F.to_json(doc).alias("report"), F.coalesce(F.to_json("segments"), F.lit("[]")).alias("segments"))


# Statuses reported first, one sample each (fixed values).
REPORT_PRIORITY = ["clean_human_accepted", "clean_human_borderline", "clean_human_false_alarm", "direct_ai_file_level_missed_but_segment_suspicious",
                   "human_replay_manipulation_detected", "ai_replay_detected", "ai_replay_file_level_missed_but_segment_suspicious",
                   "human_mixer_manipulation_detected", "ai_mixer_detected", "partial_fabrication_detected"]
PRI = ", ".join(f"('{s}', {i})" for i, s in enumerate(REPORT_PRIORITY))


@query("f27_report_samples", f"""{J3}, {V2}, p1 AS (SELECT v.pri, min(sample_id) AS sample_id FROM d2 JOIN (VALUES {PRI}) v(s, pri) ON v.s = calibrated_status GROUP BY 1), u AS (SELECT sample_id, 0 AS g, pri FROM p1 UNION ALL SELECT sample_id, 1, sample_id FROM d2 WHERE sample_id NOT IN (SELECT sample_id FROM p1)) SELECT sample_id FROM u ORDER BY g, pri LIMIT 12""")
def report_samples(spark, sf):
    d = decided(spark, sf, R.decision_second).select("sample_id", "calibrated_status")
    pri = F.array_position(F.array(*[F.lit(s) for s in REPORT_PRIORITY]), c("calibrated_status"))
    first = d.where(pri > 0).groupBy(pri.alias("pri")).agg(F.min("sample_id").alias("sample_id"))
    rest = d.select("sample_id").orderBy("sample_id").limit(12 + len(REPORT_PRIORITY)).join(first.select("sample_id"), "sample_id", "left_anti")
    both = first.select("sample_id", F.lit(0).alias("g"), c("pri").cast("long").alias("pri")).unionByName(rest.select("sample_id", F.lit(1).alias("g"), c("sample_id").alias("pri")))
    return both.orderBy("g", "pri").limit(12).select("sample_id")


# Summaries -------------------------------------------------------------------------------

CAT_STATUSES = [s for _, s in P.PRODUCT_COUNTS]


@query("a62_category_summary", f"{BST} SELECT manipulation_type, ground_truth_origin, prediction, error IS NOT NULL AS failed, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS status_{s}" for s in CAT_STATUSES) + """, round(avg(decision_score), 6) AS avg_decision_score, round(avg(suspicious_chunk_ratio), 6) AS avg_suspicious_chunk_ratio, round(avg(max_chunk_spoof), 6) AS avg_max_chunk_spoof,
  round(count(*) FILTER (status = 'partial_fabrication_detected') / nullif(count(*) FILTER (status IN ('partial_fabrication_detected', 'partial_fabrication_missed')), 0), 6) AS partial_detection_rate FROM s GROUP BY 1, 2, 3, 4""")
def category_summary(spark, sf):
    df = with_status(spark, sf).withColumn("failed", c("error").isNotNull())
    out = P.status_counts_wide(df, ["manipulation_type", "ground_truth_origin", "prediction", "failed"], "status", CAT_STATUSES, ["decision_score", "suspicious_chunk_ratio", "max_chunk_spoof"])
    hit, miss = c("status_partial_fabrication_detected"), c("status_partial_fabrication_missed")
    return rounded(out.withColumn("partial_detection_rate", ratio(hit, hit + miss)))


def pm_sql(src, keys, status="status", n=None):
    cnt = (lambda cond: f"CAST(coalesce(sum({n}) FILTER ({cond}), 0) AS BIGINT)") if n else (lambda cond: f"count(*) FILTER ({cond})")
    cl, mi, m, o = "manipulation_type = 'clean_direct'", "manipulation_type = 'mixer_processed'", "manipulation_type", "ground_truth_origin"
    sizes = {"clean_human_n": f"{cl} AND {o} = 'human'", "direct_ai_n": f"{cl} AND {o} = 'ai'", "human_replay_n": f"{m} = 'human_replay'", "ai_replay_n": f"{m} = 'ai_replay'", "human_mixer_n": f"{mi} AND {o} = 'human'", "ai_mixer_n": f"{mi} AND {o} = 'ai'",
             "partial_fabrication_evaluable_n": f"{m} = 'partial_ai_insert' AND coalesce(suspicious_end_time > suspicious_start_time, false)"}
    cols = ", ".join([f"{cnt(v)} AS {k}" for k, v in sizes.items()] + [f"{cnt(f'{status} = {chr(39)}{s}{chr(39)}')} AS {k}" for k, s in P.PRODUCT_COUNTS])
    sc = """round(0.2::DOUBLE * (clean_human_accept_count / greatest(clean_human_n, 1) + (direct_ai_detected_count + direct_ai_segment_suspicious_count) / greatest(direct_ai_n, 1) + (human_replay_detected_count / greatest(human_replay_n, 1) + ai_replay_detected_count / greatest(ai_replay_n, 1)) / 2
      + (human_mixer_detected_count / greatest(human_mixer_n, 1) + ai_mixer_detected_count / greatest(ai_mixer_n, 1)) / 2 + partial_fabrication_detected_count / greatest(partial_fabrication_evaluable_n, 1)), 6) AS product_score"""
    kk = f"{keys}, " if keys else ""
    return f"SELECT *, round(CASE WHEN clean_human_n > 0 THEN clean_human_borderline_count / clean_human_n ELSE 0 END::DOUBLE, 6) AS clean_human_review_rate, {sc} FROM (SELECT {kk}count(*) AS n_samples, {cols} FROM {src}{' GROUP BY ' + keys if keys else ''})"


@query("a63_product_metrics", f"{BST}, k AS (SELECT *, 'baseline' AS source FROM s) {pm_sql('k', 'source')}")
def product_metrics(spark, sf):
    return rounded(P.product_metrics(with_status(spark, sf).withColumn("source", F.lit("baseline")), ["source"], "status"))


VOTES, SEGS, RATS = [0.60, 0.70, 0.80], [0.85, 0.95], [0.20, 0.30, 0.40]


@query("a64_threshold_sweep", f"""WITH b AS ({I.GAP_RESULTS_SQL}), k0 AS (SELECT b.*, v.v AS vote_threshold, g.v AS segment_threshold, t.v AS ratio_threshold FROM b, (VALUES {', '.join(f'({x}::DOUBLE)' for x in VOTES)}) v(v), (VALUES {', '.join(f'({x}::DOUBLE)' for x in SEGS)}) g(v), (VALUES {', '.join(f'({x}::DOUBLE)' for x in RATS)}) t(v)),
k AS ({gap_rows_sql('k0', 'vote_threshold')}), s AS (SELECT k.*, {gap_status_sql('vote_threshold', 'segment_threshold', 'ratio_threshold')} AS status, 'baseline' AS source FROM k) {pm_sql('s', 'source, vote_threshold, segment_threshold, ratio_threshold')}""")
def threshold_sweep(spark, sf):
    return rounded(P.threshold_sweep(I.gap_results(spark, sf), "baseline", VOTES, SEGS, RATS))


ENS = f"{THREE}, e AS (SELECT b.sample_id, b.manipulation_type, b.ground_truth_origin, b.suspicious_start_time, b.suspicious_end_time, greatest(b.decision_score, p.decision_score, l.decision_score) AS decision_score, greatest(b.max_chunk_spoof, p.max_chunk_spoof, l.max_chunk_spoof) AS max_chunk_spoof, greatest(b.suspicious_chunk_ratio, p.suspicious_chunk_ratio, l.suspicious_chunk_ratio) AS suspicious_chunk_ratio, b.partial_region_detected OR p.partial_region_detected OR l.partial_region_detected AS partial_region_detected, CAST(NULL AS VARCHAR) AS error FROM b JOIN p USING (sample_id) JOIN l USING (sample_id))"


@query("a65_ensemble_rows", f"{ENS} SELECT sample_id, decision_score, max_chunk_spoof, suspicious_chunk_ratio, partial_region_detected, {status_sql()} AS status FROM e")
def ensemble_rows(spark, sf):
    e = P.ensemble(three_models(spark, sf), list(I.VARIANTS)).withColumn("status", R.baseline_status())
    return e.select("sample_id", "decision_score", "max_chunk_spoof", "suspicious_chunk_ratio", "partial_region_detected", "status")


@query("a66_status_delta", f"{J3}, x AS (SELECT st_b AS s, count(*) AS n FROM j GROUP BY 1), y AS (SELECT st_p AS s, count(*) AS n FROM j GROUP BY 1) SELECT coalesce(x.s, y.s) AS status, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y ON x.s = y.s")
def status_delta(spark, sf):
    return P.count_delta(with_status(spark, sf), with_status(spark, sf, "product"), "status")


AIOK = "('direct_ai_detected', 'direct_ai_file_level_missed_but_segment_suspicious')"


@query("a67_model_improvements", f"{J3} SELECT m AS manipulation_type, count(*) AS n, count(*) FILTER (st_p IN {AIOK} AND st_b NOT IN {AIOK}) AS better_direct_ai, count(*) FILTER (st_b IN {AIOK} AND st_p NOT IN {AIOK}) AS worse_direct_ai, count(*) FILTER (st_p = 'clean_human_false_alarm' AND st_b <> 'clean_human_false_alarm') AS worse_clean_human FROM j GROUP BY 1")
def model_improvements(spark, sf):
    ok = ["direct_ai_detected", "direct_ai_file_level_missed_but_segment_suspicious"]
    t = join_ids(three_status(spark, sf), I.model_results(spark, sf).select("sample_id", "manipulation_type"), ["sample_id"])
    b, p = c("st_baseline"), c("st_product")
    return t.groupBy("manipulation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.isin(ok) & ~b.isin(ok)).alias("better_direct_ai"),
                                              F.count_if(b.isin(ok) & ~p.isin(ok)).alias("worse_direct_ai"), F.count_if((p == "clean_human_false_alarm") & (b != "clean_human_false_alarm")).alias("worse_clean_human"))


ORIGINS = ["likely_ai_generated", "likely_human", "inconclusive", "inconclusive_under_processing", "likely_ai_generated_with_processing", "unavailable"]
AISET, HUSET = "('likely_ai_generated', 'likely_ai_generated_with_processing')", "('likely_human', 'inconclusive', 'inconclusive_under_processing')"


@query("a68_label_agreement", f"""{THREE}, x AS (SELECT b.sample_id, b.ground_truth_origin AS o, {I._sql_list(ORIGINS)}[1 + CAST(b.decision_score * 100 AS BIGINT) % 6] AS sh, {I._sql_list(ORIGINS[:5])}[1 + CAST(p.decision_score * 100 AS BIGINT) % 5] AS ss FROM b JOIN p USING (sample_id)), y AS (SELECT * FROM x WHERE sh <> 'unavailable'),
z AS (SELECT o, sh = ss OR (sh IN {AISET} AND ss IN {AISET}) OR (sh IN {HUSET} AND ss IN {HUSET}) AS ag, CASE WHEN o = 'ai' THEN sh = 'likely_ai_generated' WHEN o = 'human' THEN sh IN {HUSET} ELSE false END AS sok, CASE WHEN o = 'ai' THEN ss = 'likely_ai_generated' WHEN o = 'human' THEN ss IN {HUSET} ELSE false END AS bok FROM y)
SELECT o AS origin, count(*) AS evaluated, round(avg(ag::INT), 6) AS agreement_rate, count(*) FILTER (NOT ag) AS disagreements, count(*) FILTER (sok AND NOT bok) AS helped, count(*) FILTER (bok AND NOT sok) AS hurt, count(*) FILTER (sok AND NOT bok) - count(*) FILTER (bok AND NOT sok) AS net_help FROM z GROUP BY 1""")
def label_agreement(spark, sf):
    t = three_models(spark, sf)
    pick = lambda vals, m: F.element_at(F.array(*[F.lit(v) for v in vals]), (F.round(c(f"decision_score_{m}") * 100).cast("long") % len(vals) + 1).cast("int"))
    t = t.select(c("ground_truth_origin_baseline").alias("origin"), pick(ORIGINS, "baseline").alias("sh"), pick(ORIGINS[:5], "product").alias("ss")).where(c("sh") != "unavailable")
    ai, human = ["likely_ai_generated", "likely_ai_generated_with_processing"], ["likely_human", "inconclusive", "inconclusive_under_processing"]
    sh, ss, o = c("sh"), c("ss"), c("origin")
    agree = (sh == ss) | (sh.isin(ai) & ss.isin(ai)) | (sh.isin(human) & ss.isin(human))
    right = lambda x: F.when(o == "ai", x == "likely_ai_generated").when(o == "human", x.isin(human)).otherwise(F.lit(False))
    helped, hurt = F.count_if(right(sh) & ~right(ss)), F.count_if(right(ss) & ~right(sh))
    return t.groupBy("origin").agg(F.count(F.lit(1)).alias("evaluated"), F.round(F.avg(agree.cast("int")), 6).alias("agreement_rate"), F.count_if(~agree).alias("disagreements"),
                                   helped.alias("helped"), hurt.alias("hurt"), (helped - hurt).alias("net_help"))


@query("a69_holdout_impact", f"""{J3}, x AS (SELECT m, o, unnest(['baseline', 'product', 'loss']) AS source, unnest([st_b, st_p, st_l]) AS s FROM j) SELECT source, count(*) AS n_samples, count(*) FILTER (m = 'clean_direct' AND o = 'human' AND s = 'clean_human_accepted') AS clean_human__accepted, count(*) FILTER (m = 'clean_direct' AND o = 'human' AND s = 'clean_human_false_alarm') AS clean_human__false_alarm,
  count(*) FILTER (m = 'clean_direct' AND o = 'ai' AND s = 'direct_ai_detected') AS direct_ai__detected, count(*) FILTER (m = 'clean_direct' AND o = 'ai' AND s = 'direct_ai_missed') AS direct_ai__missed, count(*) FILTER (m = 'partial_ai_insert' AND s = 'partial_fabrication_detected') AS partial__detected FROM x GROUP BY source""")
def holdout_impact(spark, sf):
    parts = None
    for v in I.VARIANTS:
        t = with_status(spark, sf, v).select(F.lit(v).alias("source"), "manipulation_type", "ground_truth_origin", "status")
        parts = t if parts is None else parts.unionByName(t)
    clean, s = c("manipulation_type") == "clean_direct", c("status")
    human, ai, partial = clean & (c("ground_truth_origin") == "human"), clean & (c("ground_truth_origin") == "ai"), c("manipulation_type") == "partial_ai_insert"
    return parts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(human & (s == "clean_human_accepted")).alias("clean_human__accepted"), F.count_if(human & (s == "clean_human_false_alarm")).alias("clean_human__false_alarm"),
        F.count_if(ai & (s == "direct_ai_detected")).alias("direct_ai__detected"), F.count_if(ai & (s == "direct_ai_missed")).alias("direct_ai__missed"), F.count_if(partial & (s == "partial_fabrication_detected")).alias("partial__detected"))


CONS = ["expected", "acceptable_with_manual_review", "needs_review", "unexpected_axis", "pipeline_error"]


@query("a70_axis_consistency", f"""{arb_cte()}, x AS (SELECT *, CASE WHEN file_id % 53 = 0 THEN 'exception' ELSE 'ok' END AS run FROM ar), y AS (SELECT file_category, CASE WHEN run = 'exception' THEN 'pipeline_error' WHEN file_category = 'ai_direct' THEN CASE status WHEN 'suspicious_origin_experimental' THEN 'expected' WHEN 'inconclusive_manual_review_experimental' THEN 'acceptable_with_manual_review' ELSE 'unexpected_axis' END
  WHEN file_category = 'ai_replay' THEN CASE WHEN status = 'suspicious_replay_experimental' THEN 'expected' WHEN status = 'suspicious_mixed_evidence_experimental' AND NOT eligible2 THEN 'needs_review' ELSE 'unexpected_axis' END WHEN file_category = 'ai_mixer' THEN CASE WHEN status = 'suspicious_mixer_channel_experimental' THEN 'expected' WHEN status = 'suspicious_mixed_evidence_experimental' AND NOT eligible2 THEN 'needs_review' ELSE 'unexpected_axis' END
  WHEN status = 'suspicious_partial_fabrication_experimental' AND eligible2 THEN 'expected' WHEN gate = 'global_activation_not_localized' THEN 'needs_review' WHEN starts_with(status, 'suspicious_') THEN 'acceptable_with_manual_review' ELSE 'needs_review' END AS cons FROM x)
SELECT file_category, count(*) AS total, {', '.join(f"count(*) FILTER (cons = '{k}') AS status_{k}" for k in CONS)} FROM y GROUP BY 1""")
def axis_consistency(spark, sf):
    t = arbitrated(spark, sf)
    run = F.when(c("file_id") % 53 == 0, "exception").otherwise("ok")
    cons = R.axis_consistency(c("file_category"), c("experimental_fusion_status"), run, c("arb.gate"), c("arb.eligible"))
    return P.status_counts_wide(t.withColumn("_c", cons), ["file_category"], "_c", CONS)


TYPES = ["human_replay", "ai_replay", "mixer_processed", "clean"]


def stage_two(spark, sf):
    t = three_models(spark, sf)
    pick = lambda vals, m, k: F.element_at(F.array(*[F.lit(v) for v in vals]), (F.round(c(f"{m}") * 100).cast("long") % k + 1).cast("int"))
    raw = pick(TYPES[:3], "decision_score_product", 3)
    return t.select("sample_id", F.when(c("manipulation_type_baseline").isin(TYPES[:3]), c("manipulation_type_baseline")).otherwise("clean").alias("expected"),
                    raw.alias("raw_type"), c("decision_score_loss").alias("confidence"), (c("prediction_baseline") == "FAKE").cast("int").alias("stage1"),
                    c("ground_truth_origin_baseline").alias("scope"))


ST2 = f"{J3}, x AS (SELECT sample_id, o AS scope, CASE WHEN m IN ('human_replay', 'ai_replay', 'mixer_processed') THEN m ELSE 'clean' END AS ex, {I._sql_list(TYPES[:3])}[1 + CAST(round(score_p * 100) AS BIGINT) % 3] AS raw, score_l AS conf, (pred_b = 'FAKE')::INT AS s1 FROM j)"


@query("a80_subtype_accuracy", f"""{ST2}, y AS (SELECT *, CASE WHEN conf >= 0.55 THEN raw ELSE 'unknown_channel_artifact' END AS rep FROM x WHERE ex <> 'clean'), z AS (SELECT *, CASE WHEN s1 = 1 THEN rep ELSE 'clean' END AS fin FROM y)
SELECT scope, count(*) AS n, round(avg((rep = ex)::INT), 6) AS stage2_accuracy, round(avg((rep = 'unknown_channel_artifact')::INT), 6) AS unknown_rate, round(avg((fin = ex)::INT), 6) AS accuracy_exact, round(avg((fin <> 'clean')::INT), 6) AS safe_non_clean_rate FROM z GROUP BY 1""")
def subtype_accuracy(spark, sf):
    t = stage_two(spark, sf).where(c("expected") != "clean").withColumn("rep", R.confident_label(c("raw_type"), c("confidence"), 0.55))
    t = t.withColumn("fin", R.two_stage_label(c("stage1"), c("rep")))
    share = lambda cond: F.avg(cond.cast("int"))
    return rounded(t.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), share(c("rep") == c("expected")).alias("stage2_accuracy"), share(c("rep") == "unknown_channel_artifact").alias("unknown_rate"),
                                          share(c("fin") == c("expected")).alias("accuracy_exact"), share(c("fin") != "clean").alias("safe_non_clean_rate")))


@query("a81_confidence_grid", f"""{ST2}, t AS (SELECT k / 100::DOUBLE AS min_confidence FROM range(35, 96, 5) r(k)), y AS (SELECT min_confidence, ex, CASE WHEN conf >= min_confidence THEN raw ELSE 'unknown_channel_artifact' END AS rep FROM x, t WHERE s1 = 1 AND ex <> 'clean'),
g AS (SELECT min_confidence, count(*) AS n, round(avg((rep = ex)::INT), 6) AS accuracy, round(avg((rep = 'unknown_channel_artifact')::INT), 6) AS unknown_rate FROM y GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, unknown_rate, min_confidence DESC) = 1 AS chosen FROM g""")
def confidence_grid(spark, sf):
    from echotrail.operators.metrics import threshold_counts
    t = stage_two(spark, sf).where((c("stage1") == 1) & (c("expected") != "clean")).select(
        F.lit("all").alias("scope"), "confidence", (c("raw_type") == c("expected")).cast("int").alias("hit"))
    g = threshold_counts(t, ["scope"], "confidence", "hit", 35, 95, 5)
    n = c("tn") + c("fp") + c("fn") + c("tp")
    g = g.select("scope", c("threshold").alias("min_confidence"), n.alias("n"), F.round(c("tp") / n, 6).alias("accuracy"), F.round((c("tn") + c("fn")) / n, 6).alias("unknown_rate"))
    best = best_row(g, ["scope"], [c("accuracy").desc(), c("unknown_rate").asc(), c("min_confidence").desc()]).select("min_confidence", F.lit(True).alias("_b"))
    return join_ids(g, best, ["min_confidence"], "left").select("min_confidence", "n", "accuracy", "unknown_rate", F.coalesce("_b", F.lit(False)).alias("chosen"))


@query("a82_variant_evaluation", f"""{arb_cte()}, x AS (SELECT *, CASE file_category WHEN 'ai_direct' THEN 'ai_clean' WHEN 'ai_replay' THEN 'ai_replayed' ELSE file_category END AS variant, file_id % 67 = 0 AS err FROM ar), y AS (SELECT variant, err, CASE WHEN err THEN 'release_integration_issue' WHEN variant = 'ai_clean' THEN CASE WHEN origin_s IN ('moderate', 'high') THEN 'pass' ELSE 'acceptable_with_limitation' END
  WHEN variant = 'ai_replayed' THEN CASE WHEN replay_s IN ('moderate', 'high') THEN 'pass' ELSE 'model_issue' END WHEN variant = 'ai_mixer' THEN CASE WHEN mixer_s IN ('moderate', 'high') THEN 'pass' ELSE 'model_issue' END WHEN eligible2 THEN 'pass' ELSE 'acceptable_with_limitation' END AS cls FROM x)
SELECT variant, count(*) AS files, count(*) FILTER (err) AS failed_files, round(avg((cls IN ('pass', 'acceptable_with_limitation'))::INT), 6) AS acceptable_rate, count(*) FILTER (cls = 'pass') AS pass_count, count(*) FILTER (cls = 'model_issue') AS model_issue_count, count(*) FILTER (cls = 'acceptable_with_limitation') AS limitation_count FROM y GROUP BY 1""")
def variant_evaluation(spark, sf):
    t = arbitrated(spark, sf)
    cat = c("file_category")
    variant = F.when(cat == "ai_direct", "ai_clean").when(cat == "ai_replay", "ai_replayed").otherwise(cat)
    err = c("file_id") % 67 == 0
    up = lambda a: c(f"{a}_evidence_strength").isin(R.ELEVATED)
    cls = (F.when(err, "release_integration_issue").when(variant == "ai_clean", F.when(up("origin"), "pass").otherwise("acceptable_with_limitation"))
           .when(variant == "ai_replayed", F.when(up("replay"), "pass").otherwise("model_issue")).when(variant == "ai_mixer", F.when(up("mixer"), "pass").otherwise("model_issue"))
           .when(c("arb.eligible"), "pass").otherwise("acceptable_with_limitation"))
    t = t.select(variant.alias("variant"), err.alias("err"), cls.alias("cls"))
    return t.groupBy("variant").agg(F.count(F.lit(1)).alias("files"), F.count_if(c("err")).alias("failed_files"), F.round(F.avg(c("cls").isin("pass", "acceptable_with_limitation").cast("int")), 6).alias("acceptable_rate"),
                                    F.count_if(c("cls") == "pass").alias("pass_count"), F.count_if(c("cls") == "model_issue").alias("model_issue_count"), F.count_if(c("cls") == "acceptable_with_limitation").alias("limitation_count"))


# Targets of the second decision layer (fixed values): metric, direction, limit.
V2_TARGETS = [("clean_human_false_alarm_count", "max", 7), ("clean_human_accept_plus_borderline", "min", 14), ("direct_ai_detect_plus_segment", "min", 19), ("human_replay_detected_count", "min", 20),
              ("ai_replay_detect_plus_segment", "min", 15), ("human_mixer_detected_count", "min", 23), ("ai_mixer_detected_count", "min", 23), ("partial_fabrication_detected_count", "min", 43)]
V2V = ", ".join(f"('{n}', '{w}', {v}::DOUBLE, {n}::DOUBLE)" for n, w, v in V2_TARGETS)


@query("a83_acceptance_matrix", f"""{J3}, {V2}, k AS (SELECT count(*) FILTER (calibrated_status = 'clean_human_false_alarm') AS clean_human_false_alarm_count, count(*) FILTER (calibrated_status IN ('clean_human_accepted', 'clean_human_borderline')) AS clean_human_accept_plus_borderline, count(*) FILTER (calibrated_status IN {AIOK}) AS direct_ai_detect_plus_segment,
  count(*) FILTER (calibrated_status = 'human_replay_manipulation_detected') AS human_replay_detected_count, count(*) FILTER (calibrated_status IN ('ai_replay_detected', 'ai_replay_file_level_missed_but_segment_suspicious')) AS ai_replay_detect_plus_segment, count(*) FILTER (calibrated_status = 'human_mixer_manipulation_detected') AS human_mixer_detected_count,
  count(*) FILTER (calibrated_status = 'ai_mixer_detected') AS ai_mixer_detected_count, count(*) FILTER (calibrated_status = 'partial_fabrication_detected') AS partial_fabrication_detected_count FROM d2)
SELECT g.criterion, g.value, g.limit_value, CASE WHEN g.way = 'max' THEN g.value <= g.limit_value ELSE g.value >= g.limit_value END AS passed, CASE WHEN g.way = 'max' AND g.value > g.limit_value THEN 'above limit' WHEN g.way = 'min' AND g.value < g.limit_value THEN 'below limit' ELSE '' END AS reason FROM k, LATERAL (VALUES {V2V}) g(criterion, way, limit_value, value)""")
def acceptance_matrix(spark, sf):
    d = decided(spark, sf, R.decision_second)
    keep = d.select(c("manipulation_type_baseline").alias("manipulation_type"), c("ground_truth_origin_baseline").alias("ground_truth_origin"), c("suspicious_start_time_baseline").alias("suspicious_start_time"),
                    c("suspicious_end_time_baseline").alias("suspicious_end_time"), "calibrated_status", F.lit("v2").alias("layer"))
    m = P.product_metrics(keep, ["layer"], "calibrated_status")
    plus = {"clean_human_accept_plus_borderline": ("clean_human_accept_count", "clean_human_borderline_count"),
            "direct_ai_detect_plus_segment": ("direct_ai_detected_count", "direct_ai_segment_suspicious_count"),
            "ai_replay_detect_plus_segment": ("ai_replay_detected_count", "ai_replay_segment_suspicious_count")}
    return check_limits(m.select("*", *[(c(a) + c(b)).alias(k) for k, (a, b) in plus.items()]), V2_TARGETS)


@query("a85_beats_baseline", f"""WITH p AS ({I.PREDICTIONS_SQL}), m AS (SELECT task_name, feature_set, CASE WHEN file_id % 2 = 0 THEN 'test' ELSE 'field' END AS scope, count(*) FILTER (y_true = 1 AND prob >= 0.5) / count(*) FILTER (y_true = 1) AS rec, count(*) FILTER (y_true = 0 AND prob < 0.5) / count(*) FILTER (y_true = 0) AS spec FROM p GROUP BY ALL),
b AS (SELECT task_name, feature_set, scope, round((rec + spec) / 2, 6) AS ba FROM m) SELECT x.task_name, bool_and(x.ba > y.ba) AS beats, max(x.ba) FILTER (x.scope = 'test') AS test_bal_acc, max(y.ba) FILTER (x.scope = 'test') AS baseline_test_bal_acc FROM b x JOIN b y ON x.task_name = y.task_name AND x.scope = y.scope AND x.feature_set = 'ssl' AND y.feature_set = 'acoustic' GROUP BY 1""")
def beats_baseline(spark, sf):
    from echotrail.operators.metrics import confusion_counts, rate_columns
    p = I.predictions(spark, sf).withColumn("scope", F.when(c("file_id") % 2 == 0, "test").otherwise("field"))
    m = p.groupBy("task_name", "scope", "feature_set").agg(*confusion_counts(c("y_true"), (c("prob") >= 0.5).cast("int"))).withColumn("ba", F.round(rate_columns()["balanced_accuracy"], 6))
    wide = m.groupBy("task_name", "scope").agg(F.max(F.when(c("feature_set") == "ssl", c("ba"))).alias("cand"), F.max(F.when(c("feature_set") == "acoustic", c("ba"))).alias("base"))
    test = c("scope") == "test"
    return wide.groupBy("task_name").agg(F.min(c("cand") > c("base")).alias("beats"), F.max(F.when(test, c("cand"))).alias("test_bal_acc"), F.max(F.when(test, c("base"))).alias("baseline_test_bal_acc"))


COLL = ["manip_raw", "gt_origin", "gt_manip", "status_raw", "split_raw", "manifest_name", "hint_raw", "stem_raw"]


@query("a86_collection_summary", f"WITH r AS ({I.RAW_SQL}), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, CASE WHEN trim(coalesce({k}, '')) = '' THEN '<missing>' ELSE trim({k}) END AS value FROM r" for k in COLL) + "), n AS (SELECT dimension, value, count(*) AS count FROM l GROUP BY ALL) SELECT *, round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY dimension), 4) AS pct FROM n")
def collection_summary(spark, sf):
    return value_counts(I.raw_labels(spark, sf), COLL)

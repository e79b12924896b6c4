"""Rule-based fusion, statuses and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotrail.functions.labels import norm, valid_region

AXES = ["origin", "replay", "mixer", "partial"]
ELEVATED = ["moderate", "high"]
# Labels an axis shows at or above its threshold (fixed values).
AXIS_LABELS = {"origin": "elevated_ai_origin_indicator", "replay": "elevated_replay_rerecording_indicator",
               "mixer": "elevated_mixer_channel_indicator", "partial": "elevated_partial_fabrication_indicator"}


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def evidence_strength(prob: Column, threshold: Column, margin: float = 0.10) -> Column:
    """low / borderline / moderate / high around a threshold; null inputs are named."""
    return (F.when(prob.isNull(), "not_evaluated").when(threshold.isNull(), "unknown")
            .when(prob < F.greatest(F.lit(0.0), threshold - margin), "low")
            .when(F.abs(prob - threshold) <= margin, "borderline")
            .when(prob >= threshold + 2.0 * margin, "high").otherwise("moderate"))


def axis_evidence(axis: str, available: Column, prob: Column, threshold: Column) -> dict[str, Column]:
    """Strength and label of one axis; unavailable axes are not evaluated."""
    off = ~known(available) | prob.isNull()
    return {
        f"{axis}_evidence_strength": F.when(off, "not_evaluated").otherwise(evidence_strength(prob, threshold)),
        f"{axis}_evidence_label": F.when(off | threshold.isNull(), "not_evaluated")
        .when(prob >= threshold, AXIS_LABELS[axis]).otherwise("low_indicator"),
    }


def _count(*conds: Column) -> Column:
    return sum((c.cast("int") for c in conds[1:]), conds[0].cast("int"))


def fuse_axes(strength: dict[str, Column]) -> dict[str, Column]:
    """Status, risk and whether a person must look, from four axis strengths.

    A recording that looks clean on origin but has an axis of unknown strength keeps
    the inconclusive default.
    """
    up = {a: s.isin(ELEVATED) for a, s in strength.items()}
    n_up = _count(*up.values())
    edge = known(strength["origin"] == "borderline")
    for a in AXES[1:]:
        edge = edge | known(strength[a] == "borderline")
    n_eval = _count(*[~s.isin("not_evaluated", "unknown") for s in strength.values()])
    quiet = strength["origin"] == "low"
    for a in AXES[1:]:
        quiet = quiet & strength[a].isin("low", "not_evaluated")
    single = lambda a: F.when(strength[a] == "high", "high").otherwise("medium")
    default = "inconclusive_manual_review_experimental"
    calm = (n_up == 0) & ~edge & (strength["origin"] == "low")
    status = (
        F.when(n_eval == 0, default).when(calm, F.when(quiet, "accept_human_clean_experimental").otherwise(default))
        .when(n_up > 1, "suspicious_mixed_evidence_experimental")
        .when(up["partial"], "suspicious_partial_fabrication_experimental")
        .when(up["replay"], "suspicious_replay_experimental").when(up["mixer"], "suspicious_mixer_channel_experimental")
        .when(up["origin"], "suspicious_origin_experimental").otherwise(default))
    risk = (
        F.when(n_eval == 0, "inconclusive").when(calm, F.when(quiet, "low").otherwise("inconclusive"))
        .when(n_up > 1, "high").when(up["partial"], single("partial")).when(up["replay"], single("replay"))
        .when(up["mixer"], single("mixer")).when(up["origin"], single("origin")).otherwise("inconclusive"))
    return {"experimental_fusion_status": status, "forensic_risk_level": risk,
            "manual_review_required": F.when(status == "accept_human_clean_experimental", "false").otherwise("true")}


def review_reasons(strength: dict[str, Column], status: Column) -> Column:
    """Sorted distinct reasons joined by ';', or none."""
    notes = {"origin": "origin_ai_evidence_review", "replay": "replay_rerecording_evidence_review",
             "mixer": "mixer_channel_evidence_review", "partial": "partial_segment_evidence_review"}
    found = [F.when(s == "borderline", f"{a}_borderline") for a, s in strength.items()]
    found += [F.when(s.isin(ELEVATED), notes[a]) for a, s in strength.items()]
    found += [F.when(status == "suspicious_mixed_evidence_experimental", "multi_axis_evidence_review"),
              F.when(status == "inconclusive_manual_review_experimental", "insufficient_evidence_review")]
    kept = F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return F.when(F.size(kept) == 0, "none").otherwise(F.array_join(kept, ";"))


def fusion_trace(strength: dict[str, Column], status: Column, risk: Column) -> Column:
    parts = [F.concat(F.lit(f"{a}="), s) for a, s in strength.items()]
    return F.concat_ws("|", *parts, F.concat(F.lit("status="), status), F.concat(F.lit("risk="), risk))


# Localisation gate and arbitration -------------------------------------------------------


def localization_gate(count: Column, fraction: Column, top: Column, contrast: Column,
                      threshold: float) -> Column:
    """Struct (gate, eligible, strength, block_reason) from a segment profile."""
    out = lambda gate, ok, strength, why: F.struct(
        F.lit(gate).alias("gate"), F.lit(ok).alias("eligible"),
        (strength if isinstance(strength, Column) else F.lit(strength)).alias("strength"), F.lit(why).alias("block_reason"))
    hot = top >= threshold
    return (F.when(count < 3, out("insufficient_segments", False, "not_evaluated", "insufficient_segments"))
            .when(fraction >= 0.60, out("global_activation_not_localized", False, "borderline", "global_activation_not_localized"))
            .when(hot & (contrast >= 0.15), out("localized_pattern_supported", True, F.when(
                top >= threshold + 0.20, "high").otherwise("moderate"), "none"))
            .when(hot, out("weak_localization_contrast", False, "borderline", "weak_localization_contrast"))
            .otherwise(out("low_partial_indicator", False, "low", "none")))


def arbitrate(gate: Column, fraction: Column, contrast: Column, replay: Column, mixer: Column) -> Column:
    """Gate struct after replay/mixer context: localized patterns stay, others are blocked."""
    context = replay.isin(ELEVATED) | mixer.isin(ELEVATED)
    local = (gate["gate"] == "localized_pattern_supported") & (fraction <= 0.35) & (contrast >= 0.20)
    out = lambda ok, strength, why: F.struct(
        gate["gate"].alias("gate"), F.lit(ok).alias("eligible"), strength.alias("strength"), F.lit(why).alias("block_reason"))
    raised = F.when(gate["strength"].isin("", "not_evaluated", "low"), "borderline").otherwise(gate["strength"])
    return (F.when(~context, gate).when(local, out(True, raised, "coexists_with_replay_or_mixer_context"))
            .otherwise(out(False, F.lit("borderline"), "blocked_by_replay_or_mixer_context")))


def live_status(strength: dict[str, Column], partial_up: Column, fallback: Column) -> Column:
    """Status with the partial axis counted only when its gate allows it."""
    up = {a: strength[a].isin(ELEVATED) for a in AXES[:3]}
    n = _count(*up.values(), partial_up)
    return (F.when(n >= 2, "suspicious_mixed_evidence_experimental")
            .when(partial_up, "suspicious_partial_fabrication_experimental")
            .when(up["replay"], "suspicious_replay_experimental").when(up["mixer"], "suspicious_mixer_channel_experimental")
            .when(up["origin"], "suspicious_origin_experimental").otherwise(fallback))


def live_risk(status: Column, partial_strength: Column) -> Column:
    return (F.when(status == "accept_human_clean_experimental", "low")
            .when(status == "suspicious_mixed_evidence_experimental", "high")
            .when(status.startswith("suspicious_"), F.when(partial_strength == "high", "high").otherwise("medium"))
            .otherwise("inconclusive"))


def evidence_band(prob: Column, low: Column, medium: Column) -> Column:
    """Band by cut-points; outside [0, 1] there is not enough to say."""
    return (F.when(prob.isNull(), "Inconclusive").when(~prob.between(0.0, 1.0) | F.isnan(prob), "Insufficient evidence")
            .when(prob <= low, "Low evidence").when(prob <= medium, "Medium evidence").otherwise("High evidence"))


# Statuses per sample ---------------------------------------------------------------------


def _has_error() -> Column:
    return F.trim(F.coalesce(F.col("error"), F.lit(""))) != ""


def _partial_status(detected: Column) -> Column:
    return (F.when(~valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time")),
                   "partial_fabrication_not_evaluable")
            .when(known(detected), "partial_fabrication_detected").otherwise("partial_fabrication_missed"))


#: Words that set a flag (fixed values).
TRUE_WORDS = ["true", "1", "yes", "y", "t"]


def predicted(vote: Column) -> Column:
    """FAKE or REAL by the score; without a score the prediction as given; null if neither tells."""
    score, given = F.col("decision_score"), F.upper(F.trim("prediction"))
    return (F.when(score >= vote, "FAKE").when(score < vote, "REAL")
            .otherwise(F.when(given.isin("FAKE", "REAL"), given)))


def flag_set(c: Column) -> Column:
    """Whether a text or boolean flag is set; unknown words and null are not."""
    return known(F.lower(F.trim(c.cast("string"))).isin(TRUE_WORDS))


def baseline_flags(vote: Column, segment_max: Column, ratio: Column, margin: float = 0.05,
                   detect: float = 0.65) -> dict[str, Column]:
    """What the status rules need: voted fake or real (neither if unknown), near the vote, hot segments, found."""
    score = F.col("decision_score")
    fake = known(predicted(vote) == "FAKE")
    return {"fake": fake, "real": known(predicted(vote) == "REAL"), "edge": known(F.abs(score - vote) <= margin),
            "hot": known(F.col("max_chunk_spoof") >= segment_max) | known(F.col("suspicious_chunk_ratio") >= ratio),
            "found": fake | known(score >= detect)}


def status_from_flags(fake: Column, real: Column, edge: Column, hot: Column, found: Column, error: Column,
                      partial: Column, partial_flag: Column) -> Column:
    """Status of a sample from its kind, true origin and flags; a sample of unknown prediction is never cleared."""
    m, o = norm(F.col("manipulation_type")), norm(F.col("ground_truth_origin"))
    missed = lambda name: F.when(real & hot, f"{name}_file_level_missed_but_segment_suspicious")
    clean, mixer = m == "clean_direct", m == "mixer_processed"
    return (
        F.when(error, "unknown_review_required").when(partial_flag | (m == "partial_ai_insert"), partial)
        .when(clean & (o == "human"), F.when(edge, "clean_human_borderline").when(real, "clean_human_accepted")
              .when(fake, "clean_human_false_alarm").otherwise("borderline_needs_review"))
        .when(clean & (o == "ai"), F.when(fake, "direct_ai_detected").otherwise(F.coalesce(
            missed("direct_ai"), F.when(real, "direct_ai_missed"), F.lit("borderline_needs_review"))))
        .when(m == "human_replay", F.when(found, "human_replay_manipulation_detected").otherwise("human_replay_missed"))
        .when(m == "ai_replay", F.when(found, "ai_replay_detected").otherwise(F.coalesce(missed("ai_replay"), F.lit("ai_replay_missed"))))
        .when(mixer & (o == "human"), F.when(found, "human_mixer_manipulation_detected").otherwise("human_mixer_missed"))
        .when(mixer & (o == "ai"), F.when(found, "ai_mixer_detected").otherwise(F.coalesce(missed("ai_mixer"), F.lit("ai_mixer_missed"))))
        .when(edge, "borderline_needs_review").otherwise("unknown_review_required"))


def baseline_status(vote: float = 0.70, segment_max: float = 0.95, ratio: float = 0.30,
                    partial_flag: str = "partial_fabrication_binary") -> Column:
    """Status from the baseline model's columns, `prediction` and the partial flag among them."""
    flags = baseline_flags(F.lit(vote), F.lit(segment_max), F.lit(ratio))
    return status_from_flags(**flags, error=_has_error(), partial=_partial_status(F.col("partial_region_detected")),
                             partial_flag=flag_set(F.col(partial_flag)))


def window_status() -> Column:
    """Status from window-model scores (mean, maximum, ratio) with a threshold column."""
    m, o = norm(F.col("manipulation_type")), norm(F.col("ground_truth_origin"))
    score, th = F.coalesce("mean_spoof_score", F.lit(0.0)), F.col("threshold_used")
    hot = known(F.col("max_spoof_score") >= 0.95) | known(F.col("suspicious_window_ratio") >= 0.30)
    fake = score >= th
    found = (score >= 0.65) | hot
    edge = F.abs(score - th) <= 0.05
    seg = lambda hit, name: F.when(hit, f"{name}_detected").when(hot, f"{name}_file_level_missed_but_segment_suspicious").otherwise(f"{name}_missed")
    pair = lambda name, good="manipulation_detected": F.when(found, f"{name}_{good}").otherwise(f"{name}_missed")
    strong = fake | (score >= 0.65)
    clean, mixer = m == "clean_direct", m == "mixer_processed"
    platform = m.isin("whatsapp_compressed", "youtube_broadcast", "phone_recorded", "noisy_room")
    return (
        F.when(_has_error(), "unknown_review_required")
        .when(m == "partial_ai_insert", _partial_status(F.col("partial_region_detected")))
        .when(clean & (o == "human"), F.when(edge, "clean_human_borderline").when(fake, "clean_human_false_alarm")
              .otherwise("clean_human_accepted"))
        .when(clean & (o == "ai"), seg(fake, "direct_ai"))
        .when(m == "human_replay", pair("human_replay")).when(m == "ai_replay", seg(strong, "ai_replay"))
        .when(mixer & (o == "human"), pair("human_mixer")).when(mixer & (o == "ai"), seg(strong, "ai_mixer"))
        .when(platform & (o == "human"), pair("human_processed", "detected"))
        .when(platform & (o == "ai"), seg(strong, "ai_processed"))
        .when(edge, "borderline_needs_review").otherwise("unknown_review_required"))


def origin_correctness() -> Column:
    """yes / no / borderline: does the prediction fit the true origin."""
    m, o = norm(F.col("manipulation_type")), norm(F.col("ground_truth_origin"))
    pred = F.upper("prediction")
    edge = known(F.abs(F.col("decision_score") - F.coalesce(F.col("effective_threshold"), F.lit(0.70))) <= 0.05)
    region = valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time"))
    hit = known(F.col("partial_region_detected"))
    return (
        F.when(_has_error(), "no").when(edge & (m != "partial_ai_insert"), "borderline")
        .when(o == "human", F.when(pred == "REAL", "yes").when(pred == "FAKE", "no").otherwise("borderline"))
        .when(o == "ai", F.when(pred == "FAKE", "yes").when(pred == "REAL", "no").otherwise("borderline"))
        .when((o == "mixed") & (m == "partial_ai_insert"), F.when(~region, "borderline")
              .when(hit | (pred == "FAKE"), "yes").when(edge, "borderline").otherwise("no"))
        .when((o == "mixed") & (pred == "FAKE"), "yes").otherwise("borderline"))


def failure_type(correct: Column) -> Column:
    """Why a prediction was wrong; blank when it was right."""
    m, o = norm(F.col("manipulation_type")), norm(F.col("ground_truth_origin"))
    pred = F.upper("prediction")
    region = valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time"))
    hit = known(F.col("partial_region_detected"))
    partial = m == "partial_ai_insert"
    return (
        F.when(_has_error(), F.substring("error", 1, 80)).when(correct == "borderline", "borderline").when(correct == "yes", "")
        .when(partial & ~region, "partial_not_evaluated_missing_timestamp")
        .when((o == "human") & (pred == "FAKE"), F.when(
            m.isin("mixer_processed", "whatsapp_compressed", "phone_recorded", "human_replay"), "fp_processed_human").otherwise("fp_human"))
        .when((o == "ai") & (pred == "REAL"), F.when(m.isin("ai_replay", "mixer_processed"), "fn_ai_replay").otherwise("fn_direct_ai"))
        .when((o == "mixed") & partial, "missed_partial_insert")
        .when(hit & ~partial, "false_partial_alarm").otherwise("wrong_origin"))


# Recording types counted as processed (fixed values).
PROCESSED_HUMAN = ["human_replay", "mixer_processed", "edited_spliced", "phone_recorded", "whatsapp_compressed", "noisy_room"]
PROCESSED_AI = ["ai_replay", "mixer_processed", "whatsapp_compressed", "phone_recorded", "noisy_room"]


def product_status() -> Column:
    """Product-level status from the file decision and its chunk and region metrics."""
    m, o = norm(F.col("manipulation_type")), norm(F.col("ground_truth_origin"))
    pred, score = F.upper("prediction"), F.col("decision_score")
    edge = known(F.abs(score - F.coalesce(F.col("effective_threshold"), F.lit(0.70))) <= 0.05)
    found = (pred == "FAKE") | known(score >= 0.65)
    hot = known(F.col("max_chunk_spoof") >= 0.95) | known(F.col("suspicious_chunk_ratio") >= 0.30)
    clean = m == "clean_direct"
    missed = F.when(m == "ai_replay", "ai_replay_file_level_missed_but_segment_suspicious").otherwise(
        "processed_ai_file_level_missed_but_segment_suspicious")
    region = valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time"))
    return (
        F.when(clean & (o == "human"), F.when(edge, "clean_human_borderline").when(pred == "REAL", "clean_human_accepted")
               .otherwise("clean_human_false_alarm"))
        .when(clean & (o == "ai"), F.when(edge, "direct_ai_borderline").when(found, "direct_ai_detected")
              .when((pred == "REAL") & hot, "direct_ai_file_level_missed_but_segment_suspicious").otherwise("direct_ai_missed"))
        .when((o == "human") & m.isin(PROCESSED_HUMAN), F.when(found, "processed_human_manipulation_detected")
              .otherwise("processed_human_missed"))
        .when((o == "ai") & m.isin(PROCESSED_AI), F.when(found, "ai_replay_or_processed_detected")
              .when((pred == "REAL") & hot, missed).otherwise("ai_replay_or_processed_missed"))
        .when(m == "partial_ai_insert", F.when(~region, "partial_not_evaluated_missing_timestamp")
              .when(known(F.col("partial_region_detected")), "partial_fabrication_detected").otherwise("partial_fabrication_missed"))
        .when(edge, "borderline_needs_review").otherwise("unknown_review_required"))


# Decisions over three models (columns suffixed baseline, product, loss) ---------------------


def _col(field: str, model: str) -> Column:
    return F.col(f"{field}_{model}")


def partial_hit(columns, flagged: list[str], models=("baseline", "product", "loss")) -> Column:
    """A model flags the region, or a region metric that is present passes its limit (0.65, 0.10)."""
    hits = [known(_col("partial_region_detected", k)) for k in flagged]
    for k in models:
        for field, limit in (("inside_region_max_spoof", 0.65), ("region_delta", 0.10)):
            if f"{field}_{k}" in columns:
                hits.append(known(_col(field, k) >= limit))
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def decision_first(columns=()) -> dict[str, Column]:
    """First decision layer: calibrated status and risk from three model variants."""
    m, o = norm(_col("manipulation_type", "baseline")), norm(_col("ground_truth_origin", "baseline"))
    models = ["baseline", "product", "loss"]
    score = {k: _col("decision_score", k) for k in models}
    spoof = {k: _col("max_chunk_spoof", k) for k in models}
    fake_b = F.upper(_col("prediction", "baseline")) == "FAKE"
    fake_p = F.upper(_col("prediction", "product")) == "FAKE"
    any_of = lambda cols, t: known(F.greatest(*cols) >= t)
    accept = known(score["product"] < 0.65) & F.coalesce(spoof["baseline"] < 0.98, F.lit(True))
    doubt = (known(spoof["baseline"] >= 0.95) | known(_col("suspicious_chunk_ratio", "baseline") >= 0.20)
             | known(score["loss"] >= 0.55))
    human_hit = fake_b | known(score["baseline"] >= 0.65) | known(score["loss"] >= 0.55)
    high_score, high_spoof = any_of(score.values(), 0.65), any_of(spoof.values(), 0.95)
    region = valid_region(_col("suspicious_start_time", "baseline"), _col("suspicious_end_time", "baseline"))
    partial = partial_hit(columns, models)
    ai = lambda name: F.when(fake_b | high_score, f"{name}_detected").when(
        high_spoof, f"{name}_file_level_missed_but_segment_suspicious").otherwise(f"{name}_missed")
    clean, mixer = m == "clean_direct", m == "mixer_processed"
    status = (
        F.when(clean & (o == "human"), F.when(accept, "clean_human_accepted").when(fake_b | fake_p, "clean_human_false_alarm")
               .otherwise("clean_human_borderline"))
        .when(clean & (o == "ai"), F.when(fake_b, "direct_ai_detected").when(
            doubt, "direct_ai_file_level_missed_but_segment_suspicious").otherwise("direct_ai_missed"))
        .when((m == "human_replay") & (o == "human"), F.when(human_hit, "human_replay_manipulation_detected").otherwise("human_replay_missed"))
        .when(mixer & (o == "human"), F.when(human_hit, "human_mixer_manipulation_detected").otherwise("human_mixer_missed"))
        .when((m == "ai_replay") & (o == "ai"), ai("ai_replay")).when(mixer & (o == "ai"), ai("ai_mixer"))
        .when(m == "partial_ai_insert", F.when(~region, "partial_fabrication_not_evaluable")
              .when(partial, "partial_fabrication_detected").otherwise("partial_fabrication_missed"))
        .otherwise("unknown_review_required"))
    return _with_risk(status)


def decision_second(columns=()) -> dict[str, Column]:
    """Second decision layer: clean speech needs agreement, segment evidence comes earlier."""
    m, o = norm(_col("manipulation_type", "baseline")), norm(_col("ground_truth_origin", "baseline"))
    real = lambda k: F.upper(_col("prediction", k)) == "REAL"
    score = lambda k: _col("decision_score", k)
    low_p = real("product") | known(score("product") < 0.70)
    low_l = real("loss") | known(score("loss") < 0.75)
    spoof_b, ratio_b = _col("max_chunk_spoof", "baseline"), _col("suspicious_chunk_ratio", "baseline")
    extreme = known(spoof_b >= 0.995) | known(ratio_b >= 0.50)
    found = (F.upper(_col("prediction", "baseline")) == "FAKE") | known(score("baseline") >= 0.65)
    hot = known(spoof_b >= 0.95) | known(ratio_b >= 0.20)
    up_l, up_p = known(score("loss") >= 0.55), known(score("product") >= 0.55)
    region = valid_region(_col("suspicious_start_time", "baseline"), _col("suspicious_end_time", "baseline"))
    partial = partial_hit(columns, ["baseline", "loss"])
    clean, mixer = m == "clean_direct", m == "mixer_processed"
    human = lambda name: F.when(found | up_l, f"{name}_manipulation_detected").otherwise(f"{name}_missed")
    status = (
        F.when(clean & (o == "human"), F.when(low_p & low_l & ~extreme, "clean_human_accepted")
               .when(~low_p & ~low_l & (extreme | found), "clean_human_false_alarm").otherwise("clean_human_borderline"))
        .when(clean & (o == "ai"), F.when(hot, "direct_ai_file_level_missed_but_segment_suspicious")
              .when(up_l | up_p, "direct_ai_detected").otherwise("direct_ai_missed"))
        .when(m == "human_replay", human("human_replay"))
        .when(m == "ai_replay", F.when(found, "ai_replay_detected").when(hot, "ai_replay_file_level_missed_but_segment_suspicious")
              .when(up_l, "ai_replay_detected").otherwise("ai_replay_missed"))
        .when(mixer & (o == "human"), human("human_mixer"))
        .when(mixer & (o == "ai"), F.when(found | up_l, "ai_mixer_detected")
              .when(hot, "ai_mixer_file_level_missed_but_segment_suspicious").otherwise("ai_mixer_missed"))
        .when(m == "partial_ai_insert", F.when(~region, "partial_fabrication_not_evaluable")
              .when(partial, "partial_fabrication_detected").otherwise("partial_fabrication_missed"))
        .otherwise("unknown_review_required"))
    return _with_risk(status)


def _with_risk(status: Column) -> dict[str, Column]:
    high = status.endswith("_detected") | status.endswith("segment_suspicious") | (status == "clean_human_false_alarm")
    risk = F.when(status == "clean_human_accepted", "low").when(high, "high").otherwise("medium")
    review = status.isin("clean_human_false_alarm", "clean_human_borderline", "unknown_review_required")
    return {"calibrated_status": status, "calibrated_risk_level": risk, "needs_manual_review": review}


def disagreement(b: Column, p: Column, lo: Column) -> Column:
    """Kind of disagreement between three statuses."""
    caught = ["human_replay_manipulation_detected", "human_mixer_manipulation_detected"]
    return (
        F.when(F.size(F.array_distinct(F.array(b, p, lo))) <= 1, "agreement")
        .when((b == "clean_human_accepted") & (p != "clean_human_accepted"), "clean_human_disagreement")
        .when(b.isin(caught) & ~p.isin(caught), "replay_mixer_disagreement")
        .when((b == "partial_fabrication_detected") & (p != "partial_fabrication_detected"), "partial_disagreement")
        .when(b.contains("direct_ai") | p.contains("direct_ai"), "direct_ai_disagreement").otherwise("mixed_disagreement"))


def disagreement_flags(b: Column, p: Column, lo: Column, score_b: Column, score_p: Column) -> Column:
    return F.filter(F.array(
        F.when(b != p, "baseline_vs_r2_product_status_mismatch"),
        F.when((score_b >= 0.65) & (score_p < 0.5), "baseline_high_r2_low_file"),
        F.when((score_b < 0.5) & (score_p >= 0.65), "baseline_low_r2_high_file"),
        F.when(p != lo, "r2_product_vs_r2_loss_mismatch")), lambda x: x.isNotNull())


def confident_label(label: Column, confidence: Column, floor: float) -> Column:
    return F.when(confidence >= floor, label).otherwise("unknown_channel_artifact")


def two_stage_label(stage1: Column, reported: Column) -> Column:
    """Clean unless stage one fired; a blank second stage is an unknown artifact."""
    return F.when(F.coalesce(stage1, F.lit(0)) >= 1, F.coalesce(
        F.nullif(reported, F.lit("")), F.lit("unknown_channel_artifact"))).otherwise("clean")


def localization_diagnosis(error: Column, gate: Column, broad: Column, top1: Column, top5: Column,
                           inside5: Column, boundary_only: Column) -> Column:
    wide = (gate == "global_activation_not_localized") | broad
    return (F.when(error, "inference_error")
            .when(wide, F.when(top5, "topk_hits_but_broad_activation").otherwise("broad_activation_not_localized"))
            .when(top1, "localized_success").when(top5, "topk_hits_but_broad_activation")
            .when(boundary_only & (inside5 == 0), "boundary_only_signal").otherwise("no_timestamp_hit"))


def axis_consistency(category: Column, status: Column, run: Column, gate: Column, eligible: Column) -> Column:
    """Does the fused status fit the expected category."""
    broke = run.isin("exception", "pipeline_error")
    bad = category.startswith("bad_audio")
    review, inconclusive = "acceptable_with_manual_review", status == "inconclusive_manual_review_experimental"
    mixed_blocked = (status == "suspicious_mixed_evidence_experimental") & ~F.coalesce(eligible, F.lit(True))
    axis = lambda want: F.when(status == want, "expected").when(mixed_blocked, "needs_review").otherwise("unexpected_axis")
    return (
        F.when(broke, F.when(bad, "expected").otherwise("pipeline_error"))
        .when(category == "ai_direct", F.when(status == "suspicious_origin_experimental", "expected")
              .when(inconclusive, review).otherwise("unexpected_axis"))
        .when(category == "human_direct", F.when(status == "accept_human_clean_experimental", "expected")
              .when(status.startswith("suspicious_"), "needs_review").otherwise(review))
        .when(category.isin("ai_replay", "human_replay", "replay"), axis("suspicious_replay_experimental"))
        .when(category.isin("ai_mixer", "human_mixer", "mixer_channel"), axis("suspicious_mixer_channel_experimental"))
        .when(category.isin("ai_fabricated", "human_fabricated"), F.when(
            (status == "suspicious_partial_fabrication_experimental") & known(eligible), "expected")
            .when(gate == "global_activation_not_localized", "needs_review")
            .when(status.startswith("suspicious_"), review).otherwise("needs_review"))
        .when(bad, review).otherwise("needs_review"))

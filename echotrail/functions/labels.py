"""Label vocabularies, normalisation, targets, weights and rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed vocabularies and aliases ---------------------------------------------------------

ORIGIN_LABELS = ["human", "ai_synthetic", "mixed", "unknown", "na"]
MANIPULATION_LABELS = ["clean", "replay_rerecorded", "mixer_channel_processed", "partial_fabrication",
                       "edited_spliced", "compressed_low_quality", "unknown_manipulation"]
DIRECT_SYNTHETIC = ["manipulation_direct_synthetic", "direct_synthetic", "direct_synthesis"]
ORIGIN_ALIASES = {
    "origin_ai": "ai_synthetic", "origin_human": "human", "ai": "ai_synthetic",
    "ai_likely": "ai_synthetic", "ai_synthetic": "ai_synthetic", "synthetic": "ai_synthetic",
    "fake": "ai_synthetic", "spoof": "ai_synthetic", "human": "human", "human_likely": "human",
    "bonafide": "human", "real": "human", "mixed": "mixed", "mixed_or_partial_ai": "mixed",
    "unknown": "unknown", "na": "na", "": "na",
}
MANIPULATION_ALIASES = {
    "manipulation_replay": "replay_rerecorded",
    "manipulation_mixer_channel": "mixer_channel_processed",
    "manipulation_partial_fabrication": "partial_fabrication",
    "manipulation_edited_spliced": "edited_spliced",
    "manipulation_compressed_low_quality": "compressed_low_quality",
    "manipulation_clean": "clean", "clean": "clean", "clean_original": "clean",
    "clean_direct": "clean", "replay": "replay_rerecorded", "replayed": "replay_rerecorded",
    "replayed_or_re-recorded": "replay_rerecorded", "replayed_or_re_recorded": "replay_rerecorded",
    "ai_replay": "replay_rerecorded", "human_replay": "replay_rerecorded",
    "mixer": "mixer_channel_processed", "mixer_processed": "mixer_channel_processed",
    "channel_processed": "mixer_channel_processed", "processed": "mixer_channel_processed",
    "partial": "partial_fabrication", "partial_fabrication": "partial_fabrication",
    "partial_ai_insert": "partial_fabrication", "edited": "edited_spliced",
    "edited_or_spliced": "edited_spliced", "spliced": "edited_spliced",
    "compressed": "compressed_low_quality", "low_quality": "compressed_low_quality",
    "unknown_manipulation": "unknown_manipulation",
}
SPLITS = ["train", "val", "test", "holdout", "eval_only", "none"]


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def norm(c: Column) -> Column:
    """Trimmed lower-case text, null as blank."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def origin_label(c: Column) -> Column:
    """Canonical origin: null is na, aliases map, anything else is unknown."""
    t = norm(c)
    return (F.when(t.isin(DIRECT_SYNTHETIC), "ai_synthetic")
            .otherwise(F.coalesce(F.try_element_at(lookup(ORIGIN_ALIASES), t),
                                  F.when(t.isin(ORIGIN_LABELS), t), F.lit("unknown"))))


def tokens(*cols: Column) -> Column:
    """Lower-case tokens of `;|,` separated columns, in column order."""
    text = F.concat_ws(";", *cols)
    parts = F.transform(F.split(text, "[;|,]+"), lambda p: F.lower(F.trim(p)))
    return F.filter(parts, lambda p: p != "")


def manipulation_labels(*cols: Column) -> Column:
    """Canonical manipulation labels in first-seen order joined by ';', or na."""
    canon = F.transform(tokens(*cols), lambda p: F.when(~p.isin(DIRECT_SYNTHETIC), F.coalesce(
        F.try_element_at(lookup(MANIPULATION_ALIASES), p), p)))
    kept = F.array_distinct(F.filter(canon, lambda p: p.isin(MANIPULATION_LABELS)))
    kept = F.when(F.size(kept) > 1, F.array_remove(kept, "clean")).otherwise(kept)
    return F.when(F.size(kept) == 0, "na").otherwise(F.array_join(kept, ";"))


def infer_origin(origin_cols: list[Column], token_cols: list[Column]) -> Column:
    """A direct-synthetic token decides; else the first origin column that is not na."""
    direct = F.exists(tokens(*token_cols), lambda p: p.isin(DIRECT_SYNTHETIC))
    usable = [F.nullif(origin_label(c), F.lit("na")) for c in origin_cols]
    return F.when(direct, "ai_synthetic").otherwise(F.coalesce(*usable, F.lit("na")))


def infer_split(split: Column, name: Column) -> Column:
    s, n = norm(split), F.lower(name)
    return (F.when(s.isin(SPLITS), s).when(s.isin("validation", "valid"), "val")
            .when(s.isin("eval", "evaluation"), "eval_only")
            .when(n.contains("train"), "train").when(n.contains("val"), "val")
            .when(n.contains("test"), "test").otherwise("none"))


def label_set(c: Column) -> Column:
    """Set of labels from a `;`/`,` list; nan, none, null and na mean no labels."""
    t = norm(c)
    parts = F.transform(F.split(F.replace(t, F.lit(","), F.lit(";")), ";"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & (p != "na"))
    return F.when(t.isin("", "nan", "none", "null", "na"), F.array().cast("array<string>")).otherwise(kept)


def has_label(c: Column, label: str) -> Column:
    return F.array_contains(label_set(c), label)


def _flag(cond: Column) -> Column:
    return F.when(cond, "1").otherwise("0")


def _text(cond: Column) -> Column:
    return F.when(cond, "true").otherwise("false")


def file_targets(origin: Column, manipulation: Column) -> dict[str, Column]:
    """Targets and eligibility flags of one recording, as text flags; unknown target is null."""
    o = norm(origin)
    has = lambda x: has_label(manipulation, x)
    mixed = o.contains("mixed") | has("mixed")
    replay, mixer = has("replay_rerecorded"), has("mixer_channel_processed")
    partial, clean = has("partial_fabrication"), has("clean")
    other = has("edited_spliced") | has("unknown_manipulation") | has("compressed_low_quality")
    known = o.isin("human", "ai_synthetic") & ~mixed
    alone = ~partial & ~other & ~mixed
    return {
        "target_origin_multiclass": F.when(mixed, "mixed").when(known, o).otherwise("unknown"),
        "target_is_ai_synthetic": F.when(known & (o == "human"), "0").when(known, "1"),
        "target_is_replay": _flag(replay),
        "target_is_mixer_channel": _flag(mixer),
        "target_is_partial_fabrication_file": _flag(partial),
        "target_is_clean": _flag(clean),
        "eligible_origin_file_model": _text(known & clean),
        "eligible_replay_file_model": _text((replay | clean) & ~mixer & alone),
        "eligible_mixer_file_model": _text((mixer | clean) & ~replay & alone),
        "eligible_partial_file_context_only": _text(partial),
        "eligible_partial_segment_training": F.lit("false"),
    }


def segment_targets(origin: Column, manipulation: Column, source: Column,
                    start: Column, end: Column) -> dict[str, Column]:
    """Targets a segment inherits from its recording, and where its own label came from."""
    base = file_targets(origin, manipulation)
    given = F.trim(F.coalesce(source, F.lit("")))
    stamped = start.isNotNull() | end.isNotNull()
    src = (F.when(given != "", given).when(stamped, "true_segment_timestamp")
           .otherwise("file_level_inherited"))
    sources = ["file_level_inherited", "true_segment_timestamp", "unknown"]
    return {
        **{f"inherited_{k}": base[k] for k in (
            "target_origin_multiclass", "target_is_replay", "target_is_mixer_channel",
            "target_is_partial_fabrication_file", "target_is_clean")},
        "segment_label_source": F.when(src.isin(sources), src).otherwise("unknown"),
        "eligible_segment_origin_context": _text(
            base["target_origin_multiclass"].isin("human", "ai_synthetic")),
        "eligible_partial_segment_training": _text(
            (src == "true_segment_timestamp") & (base["target_is_partial_fabrication_file"] == "1")),
    }


# Categories -----------------------------------------------------------------------------


def replay_category(c: Column) -> Column:
    known = c.isin("ai_repeat", "human_repeat", "ai_replay", "human_replay")
    return F.when(known, F.replace(c, F.lit("repeat"), F.lit("replay"))).otherwise(c)


def negative_source_type(c: Column) -> Column:
    cat = replay_category(c)
    return (F.when(cat.isin("ai_direct", "human_direct", "human_clean"), "clean_direct_negative")
            .when(cat.isin("ai_replay", "human_replay"), "replay_negative")
            .when(cat.isin("ai_mixer", "human_mixer"), "mixer_negative"))


def fabrication_direction(c: Column) -> Column:
    return F.when(c.isin("ai_fabricated", "human_fabricated"), c).otherwise("none")


# Rule-based label normalisation ----------------------------------------------------------

# Labels and risk levels of the schema (fixed values).
ATTACK_HINTS = ["bonafide", "synthesis", "voice_conversion", "replay", "unknown"]
RISKS = ["low", "medium", "high", "inconclusive"]


def attack_hint(hint: Column, conversion: Column, synthesis: Column, default: str) -> Column:
    """Given hint when allowed, else the clearly larger probability, else the default."""
    h = F.coalesce(F.nullif(norm(hint), F.lit("")), F.lit(default))
    conv, syn = F.coalesce(conversion, F.lit(0.0)), F.coalesce(synthesis, F.lit(0.0))
    return (F.when(h.isin("conversion", "voice_conversion"), "voice_conversion")
            .when(h.isin(ATTACK_HINTS), h).when(conv > syn + 0.1, "voice_conversion")
            .when(syn > conv + 0.1, "synthesis").otherwise(default))


def forensic_labels(manip: Column, origin: Column, gt_manip: Column, status: Column,
                    prediction: Column, hint: Column, conversion: Column, synthesis: Column,
                    given_origin: Column, given_manip: Column, given_risk: Column) -> dict[str, Column]:
    """Canonical origin, manipulation, attack hint, risk and binaries for one recording."""
    m, o, st = norm(manip), norm(origin), norm(status)
    clean_human = (m == "clean_direct") & (o == "human")
    clean_ai = (m == "clean_direct") & (o == "ai")
    platform = m.isin("whatsapp_compressed", "youtube_broadcast")
    hint_or = lambda d: attack_hint(hint, conversion, synthesis, d)
    side = F.when(o == "human", "human_likely").when(o == "ai", "ai_likely").otherwise("uncertain")
    blank_to = lambda c, d: F.coalesce(F.nullif(norm(c), F.lit("")), F.lit(d))

    origin_out = (
        F.when(clean_human | (m == "human_replay"), "human_likely")
        .when(clean_ai | (m == "ai_replay"), "ai_likely")
        .when((m == "mixer_processed") | platform | m.isin("phone_recorded", "noisy_room"), side)
        .when(m == "edited_spliced", F.when(o == "mixed", "mixed_or_partial_ai").otherwise("human_likely"))
        .when(m == "partial_ai_insert", "mixed_or_partial_ai")
        .otherwise(blank_to(given_origin, "uncertain")))
    manip_out = (
        F.when(clean_human | clean_ai, "clean_original")
        .when(m.isin("human_replay", "ai_replay"), "replayed_or_re_recorded")
        .when(m.isin("mixer_processed", "phone_recorded"), "channel_processed")
        .when(platform, "platform_compressed")
        .when(m.isin("edited_spliced", "partial_ai_insert"), "edited_or_spliced")
        .when(m == "noisy_room", "noisy_low_quality")
        .otherwise(blank_to(given_manip, "uncertain")))
    hint_out = (
        F.when(clean_human, "bonafide").when(clean_ai, hint_or("synthesis"))
        .when(m == "human_replay", "replay").when(m == "ai_replay", hint_or("replay"))
        .when((m == "mixer_processed") & (o == "ai"), hint_or("voice_conversion"))
        .when(m.isin("mixer_processed", "edited_spliced"), "unknown")
        .when(m == "partial_ai_insert", hint_or("voice_conversion")).otherwise(hint_or("unknown")))
    given = blank_to(given_risk, "medium")
    risk = (
        F.when(clean_human, F.when(st == "clean_human_borderline", "inconclusive").otherwise("low"))
        .when(clean_ai, F.when(st.isin("direct_ai_detected", "direct_ai_missed"), "high")
              .when(st == "direct_ai_file_level_missed_but_segment_suspicious", "medium").otherwise(given))
        .when(m == "human_replay", F.when(F.upper(prediction) == "FAKE", "high").otherwise("medium"))
        .when(m.isin("ai_replay", "partial_ai_insert"), "high")
        .when((m == "mixer_processed") | platform | m.isin("phone_recorded", "edited_spliced", "noisy_room"), "medium")
        .otherwise(given))
    return {
        "origin_label": origin_out, "manipulation_label": manip_out, "attack_hint": hint_out,
        "risk_level": F.when(risk.isin(RISKS), risk).otherwise("inconclusive"),
        "origin_binary": F.when(origin_out == "uncertain", "unknown")
        .when(o.isin("human", "ai", "mixed"), o).otherwise("unknown"),
        "manipulation_binary": F.when(
            manip_out.isin("uncertain", "noisy_low_quality") | (norm(gt_manip) == "unknown"), "uncertain")
        .when((manip_out == "clean_original") & (m == "clean_direct"), "clean").otherwise("manipulated"),
        "partial_fabrication_binary": F.when(m == "partial_ai_insert", 1).otherwise(0),
    }


# Product statuses that a person has to look at (fixed values).
REVIEW_STATUSES = ["clean_human_borderline", "direct_ai_borderline", "borderline_needs_review",
                   "partial_not_evaluated_missing_timestamp", "unknown_review_required"]


def valid_region(start: Column, end: Column) -> Column:
    return F.coalesce(end > start, F.lit(False))


def review_flags(manip: Column, status: Column, exists: Column, start: Column, end: Column,
                 segment_suspicious: Column, origin: Column) -> dict[str, Column]:
    """Review status, label confidence and exclusion reason of a recording."""
    st = norm(status)
    no_region = (norm(manip) == "partial_ai_insert") & ~valid_region(start, end)
    listed = st.isin(REVIEW_STATUSES)
    missed = st.endswith("_missed") & ~F.coalesce(segment_suspicious, F.lit(False))
    unsure = origin == "uncertain"
    status_out = (F.when(~exists, "rejected").when(no_region | listed, "needs_review")
                  .when(missed, "approved").when(unsure, "needs_review").otherwise("approved"))
    return {
        "review_status": status_out,
        "label_confidence": F.when(~exists | no_region, "low")
        .when(listed, F.when(st == "clean_human_borderline", "medium").otherwise("low"))
        .when(missed, "medium").when(unsure, "low").otherwise("high"),
        "use_for_validation": status_out == "approved",
        "exclusion_reason": F.when(~exists, "audio_not_found").when(
            no_region | (st == "partial_not_evaluated_missing_timestamp"),
            "missing_partial_fabrication_timestamps").otherwise(""),
    }


def attack_group(label: Column, attack: Column) -> Column:
    """bonafide/synthesis/conversion/replay, or null when the row fits none."""
    lb, at = norm(label), norm(attack)
    return (F.when((lb == "bonafide") | (at == "bonafide"), "bonafide")
            .when((lb == "spoof") & at.isin("synthesis", "conversion", "replay"), at))


# Base training weights, bonuses for known failures and limits (fixed values).
BASE_WEIGHTS = {"partial_ai_insert": 3.0, "clean_direct": 2.5, "human_replay": 2.5, "ai_replay": 2.0}
STATUS_BONUS = {"clean_human_false_alarm": 0.5, "direct_ai_file_level_missed_but_segment_suspicious": 0.5,
                "direct_ai_missed": 0.75, "partial_fabrication_missed": 0.75}
WEIGHT_MIN, WEIGHT_MAX = 0.1, 4.0


def collection_weight(manip: Column, origin: Column, status: Column) -> tuple[Column, Column]:
    """Sample weight and its reason for a collected recording."""
    m, o, st = norm(manip), norm(origin), norm(status)
    side = F.when(o.isin("human", "ai"), o)
    base = (F.when(m.isin(list(BASE_WEIGHTS)), F.try_element_at(lookup(BASE_WEIGHTS), m))
            .when((m == "mixer_processed") & (o != "ai"), 2.5).otherwise(2.0))
    reason = F.concat(F.lit("p7c1_"), (
        F.when(m == "partial_ai_insert", "partial_fabrication")
        .when(m == "clean_direct", F.concat(F.lit("clean_direct_"), F.coalesce(side, F.lit("ai"))))
        .when(m.isin("human_replay", "ai_replay"), m)
        .when(m == "mixer_processed", F.concat(F.lit("mixer_"), F.coalesce(side, F.lit("human"))))
        .otherwise("default")))
    bonus = F.try_element_at(lookup(STATUS_BONUS), st)
    weight = F.least(F.lit(WEIGHT_MAX), F.greatest(F.lit(WEIGHT_MIN), base + F.coalesce(bonus, F.lit(0.0))))
    return F.round(weight, 4), F.when(
        bonus.isNotNull(), F.concat(reason, F.lit("+baseline_"), st)).otherwise(reason)


def window_weight(source: Column, role: Column, risk: Column, existing: Column) -> tuple[Column, Column]:
    """Fine-tuning weight by source and role, raised to half of an existing weight, capped."""
    r = F.lower(role)
    old = source == "old"
    base = (F.when(old, 1.0).when(r.contains("clean_human"), 4.0).when(r.contains("direct_ai"), 3.0)
            .when(r.contains("partial"), 2.5).otherwise(2.0))
    name = F.nullif(role, F.lit(""))
    reason = (F.when(old & (risk == 0), "old_bonafide")
              .when(old, F.concat(F.lit("old_"), F.coalesce(name, F.lit("spoof"))))
              .when(r.contains("clean_human"), "phase7c1_clean_human_boost")
              .when(r.contains("direct_ai"), "phase7c1_direct_ai")
              .when(r.contains("partial"), "phase7c1_partial_fabrication")
              .otherwise(F.concat(F.lit("phase7c1_"), F.coalesce(name, F.lit("risk_positive")))))
    return F.least(F.lit(WEIGHT_MAX), F.greatest(base, existing * 0.5)), reason


# Manipulation types that are platform effects (fixed values).
PLATFORM_TYPES = ["whatsapp_compressed", "youtube_broadcast", "phone_recorded", "noisy_room"]


def expected_risk(manip: Column, origin: Column, gt_manip: Column, partial: Column) -> Column:
    """Struct (risk, role): 1 risky, 0 clean, null when a person has to decide."""
    m, o, g = norm(manip), norm(origin), norm(gt_manip)
    out = lambda risk, role: F.struct(
        F.lit(risk).cast("string").alias("risk"),
        (role if isinstance(role, Column) else F.lit(role)).alias("role"))
    human = o == "human"
    return (
        F.when(F.coalesce(partial, F.lit(False)) | m.isin("partial_ai_insert", "edited_spliced", "edited_or_spliced"),
               out("1", "partial_fabrication"))
        .when((m == "clean_direct") & human & g.isin("clean", ""), out("0", "clean_human"))
        .when((m == "clean_direct") & (o == "ai"), out("1", "direct_ai"))
        .when(m.isin("human_replay", "ai_replay"), out("1", m))
        .when(m == "mixer_processed", out("1", F.when(human, "human_mixer").otherwise("ai_mixer")))
        .when(m.isin(PLATFORM_TYPES), out("1", F.when(o == "ai", "ai_processed").otherwise("human_processed")))
        .when(m == "spliced", out("1", "edited_spliced"))
        .when((g == "clean") & human, out("0", "clean_human"))
        .when(g.isin("replayed", "processed", "mixed"), out("1", "manipulation_risk"))
        .otherwise(out(None, "needs_review")))


def legacy_risk(attack: Column, label: Column) -> Column:
    """Struct (risk, role) for rows of the older manifest."""
    a, lb = norm(attack), norm(label)
    out = lambda risk, role: F.struct(F.lit(risk).cast("string").alias("risk"), role.alias("role"))
    return (F.when((a == "bonafide") | (lb == "bonafide"), out("0", F.lit("old_bonafide")))
            .when(a.isin("synthesis", "conversion", "replay"), out("1", F.concat(F.lit("old_"), a)))
            .when(lb.isin("spoof", "fake"), out("1", F.concat(F.lit("old_"), F.coalesce(F.nullif(a, F.lit("")), lb))))
            .otherwise(out(None, F.lit(""))))


# One row per collected variant: origin, manipulation, chain and labels (fixed values).
VARIANT_COLUMNS = ["variant_id", "source_origin", "manipulation_type", "device_chain",
                   "ground_truth_manipulation", "origin_label", "manipulation_label",
                   "attack_hint", "risk_level"]
VARIANT_ROWS = [
    ("human_clean", "human", "clean_direct", "direct_recording", "clean",
     "human_likely", "clean_original", "bonafide", "low"),
    ("human_replay_laptop_mobile", "human", "human_replay", "laptop_speaker_to_mobile_recording",
     "replayed", "human_likely", "replayed_or_re_recorded", "replay", "medium"),
    ("human_mixer_processed", "human", "mixer_processed", "laptop_mixer_mobile_recording",
     "processed", "human_likely", "channel_processed", "unknown", "medium"),
    ("human_fabricated", "mixed", "partial_ai_insert", "edited_real_plus_ai",
     "mixed", "mixed_or_partial_ai", "edited_or_spliced", "synthesis", "high"),
    ("ai_direct", "ai", "clean_direct", "direct_ai_file", "clean",
     "ai_likely", "clean_original", "synthesis", "high"),
    ("ai_replay_laptop_mobile", "ai", "ai_replay", "laptop_speaker_to_mobile_recording",
     "replayed", "ai_likely", "replayed_or_re_recorded", "replay", "high"),
    ("ai_mixer_processed", "ai", "mixer_processed", "laptop_mixer_mobile_recording",
     "processed", "ai_likely", "channel_processed", "synthesis", "high"),
    ("ai_fabricated", "mixed", "partial_ai_insert", "edited_mixed_ai_or_human_insert",
     "mixed", "mixed_or_partial_ai", "edited_or_spliced", "synthesis", "high"),
]


def variant_id(prefix: Column, suffix: Column) -> Column:
    p, s = F.lower(prefix), F.lower(suffix)
    return (F.when((s == "clean") & (p == "human"), "human_clean")
            .when((s == "direct") & (p == "ai"), "ai_direct")
            .when(s.isin("replay_laptop_mobile", "mixer_processed", "fabricated"), F.concat_ws("_", p, s)))


def split_of_base(n: Column) -> Column:
    """Split from the collected speaker's number."""
    return (F.when(n.between(1, 16), "train").when(n.between(17, 19), "val")
            .when(n.between(20, 23), "test").otherwise("unassigned"))


def region_problem(start: Column, end: Column, duration: Column) -> Column:
    """Why an annotated region does not fit its recording; null when it does."""
    return (F.when(start < 0, "negative_start").when(end <= start, "end_not_after_start")
            .when(start >= duration, "start_past_duration").when(end > duration, "end_past_duration"))

"""Status counts, product metrics, sweeps, comparisons and nested reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.functions import rules as R
from echotrail.functions.labels import valid_region
from echotrail.operators.metrics import ratio
from echotrail.operators.skew import join_keys, top_rows

# Counts per status within a kind of sample (fixed values): metric, status.
PRODUCT_COUNTS = [
    ("clean_human_accept_count", "clean_human_accepted"), ("clean_human_borderline_count", "clean_human_borderline"),
    ("clean_human_false_alarm_count", "clean_human_false_alarm"), ("direct_ai_detected_count", "direct_ai_detected"),
    ("direct_ai_segment_suspicious_count", "direct_ai_file_level_missed_but_segment_suspicious"),
    ("direct_ai_missed_count", "direct_ai_missed"),
    ("human_replay_detected_count", "human_replay_manipulation_detected"), ("human_replay_missed_count", "human_replay_missed"),
    ("ai_replay_detected_count", "ai_replay_detected"), ("ai_replay_missed_count", "ai_replay_missed"),
    ("ai_replay_segment_suspicious_count", "ai_replay_file_level_missed_but_segment_suspicious"),
    ("human_mixer_detected_count", "human_mixer_manipulation_detected"), ("human_mixer_missed_count", "human_mixer_missed"),
    ("ai_mixer_detected_count", "ai_mixer_detected"), ("ai_mixer_missed_count", "ai_mixer_missed"),
    ("ai_mixer_segment_suspicious_count", "ai_mixer_file_level_missed_but_segment_suspicious"),
    ("partial_fabrication_detected_count", "partial_fabrication_detected"),
    ("partial_fabrication_missed_count", "partial_fabrication_missed"),
    ("partial_fabrication_not_evaluable_count", "partial_fabrication_not_evaluable"),
]


def product_metrics(df: DataFrame, keys: Sequence[str], status: str, weight: Column | None = None,
                    evaluable: Column | None = None) -> DataFrame:
    """Status counts per kind, sizes of the kinds, and the product score of five equal rates.

    `weight` lets rows stand for several samples (histograms).
    """
    n = F.lit(1) if weight is None else weight
    m, o, s = F.col("manipulation_type"), F.col("ground_truth_origin"), F.col(status)
    if evaluable is None:
        evaluable = valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time"))
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    clean, mixer = m == "clean_direct", m == "mixer_processed"
    sizes = {"clean_human_n": clean & (o == "human"), "direct_ai_n": clean & (o == "ai"), "human_replay_n": m == "human_replay",
             "ai_replay_n": m == "ai_replay", "human_mixer_n": mixer & (o == "human"), "ai_mixer_n": mixer & (o == "ai"),
             "partial_fabrication_evaluable_n": (m == "partial_ai_insert") & evaluable}
    counts = df.groupBy(*keys).agg(
        F.sum(n).alias("n_samples"), *[total(cond).alias(k) for k, cond in sizes.items()],
        *[total(s == st).alias(k) for k, st in PRODUCT_COUNTS])
    share = lambda hit, size: hit / F.greatest(F.col(size), F.lit(1))
    c = F.col
    score = 0.20 * (
        share(c("clean_human_accept_count"), "clean_human_n")
        + share(c("direct_ai_detected_count") + c("direct_ai_segment_suspicious_count"), "direct_ai_n")
        + (share(c("human_replay_detected_count"), "human_replay_n") + share(c("ai_replay_detected_count"), "ai_replay_n")) / 2.0
        + (share(c("human_mixer_detected_count"), "human_mixer_n") + share(c("ai_mixer_detected_count"), "ai_mixer_n")) / 2.0
        + share(c("partial_fabrication_detected_count"), "partial_fabrication_evaluable_n"))
    return counts.withColumn("clean_human_review_rate", F.coalesce(
        ratio(c("clean_human_borderline_count"), c("clean_human_n")), F.lit(0.0))).withColumn("product_score", score)


def threshold_sweep(df: DataFrame, source: str, votes: Sequence[float], segments: Sequence[float],
                    ratios: Sequence[float], margin: float = 0.05) -> DataFrame:
    """Product metrics for every (vote, segment, ratio) combination.

    Samples collapse to a histogram over the rules' inputs and the levels they reach;
    the combinations are applied to that histogram only.
    """
    slot = lambda c, levels: sum((R.known(c >= v).cast("int") for v in levels[1:]), R.known(c >= levels[0]).cast("int"))
    score = F.col("decision_score")
    per_vote = F.array(*[F.struct(F.lit(float(v)).alias("vote"), R.known(R.predicted(F.lit(v)) == "FAKE").alias("fake"),
                                  R.known(R.predicted(F.lit(v)) == "REAL").alias("real"),
                                  R.known(F.abs(score - v) <= margin).alias("edge"),
                                  (R.known(R.predicted(F.lit(v)) == "FAKE") | R.known(score >= 0.65)).alias("found")) for v in votes])
    region = valid_region(F.col("suspicious_start_time"), F.col("suspicious_end_time"))
    hist = df.select(
        "manipulation_type", "ground_truth_origin", R._has_error().alias("_err"), region.alias("_region"),
        R._partial_status(F.col("partial_region_detected")).alias("_partial"),
        R.flag_set(F.col("partial_fabrication_binary")).alias("_flag"),
        slot(F.col("max_chunk_spoof"), segments).alias("_ss"), slot(F.col("suspicious_chunk_ratio"), ratios).alias("_rs"),
        F.explode(per_vote).alias("_v")).groupBy(
        "manipulation_type", "ground_truth_origin", "_err", "_region", "_partial", "_flag", "_ss", "_rs",
        "_v.vote", "_v.fake", "_v.real", "_v.edge", "_v.found").agg(F.count(F.lit(1)).alias("_n"))
    levels = lambda vals: F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(x)).alias("v")) for i, x in enumerate(vals)]))
    g = hist.select("*", levels(segments).alias("_s")).select("*", levels(ratios).alias("_r"))
    hot = (F.col("_s.i") <= F.col("_ss")) | (F.col("_r.i") <= F.col("_rs"))
    status = R.status_from_flags(F.col("fake"), F.col("real"), F.col("edge"), hot, F.col("found"), F.col("_err"), F.col("_partial"), F.col("_flag"))
    g = g.withColumn("_status", status).withColumn("segment_threshold", F.col("_s.v")).withColumn("ratio_threshold", F.col("_r.v"))
    out = product_metrics(g.withColumnRenamed("vote", "vote_threshold"), ["vote_threshold", "segment_threshold", "ratio_threshold"],
                          "_status", F.col("_n"), F.col("_region"))
    return out.withColumn("source", F.lit(source))


def ensemble(merged: DataFrame, models: Sequence[str]) -> DataFrame:
    """One sample row from several models: highest score, spoof and ratio, any region hit."""
    first = models[0]
    pick = lambda f: F.greatest(*[F.col(f"{f}_{m}") for m in models])
    hit = F.greatest(*[F.coalesce(f"partial_region_detected_{m}", F.lit(False)) for m in models])
    return merged.select(
        "sample_id", *[F.col(f"{c}_{first}").alias(c) for c in (
            "manipulation_type", "ground_truth_origin", "suspicious_start_time", "suspicious_end_time")],
        pick("decision_score").alias("decision_score"), pick("max_chunk_spoof").alias("max_chunk_spoof"),
        F.coalesce(pick("suspicious_chunk_ratio"), F.lit(0.0)).alias("suspicious_chunk_ratio"),
        hit.alias("partial_region_detected"), F.lit(None).cast("string").alias("prediction"),
        F.lit(None).cast("string").alias("partial_fabrication_binary"), F.lit(None).cast("string").alias("error"))


def count_delta(before: DataFrame, after: DataFrame, status: str) -> DataFrame:
    """Counts per status before and after, and the change."""
    count = lambda d, n: d.groupBy(status).agg(F.count(F.lit(1)).alias(n))
    j = count(before, "before").join(count(after, "after"), status, "full_outer").na.fill(0, ["before", "after"])
    return j.withColumn("delta", F.col("after") - F.col("before"))


def top_texts(df: DataFrame, keys: Sequence[str], column: str, k: int, name: str) -> DataFrame:
    """The k most frequent values per group as 'value (count); ...'."""
    counts = df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    top = top_rows(counts, keys, [F.col("_n").desc(), F.col(column).asc()], k, "_r")
    text = F.concat(F.col(column), F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), "; ").alias(name))


# Risk, overall status, hints, review and confidence per calibrated status (fixed values).
STATUS_REPORT_COLUMNS = ["calibrated_status", "risk", "overall_status", "origin_hint", "manipulation_hint", "confidence"]
STATUS_REPORT = [
    ("clean_human_accepted", "low", "no_strong_synthetic_or_manipulation_evidence", "likely_human", "no_strong_manipulation_evidence", "medium"),
    ("clean_human_borderline", "medium", "inconclusive_manual_review_recommended", "likely_human_or_uncertain", "uncertain", "low"),
    ("clean_human_false_alarm", "medium", "suspicious_but_possible_clean_human_false_alarm", "uncertain", "uncertain", "low"),
    ("direct_ai_detected", "high", "ai_synthetic_speech_indicators_detected", "likely_ai_generated", "synthetic_generation_indicators", "high"),
    ("direct_ai_file_level_missed_but_segment_suspicious", "high", "segment_level_ai_suspicion", "ai_suspicious", "synthetic_segment_indicators", "medium"),
    ("direct_ai_missed", "medium", "evaluation_mismatch_or_weak_ai_evidence", "uncertain", "uncertain", "low"),
    ("human_replay_manipulation_detected", "medium", "replay_or_rerecording_indicators_detected", "likely_human", "replayed_or_rerecorded", "medium"),
    ("human_replay_missed", "medium", "replay_evidence_weak_or_missed", "likely_human_or_uncertain", "uncertain", "low"),
    ("ai_replay_detected", "high", "ai_replay_or_processed_speech_indicators_detected", "ai_suspicious", "replayed_or_rerecorded", "high"),
    ("ai_replay_file_level_missed_but_segment_suspicious", "high", "segment_level_ai_replay_suspicion", "ai_suspicious", "replayed_or_rerecorded", "medium"),
    ("ai_replay_missed", "medium", "ai_replay_evidence_weak_or_missed", "uncertain", "uncertain", "low"),
    ("human_mixer_manipulation_detected", "medium", "channel_processing_or_mixer_artifacts_detected", "likely_human", "channel_processed", "medium"),
    ("human_mixer_missed", "medium", "mixer_evidence_weak_or_missed", "likely_human_or_uncertain", "uncertain", "low"),
    ("ai_mixer_detected", "high", "ai_speech_with_channel_processing_indicators", "ai_suspicious", "channel_processed", "high"),
    ("ai_mixer_file_level_missed_but_segment_suspicious", "high", "segment_level_ai_mixer_suspicion", "ai_suspicious", "channel_processed", "medium"),
    ("ai_mixer_missed", "medium", "ai_mixer_evidence_weak_or_missed", "uncertain", "uncertain", "low"),
    ("partial_fabrication_detected", "high", "partial_fabrication_or_splice_indicators_detected", "mixed_or_uncertain", "edited_or_partially_synthetic", "high"),
    ("partial_fabrication_missed", "medium", "no_strong_partial_fabrication_evidence_but_limitations_apply", "mixed_or_uncertain", "uncertain", "low"),
    ("partial_fabrication_not_evaluable", "inconclusive", "partial_fabrication_not_evaluable_missing_timestamps", "uncertain", "uncertain", "low"),
    ("borderline_needs_review", "inconclusive", "inconclusive_manual_review_recommended", "uncertain", "uncertain", "low"),
    ("unknown_review_required", "inconclusive", "unknown_review_required", "uncertain", "uncertain", "low"),
]


def report_fields(df: DataFrame, ratio_col: str) -> DataFrame:
    """Report fields by calibrated_status; unlisted statuses read as needing review, hot chunks raise risk."""
    rules = df.sparkSession.createDataFrame(STATUS_REPORT, STATUS_REPORT_COLUMNS)  # fixed, a few rows
    rules = rules.withColumnRenamed("calibrated_status", "_key")
    status = F.col("calibrated_status")
    key = F.when(status.isin([r[0] for r in STATUS_REPORT]), status).otherwise("unknown_review_required")
    j = df.withColumn("_lookup", key).join(F.broadcast(rules), F.col("_lookup") == F.col("_key"), "left")
    raised = status.isin("human_replay_manipulation_detected", "human_mixer_manipulation_detected") \
        & R.known(F.col(ratio_col) >= 0.5)
    return j.withColumn("risk", F.when(raised, "high").otherwise(F.col("risk"))).drop("_lookup", "_key")


def status_counts_wide(df: DataFrame, keys: Sequence[str], status: str, statuses: Sequence[str],
                       averages: Sequence[str] = ()) -> DataFrame:
    """total, one column per status and means per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(f"status_{s}") for s in statuses],
        *[F.avg(c).alias(f"avg_{c}") for c in averages])


def nested_segments(df: DataFrame, key: str, rank: str, fields: Sequence[str]) -> DataFrame:
    """Ordered array of structs per key; meant for lists already cut to a few rows per key."""
    return df.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(rank, *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("segments"))

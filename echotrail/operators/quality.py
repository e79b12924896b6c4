"""Table checks: rules counted in one pass, issue rows, annotation and rank integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.functions.numbers import to_number
from echotrail.operators.profile import issue_rows
from echotrail.operators.skew import join_ids, numbered


def missing_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ()) -> list[str]:
    have = set(df.columns)
    return [f"missing column {c}" for c in required if c not in have] + \
           [f"forbidden column {c}" for c in forbidden if c in have]


def rule_counts(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Violations per rule with its level (blocking or warning), all counted in one pass."""
    wide = df.agg(*[F.count_if(cond).alias(name) for name, (_, cond) in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"), F.col(n).alias("violations"))
                     for n, (level, _) in rules.items()])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "status", F.when(F.col("violations") == 0, "PASS").when(F.col("level") == "blocking", "FAIL").otherwise("WARN"))


def repeated_keys(df: DataFrame, key: str, rule: str, level: str = "blocking") -> DataFrame:
    """Distinct repeated keys as a rule row."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("violations"))
    return _rule_row(n, rule, level)


def orphans(child: DataFrame, parent: DataFrame, key: str, rule: str, level: str = "blocking") -> DataFrame:
    """Distinct child keys without a parent as a rule row."""
    lost = child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")
    return _rule_row(lost.agg(F.count(F.lit(1)).alias("violations")), rule, level)


def _rule_row(counted: DataFrame, rule: str, level: str) -> DataFrame:
    bad = "FAIL" if level == "blocking" else "WARN"
    return counted.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "violations",
                          F.when(F.col("violations") == 0, "PASS").otherwise(bad).alias("status"))


def disallowed_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside the vocabulary with their row counts."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("<null>"))
    return df.where(~value.isin(list(allowed))).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def normalise_annotations(df: DataFrame, start: str, end: str, label: str, positive: Sequence[str],
                          negative: Sequence[str]) -> DataFrame:
    """Numeric bounds, duration, canonical label and status of raw annotation rows."""
    s, e = to_number(F.col(start)), to_number(F.col(end))
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    unusable = s.isNull() | e.isNull()
    status = F.when(unusable, "missing_start_or_end").when(e <= s, "invalid_time_range").otherwise("matched")
    return df.select(
        "*", s.alias("fabricated_start_sec"), e.alias("fabricated_end_sec"),
        F.when(e > s, e - s).alias("fabricated_duration_sec"),
        F.when(text.isin(list(positive)), "positive").when(text.isin(list(negative)), "negative")
        .when(text == "", "unknown").otherwise(text).alias("annotation_label"), status.alias("annotation_status"))


def timestamp_audit(df: DataFrame, key: str, bounds: Sequence[tuple[str, str]], truth: Sequence[str]) -> DataFrame:
    """Per recording: which timestamp columns hold values and whether they can supervise training."""
    cols = [c for pair in bounds for c in pair] + list(truth)
    filled = lambda c: F.max(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    g = df.groupBy(key).agg(*[filled(c).alias(f"_{c}") for c in cols])
    both = F.lit(False)
    for a, b in bounds:
        both = both | (F.col(f"_{a}") & F.col(f"_{b}"))
    for c in truth:
        both = both | F.col(f"_{c}")
    found = F.array_join(F.filter(F.array(*[F.when(F.col(f"_{c}"), c) for c in cols]), lambda x: x.isNotNull()), ";")
    return g.select(key, found.alias("timestamp_columns_found"), both.alias("usable_for_supervised_segment_training"),
                    F.when(both, "per-segment or start/end timestamp labels available")
                    .when(found == "", "only inherited file-level partial label available")
                    .otherwise("timestamp labels incomplete").alias("reason"))


def rank_integrity(df: DataFrame, key: str, rank: str, prob: str, index: str, start: str) -> DataFrame:
    """Recordings whose ranks are not 1..n, whose rank 1 is not the maximum, or whose index is not in time order.

    Ranks are 1..n exactly when they are whole, distinct, and run from 1 to n; the time
    order is checked against the row position.
    """
    distinct = df.select(key, rank).distinct().groupBy(key).agg(F.count(rank).alias("_d"))
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_lo"), F.max(rank).alias("_hi"),
        F.max(prob).alias("_top"), F.max(F.when(F.col(rank) == 1, F.col(prob))).alias("_first"))
    pos = numbered(df, [key], [F.col(start).asc(), F.col(index).asc()], "_pos")
    order = pos.groupBy(key).agg(F.max(F.col(index) != F.col("_pos") - 1).alias("_moved"))
    j = join_ids(join_ids(g, distinct, [key]), order, [key])
    ranks = (F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_d") != F.col("_n"))
    first = F.coalesce(F.abs(F.col("_first") - F.col("_top")) > 1e-9, F.lit(True))
    return issue_rows(j, {"ranks_not_1_to_n": ranks, "rank_1_not_maximum": first,
                          "index_not_chronological": F.coalesce("_moved", F.lit(False))}, [key])


def candidate_matches_first(files: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Recordings whose stored candidate is not their rank-1 segment (bounds and score within 1e-6)."""
    first = segments.where(F.col("segment_rank") == 1).select(
        key, F.col("segment_start").alias("_s"), F.col("segment_end").alias("_e"), F.col("segment_probability").alias("_p"))
    j = join_ids(files, first, [key], "left")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6
    ok = near("candidate_start", "_s") & near("candidate_end", "_e") & near("candidate_probability", "_p")
    return j.where(~F.coalesce(ok, F.lit(False))).select(key, F.when(
        F.col("_s").isNull(), "no_rank_1").otherwise("candidate_differs").alias("issue"))


# Columns that must never be model features: exact names and parts of names (fixed values).
FORBIDDEN_FEATURES = [
    "timestamp_region_label", "timestamp_overlap_sec", "timestamp_overlap_ratio_segment", "fabricated_start_sec",
    "fabricated_end_sec", "target_is_fabricated_segment", "target_is_partial_fabrication_file", "known_origin_label",
    "known_manipulation_labels", "file_category", "segment_source_type", "allowed_use", "model_feature_columns_json",
    "partial_file_label_source", "fabrication_direction", "partial_probability", "fake_score", "real_score",
    "timestamp_segment_label", "max_fabricated_overlap_ratio", "max_fabricated_overlap_sec",
    "overlaps_true_fabricated_region", "candidate_type", "candidate_reason",
]
FORBIDDEN_PARTS = ["fabricated_baseline", "outside_baseline", "inside_outside_margin", "inside_outside_separation",
                   "fusion_", "_fusion", "partial_fusion", "origin_probability", "replay_probability", "mixer_probability"]


def feature_leakage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Status of every column name of a table against the forbidden-feature rules."""
    names = df.sparkSession.createDataFrame(
        [(c, c in set(features)) for c in sorted({*df.columns, *features})], "column string, in_model_features boolean")
    low = F.lower("column")
    bad = F.col("column").isin(FORBIDDEN_FEATURES)
    for part in FORBIDDEN_PARTS:
        bad = bad | low.contains(part)
    return names.select(
        "column", "in_model_features",
        F.when(bad & F.col("in_model_features"), "forbidden_as_feature").when(bad, "present_as_metadata_ok")
        .otherwise("absent").alias("status"),
        F.when(bad & F.col("in_model_features"), "remove_from_model_features").when(bad, "keep_metadata_only")
        .when(F.col("in_model_features"), "usable_feature").otherwise("none").alias("action"))

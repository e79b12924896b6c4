"""Row generators: cutting recordings into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _explode_windows(df: DataFrame, count: Column, name: str = "segment_index") -> DataFrame:
    """One row per window number 0..count-1; recordings with no window disappear."""
    many = F.when(count > 0, F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))
    return df.select("*", F.explode(many).alias(name))


def hop_windows(df: DataFrame, duration: str, length: float, hop: float) -> DataFrame:
    """Windows over [0, duration): the last one is cut at the end, none after it."""
    d = F.col(duration)
    step = hop if hop > 0 else length
    if length <= 0:
        return df.select("*", *[F.lit(None).cast("double").alias(c) for c in (
            "start_sec", "end_sec", "segment_duration_sec")]).where(F.lit(False))
    count = F.when(d > 0, F.greatest(F.lit(1), F.ceil((d - length) / step) + 1))
    start = F.col("segment_index") * F.lit(float(step))
    end = F.least(start + F.lit(float(length)), d)
    return _explode_windows(df, count).where(start < d).select(
        "*", F.round(start, 6).alias("start_sec"), F.round(end, 6).alias("end_sec"),
        F.round(end - start, 6).alias("segment_duration_sec"))


def sample_windows(df: DataFrame, samples: str, rate: str, length: float = 4.0,
                   hop: float = 2.0) -> DataFrame:
    """Windows by sample index; a recording no longer than one window gives one short row."""
    n, sr = F.col(samples), F.col(rate)
    seg = F.greatest(F.floor(sr * length), F.lit(1))
    step = F.greatest(F.floor(sr * hop), F.lit(1))
    single = n / sr <= length
    count = F.when(single, 1).otherwise(F.greatest(F.lit(1), F.ceil((n - seg) / step) + 1))
    first = F.when(single, F.lit(0).cast("long")).otherwise(F.col("segment_index") * step)
    last = F.least(first + seg, n)
    sec = lambda c: F.round(c / sr, 4)
    return _explode_windows(df, count).select(
        "*", F.concat(F.lit("seg_"), F.when(F.col("segment_index") < 10000, F.lpad(
            F.col("segment_index").cast("string"), 4, "0")).otherwise(
            F.col("segment_index").cast("string"))).alias("segment_id"),
        first.cast("long").alias("sample_start"), last.cast("long").alias("sample_end"),
        sec(first).alias("start_sec"), sec(F.when(single, n).otherwise(last)).alias("end_sec"))


def full_windows(df: DataFrame, samples: str, rate: str, length: float = 4.0,
                 overlap: float = 1.0) -> DataFrame:
    """Full windows only, the tail is dropped; short recordings give one short window."""
    n, sr = F.col(samples), F.col(rate)
    seg = F.floor(sr * length)
    hop = F.floor(sr * (length - overlap))
    step = F.when(hop > 0, hop).otherwise(seg)
    short = n <= seg
    count = F.when(short, 1).otherwise(F.floor((n - seg) / step) + 1)
    first = F.col("segment_index") * step
    return _explode_windows(df, count).select(
        "*", F.when(short, 0.0).otherwise(first / sr).alias("start_sec"),
        F.when(short, n / sr).otherwise((first + seg) / sr).alias("end_sec"))


def window_starts(df: DataFrame, samples: str, window: int, hop: int, rate: int,
                  region_start: str, region_end: str) -> DataFrame:
    """Sorted distinct start samples: sliding, tail-aligned, and two anchors on the region."""
    n = F.col(samples)
    last = n - window
    rs, re_ = F.col(region_start), F.col(region_end)
    sliding = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long"))
    inside = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, last.cast("long")))
    centre = inside((F.floor((rs + re_) / 2.0 * rate) - window // 2).cast("long"))
    begin = inside(F.floor(rs * rate).cast("long"))
    anchors = F.when(re_ > rs, F.array(centre, begin)).otherwise(F.array().cast("array<bigint>"))
    base = F.array_union(sliding, F.array(last.cast("long")))
    starts = F.when(n <= window, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_sort(F.array_union(base, anchors)))
    return df.select("*", F.explode(starts).alias("start_sample"))


def training_windows(df: DataFrame, duration: str, source: str, partial: Column,
                     region_start: str, region_end: str, length: float) -> DataFrame:
    """Windows per training row: on the region, first only, or start, middle and end."""
    d, rs, re_ = F.col(duration), F.col(region_start), F.col(region_end)
    win = F.lit(float(length))
    w = lambda strategy, start, end: F.struct(
        F.lit(strategy).alias("window_strategy"), F.round(start, 4).alias("window_start_time"),
        F.round(end, 4).alias("window_end_time"))
    zero = F.lit(0.0)
    on_region = F.greatest(zero, (rs + re_) / 2.0 - win / 2.0)
    far = d - win
    none = F.array().cast("array<struct<window_strategy:string,window_start_time:double,window_end_time:double>>")
    windows = (
        F.when(partial, F.when(re_ > rs, F.array(w("partial_suspicious_region", on_region, on_region + win))).otherwise(none))
        .when(F.col(source) == "old", F.array(w("old_first_window", zero, F.least(win, F.coalesce(d, win)))))
        .when(d.isNull() | (d <= win), F.array(w("phase7c1_start_only", zero, F.least(win, F.coalesce(d, win)))))
        .otherwise(F.array(w("phase7c1_start", zero, zero + win),
                           w("phase7c1_middle", far / 2.0, far / 2.0 + win),
                           w("phase7c1_end", far, far + win))))
    return df.select("*", F.inline(windows))


def clamp_window(start: Column, duration: Column, length: float,
                 strategy: Column) -> dict[str, Column]:
    """Move a window that passes the end back inside; the strategy says when it was moved."""
    begin = F.greatest(F.lit(0.0), start)
    over = begin + length > duration
    return {
        "window_start": F.when(over, F.greatest(F.lit(0.0), duration - length)).otherwise(begin),
        "window_end": F.when(over, duration).otherwise(begin + length),
        "window_strategy": F.when(over | (duration < length), F.concat(strategy, F.lit("_clamped")))
        .otherwise(strategy),
    }


def insertion_segments(df: DataFrame, ident: str, duration: str, start: str, end: str,
                       valid: Column, whole: Column) -> DataFrame:
    """Before/inserted/after rows where a region is valid, one whole row where `whole` holds."""
    t1, t2, d = F.col(start), F.col(end), F.col(duration)
    name = F.col(ident).cast("string")
    part = lambda suffix, a, b, label, origin, risk: F.struct(
        F.concat(name, F.lit(suffix)).alias("segment_id"), a.alias("segment_start_time"),
        b.alias("segment_end_time"), F.lit(label).alias("segment_label"),
        F.lit(origin).alias("segment_origin_label"), F.lit(risk).alias("segment_risk_level"))
    zero = F.lit(0.0)
    three = F.array(
        part("_pre_real", zero, t1, "pre_real_segment", "human_likely", "low"),
        part("_inserted_ai", t1, t2, "inserted_ai_segment", "ai_likely", "high"),
        part("_post_real", t2, F.coalesce(d, t2), "post_real_segment", "human_likely", "low"))
    one = F.array(part("_full", zero, d, "full_file_clean", "human_likely", "low"))
    return df.select(ident, F.explode(
        F.when(valid, three).when(whole & d.isNotNull(), one)).alias("s")).select(ident, "s.*")

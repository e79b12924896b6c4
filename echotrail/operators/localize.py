"""Which segments of a recording stand out: deviation, transition and baseline margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.functions.numbers import row_mean
from echotrail.operators.skew import (
    EVERY, MEASURE, by_halves, group_medians, join_ids, min_rank_descending, neighbours,
    percent_rank_average, settled, spread, top_rows,
)

MAD_SCALE = 1.4826  # makes the median absolute deviation comparable to a standard deviation


def with_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], hot=MEASURE) -> DataFrame:
    """Add med_<c> (group median) and mad_<c> (median absolute deviation, 0 as null)."""
    return by_halves(df, keys, lambda part, size: _with_medians(part, keys, cols, size), hot)


def _with_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], hot) -> DataFrame:
    if hot is None:
        # windows on the key alone: one shuffle for medians, deviations and whatever follows
        w = Window.partitionBy(*keys)
        half = lambda c: F.percentile(c, F.lit(0.5)).over(w)
        med = df.select("*", *[half(F.col(c)).alias(f"med_{c}") for c in cols])
        return med.select("*", *[F.nullif(half(F.abs(F.col(c) - F.col(f"med_{c}"))), F.lit(0.0)).alias(f"mad_{c}")
                                 for c in cols])
    med = join_ids(df, group_medians(df, keys, cols, "med_", hot), keys)
    dev = med.select(*keys, *[F.abs(F.col(c) - F.col(f"med_{c}")).alias(c) for c in cols])
    mad = group_medians(dev, keys, cols, "mad_", hot)
    mad = mad.select(*keys, *[F.nullif(F.col(f"mad_{c}"), F.lit(0.0)).alias(f"mad_{c}") for c in cols])
    return join_ids(med, mad, keys)


def robust_z(c: str) -> Column:
    return (F.col(c) - F.col(f"med_{c}")) / (MAD_SCALE * F.col(f"mad_{c}"))


def distance_from_median(cols: Sequence[str]) -> Column:
    """Euclidean distance; a missing value adds nothing."""
    gaps = [F.coalesce(F.col(c) - F.col(f"med_{c}"), F.lit(0.0)) for c in cols]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def mean_abs(*values: Column) -> Column:
    return row_mean(*[F.abs(v) for v in values])


def mean_abs_difference(a: str, b: str) -> Column:
    """Mean absolute difference of two arrays, skipping nulls; null without a pair."""
    gaps = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda v: v.isNotNull())
    return F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(gaps))


def neighbour_deltas(df: DataFrame, key: str, order: Sequence[Column], groups: dict[str, list[str]],
                     k: int = 1, hot=MEASURE) -> DataFrame:
    """Per feature group: mean |z difference| to the segments k before and after, and their max."""
    z = df.withColumn("_z", F.struct(*[F.array(*[robust_z(c) for c in cols]).alias(g)
                                       for g, cols in groups.items()]))
    near = neighbours(z, [key], order, "_z", k, "_zp", "_zn", hot)
    out = near
    for g in groups:
        out = out.withColumn(f"{g}_prev_delta", mean_abs_difference(f"_z.{g}", f"_zp.{g}")) \
                 .withColumn(f"{g}_next_delta", mean_abs_difference(f"_z.{g}", f"_zn.{g}")) \
                 .withColumn(f"max_{g}_delta", F.greatest(f"{g}_prev_delta", f"{g}_next_delta"))
    return out.drop("_z", "_zp", "_zn")


def baseline_margins(df: DataFrame, key: str, groups: dict[str, list[str]], inside: Column,
                     outside: Column, hot=MEASURE) -> DataFrame:
    """Robust distance to the recording's outside and inside baselines, and their margin.

    Recordings without both kinds of segments get nulls.
    """
    return by_halves(df, [key], lambda part, size: _baseline_margins(part, key, groups, inside, outside, size), hot)


def _baseline_margins(df: DataFrame, key: str, groups: dict[str, list[str]], inside: Column, outside: Column, hot) -> DataFrame:
    cols = [c for g in groups.values() for c in g]
    if hot is None:
        w = Window.partitionBy(key)
        j = df.select("*", *[
            F.percentile(F.when(cond, F.col(c)), F.lit(0.5)).over(w).alias(f"{side}_{c}")
            for side, cond in (("in", inside), ("out", outside)) for c in cols],
            (F.max(F.coalesce(inside, F.lit(False))).over(w)
             & F.max(F.coalesce(outside, F.lit(False))).over(w)).alias("_both"))
        return _margins(j, groups)
    split = df.select(key, *[F.when(inside, F.col(c)).alias(f"in_{c}") for c in cols],
                      *[F.when(outside, F.col(c)).alias(f"out_{c}") for c in cols])
    base = group_medians(split, [key], [*[f"in_{c}" for c in cols], *[f"out_{c}" for c in cols]], "", hot)
    both = df.groupBy(key).agg((F.max(F.coalesce(inside, F.lit(False)))
                                & F.max(F.coalesce(outside, F.lit(False)))).alias("_both"))
    return _margins(join_ids(join_ids(df, base, [key]), both, [key]), groups)


def _margins(j: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    cols = [c for g in groups.values() for c in g]
    gap = lambda side, c: (F.col(c) - F.col(f"{side}_{c}")) / (MAD_SCALE * F.col(f"mad_{c}"))
    for g, gcols in groups.items():
        for side in ("out", "in"):
            j = j.withColumn(f"{g}_dist_{side}", F.when(F.col("_both"), mean_abs(*[gap(side, c) for c in gcols])))
        j = j.withColumn(f"{g}_margin", F.col(f"{g}_dist_out") - F.col(f"{g}_dist_in"))
    far = row_mean(*[F.col(f"{g}_dist_out") for g in groups])
    near = row_mean(*[F.col(f"{g}_dist_in") for g in groups])
    return j.withColumn("combined_margin", far - near).drop(
        "_both", *[f"in_{c}" for c in cols], *[f"out_{c}" for c in cols])


def localization_candidates(df: DataFrame, key: str, ident: str, groups: dict[str, list[str]],
                            inside: Column, outside: Column, top_k: int = 5, k: int = 1) -> DataFrame:
    """All within-recording scores, the candidate rank and class of every segment."""
    work = lambda part, size: _candidates(spread(part, [key]) if size is None else part, key, ident, groups, inside, outside, top_k, k, size)
    return by_halves(df, [key], work)


def _candidates(df: DataFrame, key: str, ident: str, groups: dict[str, list[str]],
                inside: Column, outside: Column, top_k: int, k: int, hot) -> DataFrame:
    cols = [c for g in groups.values() for c in g]
    order = [F.col("start_sec").asc(), F.col(ident).asc()]
    t = with_medians(df, [key], cols, hot)
    t = baseline_margins(t, key, groups, inside, outside, hot)
    t = neighbour_deltas(t, key, order, groups, k, hot)
    for g, gcols in groups.items():
        t = t.withColumn(f"{g}_distance", distance_from_median(gcols))
    # the ranks sort the group once per score: carry only what they and the result need
    t = t.select(key, ident, *[c for c in ("start_sec", "end_sec") if c in df.columns], "combined_margin",
                 *[f"{p}{g}{s}" for g in groups for p, s in (("", "_distance"), ("max_", "_delta"))])
    if hot is EVERY:
        t = settled(t)
    for g in groups:
        t = percent_rank_average(t, [key], f"{g}_distance", f"{g}_deviation", hot)
        t = percent_rank_average(t, [key], f"max_{g}_delta", f"{g}_transition", hot)
    t = percent_rank_average(t, [key], "combined_margin", "_margin_rank", hot)
    t = t.withColumn("combined_deviation", row_mean(*[F.col(f"{g}_deviation") for g in groups])) \
         .withColumn("combined_transition", row_mean(*[F.col(f"{g}_transition") for g in groups]))
    score = row_mean(F.col("combined_deviation"), F.col("combined_transition"), F.col("_margin_rank"))
    t = t.withColumn("candidate_score", F.round(score, 9))
    t = min_rank_descending(t, [key], "candidate_score", "candidate_rank", hot)
    if hot is None:
        t = t.withColumn("segment_count", F.count(F.lit(1)).over(Window.partitionBy(key)))
    else:
        t = join_ids(t, df.groupBy(key).agg(F.count(F.lit(1)).alias("segment_count")), [key])
    return t.withColumn("candidate_type", candidate_class(top_k)).drop("_margin_rank")


def candidate_class(top_k: int) -> Column:
    """Class of a segment; when several rules hold, the most specific one named first wins.

    The inside/outside margin is in distance units and is compared with ranks as it stands.
    """
    dev, tra, margin = (F.col(c) for c in ("combined_deviation", "combined_transition", "combined_margin"))
    top = F.col("candidate_rank") <= top_k
    return (
        F.when(F.col("segment_count") < 2, "insufficient_data")
        .when(top & (dev >= 0.65) & (tra >= 0.65) & (margin >= 0.65), "combined_localization_candidate")
        .when(top & (dev >= 0.7) & (tra >= 0.7), "both_deviation_and_transition")
        .when(top & (dev < tra), "neighbor_transition_candidate")
        .when(top & (dev > tra), "within_file_deviation_candidate")
        .when(top & (margin >= dev) & (margin >= tra), "inside_outside_candidate")
        .otherwise("not_top_candidate"))


def live_features(df: DataFrame, key: str, ident: str, groups: dict[str, list[str]]) -> DataFrame:
    """Scoring-time features: mean |x - median|, its rank and share of the maximum, step to the previous."""
    return by_halves(df, [key], lambda part, size: _live_features(part, key, ident, groups, size))


def _live_features(df: DataFrame, key: str, ident: str, groups: dict[str, list[str]], hot) -> DataFrame:
    cols = [c for g in groups.values() for c in g]
    order = [F.col("start_sec").asc(), F.col(ident).asc()]
    if hot is None:
        w = Window.partitionBy(key)
        t = df.select("*", *[F.percentile(c, F.lit(0.5)).over(w).alias(f"med_{c}") for c in cols])
    else:
        t = join_ids(df, group_medians(df, [key], cols, "med_", hot), [key])
    for g, gcols in groups.items():
        t = t.withColumn(f"{g}_distance", mean_abs(*[F.col(c) - F.col(f"med_{c}") for c in gcols]))
    t = t.withColumn("_x", F.struct(*[F.array(*gcols).alias(g) for g, gcols in groups.items()]))
    t = neighbours(t, [key], order, "_x", 1, "_xp", "_xn", hot)
    if hot is None:
        w = Window.partitionBy(key)
        t = t.select("*", *[F.max(f"{g}_distance").over(w).alias(f"_top_{g}") for g in groups])
    else:
        tops = t.groupBy(key).agg(*[F.max(f"{g}_distance").alias(f"_top_{g}") for g in groups])
        t = settled(join_ids(t, tops, [key]))
    for g in groups:
        t = percent_rank_average(t, [key], f"{g}_distance", f"{g}_deviation_percentile", hot)
        t = t.withColumn(f"{g}_deviation_score", F.col(f"{g}_distance") / (F.col(f"_top_{g}") + 1e-9)) \
             .withColumn(f"{g}_transition_score", mean_abs_difference(f"_x.{g}", f"_xp.{g}"))
    t = t.withColumn("combined_deviation_score", row_mean(*[F.col(f"{g}_deviation_score") for g in groups])) \
         .withColumn("combined_transition_score", row_mean(*[F.col(f"{g}_transition_score") for g in groups]))
    return t.drop("_x", "_xp", "_xn", *[f"_top_{g}" for g in groups], *[f"med_{c}" for c in cols])


def top_ranges(df: DataFrame, key: str, ident: str, prob: str, k: int = 3) -> DataFrame:
    """The k strongest segments per recording as 'start-end;start-end'."""
    top = top_rows(df, [key], [F.col(prob).desc_nulls_last(), F.col("start_sec").asc(), F.col(ident).asc()], k, "_r")
    text = F.concat(F.col("start_sec").cast("string"), F.lit("-"), F.col("end_sec").cast("string"))
    return top.groupBy(key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), ";").alias("top_segment_ranges"))

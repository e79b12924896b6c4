"""Scored chunk timelines: per-sample metrics, regions and segment lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.operators.intervals import overlaps
from echotrail.operators.profile import mode_per_group
from echotrail.operators.skew import group_stats, join_ids, running, top_rows

# Attack types by index of the probability vector (fixed values).
ATTACK_TYPES = ["bonafide", "synthesis", "conversion", "replay"]
SUSPICIOUS = 0.65


def evaluated_chunks(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Scored chunks marked as evaluated; all scored chunks where a sample has no such mark."""
    scored = df.where(F.col("spoof_probability").isNotNull())
    any_eval = scored.groupBy(key).agg(F.max("evaluated").alias("_any"))
    return join_ids(scored, any_eval, [key]).where(
        F.coalesce("evaluated", F.lit(True)) | ~F.coalesce("_any", F.lit(True))).drop("_any")


def dominant_attack(df: DataFrame, keys: list[str], name: str = "dominant_attack") -> DataFrame:
    """Attack with the largest summed probability; without vectors the most common type."""
    probs = F.slice(F.from_json("attack_probs", "array<double>"), 1, len(ATTACK_TYPES))
    sums = (df.select(*keys, F.posexplode(probs).alias("_i", "_p"))
            .groupBy(*keys, "_i").agg(F.sum("_p").alias("_s")))
    best = sums.groupBy(*keys).agg(
        F.max(F.struct("_s", (-F.col("_i")).alias("_neg"))).alias("_b"))
    names = F.array(*[F.lit(a) for a in ATTACK_TYPES])
    by_prob = best.select(*keys, F.element_at(names, (1 - F.col("_b._neg")).cast("int")).alias("_by_prob"))
    by_type = mode_per_group(df, keys, "attack_type", "_by_type")
    return join_ids(by_type, by_prob, keys, "left").select(
        *keys, F.coalesce("_by_prob", "_by_type").alias(name))


def chunk_metrics(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Suspicious count and ratio, max, mean, median and dominant attack per sample."""
    ev = evaluated_chunks(df, key)
    p = F.col("spoof_probability")
    base = group_stats(ev, [key], [
        F.count_if(p >= SUSPICIOUS).alias("suspicious_chunk_count"),
        (F.count_if(p >= SUSPICIOUS) / F.count(F.lit(1))).alias("suspicious_chunk_ratio"),
        F.max(p).alias("max_chunk_spoof"), F.avg(p).alias("mean_chunk_spoof"),
    ], "spoof_probability", {"median_chunk_spoof": 0.5})
    return join_ids(base, dominant_attack(ev, [key], "dominant_chunk_attack"), [key])


def region_metrics(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Chunks inside against outside the annotated region, and whether the region stands out."""
    ev = evaluated_chunks(df, key).where(F.col("region_end") > F.col("region_start")).withColumn(
        "_side", F.when(overlaps(F.col("start_time"), F.col("end_time"), F.col("region_start"),
                                 F.col("region_end")), "inside").otherwise("outside"))
    p = F.col("spoof_probability")
    side = lambda s: F.when(F.col("_side") == s, p)
    base = ev.groupBy(key).agg(*[
        f(side(s)).alias(f"{n}_{s}" if n == "n_chunks" else f"{s}_region_{n}")
        for s in ("inside", "outside") for n, f in (
            ("n_chunks", F.count), ("avg_spoof", F.avg), ("max_spoof", F.max))])
    dom = dominant_attack(ev, [key, "_side"], "_dom").groupBy(key).agg(
        F.max(F.when(F.col("_side") == "inside", F.col("_dom"))).alias("inside_region_dominant_attack"),
        F.max(F.when(F.col("_side") == "outside", F.col("_dom"))).alias("outside_region_dominant_attack"))
    inside, outside = F.col("inside_region_avg_spoof"), F.col("outside_region_avg_spoof")
    known = lambda c: F.coalesce(c, F.lit(False))
    detected = (known(inside >= outside + 0.15) | known(F.col("inside_region_max_spoof") >= 0.65)
                | (known(F.col("inside_region_dominant_attack").isin("synthesis", "conversion"))
                   & (F.coalesce("outside_region_dominant_attack", F.lit("bonafide")) == "bonafide")))
    return join_ids(base, dom, [key]).withColumn(
        "partial_region_detected", (F.col("n_chunks_inside") > 0) & detected)


def window_region_metrics(df: DataFrame, threshold: float, min_delta: float = 0.10,
                          key: str = "sample_id") -> DataFrame:
    """Region metrics over all windows: detected by maximum or by mean difference."""
    ok = df.where(F.col("region_end") > F.col("region_start"))
    inside = (F.col("end_time") > F.col("region_start")) & (F.col("start_time") < F.col("region_end"))
    p = F.col("spoof_probability")
    pin, pout = F.when(inside, p), F.when(~inside, p)
    base = ok.groupBy(key).agg(
        F.count(pin).alias("n_inside"), F.count(pout).alias("n_outside"),
        F.avg(pin).alias("inside_avg"), F.max(pin).alias("inside_max"),
        F.coalesce(F.avg(pout), F.lit(0.0)).alias("outside_avg"))
    delta = F.col("inside_avg") - F.col("outside_avg")
    return base.withColumn("region_delta", delta).withColumn(
        "partial_region_detected", F.coalesce(
            (F.col("inside_max") >= threshold) | (delta >= min_delta), F.lit(False)))


def suspicious_regions(df: DataFrame, threshold: float = SUSPICIOUS, top_k: int | None = 3,
                       gap: float = 0.01, key: str = "sample_id") -> DataFrame:
    """Hot chunks merged when at most `gap` apart; the top regions by score, then length."""
    hot = evaluated_chunks(df, key).where(F.col("spoof_probability") >= threshold)
    order = [F.col("start_time").asc(), F.col("chunk_id").asc()]
    reach = running(hot, [key], order, {"_reach": ("max", F.col("end_time"))}, exclusive=True)
    fresh = F.when(F.col("start_time") <= F.col("_reach") + gap, 0).otherwise(1)
    islands = running(reach.withColumn("_new", fresh.cast("long")), [key], order,
                      {"_island": ("sum", F.col("_new"))})
    p = F.col("spoof_probability")
    regions = islands.groupBy(key, "_island").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.max(p).alias("max_spoof"), F.avg(p).alias("mean_spoof"), F.count(F.lit(1)).alias("chunk_count"))
    if top_k is None:
        return regions.drop("_island")
    return top_rows(regions, [key], [
        F.col("max_spoof").desc(), (F.col("end_time") - F.col("start_time")).desc(),
        F.col("start_time").asc()], top_k, "region_rank").drop("_island")


def suspicious_segments(df: DataFrame, regions: DataFrame, limit: int = 5,
                        key: str = "sample_id") -> DataFrame:
    """The labelled region first, then the strongest chunks, without repeated bounds.

    `regions`: key, region_start, region_end, evidence (score of the labelled region).
    """
    chunks = top_rows(df.where(F.col("spoof_probability").isNotNull()), [key],
                      [F.col("spoof_probability").desc(), F.col("chunk_id").asc()], 2 * limit, "_pos")
    p = F.col("spoof_probability")
    hot = chunks.where(p >= SUSPICIOUS).select(
        key, "_pos", "start_time", "end_time", F.lit("high_spoof_chunk").alias("segment_type"),
        p.alias("evidence_score"), F.when(p >= 0.85, "high").otherwise("medium").alias("review_priority"))
    labelled = regions.where(F.col("region_end") > F.col("region_start")).select(
        key, F.lit(0).alias("_pos"), F.col("region_start").alias("start_time"),
        F.col("region_end").alias("end_time"), F.lit("labeled_partial_region").alias("segment_type"),
        F.coalesce("evidence", F.lit(0.0)).alias("evidence_score"), F.lit("high").alias("review_priority"))
    # at most 2 * limit + 1 rows per sample from here on
    both = labelled.unionByName(hot)
    bounds = [key, F.round("start_time", 2), F.round("end_time", 2)]
    first = both.withColumn("_dup", F.row_number().over(
        Window.partitionBy(*bounds).orderBy("_pos"))).where("_dup = 1").drop("_dup")
    return top_rows(first, [key], [F.col("_pos").asc()], limit, "segment_rank").drop("_pos")


def merged_candidates(key: str, *sources: DataFrame) -> DataFrame:
    """Candidate lists (key, rank, start_sec, end_sec, probability) without repeated bounds.

    Earlier sources win. Rows are not sorted: the rank is a column, null or 0 for unranked ones.
    """
    tagged = [s.select(key, "rank", "start_sec", "end_sec", "probability", F.lit(i).alias("_src"))
              for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    w = Window.partitionBy(key, "start_sec", "end_sec").orderBy("_src", F.col("rank").asc_nulls_last())
    kept = union.where(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()).withColumn(
        "_dup", F.row_number().over(w)).where("_dup = 1")
    return kept.select(key, "rank", "start_sec", "end_sec", "probability")


def text_of(seconds: Column) -> Column:
    """Seconds as text the way a float prints (4.0, 2.5)."""
    return seconds.cast("double").cast("string")

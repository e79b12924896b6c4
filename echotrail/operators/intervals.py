"""Interval overlap between segments and annotated regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.operators.skew import join_ids, neighbours

#: How much wider the cells of a level are than those below, and the level whose single cell holds all times.
STEP, TOP = 16, 13


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Open overlap test; unknown bounds do not overlap."""
    return F.coalesce((a0 < b1) & (a1 > b0), F.lit(False))


def overlap_label(s: Column, e: Column, fs: Column, fe: Column, min_ratio: float) -> dict[str, Column]:
    """Overlap seconds, ratio to the segment, and inside/boundary/outside."""
    sec = overlap_seconds(s, e, fs, fe)
    share = sec / F.greatest(F.lit(1e-9), e - s)
    return {
        "overlap_sec": F.round(sec, 4), "overlap_ratio": F.round(share, 4),
        "region_label": F.when(share >= min_ratio, "inside_fabricated_region")
        .when(sec > 0, "boundary_overlap").otherwise("outside_fabricated_region"),
    }


def distance_to_region(s: Column, e: Column, fs: Column, fe: Column) -> Column:
    """Seconds from the segment's middle to the region, 0 inside."""
    mid = (s + e) / 2.0
    return F.round(F.when((mid >= fs) & (mid <= fe), 0.0).when(mid < fs, fs - mid)
                   .otherwise(mid - fe), 4)


def level_of(length: Column, cell_sec: float) -> Column:
    """The finest level at which an interval of this length lies in at most STEP + 1 cells."""
    out = F.when(length <= cell_sec * STEP, 0)
    for level in range(1, TOP):
        out = out.when(length <= cell_sec * STEP ** (level + 1), level)
    return out.otherwise(TOP)


def cell_at(time: Column, level: Column, cell_sec: float) -> Column:
    """Number of the cell that holds a time; the top level is one cell."""
    width = F.element_at(F.lit([cell_sec * float(STEP) ** k for k in range(TOP)]), F.least(level, F.lit(TOP - 1)) + 1)
    return F.when(level >= TOP, F.lit(0).cast("long")).otherwise(F.floor(time / width))


def overlap_pairs(seg: DataFrame, ann: DataFrame, key: str, cell_sec: float = 60.0) -> DataFrame:
    """Overlapping (segment, annotation) pairs within a recording.

    Both sides are spread over time cells and joined on (recording, level, cell), so a very long recording with many
    annotations is compared cell by cell instead of all against all. Cells of a level are STEP times as wide as those of the
    level below; an interval fills its own level's cells, STEP + 1 at most, and two at most of each coarser level that
    an interval of its recording needs. So the cells grow with the logarithm of a length, and a wrong end time costs one
    recording a few rows. A pair meets at the coarser of its two levels and is kept only in the cell where its overlap
    begins. Intervals without positive length, or with an unknown or NaN bound, meet nothing; endless ones are allowed.
    Columns: seg (key, start_sec, end_sec, ...), ann (key, ann_start, ann_end, ...).
    """
    def fine(df: DataFrame, start: str, end: str) -> DataFrame:
        known = df.where((F.col(end) > F.col(start)) & ~F.isnan(end) & ~F.isnan(start))
        return known.withColumn("_own", level_of(F.col(end) - F.col(start), cell_sec))

    left, right = fine(seg, "start_sec", "end_sec"), fine(ann, "ann_start", "ann_end")
    coarse = left.select(key, "_own").unionByName(right.select(key, "_own")).where("_own > 0").distinct().withColumnRenamed("_own", "_level")

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        level = F.col("_level")
        above = join_ids(df, coarse, [key]).where(level > F.col("_own")).select(*df.columns, "_level")
        every = df.withColumn("_level", F.col("_own")).unionByName(above)
        cells = F.sequence(cell_at(F.col(start), level, cell_sec), cell_at(F.col(end), level, cell_sec))
        return every.withColumn("_cell", F.explode(cells)).withColumn("_home", F.col("_own") == level).drop("_own")

    sides = spread(left, "start_sec", "end_sec"), spread(right, "ann_start", "ann_end").withColumnRenamed("_home", "_home_too")
    pairs = join_ids(*sides, [key, "_level", "_cell"]).where("_home OR _home_too")
    begin = F.greatest("start_sec", "ann_start")
    sec = F.least("end_sec", "ann_end") - begin
    return pairs.where((sec > 0) & (F.col("_cell") == cell_at(begin, F.col("_level"), cell_sec))).drop(
        "_cell", "_level", "_home", "_home_too").withColumn("overlap_sec", sec)


def label_segments(seg: DataFrame, ann: DataFrame, key: str, ident: str,
                   min_ratio: float) -> DataFrame:
    """Max and total overlap per segment with its recording's matched annotations, and a label.

    Segments of recordings without annotations stay unlabelled.
    """
    pairs = overlap_pairs(seg.select(key, ident, "start_sec", "end_sec"),
                          ann.select(key, "ann_start", "ann_end"), key)
    sums = pairs.groupBy(key, ident).agg(
        F.max("overlap_sec").alias("max_overlap_sec"), F.sum("overlap_sec").alias("total_overlap_sec"))
    annotated = ann.select(key).distinct().withColumn("_known", F.lit(True))
    j = join_ids(join_ids(seg, sums, [key, ident], "left"), annotated, [key], "left")
    usable = F.col("_known").isNotNull() & (F.col("end_sec") > F.col("start_sec"))
    share = F.col("max_overlap_sec") / (F.col("end_sec") - F.col("start_sec"))
    inside = usable & F.coalesce(share >= min_ratio, F.lit(False))
    return j.select(
        *seg.columns, "max_overlap_sec", share.alias("max_overlap_ratio"), "total_overlap_sec",
        inside.alias("overlaps_region"),
        F.when(~usable, "unknown_no_timestamp").when(inside, "fabricated_region")
        .otherwise("outside_fabricated_region").alias("segment_label"),
        usable.alias("training_label_available"))


def boundary_rows(seg: DataFrame, key: str, ident: str, prob: str) -> DataFrame:
    """The segment nearest to each region boundary, with score steps to its rank neighbours.

    `seg` carries region_start and region_end.  Distance ties go to the earlier segment.
    """
    scored = seg.where(F.col(prob).isNotNull())
    ranked = neighbours(scored, [key], [F.col(prob).desc(), F.col("start_sec").asc(), F.col(ident).asc()],
                        prob, 1, "_higher", "_lower")
    mid = (F.col("start_sec") + F.col("end_sec")) / 2.0
    marks = F.array(*[F.struct(F.lit(n).alias("boundary_type"), F.col(c).alias("t")) for n, c in (
        ("start_boundary", "region_start"), ("end_boundary", "region_end"))])
    near = ranked.where(F.col("region_end").isNotNull() & F.col("region_start").isNotNull()).select(
        key, F.explode(marks).alias("m"), F.struct(
            mid.alias("mid"), F.col("start_sec"), F.col(ident).alias("id"), F.col("end_sec"),
            F.col(prob).alias("p"), F.col("_lower").alias("lower"), F.col("_higher").alias("higher")).alias("s"))
    best = near.groupBy(key, F.col("m.boundary_type").alias("boundary_type")).agg(
        F.min(F.struct(F.abs(F.col("s.mid") - F.col("m.t")).alias("d"), F.col("s.start_sec").alias("st"),
                       F.col("s.id").alias("id"), F.col("s.end_sec").alias("en"), F.col("s.p").alias("p"),
                       F.col("s.lower").alias("lower"), F.col("s.higher").alias("higher"))).alias("b"))
    before, after = F.col("b.p") - F.col("b.lower"), F.col("b.p") - F.col("b.higher")
    return best.select(
        key, "boundary_type", F.col("b.id").alias("nearest_segment_id"), F.col("b.st").alias("nearest_start_sec"),
        F.col("b.en").alias("nearest_end_sec"), F.col("b.p").alias("nearest_probability"),
        before.alias("delta_before"), after.alias("delta_after"),
        F.round(F.coalesce(F.greatest(before, after), F.col("b.p")), 4).alias("boundary_signal_strength"))

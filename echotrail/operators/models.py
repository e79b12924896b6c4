"""Feature screening and centroid distances; `newton` fits the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.operators.skew import group_medians, join_keys


def anova_f(long: DataFrame, label: str) -> DataFrame:
    """One-way ANOVA F per feature from counts, means and variances of each class."""
    g = long.where(F.col("x").isNotNull()).groupBy("feature", label).agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    s = g.groupBy("feature").agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("n") * F.col("m")).alias("_s"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("_within"))
    between = join_keys(g, s, ["feature"]).groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_s") / F.col("_n"), 2)).alias("_between"),
        F.max("_n").alias("_n"), F.max("_k").alias("_k"), F.max("_within").alias("_within"))
    inner = F.col("_within") / (F.col("_n") - F.col("_k"))
    return between.select("feature", F.when((F.col("_k") > 1) & (inner > 0), F.col("_between") / (F.col("_k") - 1) / inner).alias("f_value"))


def centroid_distances(df: DataFrame, ident: str, group: str, features: Sequence[str]) -> DataFrame:
    """Root mean squared standardised distance to each group's mean vector, and the nearest group.

    Standardising uses the median and sample std of all rows; missing values take the median.
    The group means travel as one literal per group, so rows are not multiplied by a join.
    """
    scoped = df.withColumn("_one", F.lit(1))
    med = group_medians(scoped, ["_one"], features, "m_").first()
    std = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    z = df.select(ident, group, *[
        ((F.coalesce(F.col(f), F.lit(med[f"m_{f}"])) - med[f"m_{f}"]) / (std[f] or 1.0)).alias(f) for f in features])
    means = z.groupBy(group).agg(*[F.avg(f).alias(f) for f in features]).orderBy(group).limit(1001).collect()
    if len(means) > 1000:
        raise ValueError("centroid distances expect at most 1000 groups")
    cells = [F.struct(F.sqrt(sum(((F.col(f) - r[f]) * (F.col(f) - r[f]) for f in features[1:]),
                                 (F.col(features[0]) - r[features[0]]) * (F.col(features[0]) - r[features[0]])) / len(features)).alias("distance"),
                      F.lit(r[group]).alias("centroid")) for r in means]
    near = F.array_min(F.array(*cells))
    return z.select(ident, group, near["centroid"].alias("nearest_group"), near["distance"].alias("nearest_distance"))


def group_gaps(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Standardised mean of every feature per group (long form)."""
    scoped = df.withColumn("_one", F.lit(1))
    med = group_medians(scoped, ["_one"], features, "m_").first()
    std = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    wide = df.groupBy(group).agg(*[
        F.avg((F.coalesce(F.col(f), F.lit(med[f"m_{f}"])) - med[f"m_{f}"]) / (std[f] or 1.0)).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_z")) for f in features])
    return wide.select(group, F.explode(rows).alias("r")).select(group, "r.*")

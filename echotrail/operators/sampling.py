"""Seeded samples and splits that do not depend on row order or partitioning.

Every draw orders rows by a hash of (row key, seed), so the same seed gives the same
rows on any cluster.  Fixed-size draws keep k rows per group with a top-k filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.operators.profile import mode_per_group
from echotrail.operators.skew import join_ids, numbered, top_rows


def draw_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def speaker_split(df: DataFrame, speaker: str, strata: Sequence[str], seed: int,
                  train: float = 0.8, val: float = 0.1) -> DataFrame:
    """One split per speaker: floor(n * ratio) per stratum to train and val, the rest to test.

    A speaker's stratum is its most frequent value of each stratum column.
    """
    group = None
    for s in strata:
        m = mode_per_group(df, [speaker], s, s)
        group = m if group is None else join_ids(group, m, [speaker])
    keyed = group.withColumn("stratum", F.concat_ws("_", *strata)).drop(*strata).withColumn(
        "_k", draw_key(F.col(speaker), seed))
    pos = numbered(keyed, ["stratum"], [F.col("_k").asc(), F.col(speaker).asc()], "_pos")
    n = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    j = join_ids(pos, n, ["stratum"])
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= a + b, "val").otherwise("test")
    return j.select(speaker, "stratum", split.alias("split"))


def verify_splits(df: DataFrame, speaker: str, split: str, label: str, source: Column) -> DataFrame:
    """Per split: rows, speakers, speakers also in another split, both classes, both sources, ratio."""
    per = df.groupBy(split, speaker).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == "bonafide").alias("_real"),
        F.count_if(F.col(label) == "spoof").alias("_fake"),
        F.max(source).alias("_rw"), F.max(~source).alias("_bench"))
    spread = per.groupBy(speaker).agg(F.count(F.lit(1)).alias("_splits"))
    return join_ids(per, spread, [speaker]).groupBy(split).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("speakers"),
        F.count_if(F.col("_splits") > 1).alias("shared_speakers"),
        ((F.sum("_real") > 0) & (F.sum("_fake") > 0)).alias("both_classes"),
        (F.max("_rw") & F.max("_bench")).alias("both_sources"),
        (F.sum("_real") / F.sum("_n")).alias("real_ratio"))


def sample_per_group(df: DataFrame, groups: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per group (all of a smaller group)."""
    keyed = df.withColumn("_k", draw_key(F.col(key), seed))
    return top_rows(keyed, groups, [F.col("_k").asc(), F.col(key).asc()], n, "_r").drop("_k", "_r")


def shortfalls(df: DataFrame, groups: Sequence[str], n: int) -> DataFrame:
    """Groups with fewer than n rows."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("available")).where(
        F.col("available") < n).withColumn("requested", F.lit(n))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, size: int, seed: int) -> DataFrame:
    """max(5, size / 40) rows per stratum, filled up to `size` from the rest in hash order."""
    cap = max(5, size // 40)
    keyed = df.withColumn("_k", draw_key(F.col(key), seed))
    order = [F.col("_k").asc(), F.col(key).asc()]
    base = top_rows(keyed, strata, order, cap, "_r").drop("_r").withColumn("_from", F.lit(0))
    # the first `size` rows not in the base are among the first size + |base| overall
    rest = keyed.join(base.select(key), key, "left_anti").withColumn("_from", F.lit(1))
    fill = rest.orderBy(*order).limit(size)
    return (base.unionByName(fill.select(base.columns)).orderBy("_from", *order).limit(size)
            .withColumn("from_stratum", F.col("_from") == 0).drop("_k", "_from"))


def downsample_negatives(df: DataFrame, target: str, kind: str, key: str, cap: int, seed: int,
                         strategy: str = "cap_per_category") -> DataFrame:
    """All positives; negatives whole, capped per kind, or capped at the number of positives."""
    pos, neg = df.where(F.col(target) == 1), df.where(F.col(target) == 0)
    if strategy == "all":
        return pos.unionByName(neg)
    if strategy == "balanced_by_positive":
        cap = min(cap, max(1, pos.count()))
    elif strategy != "cap_per_category":
        raise ValueError(f"unknown strategy {strategy}")
    return pos.unionByName(sample_per_group(neg, [kind], key, cap, seed))


def group_folds(df: DataFrame, group: str, target: str, folds: int, seed: int) -> DataFrame:
    """A fold per group: groups are dealt in hash order within their class mix, each mix from another fold on.

    No group is in two folds; the class balance of the folds is approximate.
    """
    return folds_by_mix(df.groupBy(group).agg(F.avg(F.col(target).cast("double")).alias("_m")), group, folds, seed)


def folds_by_mix(mix: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """`group_folds` from one row (group, _m) for each group, _m being the mean of its target."""
    level = F.when(F.col("_m") == 0, 0).when(F.col("_m") < 0.5, 1).when(F.col("_m") < 1, 2).otherwise(3)
    keyed = mix.select(group, level.alias("class_mix"), draw_key(F.col(group), seed).alias("_k"))
    pos = numbered(keyed, ["class_mix"], [F.col("_k").asc(), F.col(group).asc()], "_pos")
    return pos.select(group, "class_mix", ((F.col("_pos") - 1 + F.col("class_mix")) % folds).cast("int").alias("fold"))


def folds_to_use(df: DataFrame, target: str, wanted: int, least: int = 3) -> int:
    """Folds limited by the smallest class; raises when there are too few rows."""
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.min("n").alias("least")).first()
    if (sizes["rows"] or 0) < 6 or sizes["least"] < least:
        raise ValueError(f"too few rows per class for {least} folds: {sizes['rows']} rows, {sizes['least'] or 0} in the smallest class")
    return min(wanted, sizes["least"])


def spread_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups found in more than one fold or split."""
    return df.select(group, fold).distinct().groupBy(group).agg(
        F.count(F.lit(1)).alias("folds")).where("folds > 1")

"""Counting, auditing and describing tables: value counts, balance, duplicates, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.operators.ranges import bracket_stats
from echotrail.operators.skew import join_keys


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
            name: str = "dimension", value: str = "value", as_type: str = "string") -> DataFrame:
    """Long form: one row per (row, column)."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(as_type).alias(value))
                      for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(
        *keep, f"_c.{name}", f"_c.{value}")


def blank_to_missing(c: Column) -> Column:
    """Trimmed text, with null and blank shown as <missing>."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "<missing>").otherwise(t)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and percent of rows for every value of every column, in one pass."""
    shown = df.select(*[blank_to_missing(F.col(c)).alias(c) for c in columns])
    counts = unpivot(shown, columns).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("dimension").agg(F.sum("count").alias("_t"))
    return join_keys(counts, totals, ["dimension"]).select(
        "dimension", "value", "count", F.round(100.0 * F.col("count") / F.col("_t"), 4).alias("pct"))


def mode_per_group(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Most frequent value per group, ties to the smallest value.

    Counting (group, value) pairs first keeps memory flat for groups with many values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min(F.struct(-F.col("_n"), F.col(column).alias("v"))).getField("v").alias(name))


def file_balance(df: DataFrame, file_key: str, dimensions: Sequence[str]) -> DataFrame:
    """Rows against distinct files per dimension value, with percents and rows per file."""
    keyed = df.where(F.trim(F.coalesce(F.col(file_key), F.lit(""))) != "").select(
        F.trim(file_key).alias("_file"),
        *[blank_to_missing(F.col(c)).alias(c) for c in dimensions])
    long = unpivot(keyed, dimensions, ["_file"])
    # one row per (dimension, value, file) first, so no task holds a value's whole file set
    per_file = long.groupBy("dimension", "value", "_file").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_file.groupBy("dimension", "value").agg(
        F.sum("_n").alias("row_count"), F.count(F.lit(1)).alias("unique_file_count"))
    files = keyed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_files"))
    totals = files.select(F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"), "_rows", "_files")
    rows, uniq = F.col("row_count"), F.col("unique_file_count")
    return (join_keys(counts, totals, ["dimension"])
            .select("dimension", "value", "row_count", "unique_file_count",
                    F.round(100.0 * rows / F.col("_rows"), 4).alias("row_pct"),
                    F.round(100.0 * uniq / F.col("_files"), 4).alias("file_pct"),
                    F.round(rows / F.greatest(uniq, F.lit(1)), 4).alias("avg_rows_per_file")))


def weighting_bias(balance: DataFrame) -> DataFrame:
    """Risk that values with many rows per file dominate their dimension."""
    stats = balance.groupBy("dimension").agg(
        F.min("avg_rows_per_file").alias("_min"), F.max("avg_rows_per_file").alias("_max"),
        F.avg("avg_rows_per_file").alias("_mean"))
    spread = F.col("_max") / F.greatest(F.col("_min"), F.lit(1e-9))
    level = F.when(spread > 3.0, "high").when(spread > 1.75, "medium").otherwise("low")
    rpf = F.col("avg_rows_per_file")
    risk = (F.when(F.col("unique_file_count") == 0, "n/a")
            .when((rpf >= F.col("_mean") * 2.5) & (spread > 2.0), "high")
            .when((rpf >= F.col("_mean") * 1.75) & (spread > 1.5), "medium")
            .otherwise(level))
    return join_keys(balance, stats, ["dimension"]).withColumn(
        "weighting_bias_risk", risk).drop("_min", "_max", "_mean")


def duplicate_report(df: DataFrame, path: str, label: str, attack: str, limit: int | None = None) -> DataFrame:
    """Paths on more than one row, most frequent first, classed by label or attack conflict.

    `limit` shortens the report if a caller asks for it.  Label sets are collected after
    duplicates of (path, label) are merged.
    """
    shown = df.where(F.trim(F.coalesce(F.col(path), F.lit(""))) != "").select(
        F.trim(path).alias("filepath"), blank_to_missing(F.col(label)).alias("_label"),
        blank_to_missing(F.col(attack)).alias("_attack"))
    combos = shown.groupBy("filepath", "_label", "_attack").agg(F.count(F.lit(1)).alias("_n"))
    totals = combos.groupBy("filepath").agg(F.sum("_n").alias("count")).where("count > 1")
    top = totals if limit is None else totals.orderBy(F.col("count").desc(), "filepath").limit(limit)
    sets = join_keys(combos.drop("_n"), top, ["filepath"]).groupBy("filepath").agg(
        F.max("count").alias("count"),
        F.sort_array(F.collect_set("_label")).alias("_labels"),
        F.sort_array(F.collect_set("_attack")).alias("_attacks"))
    issue = (F.when(F.size("_labels") > 1, "duplicate_filepath_multi_label")
             .when(F.size("_attacks") > 1, "duplicate_filepath_multi_attack")
             .otherwise("duplicate_filepath"))
    return sets.select(issue.alias("issue"), "filepath", "count",
                       F.array_join("_labels", "|").alias("labels"),
                       F.array_join("_attacks", "|").alias("attack_types"))


def issue_rows(df: DataFrame, rules: dict[str, Column], keep: Sequence[str],
               name: str = "issue") -> DataFrame:
    """One row per violated rule, all rules checked in a single pass over the table."""
    hits = F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]),
                    lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias(name))


# Features ------------------------------------------------------------------------------


def feature_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows; NaN and infinities become null."""
    long = unpivot(df, features, keep, "feature", "x", "double")
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return long.withColumn("x", F.when(~bad, F.col("x")))


def feature_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, missing percent, mean, sample std, min, median, max per (keys, feature)."""
    by = [*keys, "feature"]
    base = bracket_stats(long, by, [
        F.count("x").alias("count"), F.count(F.lit(1)).alias("row_count"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max")], {"median": ("x", 0.5)})
    miss = 100.0 * (1 - F.col("count") / F.greatest(F.col("row_count"), F.lit(1)))
    return base.withColumn("missing_percent", F.round(miss, 4))


def missingness(long: DataFrame, limited_pct: float = 50.0) -> DataFrame:
    """Missing percent and variance per feature, with a usability class."""
    base = long.groupBy("feature").agg(
        F.count("x").alias("non_null_count"), F.count(F.lit(1)).alias("row_count"),
        F.var_samp("x").alias("variance"))
    miss = 100.0 * (1 - F.col("non_null_count") / F.col("row_count"))
    usable = (F.when(miss >= 100.0, "exclude_for_now").when(miss > limited_pct, "limited")
              .when(F.col("variance") == 0.0, "exclude_for_now").otherwise("usable"))
    return base.select("feature", F.round(miss, 4).alias("missing_percent"), "non_null_count",
                       "row_count", "variance", usable.alias("usability"))


def compare_groups(df: DataFrame, features: Sequence[str],
                   comparisons: Sequence[tuple[str, Column, Column]],
                   min_group: int = 5) -> DataFrame:
    """Two-group effect sizes per (comparison, feature): |mean difference| / pooled std."""
    sides = F.array(*[F.struct(F.lit(n).alias("comparison_name"), F.lit(s).alias("_side"), m.alias("_in"))
                      for n, a, b in comparisons for s, m in (("a", a), ("b", b))])
    # tag each row with the (comparison, side) pairs it belongs to, then go long by feature
    tagged = df.select(*features, F.explode(F.filter(sides, lambda s: s["_in"])).alias("_s")).select(
        *features, "_s.comparison_name", "_s._side")
    return group_effects(feature_long(tagged, features, ["comparison_name", "_side"]),
                         ["comparison_name"], min_group)


def group_effects(long: DataFrame, keys: Sequence[str], min_group: int = 5) -> DataFrame:
    """Effect sizes from long rows with `_side` in (a, b)."""
    by = [*keys, "feature", "_side"]
    stats = bracket_stats(long, by, [
        F.count(F.lit(1)).alias("n"), F.count("x").alias("k"), F.avg("x").alias("m"),
        F.var_samp("x").alias("v")], {"md": ("x", 0.5)})
    pick = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    wide = stats.groupBy(*keys, "feature").agg(*[
        pick(s, c).alias(f"{c}_{s}") for s in "ab" for c in ("n", "k", "m", "v", "md")])
    zero = F.lit(0)
    na, nb = (F.coalesce(f"n_{s}", zero) for s in "ab")
    ka, kb = (F.coalesce(f"k_{s}", zero) for s in "ab")
    ma, mb = F.col("m_a"), F.col("m_b")
    va, vb = (F.when(F.col(f"k_{s}") > 1, F.col(f"v_{s}")).otherwise(0.0) for s in "ab")
    pooled = F.sqrt((va + vb) / 2.0)
    enough = (na >= min_group) & (nb >= min_group) & ma.isNotNull() & mb.isNotNull()
    effect = F.when(enough & (pooled > 0), F.abs(ma - mb) / pooled)
    direction = (F.when(~enough, "insufficient_data")
                 .when((pooled > 0) & (ma > mb), "higher_in_group_a")
                 .when((pooled > 0) & (mb > ma), "higher_in_group_b").otherwise("no_clear_direction"))
    return wide.select(
        *keys, "feature", na.alias("group_a_count"), nb.alias("group_b_count"),
        ma.alias("group_a_mean"), mb.alias("group_b_mean"),
        F.col("md_a").alias("group_a_median"), F.col("md_b").alias("group_b_median"),
        F.abs(ma - mb).alias("abs_mean_difference"), effect.alias("effect_size"),
        F.round(100.0 * (1 - (ka + kb) / F.greatest(na + nb, F.lit(1))), 4).alias("missing_percent"),
        F.coalesce(direction, F.lit("insufficient_data")).alias("direction"))


def correlations(df: DataFrame, features: Sequence[str], max_features: int) -> DataFrame:
    """Pairwise-complete Pearson correlation of the top-variance features, by |r|.

    All pair sums come from one aggregation over the wide rows.
    """
    clean = df.select(*[F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c)
                        for c in features])
    if len(features) > max_features:
        var = clean.agg(*[F.var_samp(c).alias(c) for c in features]).first().asDict()
        features = sorted(features, key=lambda c: (-(var[c] or 0.0), c))[:max_features]
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    wide = clean.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                              F.col(f"p{i}").alias("correlation"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "abs_correlation", F.abs("correlation"))


def row_norms(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """L2 norm, mean and max absolute value (NaN as 0) and a finite flag per vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    zero = F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return df.select(
        ident, F.sqrt(total(F.transform(zero, lambda x: x * x))).alias("l2_norm"),
        (total(F.transform(zero, lambda x: F.abs(x))) / F.size(zero)).alias("mean_abs_value"),
        F.array_max(F.transform(zero, lambda x: F.abs(x))).alias("max_abs_value"),
        (~F.exists(v, lambda x: F.abs(x) == float("inf"))).alias("finite_row"))


def vector_long(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """(keep, feature = dimension name, x) rows of a vector column."""
    return df.select(*keep, F.posexplode(vector).alias("_d", "_x")).select(
        *keep, F.concat(F.lit("emb_"), F.lpad(F.col("_d").cast("string"), 3, "0")).alias("feature"),
        F.when(~F.isnan("_x"), F.col("_x").cast("double")).alias("x"))


# Weights and balances ------------------------------------------------------------------


def class_weights(df: DataFrame, label: Column, n_classes: int) -> DataFrame:
    """Inverse-frequency weights over classes 0..n-1, missing classes as 1, summing to n."""
    counts = df.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    filled = join_keys(classes, counts, ["class"], "left").select(
        "class", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("class_count"))
    # n_classes rows become one short array; totals and weights are taken inside it
    packed = filled.agg(F.sort_array(F.collect_list(F.struct("class", "class_count"))).alias("_c"))
    inverse = F.transform("_c", lambda s: F.lit(1.0) / s["class_count"])
    total = F.aggregate(inverse, F.lit(0.0), lambda a, x: a + x)
    return packed.withColumn("_t", total).select(F.explode("_c").alias("s"), "_t").select(
        "s.class", "s.class_count", (F.lit(1.0) / F.col("s.class_count") / F.col("_t") * n_classes).alias("weight"))

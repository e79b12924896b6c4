"""Joins with checks, key matching in levels, overlap audits and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrail.functions import text as T
from echotrail.operators.metrics import best_row
from echotrail.operators.skew import join_keys, numbered


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Inner join that must keep the left row count; duplicate columns come from the left.

    The check is one count of right keys that repeat and one of left rows without a partner.
    """
    repeated = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count()
    alone = left.select(*keys).join(right.select(*keys).distinct(), list(keys), "left_anti").limit(1).count()
    if repeated or alone:
        raise ValueError(f"join '{name}' would change the row count")
    extra = [c for c in right.columns if c in keys or c not in left.columns]
    return join_keys(left, right.select(*extra), keys)


def add_columns(left: DataFrame, right: DataFrame, keys: Sequence[str],
                columns: Sequence[str] | None = None) -> DataFrame:
    """Left join that brings only columns the left side lacks."""
    wanted = [c for c in (columns or right.columns) if c in right.columns and c not in left.columns]
    return join_keys(left, right.select(*keys, *[c for c in wanted if c not in keys]), keys, "left")


def prefixed(df: DataFrame, name: str, key: str = "sample_id") -> DataFrame:
    """Every column but the key gets the model's name as suffix."""
    return df.select(key, *[F.col(x).alias(f"{x}_{name}") for x in df.columns if x != key])


def coalesce_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Blank values of a column are filled from its twin with the suffix, which is dropped."""
    twins = {x: x[: -len(suffix) - 1] for x in df.columns if x.endswith(f"_{suffix}")}
    out = []
    for x in df.columns:
        if x in twins:
            if twins[x] not in df.columns:
                out.append(F.col(x).alias(twins[x]))
        elif f"{x}_{suffix}" in twins:
            out.append(F.coalesce(T.not_blank(F.col(x)), F.col(f"{x}_{suffix}")).alias(x))
        else:
            out.append(F.col(x))
    return df.select(*out)


def lookup_first(left: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to a dimension reduced to its first row per key in the given order."""
    return join_keys(left, best_row(dim, keys, order), keys, "left")


# Matching annotations to recordings ----------------------------------------------------


def _key_rows(keys: list[tuple[int, Column]]) -> Column:
    rows = F.array(*[F.struct(F.lit(level).alias("level"), T.not_blank(k).alias("key")) for level, k in keys])
    return F.explode(F.filter(rows, lambda r: r["key"].isNotNull()))


def match_by_levels(ann: DataFrame, files: DataFrame, ident: str) -> DataFrame:
    """Match annotations by id, else full path, else base name, else normalised stem.

    The first level with a hit decides; several recordings on it are ambiguous.
    Recordings are reduced to one row per (level, key) before the join, so a name
    shared by many recordings never multiplies rows.
    `ann`: ident, file_id, audio_path, usable; `files`: file_id, audio_path.
    """
    path = F.col("audio_path")
    keys = lambda p: [(1, F.col("file_id")), (2, F.lower(p)), (3, F.lower(T.base_name(p))), (4, T.name_key(p))]
    index = (files.select("file_id", "audio_path", _key_rows(keys(path)).alias("k"))
             .groupBy("k.level", "k.key").agg(F.count(F.lit(1)).alias("hits"),
                                              F.max(F.struct("file_id", "audio_path")).alias("f")))
    wanted = ann.where("usable").select(ident, _key_rows(keys(path)).alias("k")).select(ident, "k.level", "k.key")
    hit = join_keys(wanted, index, ["level", "key"]).groupBy(ident).agg(
        F.min(F.struct("level", "hits", F.col("f.file_id").alias("file_id"),
                       F.col("f.audio_path").alias("audio_path"))).alias("m"))
    j = join_keys(ann.select(ident, "usable"), hit, [ident], "left")
    one = (F.col("m.level") == 1) | (F.col("m.hits") == 1)
    return j.select(
        ident, F.when(~F.col("usable"), "invalid").when(F.col("m").isNull(), "unmatched_file")
        .when(one, "matched").otherwise("ambiguous_match").alias("annotation_status"),
        F.when(one, F.col("m.file_id")).alias("matched_file_id"),
        F.when(one, F.col("m.audio_path")).alias("matched_audio_path"))


def match_by_any_key(ann: DataFrame, files: DataFrame, ident: str, name: str) -> DataFrame:
    """Match annotations whose path, base name or stem equals any key of a recording.

    Per key only the smallest and largest recording id is kept: a match is unique
    exactly when they agree over all keys of the annotation.
    """
    low = lambda c: F.lower(T.clean_path(c))
    p, i = F.col("audio_path"), F.col("file_id")
    index = (files.select("file_id", _key_rows([(0, low(p)), (0, F.lower(T.base_name(p))), (0, T.lower_stem(p)),
                                                (0, low(i)), (0, T.lower_stem(i))]).alias("k"))
             .groupBy(F.col("k.key").alias("key")).agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi")))
    n = F.col(name)
    wanted = ann.where("usable").select(ident, _key_rows([(0, low(n)), (0, F.lower(T.base_name(n))), (0, T.lower_stem(n))]).alias("k")).select(
        ident, "k.key").distinct()
    hit = join_keys(wanted, index, ["key"]).groupBy(ident).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    j = join_keys(ann.select(ident, "usable"), hit, [ident], "left")
    return j.select(ident, F.when(~F.col("usable"), "invalid_time_range").when(F.col("lo").isNull(), "unmatched")
                    .when(F.col("lo") == F.col("hi"), "matched").otherwise("ambiguous").alias("match_status"),
                    F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("matched_file_id"))


# Overlap audits ------------------------------------------------------------------------


def flag_members(df: DataFrame, column: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add a flag: is the column's value among the (single-column) keys."""
    k = keys.columns[0]
    known = keys.where(T.not_blank(F.col(k)).isNotNull()).select(F.col(k).alias("_m")).distinct().withColumn(name, F.lit(True))
    return (join_keys(df.withColumn("_m", column), known, ["_m"], "left").drop("_m")
            .withColumn(name, F.coalesce(name, F.lit(False))))


def flag_seen(df: DataFrame, path: str, seen: DataFrame, seen_path: str, name: str,
              ids: tuple[str, str] | None = None, stems: bool = True) -> DataFrame:
    """Flag rows whose path, base name, stem or id occurs in `seen`; one equi-join per key, then OR."""
    parts = [("path", lambda c: F.lower(T.clean_path(c))), ("base", lambda c: F.lower(T.base_name(c)))]
    if stems:
        parts.append(("stem", T.lower_stem))
    out = df
    flags = []
    for tag, fn in parts:
        out = flag_members(out, fn(F.col(path)), seen.select(fn(F.col(seen_path)).alias("k")), f"_{tag}")
        flags.append(f"_{tag}")
    if ids:
        out = flag_members(out, F.lower(F.col(ids[0])), seen.select(F.lower(F.col(ids[1])).alias("k")), "_id")
        flags.append("_id")
    hit = reduce(lambda a, b: a | b, [F.col(f) for f in flags])
    return out.withColumn(name, hit).drop(*flags)


def split_overlap(df: DataFrame, key: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Keys shared by each pair of splits, one row each, with the pair's count and severity; a clean pair has one row."""
    k = T.not_blank(F.col(key).cast("string"))
    per_key = df.where(k.isNotNull()).groupBy(k.alias("_key")).agg(
        *[F.max(F.col(split) == s).alias(f"_{s}") for s in splits])
    pairs = list(combinations(splits, 2))
    hits = per_key.select("_key", F.explode(F.filter(F.array(*[
        F.when(F.col(f"_{a}") & F.col(f"_{b}"), F.concat(F.lit(f"{a}|{b}"))) for a, b in pairs]),
        lambda x: x.isNotNull())).alias("pair"))
    counts = hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(f"{a}|{b}", a, b) for a, b in pairs], "pair string, split_a string, split_b string")
    out = join_keys(join_keys(names, counts, ["pair"], "left"), hits, ["pair"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("split_a", "split_b", n.alias("overlap_count"), F.when(n > 0, "high").otherwise("none").alias("severity"),
                      F.col("_key").alias("shared_key"))


def attach_by_path(df: DataFrame, path: str, lookup: DataFrame, lookup_path: str, value: str, order: str) -> DataFrame:
    """Attach a value by normalised path; of repeated paths the last in `order` counts."""
    norm = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    last = lookup.groupBy(norm(lookup_path).alias("_np")).agg(F.max_by(value, order).alias(value))
    return join_keys(df.withColumn("_np", norm(path)), last, ["_np"], "left").drop("_np").withColumn(
        value, F.coalesce(value, F.lit("")))


def natural_key(c: Column) -> Column:
    """Sort key that orders numbers inside names by value: digit runs padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d") & (F.length(p) < 20), F.lpad(p, 20, "0")).otherwise(p)), "")


def positional_join(left: DataFrame, right: DataFrame, scope: str, left_order: Sequence[Column],
                    right_order: Sequence[Column]) -> DataFrame:
    """Pair rows by position within a scope, only where both sides have as many rows."""
    ln, rn = (d.groupBy(scope).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "_ln"), (right, "_rn")))
    same = join_keys(ln, rn, [scope]).where("_ln = _rn").select(scope)
    a = join_keys(numbered(left, [scope], left_order, "position"), same, [scope])
    b = numbered(right, [scope], right_order, "position")
    return join_keys(a, b, [scope, "position"])


def missing_keys(left: DataFrame, right: DataFrame, key: str, name_left: str, name_right: str) -> DataFrame:
    """Distinct keys present on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit(name_left))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit(name_right))))


def missing_combinations(df: DataFrame, base: str, variant: str, required: Sequence[str]) -> DataFrame:
    """Required variants a base lacks, one row per base with any missing."""
    want = df.select(base).distinct().select(base, F.explode(F.array(*[F.lit(v) for v in required])).alias(variant))
    missing = want.join(df.select(base, variant).distinct(), [base, variant], "left_anti")
    return missing.groupBy(base).agg(F.array_join(F.sort_array(F.collect_list(variant)), ", ").alias("missing_variants"))

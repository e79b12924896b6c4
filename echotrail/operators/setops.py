"""Unions with schema alignment, source standardisation and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrail.functions.labels import lookup
from echotrail.operators.skew import join_keys

MANIFEST_COLUMNS = ["filepath", "label", "dataset", "attack_type", "domain", "speaker_id",
                    "source", "duration", "filename", "file_id"]


def union_aligned(*frames: DataFrame, columns: Sequence[str] = MANIFEST_COLUMNS) -> DataFrame:
    """Stack tables on the given columns; a column a table lacks is null there."""
    picked = [f.select(*[c for c in columns if c in f.columns]) for f in frames]
    out = picked[0]
    for f in picked[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[c for c in columns if c in out.columns])


# Accepted values of the two source manifests (fixed values); anything else becomes null
# (benchmark sets) or unknown (real-world domains).
BENCHMARK_SETS = ["LA", "DF", "PA"]
REALWORLD_DOMAINS = ["read_speech", "studio", "broadcast", "podcast", "social", "phone", "synthetic"]
REALWORLD_SOURCES = ["public_dataset", "youtube", "synthetic", "realworld"]


def standard_benchmark(df: DataFrame) -> DataFrame:
    keep = lambda c, vals: F.when(F.col(c).isin(vals), F.col(c)).alias(c)
    rest = [c for c in df.columns if c not in ("label", "dataset", "domain", "source")]
    return df.select(*rest, keep("label", ["bonafide", "spoof"]), keep("dataset", BENCHMARK_SETS),
                     F.lit("studio").alias("domain"), F.lit("clean").alias("source"))


def standard_realworld(df: DataFrame) -> DataFrame:
    domain = F.when(F.col("domain").isin(REALWORLD_DOMAINS), F.col("domain")).otherwise("unknown")
    rest = [c for c in df.columns if c not in ("label", "dataset", "domain", "source", "attack_type")]
    made = domain == "synthetic"
    return df.select(*rest, F.when(made, "spoof").otherwise("bonafide").alias("label"),
                     F.lit("RealWorld").alias("dataset"), domain.alias("domain"),
                     F.when(F.col("source").isin(REALWORLD_SOURCES), "realworld").alias("source"),
                     F.when(made, "synthesis").otherwise("bonafide").alias("attack_type"))


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return join_keys(df, many, keys)

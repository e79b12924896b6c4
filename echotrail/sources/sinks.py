"""Sinks: overwrite, append with resume, one folder per split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_rows(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of tables with different columns; the header is the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    write_csv(out, path)


def write_split(df: DataFrame, split: str, path: str) -> None:
    """One folder per split value."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file exists in the file system that its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new(df: DataFrame, key: str, path: str, order: Sequence[str] = ()) -> DataFrame:
    """Append only rows whose key the target lacks; returns the whole target.

    Of several new rows with one key the first by `order` stays (by all other columns if none is given). Running it
    again with the same rows changes nothing. A target without the key column is an error.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_row")) if others else df.distinct()
    fresh = first.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.select(*df.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path)

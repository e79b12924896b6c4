"""Pooling of frame vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled_vectors(frames: DataFrame, keys: Sequence[str], vector: str, with_std: bool = True) -> DataFrame:
    """Mean (and population std) pooling of frame vectors: one array per key, in dimension order.

    Frames are averaged per (key, dimension) before the short vector is put together.
    """
    long = frames.select(*keys, F.posexplode(vector).alias("_d", "_x"))
    dims = long.groupBy(*keys, "_d").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    packed = dims.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_d", "_m", "_s"))).alias("_v"))
    mean = F.transform("_v", lambda s: s["_m"])
    std = F.transform("_v", lambda s: s["_s"])
    return packed.select(*keys, (F.concat(mean, std) if with_std else mean).alias("pooled"))

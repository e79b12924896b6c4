"""Ordered per-group work that stays distributed when one group is huge.

A window sorts a whole group in one task. Every function here first measures the groups and splits the table once:
ordinary groups keep the plain window; rows of groups above the limit (a fixed number of rows, whatever the table's
size) are range-partitioned into ordered slices, the work runs per slice, and slice totals (a few rows per group) carry
the prefix across slices. The two results are united and hold the same rows as one window would. Results for hot rows
are checkpointed, so a chain of steps reads each of them once. Every function needs at least one key; a whole-table
scope uses a literal key column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.session import scratch_path

HOT_ROWS_KEY = "spark.echotrail.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
SLICE_ROWS_KEY = "spark.echotrail.sliceRows"  # default: a quarter of the hot limit
SLICE = "_slice"
TASK_ROWS = 250_000  # rows of ordinary groups that `spread` gives to one task
MEASURE = object()  # default of `hot`: measure the groups now
EVERY = object()  # value of `hot`: all rows belong to hot groups; None: none does


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def slice_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SLICE_ROWS_KEY, str(max(1, hot_limit(df) // 4))))


def settled(df: DataFrame) -> DataFrame:
    """Write rows that several branches read to the shared folder: their input is computed once and outlives executors."""
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys of the groups above the limit, or None if there are none; at most rows / limit keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = settled(counts.where(F.col("_n") > hot_limit(df)))
    return None if hot.isEmpty() else hot


def halves(df: DataFrame, keys: Sequence[str], hot=MEASURE) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary groups and rows of hot groups; None for a half that is known to be empty."""
    if hot is None:
        return df, None
    if hot is EVERY:
        return None, df
    found = hot_groups(df, keys)
    if found is None:
        return df, None
    tagged = found.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    return df.join(tagged, cond, "left_anti"), settled(df.join(tagged, cond, "left_semi"))


def by_halves(df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame, object], DataFrame], hot=MEASURE) -> DataFrame:
    """Union of work(ordinary rows, None) and work(hot rows, EVERY), the latter checkpointed."""
    cold, big = halves(df, keys, hot)
    if big is None:
        return work(cold, None)
    sliced_result = settled(work(big, EVERY))
    return sliced_result if cold is None else work(cold, None).unionByName(sliced_result)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by their keys, about TASK_ROWS to a task, whatever the table's size; few rows stay as they are.

    For chains of windows on ordinary groups: tasks grow in number, not in memory. Counts the rows, so they should be cheap to read.
    """
    parts = -(-df.count() // TASK_ROWS)
    return df if parts <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(parts, *keys)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of hot groups with `_slice`: ordered contiguous parts, checkpointed so that their numbers cannot change."""
    parts = max(2, -(-df.count() // slice_rows(df)))
    return settled(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(SLICE, F.spark_partition_id()))


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
            measures: dict[str, tuple[str, Column]], exclusive: bool = False,
            hot=MEASURE) -> DataFrame:
    """Running sum/max/min per group; `exclusive` leaves the current row out."""
    work = lambda part, size: (_running_slices if size is EVERY else _running_window)(part, keys, order, measures, exclusive)
    return by_halves(df, keys, work, hot)


def _running_window(df, keys, order, measures, exclusive) -> DataFrame:
    w = (Window.partitionBy(*keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow))
    return df.select("*", *[_COMBINE[how][0](c).over(w).alias(n) for n, (how, c) in measures.items()])


def _running_slices(df, keys, order, measures, exclusive) -> DataFrame:
    s = sliced(df, keys, order)
    cols = [*keys, SLICE]
    totals = s.groupBy(*cols).agg(*[_COMBINE[how][0](c).alias(f"_t_{n}") for n, (how, c) in measures.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*cols, *[_COMBINE[how][0](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (how, _) in measures.items()])
    local = _running_window(s, cols, order, {f"_l_{n}": m for n, m in measures.items()}, exclusive)
    combined = []
    for n, (how, _) in measures.items():
        loc, pre = F.col(f"_l_{n}"), F.col(f"_p_{n}")
        joined = _COMBINE[how][1](pre, F.coalesce(loc, F.lit(0)) if how == "sum" else loc)
        combined.append((F.when(loc.isNull() & pre.isNull(), None).otherwise(joined) if how == "sum" else joined).alias(n))
    return join_keys(local, prefix, cols, "left").select(*df.columns, *combined)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             name: str = "position", hot=MEASURE) -> DataFrame:
    """1-based row number per group."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, hot=hot)


def value_positions(df: DataFrame, keys: Sequence[str], value: str,
                    descending: bool = False) -> DataFrame:
    """One row per distinct non-null value: `n` rows hold it, `before` precede it, of `total`."""
    dist = settled(df.where(F.col(value).isNotNull())
                   .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    cum = running(dist, keys, order, {"_upto": ("sum", F.col("n"))})
    totals = dist.groupBy(*keys).agg(F.sum("n").alias("total"))
    return (join_keys(cum, totals, keys)
            .withColumn("before", F.col("_upto") - F.col("n")).drop("_upto"))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
               how: str = "inner") -> DataFrame:
    """Null-safe equi-join keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_ids(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on id columns that are never null.

    Plain equality keeps the hash partitioning of earlier aggregations and windows on
    the same ids, so no side is shuffled again; a null-safe join would lose it.
    """
    return left.join(right, list(keys), how)


def merge_rows(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Put aggregates with different columns side by side per key: one shuffle, no join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in out.columns if c not in keys])


def group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], value: str,
                probs: dict[str, float], hot=MEASURE) -> DataFrame:
    """Ordinary aggregates and exact quantiles of one column per group, in one shuffle when groups are small."""
    def work(part: DataFrame, size) -> DataFrame:
        if size is EVERY:
            return join_keys(part.groupBy(*keys).agg(*aggs), exact_quantiles(part, keys, value, probs, EVERY), keys)
        return part.groupBy(*keys).agg(*aggs, *[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()])

    return by_halves(df, keys, work, hot)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], hot=MEASURE) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name.

    Small groups use the `percentile` aggregate, which holds a group's distinct values in one task; for hot groups the
    order statistics are read off cumulative counts of distinct values instead.
    """
    def work(part: DataFrame, size) -> DataFrame:
        if size is EVERY:
            return _counted_quantiles(part, keys, value, probs)
        return part.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probs.items()])

    return by_halves(df, keys, work, hot)


def _counted_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    pos = value_positions(df, keys, value)
    upto = F.col("before") + F.col("n")
    aggs = []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        aggs += [
            F.min(F.when(upto > F.floor(at), F.col(value))).alias(f"_lo_{n}"),
            F.min(F.when(upto > F.ceil(at), F.col(value))).alias(f"_hi_{n}"),
            F.max(at - F.floor(at)).alias(f"_fr_{n}"),
        ]
    found = pos.groupBy(*keys).agg(*aggs)
    found = found.select(*keys, *[
        (F.col(f"_lo_{n}") * (F.lit(1.0) - F.col(f"_fr_{n}"))
         + F.col(f"_hi_{n}") * F.col(f"_fr_{n}")).alias(n) for n in probs])
    return join_keys(df.select(*keys).distinct(), found, keys, "left")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               column: str, k: int, prev_name: str, next_name: str, hot=MEASURE) -> DataFrame:
    """The value `k` rows before and after within the group (null past the ends)."""
    def work(part: DataFrame, size) -> DataFrame:
        if size is not EVERY:
            w = Window.partitionBy(*keys).orderBy(*order)
            return part.select("*", F.lag(column, k).over(w).alias(prev_name), F.lead(column, k).over(w).alias(next_name))
        pos = numbered(part, keys, order, "_pos", EVERY)
        value = pos.select(*keys, "_pos", F.col(column).alias("_v"))
        join = [*keys, "_pos"]
        before = value.withColumn("_pos", F.col("_pos") + k).withColumnRenamed("_v", prev_name)
        after = value.withColumn("_pos", F.col("_pos") - k).withColumnRenamed("_v", next_name)
        return join_keys(join_keys(pos, before, join, "left"), after, join, "left").drop("_pos")

    return by_halves(df, keys, work, hot)


def percent_rank_average(df: DataFrame, keys: Sequence[str], value: str, name: str,
                         hot=MEASURE) -> DataFrame:
    """Rank with ties averaged, divided by the non-null count; null stays null."""
    def work(part: DataFrame, size) -> DataFrame:
        if size is EVERY:
            pos = value_positions(part, keys, value).select(
                *keys, value, ((F.col("before") + 1 + (F.col("n") - 1) / F.lit(2.0)) / F.col("total")).alias(name))
            return join_keys(part, pos, [*keys, value], "left")
        # one sort serves all three: rank, rows up to and with the ties, and the non-null total
        w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        low = F.rank().over(w)
        upto = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return part.withColumn(name, F.when(F.col(value).isNotNull(), (low + (upto - low) / F.lit(2.0)) / total))

    return by_halves(df, keys, work, hot)


def min_rank_descending(df: DataFrame, keys: Sequence[str], value: str, name: str,
                        hot=MEASURE) -> DataFrame:
    """Competition rank, highest value first; null stays null."""
    def work(part: DataFrame, size) -> DataFrame:
        if size is EVERY:
            pos = value_positions(part, keys, value, descending=True).select(*keys, value, (F.col("before") + 1).alias(name))
            return join_keys(part, pos, [*keys, value], "left")
        w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(value).desc_nulls_last())
        return part.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w).cast("long")))

    return by_halves(df, keys, work, hot)


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str,
                  hot=MEASURE) -> DataFrame:
    """Exact medians of several columns per group, named prefix + column."""
    def work(part: DataFrame, size) -> DataFrame:
        if size is not EVERY:
            return part.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"{prefix}{c}") for c in columns])
        cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in columns])
        long = part.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.f", "_c.x")
        med = _counted_quantiles(long, [*keys, "f"], "x", {"m": 0.5})
        return med.groupBy(*keys).agg(*[F.max(F.when(F.col("f") == c, F.col("m"))).alias(f"{prefix}{c}") for c in columns])

    return by_halves(df, keys, work, hot)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
             name: str = "rank_in_group") -> DataFrame:
    """The first k rows per group with their 1-based rank.

    The `<= k` filter directly on row_number lets Spark cut each map task's
    output to k rows per group before the shuffle, so a hot group stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)

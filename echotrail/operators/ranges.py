"""Order-dependent work on few large groups: ranking metrics by score ranges, quantiles by brackets.

`skew` splits groups above a limit; the functions here need no split, because no step ever holds or sorts a whole group.

*Ranges.* One sketch of all values gives `KNOTS` splitters; between two of them the range is cut evenly into `FINE` slots.
Both cuts are monotone, so slots are in the order of the values, and a slot holds few values unless they tie. Equal
values of a group become one row with counts before anything is ordered. The totals of the slots, one row each, form the
prefix table; inside a slot a window adds up from its own offset.

*Brackets.* A sketch with rank error 1 / `ACCURACY` gives for every quantile two values that enclose it. A second pass counts
the rows outside the brackets in one row for each gap and keeps the distinct values inside with their counts, some 8 /
`ACCURACY` of a group for each quantile, which fix it exactly. Groups under `SMALL` rows keep all distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrail.operators.skew import join_keys, settled

KNOTS, FINE = 63, 512
ACCURACY, SMALL = 10_000, 10_000


def splitters(df: DataFrame, value: str) -> list[float]:
    """At most KNOTS + 2 rising values, from the least to the greatest, between which about equally many rows lie."""
    shares = [k / (KNOTS + 1) for k in range(1, KNOTS + 1)]
    x = F.col(value).cast("double")
    row = df.agg(F.percentile_approx(x, shares, 1_000).alias("q"), F.min(x).alias("a"), F.max(x).alias("b")).first()
    return sorted({row["a"], *row["q"], row["b"]}) if row["q"] else []


def slotted(df: DataFrame, value: str, knots: Sequence[float]) -> DataFrame:
    """Adds `_slot`, the number of the slot of a value, which never falls as values rise; null: -1."""
    if not knots:
        return df.withColumn("_slot", F.lit(-1))
    number = lambda k: f"{k!r}D" if math.isfinite(k) else f"double('{k}')"
    widths = [b - a for a, b in zip(knots[:-1], knots[1:], strict=True)] + [0.0]
    x, at = F.col(value).cast("double"), F.col("_at")
    inner = F.expr(" + ".join(["0", *[f"int(double(`{value}`) >= {number(k)})" for k in knots[1:]]]))
    start, width = (F.expr(f"element_at(array({', '.join(map(number, ks))}), _at + 1)") for ks in (knots, widths))
    # each step is a column of its own, so that it is worked out once
    placed = df.withColumn("_at", F.coalesce(inner, F.lit(0))).withColumn("_width", width).withColumn("_start", start)
    part = F.when((F.col("_width") > 0) & (F.col("_width") < float("inf")) & (x > F.col("_start")), (x - F.col("_start")) / F.col("_width") * FINE)
    fine = F.least(F.floor(F.coalesce(part, F.lit(0.0))), F.lit(FINE - 1))
    return placed.withColumn("_slot", F.when(x.isNull(), -1).otherwise(at * FINE + fine).cast("int")).drop("_at", "_width", "_start")


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, truth: str, more: Sequence[Column] = ()) -> DataFrame:
    """Per key: roc_auc, average_precision, eer and further aggregates; see `ranking_from_counts`."""
    y = F.col(truth)
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    rows = df.select(*keys, F.col(score), count(y == 1).alias("pos"), count(y == 0).alias("neg"))
    return ranking_from_counts(rows, keys, score, more)


def ranking_from_counts(df: DataFrame, keys: Sequence[str], score: str, more: Sequence[Column] = ()) -> DataFrame:
    """Per key, from rows with `pos` positives and `neg` negatives of one score: ROC AUC (ties count half), average precision
    (step sum) and equal error rate; null for one class.

    The EER is taken at the ROC point with the smallest |FNR - FPR|; points inside a straight run of the ROC are left out, as
    the usual library curve does, the curve starts at (0, 0), and ties keep the highest threshold. `more` are aggregates
    over the columns score, pos and neg. A null score is below all others.
    """
    x = F.col(score)
    counts = df.groupBy(*keys, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = slotted(counts, score, splitters(df, score))
    inside = Window.partitionBy(*keys, "_slot").orderBy(x.desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = counts.select("*", F.sum("pos").over(upto).alias("_lp"), F.sum("neg").over(upto).alias("_ln"),
                          F.lead("pos").over(inside).alias("_next_pos"), F.lead("neg").over(inside).alias("_next_neg"),
                          (F.row_number().over(inside) == 1).alias("_head"))
    totals = local.groupBy(*keys, "_slot").agg(
        F.sum("pos").alias("_sp"), F.sum("neg").alias("_sn"),
        F.max(F.when(F.col("_head"), F.col("pos"))).alias("_hp"), F.max(F.when(F.col("_head"), F.col("neg"))).alias("_hn"))
    down = Window.partitionBy(*keys).orderBy(F.col("_slot").desc())
    before, every = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    prefix = totals.select(
        *keys, "_slot", F.coalesce(F.sum("_sp").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_fp"),
        F.sum("_sp").over(every).alias("_p"), F.sum("_sn").over(every).alias("_q"),
        F.lead("_hp").over(down).alias("_after_pos"), F.lead("_hn").over(down).alias("_after_neg"), (F.row_number().over(down) == 1).alias("_top"))
    points = join_keys(local, prefix, [*keys, "_slot"])
    pos, neg = F.col("pos"), F.col("neg")
    p, q = (F.nullif(F.col(c), F.lit(0)) for c in ("_p", "_q"))
    tp, fp = F.col("_tp") + F.col("_lp"), F.col("_fp") + F.col("_ln")
    both = p.isNotNull() & q.isNotNull()
    straight = F.coalesce(~(F.col("_top") & F.col("_head")) & (F.coalesce("_next_pos", "_after_pos") == pos)
                          & (F.coalesce("_next_neg", "_after_neg") == neg), F.lit(False))
    gap = lambda fp, tp: (1 - tp / p) - fp / q
    # along the curve FNR - FPR only falls: the best point is the last one with a gap of 0 or more, or the one after it
    high, low = both & ~straight & (gap(fp, tp) >= 0), both & ~straight & (gap(fp, tp) < 0)
    found = points.groupBy(*keys).agg(
        F.sum(neg.cast("double") * (tp - pos + pos / 2)).alias("_area"), F.sum(F.when(both & (pos > 0), pos * (tp / F.nullif(tp + fp, F.lit(0))))).alias("_ap"),
        *[f(F.when(side, c)).alias(f"_{n}{k}") for k, f, side in ((0, F.max, high), (1, F.min, low)) for n, c in (("fp", fp), ("tp", tp))],
        F.max("_p").alias("_p"), F.max("_q").alias("_q"), *more)
    used = {*keys, "_area", "_ap", "_fp0", "_tp0", "_fp1", "_tp1", "_p", "_q"}
    zero = F.lit(0)
    ends = [(F.coalesce("_fp0", zero), F.coalesce("_tp0", zero)), (F.col("_fp1"), F.col("_tp1"))]
    gaps = [F.abs(gap(*e)) for e in ends]
    rates = [((1 - b / p) + a / q) / 2 for a, b in ends]
    eer = F.when(both, F.when(gaps[1] < gaps[0], rates[1]).otherwise(rates[0]))
    return found.select(
        *keys, F.when(both, F.col("_area") / (p.cast("double") * q)).alias("roc_auc"), F.when(both, F.col("_ap") / p).alias("average_precision"),
        eer.alias("eer"), *[c for c in found.columns if c not in used])


def bracket_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], probs: dict[str, tuple[str, float]]) -> DataFrame:
    """Aggregates and exact, linearly interpolated quantiles per key: `probs` names a column and a probability for each.

    Made for few groups of any size: two passes over the rows, no sort of a group.
    """
    values = list(dict.fromkeys(v for v, _ in probs.values()))
    margin = 4 / ACCURACY
    sides = {n: (max(0.0, p - margin), min(1.0, p + margin)) for n, (_, p) in probs.items()}
    of = {v: [n for n, (c, _) in probs.items() if c == v] for v in values}
    # written, so that its size is known: a shuffled side with few keys would send all rows of a group to one task
    stats = settled(df.groupBy(*keys).agg(*aggs, *[c for k, v in enumerate(values) for c in (
        F.count(v).alias(f"_n{k}"),
        F.percentile_approx(F.col(v).cast("double"), [s for n in of[v] for s in sides[n]], ACCURACY).alias(f"_q{k}"))]))
    marked = [c for c in stats.columns if c.startswith(("_n", "_q"))]
    rows = join_keys(df.select(*keys, *values), stats.select(*keys, *marked), keys)
    cells = []
    for k, v in enumerate(values):
        x, q = F.col(v).cast("double"), F.col(f"_q{k}")
        ends = [(q[2 * j], q[2 * j + 1]) for j in range(len(of[v]))]
        inside = F.col(f"_n{k}") < SMALL
        gap = F.lit(0)
        for low, high in ends:
            inside = inside | ((x >= low) & (x <= high))
            gap = gap + (x > high).cast("int")
        cells.append(F.struct(F.lit(k).alias("v"), x.alias("x"), inside.alias("inside"), gap.alias("gap")))
    cell = F.col("_c")
    kept = (rows.select(*keys, F.explode(F.array(*cells)).alias("_c")).where(cell["x"].isNotNull())
            .groupBy(*keys, cell["v"].alias("_v"), F.when(cell["inside"], -1).otherwise(cell["gap"]).alias("_gap"),
                     F.when(cell["inside"], cell["x"]).alias("_x")).agg(F.min(cell["x"]).alias("_at"), F.count("*").alias("_k")))
    upto = Window.partitionBy(*keys, "_v").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumn("_upto", F.sum("_k").over(upto))
    placed = join_keys(placed, stats.select(*keys, *[c for c in marked if c.startswith("_n")]), keys)
    place = {n: F.lit(float(p)) * (F.col(f"_n{values.index(v)}") - 1) for n, (v, p) in probs.items()}
    hit = lambda n, rank: F.min(F.when((F.col("_v") == values.index(probs[n][0])) & (F.col("_upto") > rank), F.struct("_at", "_x")))
    found = placed.groupBy(*keys).agg(*[c for n in probs for c in (
        hit(n, F.floor(place[n])).alias(f"_lo_{n}"), hit(n, F.ceil(place[n])).alias(f"_hi_{n}"))])
    joined = join_keys(stats, found, keys, "left")

    def value(n: str) -> Column:
        share = place[n] - F.floor(place[n])
        low, high = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        lost = (low.isNotNull() & low["_x"].isNull()) | (high.isNotNull() & high["_x"].isNull())
        exact = low["_x"] * (F.lit(1.0) - share) + high["_x"] * share
        return F.when(lost, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(exact)

    return joined.select(*keys, *[c for c in stats.columns if c not in {*keys, *marked}], *[value(n).alias(n) for n in probs])

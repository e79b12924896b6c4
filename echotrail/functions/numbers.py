"""Tolerant parsing of numbers, booleans and clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null for blank, unparsable, NaN or infinite text."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_flag(c: Column) -> Column:
    """'1' for 1/true/yes/y, '0' for 0/false/no/n, else null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y"), "1").when(t.isin("0", "false", "no", "n"), "0")


def to_boolean(c: Column) -> Column:
    """Three-valued boolean from true/1/yes/y/t and false/0/no/n/f."""
    t = F.lower(F.trim(c.cast("string")))
    return (F.when(t.isin("true", "1", "yes", "y", "t"), True)
            .when(t.isin("false", "0", "no", "n", "f"), False))


def clock_seconds(c: Column, milliseconds: bool = False) -> Column:
    """Seconds from plain numbers, mm:ss or hh:mm:ss; millisecond columns divide by 1000."""
    if milliseconds:
        return to_number(c) / 1000.0
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: F.trim(p).try_cast("double"))
    n = F.size(parts)
    complete = ~F.exists(parts, lambda p: p.isNull())
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60.0 + p)
    return F.when(n == 1, to_number(c)).when((n <= 3) & complete, total)


def row_mean(*cols: Column) -> Column:
    """Mean of the non-null values of a row; null when all are null."""
    count = sum(F.when(c.isNotNull(), 1).otherwise(0) for c in cols)
    total = sum(F.coalesce(c, F.lit(0.0)) for c in cols)
    return F.when(count > 0, total / count)

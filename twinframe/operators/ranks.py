"""Exact order statistics of a numeric column, by histograms that narrow a rank down."""

import math

from pyspark.sql import functions as F

#: Bins of a histogram, and distinct values that are looked at one by one.
BINS, FEW = 4096, 10_000


def around_rank(values, column, rank, ends):
    """(value of the rank from 0, value of the next rank, None after the last one) of finite numbers.

    `ends` has their least and greatest value and their number as low, high, n.
    Each pass counts the rows of every bin between two values and goes on with
    the bin that holds the rank, from its least to its greatest value. A bin of
    few rows, or of one value, ends it, so a second pass mostly does.
    """
    if not 0 <= rank < ends.n:
        raise ValueError(f"no rank {rank} in {ends.n} rows")
    x = F.col(column)
    low, high, n, before, above = ends.low, ends.high, ends.n, 0, None
    while low < high and n > FEW:
        inside = values.where(x.between(low, high))
        at = F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
                      .collect())  # BINS rows at most
        for b, after in zip(bins, [*bins[1:], None]):
            if rank < before + b.n:
                low, high, n, above = b.low, b.high, b.n, after.low if after else above
                break
            before += b.n
    held = [(low, n)]
    if low < high:
        held = sorted(values.where(x.between(low, high)).groupBy(x).count().collect())  # FEW rows at most
    for i, (value, count) in enumerate(held):
        before += count
        if rank < before:
            return value, value if rank + 1 < before else held[i + 1][0] if i + 1 < len(held) else above


def interpolated(values, column, share):
    """The value at rank (n - 1) * share of a column without nulls, between its neighbours if that is no whole number; None without rows.

    The column is read three times or more: give it as it is stored.
    """
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if not ends.n:
        return None
    place = (ends.n - 1) * share
    rank = math.floor(place)
    low, high = around_rank(values, column, rank, ends)
    return low if place == rank else low + (high - low) * (place - rank)

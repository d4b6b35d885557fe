"""Order statistics of a column without gathering or sorting it."""

from __future__ import annotations

from math import ceil, floor, isinf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def selected(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at the given ranks, from 0, of the double column ``value`` in ascending order; nulls and NaN do not count.

    Each round counts the values in bins of the ranges that still hold a rank; the counts
    alone tell in which bin a rank lies, and the next round splits it by its own smallest and
    largest value. A range of one value is an answer. So a pass moves some thousand counts,
    whatever the number of rows, and some few passes reach any double.
    """
    x = values.select(F.col("value").cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    first = x.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    if first.low is None:
        return {}
    spark, out = values.sparkSession, {}
    todo = [(0, first.low, first.high, sorted(set(ranks)))]  # rows below, least and greatest value, ranks within
    while todo:
        todo, known = [t for t in todo if t[1] < t[2]], [t for t in todo if t[1] == t[2]]
        out |= {r: low for _, low, _, within in known for r in within}
        if not todo:
            break
        half = [0.5 if isinf(high - low) else 1.0 for _, low, high, _ in todo]  # where the difference exceeds a double
        at = spark.createDataFrame([(k, low, high, h) for k, ((_, low, high, _), h) in enumerate(zip(todo, half, strict=True))], "k int, low double, high double, half double")
        part = lambda c: F.col(c) * F.col("half")
        share = (part("value") - part("low")) / (part("high") - part("low"))
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        # No more ranges than wanted ranks.
        counted = x.join(F.broadcast(at), (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).groupBy("k", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        bins: dict[int, list] = {}
        for row in counted.collect():
            bins.setdefault(row.k, []).append((row.low, row.high, row.n))
        new = []
        for k, (below, _, _, within) in enumerate(todo):
            for low, high, n in sorted(bins[k]):
                inside = [r for r in within if below <= r < below + n]
                if inside:
                    new.append((below, low, high, inside))
                below += n
        todo = new
    return out


def percentile_rows(values: DataFrame, percents: list[float]) -> list[tuple[float, int, float]]:
    """``(percent, row, value)``: the row after the first floor(n * percent / 100), in ascending order, counted from 1."""
    n = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).count()
    at = {p: min(n - 1, floor(n * p / 100)) for p in percents} if n else {}
    found = selected(values, list(at.values()))
    return [(p, r + 1, found[r]) for p, r in at.items()]


def percentiles(values: DataFrame, shares: list[float]) -> list[float | None]:
    """Interpolated percentiles, exactly: between the two values around rank (n - 1) * share."""
    n = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * s for s in shares]
    found = selected(values, [r for p in at for r in (floor(p), ceil(p))])
    return [found[floor(p)] + (found[ceil(p)] - found[floor(p)]) * (p - floor(p)) for p in at]

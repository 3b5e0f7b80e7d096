"""Exact percentiles of one column in many tasks.

A sketch tells two values between which the wanted ranks lie for certain. One pass counts what is below them; a
histogram between them finds the bucket of each rank; and the values of that bucket alone, with their counts, are put
in order. The two steps leave about one row in ten million of a smooth column to the task that orders it, and rows of
one value count as one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The sketch's ranks are off by a 10,000th at most; bounds are taken twice as far on either side.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
BUCKETS = 4096


def _value_at(rows: DataFrame, ranks: list[int], low: float, high: float, below: int, upto: int) -> list[float]:
    """The values of ranks (from 0) that lie between low and high; below and upto are the rows under low and to high."""
    inside = rows.where(F.col("v").between(low, high))
    if low == high:
        return [low] * len(ranks)
    if upto - below <= BUCKETS:
        dealt, counts = inside.withColumn("bucket", F.lit(0)), [(0, upto - below)]
    else:
        # Halves keep the width finite for values of any size.
        bucket = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS), F.lit(BUCKETS - 1))
        dealt = inside.withColumn("bucket", bucket)
        counts = sorted((r["bucket"], r["count"]) for r in dealt.groupBy("bucket").count().collect())
    wanted, start = {}, below
    for k, n in counts:
        if any(start <= r < start + n for r in ranks):
            wanted[k] = start
        start += n
    offset = F.coalesce(*(F.when(F.col("bucket") == k, n) for k, n in wanted.items()))
    values = dealt.where(F.col("bucket").isin(list(wanted))).groupBy("bucket", "v").count()
    upto = F.sum("count").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("end", offset + upto).withColumn("start", F.col("end") - F.col("count"))
    hit = [(F.col("start") <= r) & (r < F.col("end")) for r in ranks]
    found = placed.agg(*(F.max(F.when(h, F.col("v"))).alias(f"r{k}") for k, h in enumerate(hit))).first()
    return list(found)


def exact_percentiles(values: DataFrame, column: str, quantiles: list[float]) -> list[float | None]:
    """The percentiles of the column's values that aren't null, interpolated between ranks (n - 1) q; none without
    values. NaN counts as the largest value. The values are read several times."""
    rows = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    odd = F.isnan("v")
    real = F.when(~odd, F.col("v"))
    near = [min(1.0, max(0.0, q + d)) for q in quantiles for d in (-MARGIN, MARGIN)]
    total, least, most, nans, sketch = rows.agg(F.count("*"), F.min(real), F.max(real), F.count_if(odd), F.percentile_approx(real, near, ACCURACY)).first()
    if not total:
        return [None] * len(quantiles)
    n = total - nans
    rows = rows.where(~odd)
    ranks = [sorted({math.floor((total - 1) * q), math.ceil((total - 1) * q)}) for q in quantiles]
    sketch = sketch or [math.nan] * len(near)
    bounds = [(least if near[2 * k] <= MARGIN else sketch[2 * k], most if near[2 * k + 1] >= 1 - MARGIN else sketch[2 * k + 1]) for k in range(len(quantiles))]
    counted = [c for low, high in bounds for c in (F.count_if(F.col("v") < F.lit(low)), F.count_if(F.col("v") <= F.lit(high)))]
    around = rows.agg(*counted).first()
    out: list[float | None] = []
    for k, (q, rs) in enumerate(zip(quantiles, ranks, strict=True)):
        real = [r for r in rs if r < n]
        (low, high), below, upto = bounds[k], around[2 * k], around[2 * k + 1]
        if real and not (below <= real[0] and real[-1] < upto):
            low, high, below, upto = least, most, 0, n
        found = (_value_at(rows, real, low, high, below, upto) if real else []) + [math.nan] * (len(rs) - len(real))
        share = (total - 1) * q - rs[0]
        out.append(found[0] if len(found) == 1 else found[0] * (1 - share) + found[1] * share)
    return out

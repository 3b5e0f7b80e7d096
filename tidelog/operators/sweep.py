"""Points against intervals by one ordered pass over both, instead of a range join.

Intervals and points of a record are put in one order by time; running counts then say how many points lie in an
interval, how many intervals cover a point, and what comes first after a time. The work is a sort of the rows, also
where a record has many intervals over many points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(intervals: DataFrame, key: str) -> DataFrame:
    at = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("start_s").alias("t")), F.struct(F.lit(1).alias("sign"), F.col("end_s").alias("t"))))
    return intervals.select(key, "position", at.alias("edge")).select(key, "position", "edge.sign", "edge.t")


def points_inside(intervals: DataFrame, points: DataFrame, key: str = "record_id", inclusive: bool = False) -> DataFrame:
    """(key, position, n): the points (key, t) with start_s <= t < end_s of each interval; t <= end_s if inclusive.

    An interval without an end (null) takes every point from its start.
    """
    last = F.lit(float("inf"))
    edges = _edges(intervals.withColumn("end_s", F.coalesce("end_s", last)), key)
    rank = F.when((F.col("sign") > 0) & F.lit(inclusive), 2).otherwise(0)
    both = edges.select(key, "t", rank.alias("kind"), "position", "sign", F.lit(0).alias("one")).unionByName(points.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("sign"), F.lit(1).alias("one")))
    order = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.sum("one").over(order)).where("sign is not null")
    return seen.groupBy(key, "position").agg(F.sum(F.col("sign") * F.col("seen")).cast("bigint").alias("n"))


def covering(points: DataFrame, intervals: DataFrame, key: str = "record_id", inclusive: bool = False) -> DataFrame:
    """Adds covered_by (intervals that hold t) and later (whether some interval starts after t) to points (key, t)."""
    edges = _edges(intervals.withColumn("end_s", F.coalesce("end_s", F.lit(float("inf")))), key)
    names = [c for c in points.columns if c not in (key, "t")]
    held = F.struct(*names).alias("held") if names else F.lit(None).alias("held")
    # Starts come before a point at the same time, ends too unless they are inclusive.
    rank = F.when((F.col("sign") > 0) & F.lit(inclusive), 2).otherwise(0)
    left = points.select(key, "t", F.lit(1).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast("double").alias("start"), held)
    right = edges.select(key, "t", rank.alias("kind"), (-F.col("sign")).alias("step"), F.when(F.col("sign") < 0, F.col("t")).alias("start"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("covered_by", F.sum("step").over(order)).withColumn("last_start", F.max("start").over(Window.partitionBy(key)))
    out = seen.where("kind = 1 and step = 0 and start is null")
    return out.select(key, "t", *(["held.*"] if names else []), F.col("covered_by").cast("bigint").alias("covered_by"), F.coalesce(F.col("t") < F.col("last_start"), F.lit(False)).alias("later"))


def first_from(starts: DataFrame, points: DataFrame, order: str, value: str, key: str = "record_id", tolerance: float = 0.0) -> DataFrame:
    """Adds to starts (key, position, start_s) the value of the first point, by `order`, with t >= start_s - tolerance.

    Points are (key, t, order, value); those with a null value don't count.
    """
    found = points.where(F.col(value).isNotNull()).select(key, "t", F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("point"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("double").alias("start_s"))
    asked = starts.select(key, (F.col("start_s") - tolerance).alias("t"), F.lit(None).cast(found.schema["point"].dataType).alias("point"), "position", "start_s")
    later = Window.partitionBy(key).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    return found.unionByName(asked).withColumn("best", F.min("point").over(later)).where("position is not null").select(key, "position", "start_s", F.col("best.v").alias(value))


def union_length(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, length): the length of the union of each group's intervals. Touching ones merge; reversed ones drop."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    valid = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    fresh = (F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.col("__before")))).alias("__new")
    gain = valid.withColumn("__before", before).select(*keys, F.when(F.col("__before").isNull(), F.col(end) - F.col(start)).otherwise(fresh).alias("__new"))
    return gain.groupBy(*keys).agg(F.sum("__new").alias("length"))


def union_total(intervals: DataFrame, start: str, end: str, buckets: int = 4096) -> DataFrame:
    """(length): the length of the union of all intervals, as in :func:`union_length` without keys, in many tasks.

    Starts are dealt to buckets in order; a bucket knows the latest end of all buckets before it, a table of at most
    `buckets` rows. No interval is cut.
    """
    valid = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(F.col(start).alias("__s"), F.col(end).alias("__e"))
    least, most = valid.agg(F.min("__s")).scalar(), valid.agg(F.max("__s")).scalar()
    placed = valid.withColumn("__bucket", F.floor((F.col("__s") - least) / F.greatest(most - least, F.lit(1)) * (buckets - 1)))
    tops = placed.groupBy("__bucket").agg(F.max("__e").alias("__top"))
    carried = tops.select("__bucket", F.max("__top").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = Window.partitionBy("__bucket").orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.col("__carry"), F.max("__e").over(inside))
    gain = positive(F.col("__e") - F.greatest(F.col("__s"), F.coalesce("__before", "__s")))
    return placed.join(F.broadcast(carried), "__bucket").withColumn("__before", before).agg(F.sum(gain).alias("length"))


def positive(count: Column) -> Column:
    return F.greatest(F.lit(0), count)

"""Score views over assigned windows: counts, accuracies, false alarms, misses and redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.quantiles import exact_percentiles
from tidelog.operators.sweep import covering, points_inside, positive
from tidelog.sources.folders import stored


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; where whole is 0, null or the given value."""
    out = F.try_divide(part.cast("double"), whole)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def view_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of rows (score, source, is_answered, observable), for all or for each value of `by`.

    Scores that are missing count as 0. is_answered includes answers before the window.
    """
    score = F.coalesce("score", F.lit(0.0))
    total = F.count("*")
    return rows.groupBy(*by).agg(
        total.alias("window_count"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"),
        F.count_if(score >= 1.0).alias("fully_correct_count"),
        ratio(F.coalesce(F.sum(score), F.lit(0.0)), total, 0.0).alias("accuracy"),
        F.count_if("is_answered").alias("answered_count"),
        F.count_if(F.col("source") == "no_output").alias("no_output_count"),
        F.count_if(F.col("source") == "before_window").alias("before_window_count"),
        F.count_if("observable").alias("observable_count"),
        (total - F.count_if("observable")).alias("unobservable_count"),
        ratio(F.count_if("observable"), total).alias("observable_coverage"),
    )


def score_views(strict: DataFrame, eventual: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """view_summary of the five views, named in the column view. An empty view has a row only without `by`."""
    parts = {
        "strict_all_window": strict,
        "strict_observable_window": strict.where("observable"),
        "crowded_window": strict.where("crowded_window"),
        "non_crowded_window": strict.where("not crowded_window"),
        "post_trigger_eventual": eventual,
    }
    out = None
    for name, rows in parts.items():
        one = view_summary(rows, by).withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def source_distribution(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows each source has, as rows; map_from_entries over them gives the distribution as a map."""
    return rows.groupBy(*by, "source").agg(F.count("*").alias("n"))


def episodes_outside(episodes: DataFrame, specs: DataFrame, end: str = "end_s", boundary: str = "half_open") -> DataFrame:
    """Adds outside (in no window) and false_alarm (outside, and a window starts later) to episodes (record_id, t).

    Episodes of records without windows are outside and no false alarms.
    """
    spans = specs.select("record_id", "position", "start_s", F.col(end).alias("end_s"))
    seen = covering(episodes, spans, inclusive=boundary == "inclusive")
    return seen.withColumn("outside", F.col("covered_by") == 0).withColumn("false_alarm", F.col("outside") & F.col("later")).drop("covered_by", "later")


def false_alarms(episodes: DataFrame, specs: DataFrame, boundary: str = "half_open") -> DataFrame:
    seen = episodes_outside(episodes, specs, boundary=boundary)
    return seen.agg(
        F.count_if("false_alarm").alias("false_alarm_count"),
        F.count("*").alias("answered_episode_count"),
        ratio(F.count_if("false_alarm"), F.count("*")).alias("false_alarm_rate"),
        F.count_if("outside").alias("outside_count"),
    )


def misses(assigned: DataFrame) -> DataFrame:
    missed = F.count_if(F.col("source") != "in_window")
    return assigned.agg(F.count("*").alias("window_count"), missed.alias("missed_window_count"), ratio(missed, F.count("*")).alias("miss_rate"))


def redundancy(specs: DataFrame, episodes: DataFrame, end: str = "end_s", inclusive: bool = False) -> DataFrame:
    """(record_id, position, redundant): the episodes of a window beyond its first."""
    spans = specs.select("record_id", "position", "start_s", F.col(end).alias("end_s"))
    return points_inside(spans, episodes, inclusive=inclusive).select("record_id", "position", positive(F.col("n") - 1).alias("redundant"))


def distribution(values: DataFrame, column: str, population: Column | None = None) -> DataFrame:
    """population, observed, coverage, exact p50 and p95 with linear interpolation, and max of a column.

    The percentiles are found at once, by jobs of their own that bring no more than a bucket of values to one task.
    """
    whole = F.count("*") if population is None else population
    values = stored(values.select(column) if population is None else values)
    p50, p95 = exact_percentiles(values, column, [0.5, 0.95])
    return values.agg(
        whole.alias("population_count"),
        F.count(column).alias("observed_count"),
        ratio(F.count(column), whole).alias("coverage"),
        F.lit(p50).cast("double").alias("p50"),
        F.lit(p95).cast("double").alias("p95"),
        F.max(column).alias("max"),
    )


def spread(column: Column, population: Column) -> Column:
    """The fields of :func:`distribution` as one struct inside an aggregate."""
    return F.struct(
        population.alias("population_count"),
        F.count(column).alias("observed_count"),
        ratio(F.count(column), population).alias("coverage"),
        F.percentile(column, 0.5).alias("p50"),
        F.percentile(column, 0.95).alias("p95"),
        F.max(column).alias("max"),
    )

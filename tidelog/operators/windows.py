"""Response windows: from trigger annotations to strict and eventual windows, their density and observability."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.operators.sweep import points_inside

#: The tolerances that strict windows may have, in seconds.
TOLERANCES = (5.0, 10.0)


def _blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def explode_windows(records: DataFrame) -> DataFrame:
    """One row per window of records (record_id, windows, trigger_annotations), aligned by position.

    Annotations that are null drop out first, which shifts those after them. An annotation's time and answer go
    before the window's own.
    """
    notes = F.filter(F.coalesce("trigger_annotations", F.array()), lambda a: a.isNotNull())
    rows = records.select("record_id", notes.alias("notes"), F.posexplode("windows").alias("position", "w"))
    note = F.get("notes", F.col("position"))
    is_state = F.coalesce(note["trigger_type"] == "state_interval", F.lit(False)) | F.coalesce(note["response_policy"] == "reviewed_state_interval", F.lit(False))
    return rows.select(
        "record_id",
        "position",
        F.coalesce(note["response_window_start_s"], note["point_trigger_s"], F.col("w.start_s")).alias("start_s"),
        F.col("w.end_s").alias("raw_end_s"),
        F.coalesce(_blank_as_null(note["answer"]), F.col("w.expected_answer"), F.lit("")).alias("expected_answer"),
        F.coalesce(_blank_as_null(note["trigger_type"]), F.lit("legacy_point")).alias("trigger_type"),
        F.coalesce(_blank_as_null(note["response_policy"]), F.when(is_state, "reviewed_state_interval").otherwise("fixed_point_window")).alias("response_policy"),
        note["event_id"].alias("event_id"),
        is_state.alias("is_state"),
        F.coalesce(note["response_window_end_s"], note["interval_end_s"]).alias("state_end_s"),
    )


def _next_by_rank(triggers: DataFrame) -> DataFrame:
    """Adds next_trigger_s, the next distinct start, where starts ascend with positions."""
    by_record = Window.partitionBy("record_id")
    ranked = triggers.withColumn("__rank", F.dense_rank().over(by_record.orderBy("start_s")))
    return ranked.withColumn("next_trigger_s", F.min("start_s").over(by_record.orderBy("__rank").rangeBetween(1, 1))).drop("__rank")


def next_greater(values: list[float | None]) -> list[float | None]:
    """For each value the first later one that is greater; nulls are passed over and have none."""
    out: list[float | None] = [None] * len(values)
    waiting: list[int] = []  # their values never rise
    for k, value in enumerate(values):
        if value is None:
            continue
        while waiting and values[waiting[-1]] < value:
            out[waiting.pop()] = value
        waiting.append(k)
    return out


def _next_by_position(triggers: DataFrame) -> DataFrame:
    """Adds next_trigger_s, the first start after the row's position that is greater, whatever the order of starts."""

    def follow(group: pa.Table) -> pa.Table:
        rows = group.sort_by("position")
        return rows.append_column("next_trigger_s", pa.array(next_greater(rows["start_s"].to_pylist()), pa.float64()))

    shape = StructType([*triggers.schema.fields, StructField("next_trigger_s", DoubleType())])
    return triggers.groupBy("record_id").applyInArrow(follow, shape)


def next_triggers(triggers: DataFrame) -> DataFrame:
    """Adds next_trigger_s by position. Records whose starts ascend take their ranks; the others a pass each with a
    stack of starts that still wait, in time and memory as their rows."""
    by_record = Window.partitionBy("record_id")
    before = F.lag("start_s").over(by_record.orderBy("position"))
    fits = F.col("start_s").isNotNull() & (before.isNull() | (F.col("start_s") >= before))
    told = triggers.withColumn("__fits", fits).withColumn("__ascend", F.min("__fits").over(by_record))
    part = lambda ascend: told.where(F.col("__ascend") == ascend).drop("__fits", "__ascend")
    return _next_by_rank(part(True)).unionByName(_next_by_position(part(False)))


def window_specs(triggers: DataFrame, tolerance_s: float, starts_ascend: bool = True) -> DataFrame:
    """Adds the strict and eventual windows to rows (record_id, position, start_s[, is_state, state_end_s, raw_end_s]).

    A point trigger's window lasts tolerance_s or up to the next distinct trigger; a state interval's to its
    annotated end. The next trigger is the first later one that starts after this one. With starts_ascend it is the
    next rank of the starts; otherwise positions decide, see :func:`next_triggers`.
    """
    has = set(triggers.columns)
    is_state = F.col("is_state") if "is_state" in has else F.lit(False)
    ends = [F.col(c) for c in ("state_end_s", "raw_end_s") if c in has]
    state_end = F.coalesce(*ends) if ends else F.lit(None).cast("double")
    specs = _next_by_rank(triggers) if starts_ascend else next_triggers(triggers)
    end = F.when(is_state, state_end).otherwise(F.least(F.col("start_s") + tolerance_s, "next_trigger_s"))
    specs = specs.withColumn("end_s", F.greatest(end, F.col("start_s")))
    gap = F.col("next_trigger_s") - F.col("start_s")
    return specs.withColumns(
        {
            "inter_trigger_gap_s": gap,
            "effective_window_duration_s": F.col("end_s") - F.col("start_s"),
            "crowded_window": ~is_state & F.coalesce(gap < tolerance_s, F.lit(False)),
            "eventual_end_s": F.when(is_state, F.col("end_s")).otherwise(F.coalesce("next_trigger_s", "end_s")),
        }
    )


def official_specs(records: DataFrame, tolerance_s: float = 5.0) -> DataFrame:
    """The window specs of records; only the fixed tolerances are allowed."""
    if tolerance_s not in TOLERANCES:
        raise ValueError(f"the tolerance must be one of {TOLERANCES} seconds")
    return window_specs(explode_windows(records), tolerance_s, starts_ascend=False)


def observability(specs: DataFrame, observations: DataFrame, end: str = "end_s") -> DataFrame:
    """Adds observed_frame_count and observable: observations (record_id, t) from start_s to before the end."""
    counted = points_inside(specs.select("record_id", "position", "start_s", F.col(end).alias("end_s")), observations)
    return specs.join(counted.withColumnRenamed("n", "observed_frame_count"), ["record_id", "position"]).withColumn("observable", F.col("observed_frame_count") > 0)


def density_summary(specs: DataFrame) -> DataFrame:
    return specs.agg(
        F.count("*").alias("window_count"),
        F.count_if("crowded_window").alias("crowded_window_count"),
        F.count_if(~F.col("crowded_window")).alias("non_crowded_window_count"),
        F.min("inter_trigger_gap_s").alias("min_gap_s"),
        F.sum("effective_window_duration_s").alias("duration_s"),
    )


def contains(t: Column, start: Column, end: Column, boundary: str = "half_open") -> Column:
    if boundary == "half_open":
        return (t >= start) & (t < end)
    if boundary == "inclusive":
        return (t >= start) & (t <= end)
    raise ValueError("the boundary is half_open or inclusive")

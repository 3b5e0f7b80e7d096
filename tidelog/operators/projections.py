"""Projections of what a model process did: frames submitted, silence, instructions, labels and causal checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import silence_source
from tidelog.functions.timeplan import EPSILON
from tidelog.operators.episodes import event_kind

#: The stage of a call by the phase of its question.
STAGES = {"history": "qa_history_processing", "mixed_boundary": "qa_mixed_boundary", "query": "qa_query_answer"}


def stage_label(phase: Column, task: Column) -> Column:
    """A call's stage: its question's phase, else its task's kind of work."""
    by_phase = [F.when(phase == name, label) for name, label in STAGES.items()]
    return F.coalesce(*by_phase, F.when(task == "proactive", "proactive_stream_chunk").otherwise("qa_prefix_state"))


def coverage_labels(committed: Column, text_ids: Column, output_ids: Column, instructed: Column, prompt: Column, asked: Column, first_token: Column, gpu_ok: Column) -> Column:
    """What of a call was measured, as a struct of labels; all inputs are booleans and null counts as false."""
    when = lambda ok, good, bad: F.when(F.coalesce(ok, F.lit(False)), good).otherwise(bad)
    timed = asked & F.coalesce(first_token, F.lit(False))
    return F.struct(
        when(committed, "complete", "missing_commit").alias("frames"),
        when(text_ids, "complete", "missing_vision_token_id").alias("input_text_tokens"),
        when(output_ids, "complete", "missing").alias("output_tokens"),
        F.lit("complete").alias("model_calls"),
        when(instructed, "complete", "not_applicable").alias("instruction_dispatch"),
        when(prompt, "complete", "missing").alias("rendered_prompt_hash"),
        F.when(timed, "complete").otherwise(when(asked, "partial_no_first_token", "not_applicable")).alias("query_timing"),
        F.when(timed, "complete").otherwise(when(asked, "missing", "not_applicable")).alias("ttft"),
        when(gpu_ok, "process_attributed", "unavailable_or_unattributed").alias("gpu_memory"),
    )


def observation_id(name: Column, frame_index: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("frame-"), frame_index.cast("string")))


def frame_submissions(frames: DataFrame) -> DataFrame:
    """Names and pixels of frames (record_id, call, observation_id, frame_index, width, height), one submission each."""
    named = frames.withColumn("observation_id", observation_id(F.col("observation_id"), F.col("frame_index")))
    return named.withColumns({"submitted_occurrences": F.lit(1), "submitted_pixels": F.col("width").cast("bigint") * F.col("height")})


def submission_totals(submitted: DataFrame, by: tuple[str, ...] = ("record_id", "call")) -> DataFrame:
    """Frames, different frames, repeats and pixels of each call. Frames are counted apart before they are added up, so
    a call of many frames is summed in parts."""
    once = submitted.groupBy(*by, "observation_id").agg(F.sum("submitted_occurrences").alias("n"), F.sum("submitted_pixels").alias("pixels"))
    return once.groupBy(*by).agg(
        F.sum("n").alias("submitted_frame_occurrences"),
        F.count("*").alias("unique_submitted_frames"),
        F.sum(F.col("n") - 1).alias("duplicate_frame_occurrences"),
        F.sum("pixels").alias("submitted_pixels"),
    )


def observation_events(observations: DataFrame) -> DataFrame:
    """Observations (record_id, t, observation_id, frame_index, width, height, scheduled_arrival_perf_ns,
    arrival_perf_ns) as events of the log: without a commit yet, due when the record's next one is scheduled."""
    order = Window.partitionBy("record_id").orderBy("t", "frame_index")
    told = F.struct(
        observation_id(F.col("observation_id"), F.col("frame_index")).alias("observation_id"),
        "frame_index",
        F.col("width").alias("submitted_width"),
        F.col("height").alias("submitted_height"),
        "scheduled_arrival_perf_ns",
        "arrival_perf_ns",
        F.lit(None).cast("bigint").alias("commit_perf_ns"),
        F.lit(None).cast("double").alias("frame_processing_ms"),
        F.lit(None).cast("double").alias("frame_lag_ms"),
        F.col("due").alias("frame_deadline_perf_ns"),
        F.lit(None).cast("boolean").alias("on_time"),
        F.lit(1).alias("core_delivered_frame_count"),
    )
    due = observations.withColumn("due", F.lead("scheduled_arrival_perf_ns").over(order))
    return due.select("record_id", F.lit("observation").alias("kind"), F.col("t").alias("logical_time_s"), told.alias("telemetry"))


def silenced(events: DataFrame) -> DataFrame:
    """Answers (kind, text, first_token_perf_ns) that only say to wait, or nothing, as silent waits: their first token
    is one of control and no longer counts as an answer's."""
    source = F.when(event_kind(F.col("kind")) == "answer", silence_source(F.col("text")))
    quiet = source.isNotNull()
    return events.withColumns(
        {
            "silence_source": source,
            "response_decision": F.when(quiet, "silent"),
            "control_first_token_perf_ns": F.when(quiet, F.col("first_token_perf_ns")),
            "first_token_perf_ns": F.when(~quiet, F.col("first_token_perf_ns")),
            "kind": F.when(quiet, "wait").otherwise(F.col("kind")),
            "text": F.when(quiet, "WAIT").otherwise(F.col("text")),
        }
    )


def instruction_calls(calls: DataFrame, instructions: DataFrame) -> DataFrame:
    """Adds instructed to calls (record_id, call, visible_until_s, has_query): true for the first of a record, in the
    order of call, that sees up to the instruction's time (record_id, instruction_time_s) and has no question of its
    own; a record without an instruction has none."""
    rows = calls.join(instructions.select("record_id", "instruction_time_s"), "record_id", "left")
    may = F.coalesce(~F.col("has_query") & (F.col("visible_until_s") >= F.col("instruction_time_s") - EPSILON), F.lit(False))
    first = F.min(F.when(may, F.col("call"))).over(Window.partitionBy("record_id"))
    return rows.withColumn("instructed", F.coalesce(may & (F.col("call") == first), F.lit(False))).drop("instruction_time_s")


def causality_problems(rows: DataFrame) -> DataFrame:
    """Adds problem to what a record's process was given (record_id, place, kind: observation or query, t), in order of
    place: an observation before the last one, a query before what is visible, or after an interval's end where rows
    have end_s; null if there is none."""
    before = Window.partitionBy("record_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("kind") == "observation", F.col("t"))).over(before)
    late = (F.col("t") > F.col("end_s") + EPSILON) if "end_s" in rows.columns else F.lit(False)
    problem = (
        F.when((F.col("kind") == "observation") & (F.col("t") < seen - EPSILON), "unordered_observation")
        .when((F.col("kind") == "query") & (seen > F.col("t") + EPSILON), "future_observation")
        .when((F.col("kind") == "query") & late, "query_after_interval")
    )
    return rows.withColumn("problem", problem)


def dispatch_problems(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, dispatches, problem): a completed question is sent exactly once; its answer's fragments share the
    time at which it was sent. A failed record may have none."""
    sent = events.where("query_dispatch_perf_ns is not null").groupBy("record_id").agg(F.countDistinct("query_dispatch_perf_ns").alias("dispatches"))
    rows = records.join(sent, "record_id", "left").withColumn("dispatches", F.coalesce("dispatches", F.lit(0)))
    problem = F.when(F.col("dispatches") > 1, "sent_twice").when((F.col("status") == "completed") & (F.col("dispatches") == 0), "never_sent")
    return rows.select("record_id", "dispatches", problem.alias("problem"))

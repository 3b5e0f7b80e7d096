"""JSON-lines tables: strict and permissive scans, id lists, and sorted-key output."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = "struct<start_s: double, end_s: double, expected_answer: string>"
NOTE = (
    "struct<event_id: string, answer: string, annotation_source: string, trigger_type: string, point_trigger_s: double, interval_start_s: double, interval_end_s: double, response_policy: string, "
    "response_window_start_s: double, response_window_end_s: double, source_window_start_s: double, source_window_end_s: double, accepted_facts: array<string>, evidence_description: string, evidence_start_s: double, evidence_end_s: double>"
)
QUESTIONS = "record_id string, source_id string, task string, task_type string, video_path string, question string, options array<string>, answer string, question_time_s double, evidence_anchor_s double, memory_length double, metadata struct<raw: string>"
MONITORS = f"record_id string, source_id string, task string, task_type string, video_path string, instruction string, instruction_time_s double, deadline_s double, windows array<{WINDOW}>, memory_length double, metadata struct<trigger_annotations: array<{NOTE}>>"
EVENTS = (
    "record_id string, kind string, logical_time_s double, text string, status string, failed_reason string, event_id string, response_id string, sequence_id string, text_mode string, is_final boolean, response_decision string, completion_perf_ns bigint, first_token_perf_ns bigint, "
    "telemetry struct<arrival_perf_ns: bigint, scheduled_arrival_perf_ns: bigint, commit_perf_ns: bigint, frame_deadline_perf_ns: bigint, frame_processing_ms: double, frame_lag_ms: double, on_time: boolean, observation_id: string, "
    "query_dispatch_perf_ns: bigint, semantic_query_arrival_perf_ns: bigint, first_token_perf_ns: bigint, response_completion_perf_ns: bigint, core_event_receive_perf_ns: bigint, response_scoring_perf_ns: bigint, query_id: string, ttft_ms: double, response_total_ms: double, "
    "evaluation_time_source: string, eligible_for_scoring: boolean, within_evaluation_end: boolean, suppression_reason: string, provider_output_suppressed: boolean, shutdown_drain: boolean, session_close_event: boolean, response_id: string, sequence_id: string, text_mode: string, is_final: boolean, failure_stage: string, "
    "model_calls: array<struct<stage: string, start_perf_ns: bigint, end_perf_ns: bigint, input_text_tokens: double, output_tokens: double, submitted_frame_occurrences: double, submitted_pixels: double, num_cached_tokens: double>>, "
    "frame_telemetry: array<struct<observation_id: string, commit_perf_ns: bigint, submitted_occurrences: double>>, "
    "gpu: struct<backend: string, sample_interval_ms: double, attribution_ok: boolean, devices: array<struct<uuid: string, device_id: string, baseline_bytes: bigint, peak_bytes: bigint, peak_increment_bytes: bigint, peak_minus_baseline_bytes: bigint>>>>"
)


def as_schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON-lines file; blank lines are skipped, and a line that doesn't fit, or that has a key that the
    schema doesn't name, fails the job with the file and the line's text."""
    kind = as_schema(schema)
    keys = F.array(*(F.lit(f.name) for f in kind.fields))
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    row = F.from_json("value", T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"})
    parsed = lines.withColumn("row", row)
    foreign = F.size(F.array_except(F.json_object_keys("value"), keys)) > 0
    bad = F.col("row._corrupt_record").isNotNull() | F.json_object_keys("value").isNull() | foreign
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid row in "), "file", F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("row"))
    return parsed.select(checked.alias("row")).select(*(F.col("row")[f.name].alias(f.name) for f in kind.fields))


def read_events(spark: SparkSession, path: str, schema: str | T.StructType = EVENTS) -> DataFrame:
    """An event log with event_index, the place of each event in its record; absent fields are null."""
    from pyspark.sql import Window

    rows = spark.read.schema(as_schema(schema) if isinstance(schema, str) else schema).json(path).withColumn("__at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("record_id").orderBy("__at")) - 1
    return rows.withColumn("event_index", place).drop("__at")


def read_open(spark: SparkSession, path: str) -> DataFrame:
    """Rows of unknown shape as VARIANT values; no rows where there is no file."""
    try:
        return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("row"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string").select(F.parse_json("value").alias("row"))


def read_ids(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame:
    """(key, pos) of a JSON list of ids; a list that isn't one, or that repeats an id, is an error."""
    ids = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("ids"))
    sound = F.when(F.col("ids").isNull() | (F.size("ids") != F.size(F.array_distinct("ids"))), F.raise_error(F.lit("an id list is a JSON list of different strings"))).otherwise(F.col("ids"))
    return ids.select(F.posexplode(sound).alias("pos", key))


def write_sorted(rows: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").json(path)


def dump_lines(path: Path, rows: Iterable[dict[str, Any]]) -> None:
    """A small JSON-lines file, from the driver."""
    path.write_text("".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")

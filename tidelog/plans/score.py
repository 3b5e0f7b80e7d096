"""Scoring of a whole run: records and events to metrics, and of a stored bundle beside its result."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import gates, scoring, telemetry, validation
from tidelog.operators.episodes import assemble, events_of, resolve
from tidelog.operators.windows import official_specs
from tidelog.sources.bundle import RunBundle
from tidelog.sources.folders import stored
from tidelog.sources.jsonl import EVENTS, MONITORS, as_schema

PARSERS = {"legacy": "strict", "paper-v1": "recoverable"}
RESULT_ONLY = "question string, options array<string>, answer string, prediction string, status string, failed_reason string, timed_out boolean, retry_count bigint"


def result_schema() -> T.StructType:
    return T.StructType([*as_schema(MONITORS).fields, *as_schema(RESULT_ONLY).fields])


def log_schema() -> T.StructType:
    return T.StructType([*as_schema(EVENTS).fields, *as_schema("event_index int").fields])


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict(recursive=True)


#: The columns of the telemetry summary's log, each from the event or else from its telemetry.
MEASURED = {
    "commit_perf_ns": "bigint", "frame_processing_ms": "double", "frame_lag_ms": "double", "on_time": "boolean", "arrival_perf_ns": "bigint", "query_id": "string", "query_dispatch_perf_ns": "bigint", "semantic_query_arrival_perf_ns": "bigint",
    "first_token_perf_ns": "bigint", "response_completion_perf_ns": "bigint", "ttft_ms": "double", "response_total_ms": "double", "failure_stage": "string", "transport_uploaded_image_count": "bigint", "transport_uploaded_image_total_bytes": "bigint",
}


def _run_telemetry(records: DataFrame, events: DataFrame, windows: DataFrame, episodes: DataFrame) -> dict[str, Any]:
    """The seven parts of the telemetry of a run."""
    told = {f.name for f in events.schema["telemetry"].dataType.fields}
    named = lambda n: [F.col(n)] if n in events.columns else []
    inner = lambda n: [F.col(f"telemetry.{n}")] if n in told else []
    also = {"response_completion_perf_ns": named("completion_perf_ns")}
    log = stored(events.select("record_id", "event_index", "kind", *(F.coalesce(*named(n), *also.get(n, []), *inner(n), F.lit(None)).cast(kind).alias(n) for n, kind in MEASURED.items())))
    calls, frames = stored(telemetry.calls(events)), stored(telemetry.frame_rows(events))
    return _one(telemetry.summarize(log, calls, frames, records, windows, episodes, stored(telemetry.gpu_summary(events)), stored(telemetry.gpu_devices(events))))


def eligibility(spark: SparkSession, task: str, config: dict[str, Any], metrics: dict[str, Any], judge_errors: int = 0) -> dict[str, Any]:
    """Whether a run may be published, and why not, from its configuration and metrics.

    The configuration tells pacing, synthetic, provisional and the adapter's capabilities (persistent_session,
    autonomous); what it doesn't tell counts as not given.
    """
    able = config.get("capabilities", {})
    coverage = {k: None if v is None else float(v) for k, v in metrics["telemetry"]["telemetry_coverage"].items() if not isinstance(v, bool)}
    state = {
        "task": task, "synthetic": config.get("synthetic") is True, "provisional": config.get("provisional") is True, "persistent_session": able.get("persistent_session") is True, "autonomous": able.get("autonomous") is True, "pacing": config.get("pacing", "logical"),
        "triggers_complete": metrics.get("trigger_metadata", {}).get("complete"), "coverage": coverage, "gpu_attribution_ok": metrics["telemetry"]["gpu_memory"]["attribution_ok"], "judge_errors": judge_errors,
    }
    shape = "task string, synthetic boolean, provisional boolean, persistent_session boolean, autonomous boolean, pacing string, triggers_complete boolean, coverage map<string, double>, gpu_attribution_ok boolean, judge_errors int"
    run = spark.createDataFrame([tuple(state.values())], shape)
    return _one(gates.ineligibility(gates.execution_track(run)).select("official_eligible", "reasons", "visual_state", "proactive_track", "proactive_primary_eligible"))


def score_records(task: str, records: DataFrame, events: DataFrame | None = None, proactive_window_s: float = 5.0, window_boundary: str = "half_open", profile: str = "legacy", judge_mode: str = "exact", config: dict[str, Any] | None = None) -> tuple[dict[str, Any], DataFrame]:
    """The metrics of a run and its scored rows: records for questions, strict windows for monitoring.

    Events that are given are authoritative: a record without any has no prediction from them. Without them a record's
    own events count, or else its legacy steps. Failed records stay in. With telemetry in the events, its summary and
    the run's eligibility under config are among the metrics. Tables that several metrics read are stored.
    """
    if profile not in PARSERS:
        raise ValueError(f"unknown scoring profile: {profile!r}")
    spark = records.sparkSession
    records = stored(records)
    events = stored(events_of(records, events))
    log = resolve(events)
    measured = "model_calls" in {f.name for f in getattr(events.schema["telemetry"].dataType, "fields", [])}
    metrics: dict[str, Any] = {"task": task, "scoring_profile": profile}
    judge_errors = 0
    if task == "qa":
        episodes = stored(assemble(log))
        rows = stored(scoring.score_questions(records, scoring.query_predictions(episodes), PARSERS[profile]).drop("labels"))
        metrics |= _one(scoring.question_metrics(rows))
        windows = spark.createDataFrame([], "source string, is_answered boolean, latency_ms double")
    else:
        arrival = F.col("telemetry.arrival_perf_ns") if "arrival_perf_ns" in {f.name for f in getattr(events.schema["telemetry"].dataType, "fields", [])} else F.lit(None).cast("bigint")
        arrivals = events.select("record_id", "event_index", arrival.alias("arrival_perf_ns"))
        noted = records.withColumn("trigger_annotations", F.col("metadata.trigger_annotations"))
        specs = stored(official_specs(noted, proactive_window_s))
        found = scoring.score_windows(records, specs, log.join(arrivals, ["record_id", "event_index"]), window_boundary, judge_mode)
        found = {k: v if k in ("episodes", "answered") else stored(v) for k, v in found.items()}
        rows, windows, episodes = found["strict"], found["strict"], found["episodes"]
        tables = scoring.proactive_metrics(found, specs, window_boundary)
        metrics |= {"window_boundary": window_boundary, "proactive_window_s": proactive_window_s}
        metrics["views"] = {r["view"]: r.asDict() for r in tables["views"].collect()}
        metrics["window_source_distribution"] = {r["source"]: r["n"] for r in tables["sources"].collect()}
        for name in ("false_alarms", "misses", "redundant", "eventual_outside", "eventual_redundant"):
            metrics |= _one(tables[name])
        metrics["response_delay_ms"] = _one(tables["delay"])
        judged = tables["judge"].collect()
        metrics["judge_method_counts"] = {f"{r['view']}:{r['score_method']}": r["n"] for r in judged}
        metrics["judge_error_count"] = judge_errors = sum(r["errors"] for r in judged)
        metrics["trigger_metadata"] = _one(validation.trigger_metadata_status(noted))
    if measured:
        metrics["telemetry"] = _run_telemetry(records if "task" in records.columns else records.withColumn("task", F.lit(task)), events, windows, episodes)
        metrics["official_eligibility"] = eligibility(spark, task, config or {}, metrics, judge_errors)
    return metrics, rows


def score_bundle(spark: SparkSession, root: str, profile: str | None = None, judge_mode: str = "exact") -> dict[str, Any]:
    """Scores a final bundle under its frozen configuration and writes the scores beside the result.

    The bundle's own scoring profile holds unless another is given.
    """
    bundle = RunBundle(root)
    bundle.validate(spark)
    config = bundle.config()
    profile = profile or config.get("scoring_profile", "legacy")
    records = spark.read.schema(result_schema()).json(f"{root}/records")
    events = spark.read.schema(log_schema()).json(f"{root}/events")
    metrics, rows = score_records(config.get("task", "qa"), records, events, config.get("proactive_window_s", 5.0), config.get("window_boundary", "half_open"), profile, judge_mode, config)
    metrics["reliability"] = _one(telemetry.reliability(records))
    bundle.write_rescored(metrics, rows)
    return metrics

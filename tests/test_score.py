from pyspark.sql import types as T

from tidelog import cli
from tidelog.plans.score import log_schema, result_schema
from tidelog.sources.bundle import RunBundle


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], T.StructType(schema.fields))


def test_bundles_are_scored_from_the_command_line(spark, tmp_path, capsys):
    qa = [{"record_id": "a", "options": ["A. x", "B. y"], "answer": "A", "status": "completed"}, {"record_id": "b", "options": ["A. x", "B. y"], "answer": "B", "status": "failed", "failed_reason": "x"}]
    tele = {f.name: None for f in log_schema()["telemetry"].dataType.fields} | {"query_dispatch_perf_ns": 5}
    events = [{"record_id": "a", "kind": "answer", "logical_time_s": 1.0, "text": "The answer is A", "event_index": 0, "telemetry": tuple(tele.values())}]
    bundle = RunBundle(tmp_path / "qa")
    bundle.prepare({"task": "qa"})
    bundle.finalize(table(spark, result_schema(), qa), table(spark, log_schema(), events), {}, {})
    assert cli.main(["score", str(bundle.root), "--scoring-profile", "paper-v1"]) == 0
    said = capsys.readouterr().out
    assert '"accuracy": 0.5' in said and '"strict_accuracy": 0.0' in said
    assert cli.main(["bundle", "validate", str(bundle.root)]) == 0
    assert cli.main(["bundle", "validate", str(tmp_path)]) == 1


def test_monitoring_bundle(spark, tmp_path):
    from tidelog.plans.score import score_bundle

    record = {"record_id": "p", "task": "proactive", "task_type": "T", "instruction": "i", "instruction_time_s": 0.0, "windows": [(1.0, 2.5, "event")], "status": "completed"}
    tele = {f.name: None for f in log_schema()["telemetry"].dataType.fields}
    make = lambda i, kind, t, ns, text=None: {"record_id": "p", "kind": kind, "logical_time_s": t, "text": text, "event_index": i, "telemetry": tuple((tele | {"arrival_perf_ns": ns, "first_token_perf_ns": ns if text else None}).values())}
    bundle = RunBundle(tmp_path / "pro")
    bundle.prepare({"task": "proactive"})
    bundle.finalize(table(spark, result_schema(), [record]), table(spark, log_schema(), [make(0, "observation", 1.0, 1_000_000_000), make(1, "answer", 1.5, 1_250_000_000, "Event")]), {}, {})
    metrics = score_bundle(spark, str(bundle.root))
    assert metrics["views"]["strict_all_window"]["accuracy"] == 1.0
    assert metrics["window_source_distribution"] == {"in_window": 1}
    assert metrics["response_delay_ms"]["p50"] == 250.0
    assert metrics["miss_rate"] == 0.0
    assert metrics["telemetry"]["visual_workload"]["core_delivered_frames"] == 1
    assert metrics["telemetry"]["responsiveness"]["proactive_response_latency_ms"]["p50"] == 250.0
    told = metrics["official_eligibility"]
    assert not told["official_eligible"] and {"logical_pacing_diagnostic", "missing_or_invalid_trigger_annotations", "incomplete_telemetry:model_call_intervals"} <= set(told["reasons"])


def test_eligible_run(spark):
    from tidelog.plans.score import eligibility

    full = {"model_call_intervals": 1.0, "submitted_frames": 1, "submitted_pixels": 1.0, "input_text_tokens": 1.0, "output_tokens": 1.0, "frame_commit": 1.0, "frame_processing": 1.0, "query_ttft": 1.0, "query_response_total": 1.0, "gpu_memory": True}
    metrics = {"telemetry": {"telemetry_coverage": full, "gpu_memory": {"attribution_ok": True}}, "trigger_metadata": {"complete": True}}
    native = {"pacing": "wall_clock", "capabilities": {"persistent_session": True, "autonomous": True}}
    assert eligibility(spark, "qa", native, metrics)["official_eligible"] and eligibility(spark, "proactive", native, metrics)["official_eligible"]
    assert eligibility(spark, "proactive", native, metrics, judge_errors=1)["reasons"] == ["judge_incomplete"]
    poll = native | {"capabilities": {"persistent_session": True}}
    assert eligibility(spark, "qa", poll, metrics)["official_eligible"]
    assert eligibility(spark, "proactive", poll, metrics)["reasons"] == ["proactive_not_native_autonomous_wall_clock"]
    short = {"telemetry": {"telemetry_coverage": full | {"frame_commit": 0.5}, "gpu_memory": {"attribution_ok": False}}}
    assert eligibility(spark, "qa", native, short)["reasons"] == ["incomplete_telemetry:frame_commit", "incomplete_telemetry:gpu_memory_attribution"]


def test_records_with_their_own_events_and_legacy_steps(spark):
    """Without a log, a record's events give its answer, else its steps do; a log that is given, even empty, holds."""
    from tidelog.plans.score import score_records

    event = "struct<kind: string, logical_time_s: double, text: string, telemetry: struct<query_dispatch_perf_ns: bigint>>"
    rows = [("a", ["A. x", "B. y"], "A", "completed", None, [("answer", 1.0, "A", (5,))], None), ("b", ["A. x", "B. y"], "B", "completed", "B", [], [(0.5, "WAIT", None)]), ("c", ["A. x", "B. y"], "B", "failed", None, None, None)]
    records = spark.createDataFrame(rows, f"record_id string, options array<string>, answer string, status string, prediction string, events array<{event}>, model_steps array<struct<step_t: double, prediction: string, ttft_ms: double>>")
    own, _ = score_records("qa", records)
    assert (own["record_count"], own["score_sum"]) == (3, 2.0)
    log = spark.createDataFrame([], "record_id string, event_index int, kind string, logical_time_s double, text string, telemetry struct<query_dispatch_perf_ns: bigint>")
    given, _ = score_records("qa", records, log)
    assert given["score_sum"] == 1.0


def test_bundle_with_events_that_differ(spark, tmp_path):
    """Embedded events are held against the log, in order."""
    import pytest

    from tidelog.sources.bundle import BundleError

    event = "struct<kind: string, text: string>"
    log = spark.createDataFrame([("a", 0, "wait", "x"), ("a", 1, "answer", "y")], "record_id string, event_index int, kind string, text string")
    for name, own in (("good", [("wait", "x"), ("answer", "y")]), ("bad", [("answer", "y"), ("wait", "x")])):
        records = spark.createDataFrame([("a", "completed", own)], f"record_id string, status string, events array<{event}>")
        bundle = RunBundle(tmp_path / name)
        bundle.prepare({"task": "qa"})
        bundle.finalize(records, log, {}, {})
        if name == "good":
            assert bundle.validate(spark)["records"] == 1
        else:
            with pytest.raises(BundleError, match="disagree"):
                bundle.validate(spark)

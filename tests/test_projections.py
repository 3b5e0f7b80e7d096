"""Projections of model processes on odd rows: nulls, empty names, ties and records without anything."""

from pyspark.sql import functions as F

from tidelog.operators import episodes, projections


def test_labels(spark):
    row = spark.range(1).select(
        *(projections.stage_label(F.lit(p).cast("string"), F.lit(t).cast("string")).alias(f"s{k}") for k, (p, t) in enumerate((("history", "qa"), ("query", None), (None, "proactive"), ("else", "qa"), (None, None)))),
        projections.coverage_labels(*(F.lit(v).cast("boolean") for v in (True, None, False, None, True, True, None, True))).alias("c"),
        projections.coverage_labels(*(F.lit(None).cast("boolean") for _ in range(8))).alias("n"),
    ).first()
    assert row[:5] == ("qa_history_processing", "qa_query_answer", "proactive_stream_chunk", "qa_prefix_state", "qa_prefix_state")
    assert tuple(row.c) == ("complete", "missing_vision_token_id", "missing", "complete", "not_applicable", "complete", "partial_no_first_token", "missing", "process_attributed")
    assert row.n.query_timing == row.n.ttft == "not_applicable" and row.n.frames == "missing_commit"


def test_frames(spark):
    frames = spark.createDataFrame([("a", 0, None, 3, 10, 10), ("a", 0, "", 3, 10, 10), ("a", 0, "x", 3, None, 10), ("a", 1, "x", 4, 2, 2)], "record_id string, call int, observation_id string, frame_index int, width int, height int")
    got = {r.call: r[2:] for r in projections.submission_totals(projections.frame_submissions(frames)).collect()}
    assert got == {0: (3, 2, 1, 200), 1: (1, 1, 0, 4)}


def test_silence(spark):
    rows = [("answer", "WAIT!", 5), ("provider.Answer", " ...", 6), ("answer", None, None), ("answer", "wait for it", 7), ("telemetry", "", 8), (None, "x", 9)]
    got = [tuple(r) for r in projections.silenced(spark.createDataFrame(rows, "kind string, text string, first_token_perf_ns bigint")).select("kind", "text", "first_token_perf_ns", "control_first_token_perf_ns", "silence_source").collect()]
    assert got == [("wait", "WAIT", None, 5, "text_wait"), ("wait", "WAIT", None, 6, "provider_empty_continuation"), ("wait", "WAIT", None, None, "empty_output"), ("answer", "wait for it", 7, None, None), ("telemetry", "", 8, None, None), (None, "x", 9, None, None)]


def test_instruction_once(spark):
    calls = spark.createDataFrame([("a", 0, 1.0, False), ("a", 1, 2.0 - 5e-10, True), ("a", 2, 2.0, False), ("a", 3, 3.0, False), ("b", 0, 9.0, False), ("c", 0, 9.0, False)], "record_id string, call int, visible_until_s double, has_query boolean")
    told = spark.createDataFrame([("a", 2.0), ("b", None)], "record_id string, instruction_time_s double")
    assert [(r.record_id, r.call) for r in projections.instruction_calls(calls, told).where("instructed").collect()] == [("a", 2)]


def test_causality_and_dispatch(spark):
    rows = [("a", 0, "observation", 1.0), ("a", 1, "query", 1.0), ("a", 2, "observation", 0.5), ("a", 3, "query", 0.9), ("b", 0, "query", 0.0)]
    got = {(r.record_id, r.place): r.problem for r in projections.causality_problems(spark.createDataFrame(rows, "record_id string, place int, kind string, t double")).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("a", 2): "unordered_observation", ("a", 3): "future_observation", ("b", 0): None}
    records = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "failed"), ("d", "completed")], "record_id string, status string")
    events = spark.createDataFrame([("a", 5), ("a", 5), ("a", None), ("d", 1), ("d", 2)], "record_id string, query_dispatch_perf_ns bigint")
    assert {r.record_id: r.problem for r in projections.dispatch_problems(records, events).collect()} == {"a": None, "b": "never_sent", "c": None, "d": "sent_twice"}


def test_observation_events(spark):
    rows = [("a", 1.0, None, 4, 8, 6, 100, 101), ("a", 2.0, "x", 5, 8, 6, None, 201), ("b", 0.0, "", 0, None, None, None, None)]
    got = {(r.record_id, r.logical_time_s): r.telemetry for r in projections.observation_events(spark.createDataFrame(rows, "record_id string, t double, observation_id string, frame_index int, width int, height int, scheduled_arrival_perf_ns bigint, arrival_perf_ns bigint")).collect()}
    assert got[("a", 1.0)].observation_id == "frame-4" and got[("a", 1.0)].frame_deadline_perf_ns is None and got[("b", 0.0)].observation_id == "frame-0"
    assert got[("a", 1.0)].commit_perf_ns is None and got[("a", 2.0)].submitted_width == 8


def test_variant_telemetry(spark):
    """A field of another type is lost, its neighbours stay; numbers aren't read from text."""
    told = ['{"first_token_perf_ns": 1700000000000000001, "text_mode": "delta", "eligible_for_scoring": false}', '{"first_token_perf_ns": "7", "text_mode": 3, "is_final": true}', "[]", None, '{"first_token_perf_ns": 7.0, "response_id": null}']
    rows = spark.createDataFrame([(k, "answer", "complete", t) for k, t in enumerate(told)], "record_id int, kind string, text_mode string, t string").withColumn("telemetry", F.try_parse_json("t"))
    got = [tuple(r) for r in episodes.resolve(rows).orderBy("record_id").select("first_token_perf_ns", "text_mode", "eligible_for_scoring", "is_final", "response_id").collect()]
    assert got == [(1700000000000000001, "delta", False, None, None), (None, "complete", None, True, None), (None, "complete", None, None, None), (None, "complete", None, None, None), (None, "complete", None, None, None)]

import pytest
from pyspark.sql import functions as F

from tidelog.functions import timeplan
from tidelog.operators import assignment, enrich, episodes, gates, scoring, sweep, telemetry, validation, views, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


LOG = "record_id string, event_index int, kind string, logical_time_s double, text string, sequence_id string, text_mode string, response_id string, is_final boolean, telemetry struct<eligible_for_scoring: boolean, suppression_reason: string, shutdown_drain: boolean, query_dispatch_perf_ns: bigint, first_token_perf_ns: bigint, arrival_perf_ns: bigint>"


def log(spark, *events):
    names = [c.split()[0] for c in LOG.split(", ")[:9]]
    tele = ("eligible_for_scoring", "suppression_reason", "shutdown_drain", "query_dispatch_perf_ns", "first_token_perf_ns", "arrival_perf_ns")
    rows = []
    for i, e in enumerate(events):
        e = {"record_id": "r", "event_index": i, "kind": "answer", "logical_time_s": float(i)} | e
        rows.append((*(e.get(n) for n in names), tuple(e.get(t) for t in tele)))
    return episodes.resolve(spark.createDataFrame(rows, LOG))


def texts(df):
    return [r["text"] for r in df.orderBy("episode").collect()]


def test_delta_fragments_join(spark):
    part = {"text_mode": "delta", "response_id": "a", "query_dispatch_perf_ns": 100}
    found = episodes.assemble(log(spark, part | {"text": "A", "sequence_id": "0"}, part | {"text": ".", "sequence_id": "1", "is_final": True}))
    assert texts(found) == ["A."]
    assert scoring.query_predictions(found).first()["prediction"] == "A."


def test_sequence_orders_fragments(spark):
    part = {"text_mode": "delta", "response_id": "a"}
    found = episodes.assemble(log(spark, part | {"text": "walks", "sequence_id": "2", "is_final": True}, part | {"text": "She", "sequence_id": "1"}, {"kind": "wait"}))
    row = found.first()
    assert (row["text"], row["source_event_indices"]) == ("She walks", [1, 0])


@pytest.mark.parametrize(("drain", "expected"), [(False, ["She picks it up"]), (True, ["She picks"])])
def test_late_fragment_only_finishes(spark, drain, expected):
    part = {"text_mode": "delta", "response_id": "a"}
    late = {"eligible_for_scoring": False, "suppression_reason": "after_evaluation_end", "shutdown_drain": drain}
    found = episodes.assemble(log(spark, part | {"text": "She picks"}, part | late | {"text": "it up", "is_final": True}, {"text_mode": "delta", "response_id": "b", "text": "new"} | late))
    assert texts(found) == expected


def test_ineligible_and_snapshot(spark):
    snap = {"text_mode": "snapshot", "response_id": "s"}
    found = episodes.assemble(log(spark, {"text": "no", "eligible_for_scoring": False}, snap | {"text": "a"}, snap | {"text": "a b"}, {"kind": "wait"}, {"text": "whole"}))
    assert texts(found) == ["a b", "whole"]


def triggers(spark, *starts, record="r"):
    return spark.createDataFrame([(record, i, float(s), f"e{i}") for i, s in enumerate(starts)], "record_id string, position int, start_s double, expected_answer string")


def points(spark, *times, record="r"):
    return spark.createDataFrame([(record, i, float(t)) for i, t in enumerate(times)], "record_id string, episode int, t double")


def sources(df):
    return [r["source"] for r in df.orderBy("position").collect()]


def test_dense_and_tied_windows(spark):
    rows = windows.window_specs(triggers(spark, 1, 1, 3), 5.0).orderBy("position").collect()
    assert [r["next_trigger_s"] for r in rows] == [3.0, 3.0, None]
    assert [r["end_s"] for r in rows] == [3.0, 3.0, 8.0]
    assert [r["crowded_window"] for r in rows] == [True, True, False]
    other = windows.window_specs(triggers(spark, 1, 1, 3), 5.0, starts_ascend=False).orderBy("position").collect()
    assert [r["next_trigger_s"] for r in other] == [3.0, 3.0, None]


@pytest.mark.parametrize(
    ("starts", "times", "strict", "eventual"),
    [
        ((1, 2), (2.0,), ["no_output", "in_window"], ["no_output", "eventual"]),
        ((1,), (6.0,), ["no_output"], ["no_output"]),
        ((1, 10), (8,), ["no_output", "before_window"], ["eventual", "no_output"]),
        ((1,), (4,), ["in_window"], ["eventual"]),
        ((2, 6), (0.5, 1.0, 2.5, 12.0), ["in_window", "before_window"], ["eventual", "no_output"]),
    ],
)
def test_assignment(spark, starts, times, strict, eventual):
    specs = windows.window_specs(triggers(spark, *starts), 5.0)
    assert sources(assignment.assign_strict(specs, points(spark, *times))) == strict
    assert sources(assignment.assign_eventual(specs, points(spark, *times))) == eventual


def test_records_with_states(spark):
    note = "struct<trigger_type: string, response_policy: string, answer: string, event_id: string, point_trigger_s: double, response_window_start_s: double, response_window_end_s: double, interval_end_s: double>"
    schema = f"record_id string, windows array<struct<start_s: double, end_s: double, expected_answer: string>>, trigger_annotations array<{note}>"
    rows = spark.createDataFrame([("r", [(2.0, 4.0, "x")], [("state_interval", None, "y", None, None, None, None, 4.0)])], schema)
    spec = windows.official_specs(rows, 10.0).first()
    assert (spec["end_s"], spec["expected_answer"], spec["crowded_window"], spec["eventual_end_s"]) == (4.0, "y", False, 4.0)
    assert sources(assignment.assign_strict(windows.official_specs(rows, 10.0), points(spark, 4.0))) == ["no_output"]
    with pytest.raises(ValueError):
        windows.official_specs(rows, 7.0)


def test_random_assignment_matches_a_plain_loop(spark):
    import random

    rng, specs, said, expected = random.Random(3), [], [], {}
    for r in range(40):
        starts = sorted(rng.randint(0, 20) / 2 for _ in range(rng.randint(1, 6)))
        wins = [(s, s + rng.choice([0.5, 2, 6])) for s in starts]
        times = sorted(rng.randint(0, 40) / 3 for _ in range(rng.randint(0, 6)))
        specs += [(f"{r}", i, a, b, b) for i, (a, b) in enumerate(wins)]
        said += [(f"{r}", i, t) for i, t in enumerate(times)]
        used = set()
        for i, (a, b) in enumerate(wins):
            inside = [k for k, t in enumerate(times) if k not in used and a <= t < b]
            before = [k for k, t in enumerate(times) if k not in used and t < a]
            pick = inside[0] if inside else before[-1] if before else None
            expected[(f"{r}", i)] = pick
            used |= {pick}
    s = spark.createDataFrame(specs, "record_id string, position int, start_s double, end_s double, eventual_end_s double")
    e = spark.createDataFrame(said, "record_id string, episode int, t double")
    got = {(x["record_id"], x["position"]): x["episode"] for x in assignment.assign_strict(s, e).collect()}
    assert got == expected
    counted = {(x["record_id"], x["position"]): x["n"] for x in sweep.points_inside(s, e).collect()}
    assert counted == {(r, i): sum(q == r and a <= t < b for q, _, t in said) for r, i, a, b, _ in specs}
    covered = {(x["record_id"], x["episode"]): (x["covered_by"], x["later"]) for x in sweep.covering(e, s).collect()}
    assert covered == {(r, k): (sum(q == r and a <= t < b for q, _, a, b, _ in specs), any(q == r and a > t for q, _, a, _, _ in specs)) for r, k, t in said}


def test_false_alarms_and_misses(spark):
    specs = windows.window_specs(triggers(spark, 2, 6), 4.0)
    said = points(spark, 1.0, 2.5, 12.0)
    row = views.false_alarms(said, specs).first()
    assert (row["false_alarm_count"], row["answered_episode_count"], round(row["false_alarm_rate"], 6)) == (1, 3, 0.333333)
    assert views.misses(assignment.assign_strict(specs, said)).first()["miss_rate"] == 0.5


def test_score_windows_end_to_end(spark):
    specs = windows.window_specs(triggers(spark, 1, 10), 5.0).withColumn("expected_answer", F.lit("First"))
    events = log(spark, {"kind": "observation", "logical_time_s": 1.0}, {"logical_time_s": 1.5, "text": ": first"}, {"logical_time_s": 3.0, "text": "WAIT"}, {"logical_time_s": 8.0, "text": "again"})
    records = spark.createDataFrame([("r", "SSR", "watch")], "record_id string, task_type string, instruction string")
    scored = scoring.score_windows(records, specs, events)
    assert [(r["source"], r["score"]) for r in scored["strict"].orderBy("position").collect()] == [("in_window", 1.0), ("before_window", 0.0)]
    metrics = scoring.proactive_metrics(scored, specs)
    by = {r["view"]: r for r in metrics["views"].collect()}
    assert by["strict_all_window"]["accuracy"] == 0.5
    assert by["strict_observable_window"]["window_count"] == 1
    assert metrics["misses"].first()["missed_window_count"] == 1
    assert {(r["view"], r["score_method"]): r["n"] for r in metrics["judge"].collect()}[("strict", "exact_match")] == 1


def test_judge_memo_and_model(spark):
    rows = spark.createDataFrame([(1, "SSR", "q", "a", "b"), (2, " ssr", "q", "A", "b "), (3, "X", "q", "a", "a"), (4, "SSR", "q", "a", "c")], "call int, task_type string, question string, expected string, prediction string")
    model = lambda d: d.withColumn("reply", F.when(F.col("prediction") == "c", "no idea").otherwise("0.75"))
    got = {r["call"]: (r["score"], r["score_method"], r["cached"]) for r in scoring.judge(rows, "auto", ("SSR",), model).collect()}
    assert got == {1: (0.75, "vlm", False), 2: (0.75, "vlm", True), 3: (1.0, "exact_match", False), 4: (0.0, "vlm_invalid_response", False)}
    assert {r["score_method"] for r in scoring.judge(rows, "auto", ("SSR",)).collect()} == {"exact_fallback_no_vlm", "exact_match"}


def test_latency_is_from_the_first_frame_at_the_trigger(spark):
    rows = spark.createDataFrame([("r", 0, 1.0, 1_250_000_000)], "record_id string, position int, start_s double, response_ns bigint")
    seen = spark.createDataFrame([("r", 0.5, 0, 1), ("r", 1.0, 1, 1_000_000_000), ("r", 2.0, 2, 1_100_000_000)], "record_id string, t double, event_index int, arrival_ns bigint")
    assert scoring.latency(rows, seen).first()["latency_ms"] == 250.0


def test_time_plans(spark):
    assert one(spark, timeplan.timestamp_plan(F.lit(0.0), F.lit(1.0), F.lit(2.0))) == [0.0, 0.5, 1.0]
    assert one(spark, timeplan.timestamp_plan(F.lit(377.73), F.lit(396.0), F.lit(1.0)))[-2:] == [395.73, 396.0]
    assert one(spark, timeplan.poll_schedule(F.lit(0.0), F.lit(1.0), F.lit(0.5))) == [0.0, 0.5, 1.0]
    assert [one(spark, timeplan.parse_timestamp(F.lit(x))) for x in ("1:02:03.5", "2:3", "7")] == [3723.5, 123.0, 7.0]
    assert one(spark, timeplan.frame_index(F.lit(100.0), F.lit(10.0), F.lit(40))) == 39
    assert tuple(one(spark, timeplan.resized(F.lit(48), F.lit(64), F.lit(32)))) == (24, 32)
    h, w = one(spark, timeplan.downscaled(F.lit(1080), F.lit(1920), 200_000))
    assert h % 28 == w % 28 == 0 and h * w <= 200_000


def test_telemetry(spark):
    calls = spark.createDataFrame([("r", "a", 0, 10, 4.0), ("r", "a", 10, 20, None), ("r", "b", 15, 30, 2.0), ("r", None, 50, 40, 1.0)], "record_id string, stage string, start_perf_ns bigint, end_perf_ns bigint, output_tokens double")
    assert telemetry.busy_seconds(calls, ("record_id",)).first()["inference_wall_time_s"] == 30 / 1e9
    assert telemetry.call_totals(calls).first()["output_tokens_coverage"] == 0.75
    values = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    row = views.distribution(values, "x").first()
    assert (row["p50"], round(row["p95"], 6), row["coverage"]) == (6.0, 18.5, 0.8)
    events = spark.createDataFrame([("r", "answer", 1000, None, 500_001_000, 900_001_000), ("r", "answer", 1000, None, 700_001_000, 950_001_000)], "record_id string, kind string, query_dispatch_perf_ns bigint, query_id string, first_token_perf_ns bigint, response_completion_perf_ns bigint")
    full = events.withColumns({"semantic_query_arrival_perf_ns": F.lit(None).cast("bigint"), "ttft_ms": F.lit(None).cast("double"), "response_total_ms": F.lit(None).cast("double")})
    assert [(r["ttft_ms"], r["response_total_ms"]) for r in telemetry.query_groups(full).collect()] == [(500.0, 950.0)]


def test_restamping(spark):
    rows = spark.createDataFrame([("answer", None, 3_000_000_000, 0.0)], "kind string, first_token_perf_ns bigint, core_event_receive_perf_ns bigint, logical_time_s double")
    rows = rows.withColumns({"session_close_event": F.lit(False), "within_evaluation_end": F.lit(None).cast("boolean"), "eligible_for_scoring": F.lit(None).cast("boolean"), "suppression_reason": F.lit(None).cast("string")})
    row = enrich.restamp_answers(rows, F.lit(1_000_000_000), F.lit(0.0), F.lit(10.0)).first()
    assert (row["logical_time_s"], row["evaluation_time_source"], row["within_evaluation_end"]) == (2.0, "core_event_receive_perf_ns", True)
    assert enrich.restamp_answers(rows, F.lit(1_000_000_000), F.lit(0.0), F.lit(2.0)).first()["suppression_reason"] == "after_evaluation_end"


def test_validation_and_gates(spark):
    q = spark.createDataFrame([("a", 2.0, 1.0), ("b", 1.0, 2.0), ("c", float("nan"), 0.0)], "record_id string, question_time_s double, evidence_anchor_s double")
    assert [r["problems"] for r in validation.question_problems(q).orderBy("record_id").collect()] == [[], ["anchor_after_question"], ["question_time"]]
    assert validation.unknown_ids(spark.createDataFrame([("a", 0), ("z", 1)], "record_id string, pos int"), q, "record_id").first()["record_id"] == "z"
    assert validation.differences(q.limit(0), q.limit(0)).count() == 0
    runs = spark.createDataFrame([("proactive", True, False, "logical", False, False, "Native Streaming", {"submitted_frames": 1.0}, True, 1)], "task string, synthetic boolean, provisional boolean, pacing string, proactive_primary_eligible boolean, triggers_complete boolean, visual_state string, coverage map<string,double>, gpu_attribution_ok boolean, judge_errors int")
    row = gates.ineligibility(runs).first()
    assert not row["official_eligible"]
    assert "judge_incomplete" in row["reasons"] and "incomplete_telemetry:submitted_frames" not in row["reasons"] and "incomplete_telemetry:response_first_token" not in row["reasons"]
    board = gates.leaderboard(spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", None)], "g string, m double"), "g", "m").orderBy("place").collect()
    assert [r["is_best"] for r in board] == [True, True, False]


def test_union_total_equals_one_sort(spark):
    from tidelog.operators.sweep import union_length, union_total

    rows = spark.range(3000).selectExpr("cast(id * 7919 % 100000 as bigint) as s", "cast(id * 7919 % 100000 + id % 97 - 3 as bigint) as e")
    rows = rows.unionAll(spark.createDataFrame([(5, 5), (5, 90_000), (None, 4), (4, None)], "s long, e long"))
    for some in (rows, rows.where("e < 40000"), rows.where("s = 5"), rows.where("s is null")):
        want = union_length(some, [], "s", "e").first()["length"]
        assert [union_total(some, "s", "e", n).first()["length"] for n in (1, 2, 4096)] == [want] * 3


def test_gpu_devices_keep_the_first_sample_and_the_largest_bytes(spark):
    from tidelog.operators.telemetry import gpu_devices

    device = "uuid string, device_id string, name string, baseline_bytes long, peak_bytes long"
    rows = [
        (2, {"gpu": {"devices": [("a", None, "later", 9, 4)]}}),
        (1, {"gpu": {"devices": [("a", "7", "first", 1, 8), ("", "1", "second", None, 2), (None, None, None, 3, None)]}}),
        (3, {"gpu": None}),
    ]
    events = spark.createDataFrame(rows, f"event_index int, telemetry struct<gpu: struct<devices: array<struct<{device.replace(' ', ': ').replace(',:', ',')}>>>>")
    got = {r["device"]: (r["device_id"], r["name"], r["baseline_bytes"], r["peak_bytes"]) for r in gpu_devices(events).collect()}
    assert got == {"a": ("7", "first", 9, 8), "1": ("1", "second", None, 2), "unknown": (None, None, 3, None)}


def greedy(wins, times, inclusive=False, fallback=True):
    """What each window takes, by trying all episodes."""
    used, out = set(), []
    for a, b in wins:
        inside = [k for k, t in times if k not in used and a <= t and (t <= b if inclusive else t < b)]
        before = [k for k, t in times if k not in used and t < a] if fallback and not inside else []
        out.append((min(inside) if inside else None, max(before) if before else None))
        used |= {x for x in out[-1] if x is not None}
    return out


@pytest.mark.parametrize("boundary", ["half_open", "inclusive"])
def test_assignment_of_plain_and_odd_records(spark, boundary):
    """Tied, touching, nested and unordered windows, and episodes that aren't in order of time."""
    import random

    rng, specs, said, expected = random.Random(8), [], [], {}
    for r in range(120):
        starts = sorted(rng.randint(0, 12) for _ in range(rng.randint(1, 7)))
        wins = [(float(s), float(min([s + rng.choice((0, 2, 4)) if r % 2 else s + 3, *[n for n in starts if n > s]]))) for s in starts]
        if r % 4 == 3:
            rng.shuffle(wins)
        times = [rng.randint(0, 40) / 3 for _ in range(rng.randint(0, 9))]
        times = list(enumerate(times if r % 5 == 0 else sorted(times)))
        specs += [(f"{r}", i, a, b, b) for i, (a, b) in enumerate(wins)]
        said += [(f"{r}", k, t) for k, t in times]
        expected |= {(f"{r}", i): a if a is not None else b for i, (a, b) in enumerate(greedy(wins, times, boundary == "inclusive"))}
    s = spark.createDataFrame(specs, "record_id string, position int, start_s double, end_s double, eventual_end_s double")
    e = spark.createDataFrame(said, "record_id string, episode int, t double")
    assert {(x["record_id"], x["position"]): x["episode"] for x in assignment.assign_strict(s, e, boundary).collect()} == expected
    flags = assignment._rows(s.drop("eventual_end_s"), e, boundary).groupBy("record_id").agg({"plain": "min"}).collect()
    assert {r[1] for r in flags} == {True, False}


def test_assignment_in_long_records(spark):
    """50,000 windows and episodes in one record, plain, and 20,000 that overlap; both in seconds, not hours."""
    import bisect
    import random

    rng = random.Random(2)
    times = sorted(rng.random() * 50_000 for _ in range(50_000))
    said = spark.createDataFrame([("a", k, t) for k, t in enumerate(times)], "record_id string, episode int, t double")
    specs = spark.range(50_000).selectExpr("'a' AS record_id", "CAST(id AS int) AS position", "CAST(id AS double) AS start_s", "id + 0.5D AS end_s")
    found = {r.position: r.source for r in assignment.assign_strict(specs, said).collect()}
    free = [0] * 50_000  # episodes of each second's second half go to a later window without any inside
    inside = [0] * 50_000
    for t in times:
        (inside if t % 1 < 0.5 else free)[int(t)] += 1
    left, expected = 0, {}
    for k in range(50_000):
        expected[k] = "in_window" if inside[k] else "before_window" if left else "no_output"
        left += free[k] + max(0, inside[k] - 1) - (not inside[k] and left > 0)
    assert found == expected
    wide = [(float(k), k + 100.0) for k in range(20_000)]
    got = assignment.assign_in_order(wide, list(enumerate(times)))
    following = 0
    for (start, end), (inside, _) in zip(wide, got, strict=True):
        following = max(following, bisect.bisect_left(times, start))
        assert inside == (following if times[following] < end else None)
        following += inside is not None

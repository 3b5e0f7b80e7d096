"""Run-time assignment, next triggers, exact percentiles, hashes of files, drift, event sources and rollups."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import assignment, episodes, quantiles, scoring, validation, windows
from tidelog.sources import filehash


def test_run_time_assignment(spark):
    rng, specs, said, expected = random.Random(6), [], [], set()
    for r in range(80):
        starts = sorted(rng.randint(0, 12) for _ in range(rng.randint(1, 6)))
        wins = [(float(s), s + float(rng.choice((0, 2, 6)))) for s in starts] if r % 2 else [(float(s), float(min([s + 3, *[n for n in starts if n > s]]))) for s in starts]
        times = sorted(rng.randint(0, 40) / 3 for _ in range(rng.randint(0, 8)))
        specs += [(f"{r}", i, a, b) for i, (a, b) in enumerate(wins)]
        said += [(f"{r}", k, t) for k, t in enumerate(times)]
        used = set()
        for k, t in enumerate(times):
            free = [i for i, (a, b) in enumerate(wins) if i not in used and a <= t < b]
            if free:
                used.add(free[0])
                expected.add((f"{r}", free[0], k))
    s = spark.createDataFrame(specs, "record_id string, position int, start_s double, end_s double")
    e = spark.createDataFrame(said, "record_id string, episode int, t double")
    assert {tuple(r) for r in assignment.assign_at_run_time(s, e).collect()} == expected


def test_run_time_latency(spark):
    """The tolerance lets an observation just before the start count; the first arrival told counts; none is negative."""
    specs = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 1, 3.0, 6.0), ("b", 0, 1.0, 3.0)], "record_id string, position int, start_s double, end_s double")
    said = spark.createDataFrame([("a", 0, 1.5, None, 40, 99), ("a", 1, 2.0, None, 50, 99), ("a", 2, 4.0, 10, 70, 99), ("b", 0, 2.0, None, None, None)], "record_id string, episode int, t double, scoring_perf_ns bigint, first_token_perf_ns bigint, arrival_perf_ns bigint")
    seen = spark.createDataFrame([("a", 0.5, 0, 5), ("a", 1.0 - 5e-10, 1, None), ("a", 1.0 - 4e-10, 2, 20), ("a", 3.0, 3, 30), ("b", 1.0, 0, 1)], "record_id string, t double, event_index int, arrival_ns bigint")
    rows = scoring.run_time_latency(specs, said, seen).collect()
    assert [(r.record_id, r.episode, r.position, r.trigger_arrival_ns, r.response_arrival_ns, r.latency_ms) for r in rows] == [("a", 0, 0, 20, 40, 2e-05)]


def test_next_triggers(spark):
    rng, rows = random.Random(1), []
    for r in range(60):
        n = rng.randint(1, 9)
        starts = [rng.choice((None, *range(6))) if r % 10 == 9 else rng.randint(0, 6) for _ in range(n)]
        rows += [(f"{r}", i, None if x is None else float(x), "kept") for i, x in enumerate(sorted(starts) if r % 3 == 0 and None not in starts else starts)]
    table = spark.createDataFrame(rows, "record_id string, position int, start_s double, other string")
    after = lambda r, i, x: next((s for q, k, s, _ in rows if q == r and k > i and None not in (s, x) and s > x), None)
    got = {(x["record_id"], x["position"]): (x["next_trigger_s"], x["other"]) for x in windows.next_triggers(table).collect()}
    assert got == {(r, i): (after(r, i, x), "kept") for r, i, x, _ in rows}


def test_next_triggers_of_a_long_record(spark):
    """50,000 windows in one record whose starts fall, then rise: linear, whatever the order."""
    table = spark.range(50_000).selectExpr("'a' AS record_id", "CAST(id AS int) AS position", "CAST(abs(25000 - id) AS double) AS start_s")
    got = {r.position: r.next_trigger_s for r in windows.next_triggers(table).select("position", "next_trigger_s").collect()}
    assert got[0] is None and all(got[k] == (25_000.0 - k + 1 if k > 1 else None) for k in range(1, 25_000))
    assert got[25_000] == 1.0 and got[49_999] is None


@pytest.mark.parametrize("kind", ["smooth", "tied", "outliers", "few", "constant", "nan", "empty"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(2)
    values = {
        "smooth": rng.normal(size=20_000),
        "tied": np.round(rng.normal(size=20_000)),
        "outliers": np.concatenate([rng.normal(size=5_000), [1e300, -1e300, 1e18]]),
        "few": np.array([3.0, 1.0]),
        "constant": np.full(1_000, 7.25),
        "nan": np.concatenate([np.arange(10.0), [math.nan]]),
        "empty": np.array([]),
    }[kind]
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = quantiles.exact_percentiles(table, "x", qs)
    if kind == "empty":
        assert got == [None] * 5
    else:
        ordered = np.sort(values)
        at = lambda q: ordered[math.floor(q * (len(values) - 1))] * (1 - q * (len(values) - 1) % 1) + ordered[math.ceil(q * (len(values) - 1))] * (q * (len(values) - 1) % 1) if q * (len(values) - 1) % 1 else ordered[int(q * (len(values) - 1))]
        assert got == pytest.approx([at(q) for q in qs], rel=1e-12, nan_ok=True)


def test_file_states(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for name, text in (("a.txt", "one"), ("sub dir/b+c.txt", "two"), ("new.bin", ""), ("out/x", "left out")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    told = {"a.txt": sha("one"), "sub dir/b+c.txt": sha("other"), "gone": sha("")}
    states = {r.path: r.state for r in filehash.compare(spark, str(tmp_path), told, ("out",)).collect()}
    assert states == {"a.txt": "same", "sub dir/b+c.txt": "changed", "gone": "missing", "new.bin": "unlisted"}


def test_event_drift(spark):
    event = "struct<kind: string, text: string, telemetry: struct<n: int>>"
    make = lambda *texts: [("answer", t, (len(t),)) for t in texts]
    rows = [("same", make("x", "y")), ("swapped", make("y", "x")), ("nested", [("answer", "x", (1,)), ("answer", "y", (9,))]), ("cut", make("x")), ("empty", []), ("none", None), ("unlogged", make("x")), ("twice", make("x", "x"))]
    log = [(r, i, "answer", t, (1,)) for r in ("same", "swapped", "nested", "cut", "none") for i, t in ((5, "x"), (9, "y"))] + [("twice", 0, "answer", "z", (1,)), ("twice", 1, "answer", "z", (1,))]
    records = spark.createDataFrame(rows, f"record_id string, events array<{event}>")
    events = spark.createDataFrame(log, "record_id string, event_index int, kind string, text string, telemetry struct<n: int>")
    assert {r.record_id: r.state for r in validation.event_drift(records, events).collect()} == {
        "same": "same", "swapped": "differs", "nested": "differs", "cut": "differs", "empty": "same", "none": "not_embedded", "unlogged": "differs", "twice": "differs",
    }


def test_event_sources(spark):
    step = "struct<step_t: double, prediction: string, ttft_ms: double>"
    records = spark.createDataFrame(
        [("own", [("e", "answer", 1.0, "x", (2.0,))], [(0.0, "old", None)]), ("old", [], [(0.5, None, None), None, (None, "said", 3.0), (2.0, " WAIT ", None)]), ("none", None, None)],
        f"record_id string, events array<struct<event_id: string, kind: string, logical_time_s: double, text: string, telemetry: struct<ttft_ms: double>>>, model_steps array<{step}>",
    )
    rows = sorted(tuple(r) for r in episodes.events_of(records).collect())
    assert rows == [
        ("old", 0, "legacy-step-0", "wait", 0.5, "WAIT", (None,)), ("old", 1, "legacy-step-2", "answer", 0.0, "said", (3.0,)), ("old", 2, "legacy-step-3", "wait", 2.0, "WAIT", (None,)), ("own", 0, "e", "answer", 1.0, "x", (2.0,)),
    ]
    assert {r.record_id: r.source for r in episodes.event_source(records, False).collect()} == {"own": "embedded", "old": "legacy", "none": "none"}
    nothing = spark.createDataFrame([], "record_id string, kind string")
    assert episodes.events_of(records, nothing).count() == 0 and {r.source for r in episodes.event_source(records, True).collect()} == {"sidecar"}
    assert [r.event_id for r in episodes.events_of(records.drop("events").where("record_id = 'old'")).orderBy("event_index").collect()] == ["legacy-step-0", "legacy-step-2", "legacy-step-3"]


def test_last_predictions(spark):
    records = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "stored"), ("d", None)], "record_id string, prediction string")
    log = [("a", 0, "answer", "A", "r", "delta", 1), ("a", 1, "answer", ".", "r", "delta", 1), ("b", 0, "answer", "early", None, "complete", 5), ("b", 1, "answer", "late", None, "complete", None), ("c", 0, "wait", None, None, None, None)]
    events = episodes.resolve(spark.createDataFrame(log, "record_id string, event_index int, kind string, text string, response_id string, text_mode string, query_dispatch_perf_ns bigint"))
    assert {r.record_id: r.prediction for r in scoring.last_predictions(records, events).collect()} == {"a": "A.", "b": "early", "c": "stored", "d": ""}


def test_review_rollups(spark):
    rows = [("d1", "qa", "T", "edit", "h"), ("d1", "qa", "T", "remove", "h"), ("d2", "qa", None, None, "m")]
    found = {(r.rollup, r.dataset, r.mode, r.task_type, r.disposition, r.tier): (r.record_count, r.included_count, r.review_count) for r in validation.review_rollups(spark.createDataFrame(rows, "dataset string, mode string, task_type string, disposition string, tier string")).collect()}
    assert found[("dataset:mode", "d1", "qa", None, None, None)] == (2, 1, 2)
    assert found[("task_type", None, None, None, None, None)] == (1, 1, 0) and found[("all", None, None, None, None, None)] == (3, 2, 2)
    assert len(found) == 2 + 2 + 3 + 2 + 1

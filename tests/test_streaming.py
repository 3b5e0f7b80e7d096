"""Streaming operators: windows closed by timers, records let through whole, numbered commits."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators.assignment import assign_in_order
from tidelog.plans import stream_queries
from tidelog.streaming import commits, records, windows


@pytest.mark.parametrize("view", ["strict", "eventual"])
def test_windows_close_in_any_steps_as_in_one(view):
    """However the watermark moves, the windows take what the batch assignment over all of them gives."""
    rng = random.Random(4)
    for _ in range(200):
        marks = sorted((rng.randint(0, 30) / 2, k) for k in range(rng.randint(1, 9)))
        opened = [(t, k, t + rng.choice((0, 3, 9)) if rng.random() < 0.3 else None) for t, k in marks]
        said = sorted((rng.randint(0, 60) / 3, 100 + k) for k in range(rng.randint(0, 12)))
        ends = windows.window_ends(opened, 4.0, view, True)
        order = {k: i for i, (_, k) in enumerate(said)}
        whole = assign_in_order([(w[0], end) for w, end in zip(opened, ends, strict=True)], [(order[k], t) for t, k in said], fallback=view == "strict")
        expected = [said[a if a is not None else b][1] if (a, b) != (None, None) else None for a, b in whole]
        got, left, free, seen = [], [], [], -1.0
        for until in sorted(rng.randint(0, 30) for _ in range(4)) + [1e9]:
            left += [w for w in opened if seen <= w[0] < until]
            free += [s for s in said if seen <= s[0] < until]
            seen = until
            found, left, free = windows.close_windows(left, free, until, 4.0, view, until == 1e9)
            got += [index for _, index in found]
        assert got == expected


class Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Rows(Value):
    get = lambda self: iter(self.held or ())

    def appendList(self, rows):
        self.held = [*(self.held or ()), *rows]


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return Rows()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


class Pieces(Rows):
    def put(self, rows):
        self.held = rows


class Timers(Handle):
    """States, and the timers that are still to fire."""

    def getListState(self, *_):
        return Pieces()

    def registerTimer(self, at):
        assert at not in self.timers
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("view", ["strict", "eventual"])
def test_records_share_one_timer(view):
    """Rows of many records in any batches: at most one timer waits, and each record's windows are as by itself."""
    rng = random.Random(7)
    for _ in range(60):
        log, expected = [], []
        for record in range(-3, rng.randint(-2, 5)):
            opened = [(t, k, t + rng.choice((0, 3, 9)) if rng.random() < 0.3 else None) for k, t in enumerate(sorted(rng.randint(0, 60) / 2 for _ in range(rng.randint(0, 9))))]
            said = [(rng.randint(0, 90) / 3, 100 + k) for k in range(rng.randint(0, 12))]
            log += [(record, k, windows.TRIGGER, t, e) for t, k, e in opened] + [(record, k, windows.ANSWER, t, None) for t, k in said]
            log += [(record, 999, windows.END, 31.0, None), (record, 998, windows.OTHER, 1.0, None)]
            expected += [(record, n, source, index) for n, (source, index) in enumerate(windows.close_windows(opened, said, 1e9, 4.0, view, True)[0])]
        each = windows.WindowAssigner(4.0, view)
        each.init(handle := Timers())
        got, seen = [], -1.0
        for until in sorted(rng.randint(1, 30) for _ in range(4)) + [100]:
            rows = [r for r in log if seen <= r[3] < until]
            rng.shuffle(rows)
            seen = until
            if rows:
                frame = pd.DataFrame(rows, columns=["record_id", "event_index", "kind", "t", "state_end_s"]).astype({"state_end_s": "float64"})
                list(each.handleInputRows((0,), iter([frame[:2], frame[2:]]), Watermark(0)))
                assert len(handle.timers) <= 1
            for at in [t for t in handle.timers if t <= until * 1000]:
                for out in each.handleExpiredTimer((0,), Watermark(until * 1000), None):
                    got += [(r.record_id, r.position, r.source, None if r.event_index is pd.NA else r.event_index) for r in out.itertuples()]
                handle.timers.remove(at)
                assert len(handle.timers) <= 1
        assert sorted(got, key=lambda r: r[:2]) == expected
        assert not handle.timers and not each.rows.exists() and not each.due.exists()


def test_streamed_log_is_computed_once(spark, tmp_path):
    """The parts in which a log arrives are taken from one computation of it, which itself reads the events once."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    log = stream_queries.window_log(spark, "/root/testdata/sf0.001")
    assert log._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    counted = log.mapInPandas(count, log.schema)
    assert list(stream_queries.arrive(counted, 3600.0, str(tmp_path / "log"))) == [0, 1, 2, 3]
    rows = log.count()
    assert seen.value == rows and spark.read.parquet(str(tmp_path / "log")).count() == rows + 1


def test_record_gate_holds_until_grace_or_idleness():
    gate = records.RecordGate(grace_ms=100, idle_ms=1000)
    gate.init(handle := Handle())
    put = lambda *rows: list(gate.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["payload", "at_ms", "is_end"])]), Watermark(0)))
    fire = lambda at: [list(f["payload"]) + [f["closed_by"].iloc[0]] for f in gate.handleExpiredTimer((1,), Watermark(at), None)]
    put(("a", 10, False), ("b", 500, False))
    assert handle.timers == [1500] and fire(1499) == []
    put(("c", 700, True))
    assert handle.timers[-1] == 800 and fire(799) == []
    assert fire(800) == [["a", "b", "c", "end"]] and fire(1500) == []  # the stale timer finds nothing
    put(("late", 900, False))
    assert fire(1900) == [["late", "idle"]]


def test_commits(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "record_id bigint, v string")
    log = commits.CommitLog(spark, str(tmp_path), rows.schema, settings={"a": 1})
    assert log.table().count() == 0 and log.commit(rows.where("record_id < 3"), 0)
    with pytest.raises(InterruptedError):
        log.commit(rows, 1, lambda _: (_ for _ in ()).throw(InterruptedError()))
    assert log.table().count() == 3  # without a marker nothing is committed
    assert log.commit(rows.where("record_id < 5"), 1) and not log.commit(rows, 1)
    assert sorted(r[0] for r in log.table().collect()) == [0, 1, 2, 3, 4]
    assert {n: m["records"] for n, m in log.markers().items()} == {0: 3, 1: 2}
    with pytest.raises(ValueError):
        commits.CommitLog(spark, str(tmp_path), rows.schema, settings={"a": 2}).commit(rows, 2)


def test_commit_every_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("record_id"))
    work = lambda part: part.withColumn("square", F.col("record_id") * F.col("record_id"))
    log = commits.CommitLog(spark, str(tmp_path), work(rows).schema)
    assert commits.commit_every(log, rows, work, every=4, most=1) == 1
    assert commits.commit_every(log, rows, work, every=4) == 2
    assert {n: m["records"] for n, m in log.markers().items()} == {0: 4, 1: 4, 2: 2}
    assert sorted(r.square for r in log.table().collect()) == [k * k for k in range(10)]
    with pytest.raises(ValueError):
        commits.commit_every(log, rows.unionByName(spark.range(50, 51).toDF("record_id")), lambda part: work(part).limit(0), every=4)


def test_all_fields_differ_from_plain_assembly(spark):
    """The log that the streams assemble uses every rule: without the fields' help its episodes are others."""
    log = stream_queries.flat_log(spark, "/root/testdata/sf0.01").cache()
    whole = {tuple(r) for r in stream_queries.assembled(log).collect()}
    for field in ("sequence_id", "is_final", "response_decision", "telemetry"):
        kind = log.schema[field].dataType
        assert {tuple(r) for r in stream_queries.assembled(log.withColumn(field, F.lit(None).cast(kind))).collect()} != whole, field

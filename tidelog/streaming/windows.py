"""Windows and their episodes over a stream: a window closes when the watermark has passed its end.

Each record keeps its open windows, the answers that no window took yet, and how many windows have closed. Point
triggers last for the tolerance or up to the next distinct trigger, state intervals to their annotated end. When the
watermark has passed an end, all events before it are there, late ones too, so windows up to it are final and are
closed in order, by the rules of the batch assignment. A window that overlaps an earlier, longer one waits for it. At
the record's end mark the rest closes and the state goes.

A call into Python, a timer and an access to the state cost far more than a row. So 64 neighbouring record ids
share a state: new rows are appended to it as they are, packed, and one event-time timer, for the first end that
is possible, closes whatever is due in any of these records and sets the next.

Strict windows take the first free answer inside, else the last free one before. Eventual ones last to the next
trigger, however late, so they close when it or the end mark comes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The columns of the event log that the assignment reads; state_end_s is null for a point trigger.
LOG = ("record_id", "event_index", "kind", "t", "state_end_s")
ASSIGNED = "record_id bigint, position int, source string, event_index int"
#: Fixed: record ids that share a state, as a power of two, and the rows of a packed piece of it.
SHARED_BITS = 6
PIECE = 65_536
#: A row of the state. CLOSED has the number of a record's closed windows as its event_index.
TRIGGER, ANSWER, END, CLOSED, OTHER = 0, 1, 2, 3, -1
ROW = np.dtype([("record_id", "i8"), ("event_index", "i4"), ("kind", "i1"), ("t", "f8"), ("state_end_s", "f8")])

Open = tuple[float, int, float | None]
Said = tuple[float, int]


def window_ends(windows: list[Open], tolerance: float, view: str, ended: bool) -> list[float | None]:
    """The end of each window of a sorted list, None where it isn't known yet."""
    ends: list[float | None] = []
    later, now = None, None  # the next start after `now`, the start that was seen last
    for start, _, state_end in reversed(windows):
        if now is not None and now > start:
            later = now
        now = start
        if state_end is not None:
            ends.append(max(state_end, start))
        elif view == "strict":
            ends.append(start + tolerance if later is None else min(start + tolerance, later))
        else:
            ends.append(later if later is not None else start + tolerance if ended else None)
    return ends[::-1]


def close_windows(windows: list[Open], said: list[Said], until: float, tolerance: float, view: str, ended: bool) -> tuple[list[tuple[str, int | None]], list[Open], list[Said]]:
    """What each window that ends by `until` takes, in order; the windows that stay open; the answers that stay free."""
    windows, free, out = sorted(windows, key=lambda w: w[:2]), sorted(said), []
    for (start, _, _), end in zip(windows, window_ends(windows, tolerance, view, ended), strict=True):
        if not ended and (end is None or end > until):
            break
        at = bisect_left(free, (start, -1))
        if at < len(free) and free[at][0] < end:
            out.append(("in_window" if view == "strict" else "eventual", free.pop(at)[1]))
        elif view == "strict" and at:
            out.append(("before_window", free.pop(at - 1)[1]))
        else:
            out.append(("no_output", None))
    return out, windows[len(out) :], free


def packed(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + PIECE].tobytes(),) for k in range(0, len(rows), PIECE)]


def by_record(rows: np.ndarray) -> Iterator[tuple[int, list[Open], list[Said], float | None, int]]:
    """Of each record: its id, windows, answers, end mark if there is one, and how many windows have closed."""
    rows = rows[np.lexsort((rows["event_index"], rows["t"], rows["kind"], rows["record_id"]))]
    times, indices, until = rows["t"].tolist(), rows["event_index"].tolist(), np.where(np.isnan(rows["state_end_s"]), None, rows["state_end_s"]).tolist()
    cuts = [0, *(np.flatnonzero((np.diff(rows["record_id"]) != 0) | (np.diff(rows["kind"]) != 0)) + 1).tolist(), len(rows)]
    runs = zip(rows["record_id"][cuts[:-1]].tolist(), rows["kind"][cuts[:-1]].tolist(), cuts, cuts[1:])
    for record, found in groupby(runs, key=lambda run: run[0]):
        at = {kind: slice(start, stop) for _, kind, start, stop in found}
        opened, said, ends, closed = (at.get(kind, slice(0, 0)) for kind in (TRIGGER, ANSWER, END, CLOSED))
        windows = list(zip(times[opened], indices[opened], until[opened], strict=True))
        yield record, windows, list(zip(times[said], indices[said], strict=True)), max(times[ends], default=None), sum(indices[closed])


class WindowAssigner(StatefulProcessor):
    def __init__(self, tolerance: float, view: str) -> None:
        self.tolerance, self.view = tolerance, view

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces, first = [], math.inf
        for frame in rows:
            frame = frame[frame["kind"] != OTHER]
            new = np.empty(len(frame), ROW)
            for name in ROW.names:
                new[name] = frame[name].to_numpy()
            pieces += packed(new)
            # A trigger may end an earlier window, and none of its own ends before it.
            first = new["t"][new["kind"] != ANSWER].min(initial=first)
        if pieces:
            self.rows.appendList(pieces)
        if first < math.inf:
            self._wake(math.ceil(first * 1000), self.due.get()[0] if self.due.exists() else None)
        return iter(())

    def _wake(self, at: int, before: int | None) -> None:
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] > now:
            return
        until, due, found, kept = now / 1000, math.inf, [], []
        for record, windows, said, end, done in by_record(np.concatenate([np.frombuffer(r[0], ROW) for r in self.rows.get()])):
            ended = end is not None and end <= until
            taken, windows, said = close_windows(windows, said, until, self.tolerance, self.view, ended)
            found += [(record, done + k, source, index) for k, (source, index) in enumerate(taken)]
            if ended:
                continue
            kept += [(record, index, TRIGGER, t, math.nan if e is None else e) for t, index, e in windows]
            kept += [(record, index, ANSWER, t, math.nan) for t, index in said]
            if done + len(taken):
                kept.append((record, done + len(taken), CLOSED, math.nan, math.nan))
            if end is not None:
                kept.append((record, 0, END, end, math.nan))
                due = min(due, end)
            if windows and (first := window_ends(windows, self.tolerance, self.view, False)[0]) is not None:
                due = min(due, first)
        self.rows.put(packed(np.array(kept, ROW))) if kept else self.rows.clear()
        self.due.clear()
        if due < math.inf:
            self._wake(max(math.ceil(due * 1000), now + 1), None)
        if found:
            yield pd.DataFrame(found, columns=["record_id", "position", "source", "event_index"]).astype({"event_index": "Int64"})

    def close(self) -> None:
        pass


def assign_stream(log: DataFrame, tolerance: float, view: str = "strict") -> DataFrame:
    """(record_id, position, source, event_index of the answer) of a streaming log with LOG's columns and a watermark.

    The state store has to be RocksDB's.
    """
    if view not in ("strict", "eventual"):
        raise ValueError("the view is strict or eventual")
    kind = F.when(F.col("record_id").isNull(), OTHER).when(F.col("kind") == "trigger", TRIGGER).when(F.col("kind") == "answer", ANSWER).when(F.col("kind") == "end", END).otherwise(OTHER)
    rows = log.withColumns({"kind": kind.cast("tinyint"), "record_id": F.coalesce("record_id", F.lit(0))}).withColumn("share", F.shiftright("record_id", SHARED_BITS))
    return rows.groupBy("share").transformWithStateInPandas(WindowAssigner(tolerance, view), ASSIGNED, "append", "eventTime")

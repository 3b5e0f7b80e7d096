"""Records of a stream, let through whole when a timer says that they are over.

Sequence numbers order a record's events only once all of them are there. So a record's rows are held in the state
until its end mark plus the grace time, or until it has been silent for the idle time, whichever its rows call for
when the timer fires. Then all go out at once, and a batch operator does the rest in built-in functions: the rules of
assembly are written down once. The state of a record ends with it; rows that come later form a record of their own,
which a commit log of record ids rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

RELEASED = "record_id bigint, payload string, closed_by string"


class RecordGate(StatefulProcessor):
    def __init__(self, grace_ms: int, idle_ms: int) -> None:
        self.grace_ms, self.idle_ms = grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "payload string")
        self.times = handle.getValueState("times", "last_ms bigint, end_ms bigint")

    def _due(self, last: int, end: int | None) -> int:
        return last + self.idle_ms if end is None else end + self.grace_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, end = self.times.get() if self.times.exists() else (0, None)
        held = []
        for frame in rows:
            held += [(p,) for p in frame["payload"]]
            last = max(last, int(frame["at_ms"].max()))
            if (ends := frame.loc[frame["is_end"], "at_ms"]).size:
                end = max(int(ends.max()), end or 0)
        self.rows.appendList(held)
        self.times.update((last, end))
        self.handle.registerTimer(self._due(last, end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.times.exists():
            return
        last, end = self.times.get()
        if self._due(last, end) > timerValues.getCurrentWatermarkInMs():
            return  # rows came since; theirs is another timer
        found = [row[0] for row in self.rows.get()]
        yield pd.DataFrame({"record_id": key[0], "payload": found, "closed_by": "idle" if end is None else "end"})
        self.rows.clear()
        self.times.clear()

    def close(self) -> None:
        pass


def whole_records(log: DataFrame, ts: str, grace_s: float, idle_s: float) -> DataFrame:
    """The rows of a streaming log (record_id, kind, ts and any others), each record's at once: see RELEASED.

    An event of kind end marks a record's end. The payload has the whole row; :func:`unpacked` gets it back. The log
    needs a watermark on ts, and the state store has to be RocksDB's.
    """
    packed = log.select("record_id", ts, F.unix_millis(F.col(ts)).alias("at_ms"), F.coalesce(F.col("kind") == "end", F.lit(False)).alias("is_end"), F.to_json(F.struct(*(c for c in log.columns if c not in ("record_id", ts))), {"ignoreNullFields": "true"}).alias("payload"))
    gate = RecordGate(round(grace_s * 1000), round(idle_s * 1000))
    return packed.groupBy("record_id").transformWithStateInPandas(gate, RELEASED, "append", "eventTime")


def unpacked(released: DataFrame, log: StructType, ts: str) -> DataFrame:
    """The rows that went into :func:`whole_records`, without their timestamps and end marks."""
    inner = StructType([f for f in log.fields if f.name not in ("record_id", ts)])
    rows = released.select("record_id", F.from_json("payload", inner).alias("row"))
    return rows.select("record_id", "row.*").where("kind is null or kind <> 'end'")

"""Episode assembly over a stream of events: state by record, given out when the record ends.

Sequence numbers order events only when all of a record's events are there, so a record's events are held as state
until its end mark comes, and are then assembled by the batch operator's rules. The source has to mark every
record's end: without it, a record stays in the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "record_id bigint, event_index int, kind string, logical_time_s double, text string, response_id string, text_mode string, is_final boolean"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
EPISODE = "record_id bigint, response_id string, start_s double, end_s double, parts bigint, text string"


class _Open:
    """The open episodes of one record, in the order in which they began."""

    def __init__(self) -> None:
        self.parts: dict[str, list[dict[str, Any]]] = {}
        self.done: list[list[dict[str, Any]]] = []

    def close(self, name: str | None = None) -> None:
        for key in [name] if name is not None else list(self.parts):
            if key in self.parts:
                self.done.append(self.parts.pop(key))


def _glue(parts: list[dict[str, Any]]) -> str:
    text = ""
    for p in parts:
        if p["mode"] == "snapshot":
            text = p["body"]
        else:
            text += (" " if text and text[-1].isalnum() and p["body"][0].isalnum() else "") + p["body"]
    return text


def assemble_rows(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The episodes of one record's events, all eligible and unnumbered: (response_id, start_s, end_s, parts, text)."""
    state = _Open()
    for r in sorted(rows, key=lambda r: r["event_index"]):
        body, mode = (r["text"] or "").strip(), (r["text_mode"] or "complete").lower()
        name = r["response_id"] or ""
        if r["kind"] in ("wait", "failure"):
            state.close()
        elif r["kind"] == "answer" and body:
            part = {"body": body, "mode": mode, "t": r["logical_time_s"] or 0.0, "index": r["event_index"], "id": name or f"legacy-{r['event_index']}"}
            if mode in ("delta", "snapshot") and name:
                state.parts.setdefault(name, []).append(part)
                if r["is_final"]:
                    state.close(name)
            else:
                state.close()
                state.done.append([part])
    state.close()
    ordered = sorted(state.done, key=lambda p: (p[0]["t"], p[0]["index"]))
    return [{"response_id": p[0]["id"], "start_s": p[0]["t"], "end_s": p[-1]["t"], "parts": len(p), "text": _glue(p)} for p in ordered]


def assemble_stream(events: DataFrame) -> DataFrame:
    """Episodes of a streaming event log with the columns of LOG; an event of kind end ends its record."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held += frame[COLUMNS[1:]].astype(object).where(frame[COLUMNS[1:]].notna(), None).itertuples(index=False, name=None)
        held = [tuple(h) for h in held]
        if not any(h[1] == "end" for h in held):
            state.update((held,))
            return
        if state.exists:
            state.remove()
        found = assemble_rows([dict(zip(COLUMNS[1:], h, strict=True)) for h in held])
        yield pd.DataFrame([{"record_id": key[0], **f} for f in found], columns=["record_id", "response_id", "start_s", "end_s", "parts", "text"])

    inner = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in LOG.split(", ")[1:])
    return events.groupBy("record_id").applyInPandasWithState(step, EPISODE, f"events array<struct<{inner}>>", "append", GroupStateTimeout.NoTimeout)

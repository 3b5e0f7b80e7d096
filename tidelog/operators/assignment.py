"""One-to-one assignment of answered episodes to windows, in order of the windows.

A record is plain if its windows come in order of their starts without overlapping, but for windows that are equal,
and if its episodes come in order of time. Plain records need no loop: the k-th of equal windows takes the k-th
episode inside, and what is left over is matched like brackets. Time runs over episodes that no window took (each
opens a bracket) and windows that took none (each closes the last one open), so running counts pair them. All of it is
sorts under one shuffle by record. The others go through their windows one by one over a tree of free episodes, record
by record, in logarithmic time a window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inside(t: Column, end: Column, boundary: str) -> Column:
    if boundary not in ("half_open", "inclusive"):
        raise ValueError("the boundary is half_open or inclusive")
    return t <= end if boundary == "inclusive" else t < end


def _rows(windows: DataFrame, episodes: DataFrame, boundary: str) -> DataFrame:
    """Windows (kind 0) and episodes (kind 1) in one table, and whether their record is plain."""
    w = windows.select("record_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), F.col("position").alias("number"), F.struct("start_s", "end_s").alias("held"))
    e = episodes.select("record_id", "t", F.lit(1).alias("kind"), F.col("episode").alias("number"), F.lit(None).cast(w.schema["held"].dataType).alias("held"))
    told = Window.partitionBy("record_id", "kind").orderBy("number")
    held, last = F.lag("held").over(told), F.lag("t").over(told)
    apart = F.col("t") > held["end_s"] if boundary == "inclusive" else F.col("t") >= held["end_s"]
    window_ok = held.isNull() | (F.col("held") == held) | ((F.col("t") >= held["start_s"]) & apart)
    rows = w.unionByName(e).withColumn("ok", F.when(F.col("kind") == 0, window_ok).otherwise(last.isNull() | (F.col("t") >= last)))
    return rows.withColumn("plain", F.min("ok").over(Window.partitionBy("record_id"))).drop("ok")


def _plain(rows: DataFrame, boundary: str, fallback: bool) -> DataFrame:
    """(record_id, position, inside, before) of plain records."""
    order = ("t", "kind", "number")
    in_time = Window.partitionBy("record_id").orderBy(*order)
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.last("held", ignorenulls=True).over(so_far))
    within = (F.col("kind") == 0) | F.coalesce(_inside(F.col("t"), F.col("held.end_s"), boundary), F.lit(False))
    rows = rows.withColumn("at", F.when(within, F.col("held")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("record_id", "at", "kind").orderBy("t", "number")))
    pair = Window.partitionBy("record_id", "at", "rank")
    rows = rows.withColumns({"inside": F.when(F.col("at").isNotNull(), F.max(F.when(F.col("kind") == 1, F.col("number"))).over(pair)), "asked": F.col("at").isNotNull() & (F.min("kind").over(pair) == 0)})
    found = ["record_id", F.col("number").alias("position"), "inside"]
    if not fallback:
        return rows.where("kind = 0").select(*found, F.lit(None).cast("int").alias("before"))
    step = F.when((F.col("kind") == 0) & F.col("inside").isNull(), -1).when((F.col("kind") == 1) & ~F.col("asked"), 1).otherwise(0)
    rows = rows.withColumn("step", step).withColumn("sum", F.sum("step").over(so_far))
    rows = rows.withColumn("least", F.least(F.lit(0), F.min("sum").over(so_far)))
    alone = (F.col("step") < 0) & (F.col("sum") < F.coalesce(F.lag("least").over(in_time), F.lit(0)))
    depth = F.col("sum") - F.col("least") + F.when(F.col("step") < 0, 1).otherwise(0)
    rows = rows.withColumn("level", F.when((F.col("step") != 0) & ~alone, depth))
    opened = F.lag("number").over(Window.partitionBy("record_id", "level").orderBy(*order))
    rows = rows.withColumn("before", F.when((F.col("step") < 0) & F.col("level").isNotNull(), opened))
    return rows.where("kind = 0").select(*found, "before")


class FreeEpisodes:
    """Episodes in order of time; the least and greatest free number in a range of times, as a tree over the range."""

    def __init__(self, episodes: list[tuple[int, float]]) -> None:
        found = sorted((t, k) for k, t in episodes)
        self.times = [t for t, _ in found]
        self.place = {k: i for i, (_, k) in enumerate(found)}
        self.size = len(found)
        self.least: list = [None] * self.size + [k for _, k in found]
        for i in range(self.size - 1, 0, -1):
            self._join(i)
        self.most: list = list(self.least)
        for i in range(self.size - 1, 0, -1):
            self.most[i] = self._pick(max, self.most[2 * i], self.most[2 * i + 1])

    @staticmethod
    def _pick(best, a, b):
        return b if a is None else a if b is None else best(a, b)

    def _join(self, i: int) -> None:
        self.least[i] = self._pick(min, self.least[2 * i], self.least[2 * i + 1])

    def _find(self, tree: list, best, a: int, b: int):
        out, a, b = None, a + self.size, b + self.size
        while a < b:
            if a & 1:
                out, a = self._pick(best, out, tree[a]), a + 1
            if b & 1:
                b -= 1
                out = self._pick(best, out, tree[b])
            a, b = a >> 1, b >> 1
        return out

    def first(self, start: float, end: float, inclusive: bool) -> int | None:
        """The first free episode from start to end."""
        return self._find(self.least, min, bisect_left(self.times, start), (bisect_right if inclusive else bisect_left)(self.times, end))

    def last_before(self, start: float) -> int | None:
        return self._find(self.most, max, 0, bisect_left(self.times, start))

    def take(self, episode: int) -> None:
        i = self.place[episode] + self.size
        self.least[i] = self.most[i] = None
        while i := i >> 1:
            self._join(i)
            self.most[i] = self._pick(max, self.most[2 * i], self.most[2 * i + 1])


def assign_in_order(windows: list[tuple[float, float]], episodes: list[tuple[int, float]], inclusive: bool = False, fallback: bool = True) -> list[tuple[int | None, int | None]]:
    """For each window (start, end), in order, the free episode (number, time) that it takes: (inside, before)."""
    free, out = FreeEpisodes(episodes), []
    for start, end in windows:
        inside = free.first(start, end, inclusive)
        before = free.last_before(start) if fallback and inside is None else None
        if (found := before if inside is None else inside) is not None:
            free.take(found)
        out.append((inside, before))
    return out


def _in_order(rows: DataFrame, choose) -> DataFrame:
    """(record_id, position, inside, before) of any records; choose gives a row for each of a record's windows
    (start, end), in order of their positions, over its episodes (number, time)."""
    key = rows.schema["record_id"].dataType.simpleString()

    def assign(group: pa.Table) -> pa.Table:
        told = list(zip(group["kind"].to_pylist(), group["number"].to_pylist(), group["t"].to_pylist(), group["end_s"].to_pylist(), strict=True))
        windows = sorted(r[1:] for r in told if r[0] == 0)
        found = choose([w[1:] for w in windows], [r[1:3] for r in told if r[0] == 1])
        columns = {"record_id": group["record_id"].slice(0, len(windows)), "position": pa.array([w[0] for w in windows], pa.int32())}
        return pa.table(columns | {name: pa.array([f[k] for f in found], pa.int32()) for k, name in enumerate(("inside", "before"))})

    asked = rows.select("record_id", "kind", "number", "t", F.col("held.end_s").alias("end_s"))
    return asked.groupBy("record_id").applyInArrow(assign, f"record_id {key}, position int, inside int, before int")


def _told(specs: DataFrame, episodes: DataFrame, end: str, boundary: str) -> DataFrame:
    """The rows to assign; an end that is null is never reached, a start that is null never begins."""
    never, last = F.lit(float("-inf")), F.lit(float("inf"))
    until = F.when(F.col("start_s").isNull(), never).otherwise(F.coalesce(end, last))
    w = specs.select("record_id", F.col("position").cast("int").alias("position"), F.coalesce("start_s", never).alias("start_s"), until.alias("end_s"))
    e = episodes.where("t is not null").select("record_id", F.col("episode").cast("int").alias("episode"), F.col("t").cast("double").alias("t"))
    return _rows(w, e, boundary)


def _assign(specs: DataFrame, episodes: DataFrame, end: str, boundary: str, fallback: bool) -> DataFrame:
    """(record_id, position, inside, before)."""
    rows = _told(specs, episodes, end, boundary)
    odd = _in_order(rows.where("not plain"), lambda windows, said: assign_in_order(windows, said, boundary == "inclusive", fallback))
    return _plain(rows.where("plain"), boundary, fallback).unionByName(odd)


def assign_strict(specs: DataFrame, episodes: DataFrame, boundary: str = "half_open") -> DataFrame:
    """(record_id, position, source, episode): a window takes the first free episode inside it, else the last free
    one before it, else none. Either uses the episode up."""
    source = F.when(F.col("inside").isNotNull(), "in_window").when(F.col("before").isNotNull(), "before_window").otherwise("no_output")
    return _assign(specs, episodes, "end_s", boundary, True).select("record_id", "position", source.alias("source"), F.coalesce("inside", "before").alias("episode"))


def assign_eventual(specs: DataFrame, episodes: DataFrame) -> DataFrame:
    """(record_id, position, source, episode): the first free episode from the trigger to the eventual end."""
    source = F.when(F.col("inside").isNotNull(), "eventual").otherwise("no_output")
    return _assign(specs, episodes, "eventual_end_s", "half_open", False).select("record_id", "position", source.alias("source"), F.col("inside").alias("episode"))


def first_windows(windows: list[tuple[float, float]], episodes: list[tuple[int, float]]) -> list[tuple[int | None, None]]:
    """Episodes, in order of time, each to the first window in order that has it inside and has none yet.

    A heap has the windows that have begun; what is on its top and has ended never comes back.
    """
    begins, at, open_ = sorted((start, k) for k, (start, _) in enumerate(windows)), 0, []
    out: list[tuple[int | None, None]] = [(None, None)] * len(windows)
    for t, number in sorted((t, k) for k, t in episodes):
        while at < len(begins) and begins[at][0] <= t:
            heappush(open_, begins[at][1])
            at += 1
        while open_ and windows[open_[0]][1] <= t:
            heappop(open_)
        if open_:
            out[heappop(open_)] = (number, None)
    return out


def assign_at_run_time(specs: DataFrame, episodes: DataFrame) -> DataFrame:
    """(record_id, position, episode): in order of time each episode goes to the first window, by position, that holds
    it and has none yet; an episode that finds none has no row. Windows are half-open."""
    rows = _told(specs, episodes, "end_s", "half_open")
    found = _plain(rows.where("plain"), "half_open", False).unionByName(_in_order(rows.where("not plain"), first_windows))
    return found.where("inside is not null").select("record_id", "position", F.col("inside").alias("episode"))


def first_inside(specs: DataFrame, episodes: DataFrame, end: str = "end_s") -> DataFrame:
    """The first episode in each window, for windows that don't overlap: (record_id, position, episode, t).

    An episode's only candidate is then the last window that starts at or before it, so one ordered pass over windows
    and episodes decides, however many there are.
    """
    w = specs.select("record_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), F.struct("position", F.col(end).alias("end")).alias("window"), F.lit(None).cast("int").alias("episode"))
    e = episodes.select("record_id", "t", F.lit(1).alias("kind"), F.lit(None).cast(w.schema["window"].dataType).alias("window"), "episode")
    order = Window.partitionBy("record_id").orderBy("t", "kind", "episode")
    placed = w.unionByName(e).withColumn("window", F.last("window", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = placed.where("kind = 1 and window is not null").where(F.col("window.end").isNull() | (F.col("t") < F.col("window.end")))
    return inside.groupBy("record_id", F.col("window.position").alias("position")).agg(F.min(F.struct("episode", "t")).alias("e")).select("record_id", "position", "e.episode", "e.t")

"""Video-time arithmetic: timestamps, sampling plans, evidence intervals and frame geometry, as Columns.

Video time is seconds as DOUBLE; runtime is monotonic nanoseconds as BIGINT; they only meet in clock conversions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tolerance of comparisons of video times at run time.
EPSILON = 1e-9


def parse_timestamp(text: Column) -> Column:
    """Seconds of 'H:M:S', 'M:S' or 'S'; null text is 0, and what isn't a timestamp is null."""
    parts = F.transform(F.split(F.trim(text), ":", -1), lambda p: F.trim(p).try_cast("double"))
    last, minutes, hours = (F.element_at(parts, -k) for k in (1, 2, 3))
    sized = F.size(parts)
    return (
        F.when(text.isNull(), F.lit(0.0))
        .when(sized == 3, hours * 3600 + minutes * 60 + last)
        .when(sized == 2, minutes * 60 + last)
        .otherwise(F.element_at(parts, 1))
    )


def timestamp_plan(start_s: Column, end_s: Column, fps: Column) -> Column:
    """start, start + 1/fps, ... up to end, and the end itself if it lies between two steps; 9 decimals."""
    steps = F.greatest(F.lit(0), F.floor((end_s - start_s) * fps + EPSILON)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), steps), lambda i: F.round(start_s + i / fps, 9))
    end = F.round(end_s, 9)
    return F.when((fps > 0) & (end_s >= start_s), F.when(F.element_at(grid, -1) < end - EPSILON, F.concat(grid, F.array(end))).otherwise(grid))


def poll_schedule(start_s: Column, end_s: Column, step_s: Column) -> Column:
    """start, then one step on while that isn't past the end; each time is the one before plus the step, 9 decimals."""
    count = F.greatest(F.lit(0), F.floor((end_s - start_s + EPSILON) / step_s)).cast("int")
    first = F.array(F.round(start_s, 9))
    grown = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), first, lambda acc, _: F.concat(acc, F.array(F.round(F.element_at(acc, -1) + step_s, 9))))
    return F.filter(F.when(count > 0, grown).otherwise(first), lambda t: t <= end_s + EPSILON)


def video_time(ns: Column, run_start_ns: Column, video_start_s: Column) -> Column:
    return video_start_s + F.greatest(F.lit(0), ns - run_start_ns) / F.lit(1e9)


def scheduled_ns(time_s: Column, run_start_ns: Column, video_start_s: Column) -> Column:
    return run_start_ns + F.round((time_s - video_start_s) * F.lit(1e9)).cast("bigint")


def qa_evidence(anchor_s: Column, question_s: Column, window_s: float = 10.0) -> Column:
    return F.struct(F.greatest(F.lit(0.0), anchor_s - window_s).alias("start_s"), question_s.alias("end_s"))


def proactive_evidence(instruction_s: Column, evaluation_end_s: Column, duration_s: Column, history_s: float = 5.0) -> Column:
    """From before the instruction to the end of evaluation or of the video; an unknown duration doesn't limit it."""
    return F.struct(F.greatest(F.lit(0.0), instruction_s - history_s).alias("start_s"), F.least(duration_s, evaluation_end_s).alias("end_s"))


def evaluation_end(last_window_end_s: Column, instruction_s: Column) -> Column:
    return F.coalesce(last_window_end_s, F.greatest(F.lit(0.0), instruction_s))


def grace(evaluation_end_s: Column, duration_s: Column) -> Column:
    """How long to wait after the video's end; none if its duration is unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), evaluation_end_s - duration_s), F.lit(0.0))


def frame_index(time_s: Column, fps: Column, frames: Column) -> Column:
    return F.greatest(F.lit(0), F.least(frames - 1, F.floor(time_s * fps + 0.5)))


def frame_total(value: Column) -> Column:
    """A frame count as reported, rounded, or null if it isn't a positive finite number."""
    return F.when((value > 0) & (value < float("inf")), F.greatest(F.lit(1), F.floor(value + 0.5)))


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.try_divide(frames - 1, fps))


def resized(height: Column, width: Column, max_width: Column) -> Column:
    """(height, width) with the width capped, never enlarged."""
    fits = max_width.isNull() | (width <= max_width)
    scaled = F.greatest(F.lit(1), F.floor(height * max_width / width + 0.5))
    return F.struct(F.when(fits, height).otherwise(scaled).cast("bigint").alias("height"), F.when(fits, width).otherwise(max_width).cast("bigint").alias("width"))


def downscaled(height: Column, width: Column, max_pixels: int, factor: int = 28) -> Column:
    """(height, width) as multiples of factor within max_pixels; frames that fit stay as they are.

    The scaled sides exceed the limit by a few steps at most, so a bounded fold takes them back.
    """
    scale = F.sqrt(height * width / F.lit(float(max_pixels)))
    side = lambda n: F.greatest(F.lit(factor), (F.floor(n / scale / factor) * factor).cast("int"))
    start = F.struct(side(height).alias("h"), side(width).alias("w"))

    def step(s: Column, _: Column) -> Column:
        over = s["h"] * s["w"] > max_pixels
        tall = s["h"] >= s["w"]
        return F.struct(F.when(over & tall, s["h"] - factor).otherwise(s["h"]).alias("h"), F.when(over & ~tall, s["w"] - factor).otherwise(s["w"]).alias("w"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)
    small = (out["h"] < factor) | (out["w"] < factor)
    size = lambda key, n: F.when(height * width <= max_pixels, n).when(small, factor).otherwise(out[key]).cast("bigint")
    return F.struct(size("h", height).alias("height"), size("w", width).alias("width"))

"""Telemetry: calls, frames, queries, devices and coverage, without filling in what wasn't measured.

Measures stay null where they are missing and are left out of sums; a rate with nothing below it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.episodes import event_kind
from tidelog.operators.sweep import positive, union_length, union_total
from tidelog.operators.views import ratio, spread

#: The stage names of calls before and across a question's arrival.
HISTORY_STAGES = ("qa_history_processing", "history")
MIXED_STAGES = ("qa_mixed_boundary", "mixed_boundary")
SUMS = ("input_text_tokens", "output_tokens", "submitted_frame_occurrences", "submitted_pixels", "num_cached_tokens")


def calls(events: DataFrame) -> DataFrame:
    """One row a model call of events (record_id, telemetry): model_calls, or calls where there are none."""
    fields = {f.name for f in events.schema["telemetry"].dataType.fields}
    lists = [F.col(f"telemetry.{n}") for n in ("model_calls", "calls") if n in fields]
    return events.select("record_id", F.explode(F.coalesce(*lists)).alias("call")).select("record_id", "call.*")


def frame_rows(events: DataFrame) -> DataFrame:
    return events.select("record_id", F.explode("telemetry.frame_telemetry").alias("frame")).select("record_id", "frame.*")


def query_groups(events: DataFrame) -> DataFrame:
    """(record_id, query, ttft_ms, response_total_ms) of each query, from rows with its telemetry fields.

    A query is named by query_id, else by its dispatch time. It begins with the first semantic arrival, else with the
    first dispatch. A time that can't be had from the clock is the smallest (largest) reported one.
    """
    sent = events.where(event_kind(F.col("kind")).isin("answer", "wait", "failure") & F.col("query_dispatch_perf_ns").isNotNull())
    name = F.coalesce(F.nullif("query_id", F.lit("")), F.concat(F.lit("dispatch:"), F.col("query_dispatch_perf_ns").cast("string")))
    grouped = sent.groupBy("record_id", name.alias("query")).agg(
        F.coalesce(F.min("semantic_query_arrival_perf_ns"), F.min("query_dispatch_perf_ns")).alias("begin"),
        F.min("first_token_perf_ns").alias("first"),
        F.max("response_completion_perf_ns").alias("done"),
        F.min("ttft_ms").alias("told_first"),
        F.max("response_total_ms").alias("told_total"),
    )
    since = lambda c, told: F.when(F.col(c) >= F.col("begin"), (F.col(c) - F.col("begin")) / F.lit(1e6)).otherwise(F.col(told))
    return grouped.select("record_id", "query", since("first", "told_first").alias("ttft_ms"), since("done", "told_total").alias("response_total_ms"))


def question_boundary(events: DataFrame) -> DataFrame:
    """(record_id, dispatch): when a record's question arrived, at the earliest."""
    at = F.coalesce("semantic_query_arrival_perf_ns", "query_dispatch_perf_ns")
    return events.groupBy("record_id").agg(F.min(at).alias("dispatch")).where("dispatch is not null")


def phase(stage: Column, start: Column, end: Column, dispatch: Column) -> Column:
    """history, mixed or query: where a call lies to the question; null if a time is unknown."""
    known = start.isNotNull() & end.isNotNull() & dispatch.isNotNull()
    name = F.coalesce(stage, F.lit(""))
    history = name.isin(*HISTORY_STAGES) | (end <= dispatch)
    mixed = name.isin(*MIXED_STAGES) | ((start < dispatch) & (dispatch < end))
    return F.when(known, F.when(history, "history").when(mixed, "mixed").otherwise("query"))


def classify_calls(call_rows: DataFrame, boundary: DataFrame) -> DataFrame:
    joined = call_rows.join(boundary, "record_id", "left")
    return joined.withColumn("phase", phase(F.col("stage"), F.col("start_perf_ns"), F.col("end_perf_ns"), F.col("dispatch")))


def call_totals(call_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, sums and coverage of calls. Sums of nothing are null."""
    have = [c for c in SUMS if c in call_rows.columns]
    spans = F.count_if(F.col("end_perf_ns") >= F.col("start_perf_ns"))
    return call_rows.groupBy(*by).agg(
        F.count("*").alias("model_call_count"),
        *(F.sum(c).alias(c) for c in have),
        *(ratio(F.count(c), F.count("*")).alias(f"{c}_coverage") for c in have),
        ratio(spans, F.count("*")).alias("interval_coverage"),
    )


def busy_seconds(call_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The length in seconds of the union of the calls' intervals, for each group."""
    return union_length(call_rows, list(by), "start_perf_ns", "end_perf_ns").withColumn("inference_wall_time_s", F.col("length") / F.lit(1e9)).drop("length")


def calls_by_stage(call_rows: DataFrame) -> DataFrame:
    return call_rows.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def submitted_frames(frames: DataFrame) -> DataFrame:
    """The distinct (record_id, observation_id) that were submitted at least once."""
    return frames.where((F.col("submitted_occurrences") > 0) & F.col("observation_id").isNotNull()).select("record_id", "observation_id").distinct()


def frame_workload(observations: DataFrame, frames: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Delivered, unique, duplicate and dropped frames. occurrences has one row, the sum over calls or null."""
    seen = observations.agg(F.count("*").alias("core_delivered_frames"))
    unique = submitted_frames(frames).agg(F.count("*").alias("unique_submitted_frames"))
    told = occurrences.agg(F.max("submitted_frame_occurrences").alias("submitted_frame_occurrences"))
    one = seen.withColumns({"unique_submitted_frames": unique.scalar(), "submitted_frame_occurrences": told.scalar()})
    dropped = positive(F.col("core_delivered_frames") - F.col("unique_submitted_frames"))
    return one.withColumns(
        {
            "duplicate_frame_occurrences": F.when(F.col("submitted_frame_occurrences").isNotNull(), positive(F.col("submitted_frame_occurrences") - F.col("unique_submitted_frames"))),
            "dropped_frames": dropped,
            "dropped_frame_rate": ratio(dropped, F.col("core_delivered_frames")),
        }
    )


def observation_rates(observations: DataFrame) -> DataFrame:
    """On-time and completion rates of observations (commit_perf_ns, on_time)."""
    return observations.agg(
        F.count("*").alias("observation_count"),
        F.count_if("on_time").alias("on_time_count"),
        ratio(F.count_if("on_time"), F.count("on_time")).alias("on_time_frame_rate"),
        ratio(F.count("on_time"), F.count("*")).alias("on_time_frame_coverage"),
        F.count("commit_perf_ns").alias("committed_count"),
        ratio(F.count("commit_perf_ns"), F.count("*")).alias("stream_completion_rate"),
    )


def coverage(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """name: the share of rows in which the column isn't null; null without rows."""
    return rows.agg(*(ratio(F.count(c), F.count("*")).alias(name) for name, c in columns.items()))


def device_rollup(samples: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The largest value of each field by device, and whether every sample of it was attributed."""
    return samples.groupBy("device").agg(*(F.max(f).alias(f) for f in fields), F.bool_and(F.coalesce("attribution_ok", F.lit(False))).alias("attribution_ok"), F.count("*").alias("samples"))


def gpu_summary(events: DataFrame, order: str = "event_index") -> DataFrame:
    """The last backend and interval, whether every sample was attributed (false without samples), and devices."""
    got = F.coalesce(*(F.col(f"telemetry.{n}") for n in ("gpu", "resource_telemetry") if n in {f.name for f in events.schema["telemetry"].dataType.fields}))
    samples = events.select(order, got.alias("gpu")).where("gpu is not null")
    return samples.agg(
        F.max_by(F.col("gpu.backend"), F.when(F.col("gpu.backend").isNotNull(), F.col(order))).alias("backend"),
        F.max_by(F.col("gpu.sample_interval_ms"), F.when(F.col("gpu.sample_interval_ms").isNotNull(), F.col(order))).alias("sample_interval_ms"),
        F.coalesce(F.bool_and(F.coalesce("gpu.attribution_ok", F.lit(False))), F.lit(False)).alias("attribution_ok"),
        F.count("*").alias("samples"),
    )


def reliability(records: DataFrame) -> DataFrame:
    """Completion and failure rates of records (status[, timed_out, retry_count])."""
    has = set(records.columns)
    done, failed = (F.count_if(F.col("status") == s) for s in ("completed", "failed"))
    return records.agg(
        F.count("*").alias("record_count"),
        done.alias("completed_count"),
        failed.alias("failed_count"),
        ratio(done, F.count("*")).alias("record_completion_rate"),
        ratio(failed, F.count("*")).alias("failure_rate"),
        (F.count_if("timed_out") if "timed_out" in has else F.lit(0).cast("bigint")).alias("timeout_count"),
        (F.coalesce(F.sum("retry_count"), F.lit(0)) if "retry_count" in has else F.lit(0)).cast("bigint").alias("retry_count"),
    )


def failure_types(records: DataFrame) -> DataFrame:
    return records.where("status = 'failed'").groupBy(F.coalesce(F.nullif("failed_reason", F.lit("")), F.lit("unspecified")).alias("failure_type")).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Count rows as one row with a map; the keys are few."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("counts"))


#: The fields of a device that a summary takes the largest of.
DEVICE_BYTES = ("baseline_bytes", "peak_bytes", "peak_increment_bytes", "peak_minus_baseline_bytes")


def gpu_devices(events: DataFrame, order: str = "event_index") -> DataFrame:
    """One row a device: the fields of its first sample, with the largest value of each of DEVICE_BYTES."""
    got = F.coalesce(*(F.col(f"telemetry.{n}") for n in ("gpu", "resource_telemetry") if n in {f.name for f in events.schema["telemetry"].dataType.fields}))
    each = events.select(order, F.posexplode(got["devices"]).alias("place", "device")).select(F.struct(order, "place").alias("at"), "device.*")
    names = [c for c in ("uuid", "device_id") if c in each.columns]
    key = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in names), F.lit("unknown"))
    rest = [c for c in each.columns if c != "at"]
    kept = [F.max(c).alias(c) if c in DEVICE_BYTES else F.min_by(F.struct(c), F.col("at"))[c].alias(c) for c in rest]
    return each.groupBy(key.alias("device")).agg(*kept)


def observation_elapsed(log: DataFrame, questions: DataFrame) -> DataFrame:
    """(record_id, dispatch, elapsed_s) of the questions that were asked: the time from a record's first observation
    to its question; null without an observation, or where the question came first."""
    seen = F.when(event_kind(F.col("kind")) == "observation", F.col("arrival_perf_ns"))
    asked = F.coalesce("semantic_query_arrival_perf_ns", "query_dispatch_perf_ns")
    ends = log.join(questions, "record_id", "left_semi").groupBy("record_id").agg(F.min(asked).alias("dispatch"), F.min(seen).alias("first")).where("dispatch is not null")
    return ends.select("record_id", "dispatch", F.when(F.col("dispatch") >= F.col("first"), (F.col("dispatch") - F.col("first")) / F.lit(1e9)).alias("elapsed_s"))


def summarize(log: DataFrame, call_rows: DataFrame, frames: DataFrame, records: DataFrame, windows: DataFrame, episodes: DataFrame, gpu: DataFrame, devices: DataFrame) -> DataFrame:
    """The telemetry of a run as one row of seven structs.

    log has an event a row with its telemetry's fields as columns; call_rows as from :func:`calls`, with all of SUMS;
    frames as from :func:`frame_rows`; records (record_id, task, status, ...); windows are the strict scored ones
    (source, is_answered, latency_ms); episodes (first_token_perf_ns); gpu and devices come from :func:`gpu_summary`
    and :func:`gpu_devices`. What wasn't measured is null, in no sum and below no rate.
    """
    questions = records.where("task = 'qa'").select("record_id").distinct()
    elapsed = observation_elapsed(log, questions)
    seen = log.where(event_kind(F.col("kind")) == "observation").join(questions.withColumn("qa", F.lit(True)), "record_id", "left")
    n = F.count("*")
    observed = seen.agg(
        n.alias("n"), F.count_if("on_time").alias("on_time"), F.count("on_time").alias("timed"), F.count("commit_perf_ns").alias("committed"),
        spread(F.col("frame_processing_ms"), n).alias("processing"), spread(F.col("frame_lag_ms"), n).alias("lag"), spread(F.when(F.col("qa"), F.col("frame_processing_ms")), F.count("qa")).alias("qa_processing"),
    )
    asked = query_groups(log).agg(spread(F.col("ttft_ms"), n).alias("ttft_ms"), spread(F.col("response_total_ms"), n).alias("response_total_ms"))
    late = windows.where("source = 'in_window' and is_answered").agg(spread(F.col("latency_ms"), n).alias("latency"))
    history = elapsed.agg(n.alias("asked"), spread(F.col("elapsed_s"), questions.agg(n).scalar()).alias("elapsed"))
    phased = classify_calls(call_rows, elapsed.select("record_id", "dispatch"))
    parts = {"": F.lit(True), "history_": F.col("phase") == "history", "mixed_": F.col("phase") == "mixed"}
    called = phased.agg(
        *(F.count_if(where).alias(f"{p}calls") for p, where in parts.items()),
        *(F.sum(F.when(where, F.col(c))).alias(f"{p}{c}") for p, where in parts.items() for c in SUMS),
        *(F.count(c).alias(f"with_{c}") for c in SUMS),
        F.count_if(F.col("end_perf_ns") >= F.col("start_perf_ns")).alias("spans"),
    )
    busy = {p: union_total(phased.where(where), "start_perf_ns", "end_perf_ns").select(F.col("length") / F.lit(1e9)).scalar() for p, where in parts.items()}
    sent = log.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("transport_uploaded_image_count", "transport_uploaded_image_total_bytes")))
    stages = log.where((event_kind(F.col("kind")) == "failure") & (F.col("failure_stage") != "")).groupBy("failure_stage").agg(n.alias("n"))
    told = episodes.agg(n.alias("n"), F.count("first_token_perf_ns").alias("first"))
    as_struct = lambda rows: rows.select(F.struct("*")).scalar()
    base = records.agg(F.count("*").alias("__records")).withColumns(
        {
            "__o": as_struct(observed), "__q": as_struct(asked), "__l": as_struct(late), "__h": as_struct(history), "__c": as_struct(called), "__t": as_struct(sent), "__e": as_struct(told), "__g": as_struct(gpu), "__r": as_struct(reliability(records)),
            "__u": submitted_frames(frames).agg(n).scalar(), "__d": devices.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar(),
            "__by_stage": as_map(calls_by_stage(call_rows), "stage").scalar(), "__types": as_map(failure_types(records), "failure_type").scalar(), "__failed_at": as_map(stages, "failure_stage").scalar(),
        }
    )
    o, q, c, h = (lambda name, k=k: F.col(f"{k}.{name}") for k in ("__o", "__q", "__c", "__h"))
    dropped = positive(o("n") - F.col("__u"))
    share = lambda a, b: ratio(a, b)
    each = {name: share(c(f"with_{name}"), c("calls")) for name in SUMS}
    part = lambda p: [c(f"{p}{name}").alias(f"{'mixed_boundary_' if p == 'mixed_' else ''}{name}") for name in SUMS if name != "num_cached_tokens"]
    groups = {
        "responsiveness": [
            q("ttft_ms").alias("ttft_ms"), q("response_total_ms").alias("response_total_ms"), F.col("__l.latency").alias("proactive_response_latency_ms"), o("processing").alias("frame_processing_ms"), o("lag").alias("frame_lag_ms"),
            share(o("on_time"), o("timed")).alias("on_time_frame_rate"), share(o("timed"), o("n")).alias("on_time_frame_coverage"), share(o("committed"), o("n")).alias("stream_completion_rate"), share(dropped, o("n")).alias("dropped_frame_rate"),
        ],
        "visual_workload": [
            o("n").alias("core_delivered_frames"), c("submitted_frame_occurrences").alias("submitted_frame_occurrences"), F.col("__u").alias("unique_submitted_frames"),
            F.when(c("submitted_frame_occurrences").isNotNull(), positive(c("submitted_frame_occurrences") - F.col("__u"))).alias("duplicate_frame_occurrences"), dropped.alias("dropped_frames"), c("submitted_pixels").alias("submitted_pixels"),
            F.col("__t.transport_uploaded_image_count").alias("transport_uploaded_images"), F.col("__t.transport_uploaded_image_total_bytes").alias("transport_uploaded_bytes"),
        ],
        "text_and_inference": [
            c("input_text_tokens").alias("input_text_tokens"), c("output_tokens").alias("output_tokens"), c("num_cached_tokens").alias("prefix_cached_tokens"), c("calls").alias("model_call_count"), busy[""].alias("inference_wall_time_s"), F.col("__by_stage").alias("calls_by_stage"),
        ],
        "qa_history_processing": [
            questions.agg(n).scalar().alias("record_count"), h("asked").alias("query_boundary_count"), h("elapsed").alias("history_elapsed_wall_time_s"), o("qa_processing").alias("frame_processing_ms"), c("history_calls").alias("model_call_count"),
            c("mixed_calls").alias("mixed_boundary_model_call_count"), busy["history_"].alias("inference_wall_time_s"), busy["mixed_"].alias("mixed_boundary_inference_wall_time_s"), *part("history_"), *part("mixed_"),
            share(c("history_calls"), c("history_calls") + c("mixed_calls")).alias("model_call_interval_coverage"),
        ],
        "gpu_memory": [F.col("__g.backend").alias("backend"), F.col("__g.sample_interval_ms").alias("sample_interval_ms"), F.col("__g.attribution_ok").alias("attribution_ok"), F.col("__d").alias("devices"), (F.size("__d") > 0).alias("telemetry_available")],
        "reliability": [F.col("__r").alias("records"), F.col("__types").alias("failure_types"), F.col("__failed_at").alias("failure_stages")],
        "telemetry_coverage": [
            share(o("committed"), o("n")).alias("frame_commit"), o("processing.coverage").alias("frame_processing"), o("lag.coverage").alias("frame_lag"), share(o("timed"), o("n")).alias("on_time_frame"), q("ttft_ms.coverage").alias("query_ttft"),
            q("response_total_ms.coverage").alias("query_response_total"), F.col("__l.latency.coverage").alias("proactive_response_latency"), share(F.col("__e.first"), F.col("__e.n")).alias("response_first_token"), share(c("spans"), c("calls")).alias("model_call_intervals"),
            each["submitted_frame_occurrences"].alias("submitted_frames"), each["submitted_pixels"].alias("submitted_pixels"), each["input_text_tokens"].alias("input_text_tokens"), each["output_tokens"].alias("output_tokens"), each["num_cached_tokens"].alias("prefix_cache"),
            ((F.size("__d") > 0) & F.col("__g.attribution_ok")).alias("gpu_memory"),
        ],
    }
    return base.select(*(F.struct(*columns).alias(name) for name, columns in groups.items()))

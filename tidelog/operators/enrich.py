"""Enrichment of event rows: clocks, late output, commits, deadlines, chunks and response ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timeplan import EPSILON, video_time
from tidelog.operators.episodes import event_kind


def stamp_query(events: DataFrame, dispatch: Column, received: Column) -> DataFrame:
    """Fills in dispatch, receive and completion times and the total, where they are missing."""
    done = F.coalesce("response_completion_perf_ns", received)
    sent = F.coalesce("query_dispatch_perf_ns", dispatch)
    return events.withColumns(
        {
            "query_dispatch_perf_ns": sent,
            "core_event_receive_perf_ns": F.coalesce("core_event_receive_perf_ns", received),
            "response_completion_perf_ns": done,
            "response_total_ms": F.coalesce("response_total_ms", (done - sent) / F.lit(1e6)),
        }
    )


def semantic_arrival(events: DataFrame, scheduled: Column, now: Column) -> DataFrame:
    """When a question arrived in meaning: with its frame's schedule, else now; only for events that were sent."""
    return events.withColumn("semantic_query_arrival_perf_ns", F.when(F.col("query_dispatch_perf_ns").isNotNull(), F.coalesce("semantic_query_arrival_perf_ns", scheduled, now)))


def restamp_answers(events: DataFrame, run_start_ns: Column, video_start_s: Column, evaluation_end_s: Column) -> DataFrame:
    """Answers at the video time of their first token, else of their receipt; late ones become ineligible.

    An event from closing without a token has no time and isn't eligible.
    """
    answer = event_kind(F.col("kind")) == "answer"
    token, received = F.col("first_token_perf_ns"), F.col("core_event_receive_perf_ns")
    lost = answer & F.coalesce("session_close_event", F.lit(False)) & token.isNull()
    at = F.when(answer & ~lost, video_time(F.coalesce(token, received), run_start_ns, video_start_s)).otherwise(F.col("logical_time_s"))
    late = answer & ~lost & (at >= evaluation_end_s - EPSILON)
    return events.withColumns(
        {
            "logical_time_s": at,
            "response_scoring_perf_ns": F.when(answer & ~lost, F.coalesce(token, received)),
            "evaluation_time_source": F.when(answer & ~lost, F.when(token.isNotNull(), "first_token_perf_ns").otherwise("core_event_receive_perf_ns")),
            "within_evaluation_end": F.when(answer & ~lost, ~late).otherwise(F.col("within_evaluation_end")),
            "eligible_for_scoring": F.when(lost | late, False).otherwise(F.col("eligible_for_scoring")),
            "suppression_reason": F.when(lost, "unobservable_close_time").when(late, "after_evaluation_end").otherwise(F.col("suppression_reason")),
        }
    )


def suppress_before(events: DataFrame, instruction_s: Column) -> DataFrame:
    """Output from before the instruction is telemetry."""
    early = (event_kind(F.col("kind")) == "answer") & (F.col("logical_time_s") < instruction_s - EPSILON)
    return events.withColumns({"kind": F.when(early, "telemetry").otherwise(F.col("kind")), "provider_output_suppressed": early | F.coalesce("provider_output_suppressed", F.lit(False))})


def mark_drain(events: DataFrame, end_ns: Column) -> DataFrame:
    """Closing events whose earliest model call began at or after the end are shutdown drain and don't count."""
    first = F.array_min(F.transform("model_calls", lambda c: c["start_perf_ns"]))
    drain = F.coalesce("session_close_event", F.lit(False)) & F.coalesce(first >= end_ns, F.lit(False))
    return events.withColumns({"shutdown_drain": drain, "eligible_for_scoring": F.when(drain, False).otherwise(F.col("eligible_for_scoring"))})


def failed_cleanup(events: DataFrame) -> DataFrame:
    return events.withColumns({"eligible_for_scoring": F.lit(False), "suppression_reason": F.lit("failed_record_cleanup")})


def last_commits(frames: DataFrame, direct: DataFrame) -> DataFrame:
    """(record_id, observation_id, commit_perf_ns): the latest commit that any source tells of."""
    both = frames.select("record_id", "observation_id", "commit_perf_ns").unionByName(direct.select("record_id", "observation_id", "commit_perf_ns"))
    return both.where("commit_perf_ns is not null").groupBy("record_id", "observation_id").agg(F.max("commit_perf_ns").alias("commit_perf_ns"))


def reconcile_commits(observations: DataFrame, commits: DataFrame) -> DataFrame:
    """Observations with their commit, processing time, lag (not below 0) and whether they met their deadline."""
    joined = observations.drop("commit_perf_ns").join(commits, ["record_id", "observation_id"], "left")
    commit = F.col("commit_perf_ns")
    return joined.withColumns(
        {
            "frame_processing_ms": (commit - F.col("arrival_perf_ns")) / F.lit(1e6),
            "frame_lag_ms": F.greatest(F.lit(0), commit - F.col("scheduled_arrival_perf_ns")) / F.lit(1e6),
            "on_time": commit <= F.col("frame_deadline_perf_ns"),
        }
    ).withColumn("frame_lag_ms", F.when(commit.isNotNull(), F.col("frame_lag_ms")))


def frame_deadlines(observations: DataFrame, scheduled: str = "scheduled_arrival_perf_ns") -> DataFrame:
    """A frame's deadline is the next one's schedule."""
    return observations.withColumn("frame_deadline_perf_ns", F.lead(scheduled).over(Window.partitionBy("record_id").orderBy("event_index")))


def chunks(rows: DataFrame, size: int, flush: Column, order: str = "event_index") -> DataFrame:
    """Adds segment and chunk: `size` rows a chunk, and a new segment after each row where flush holds."""
    w = Window.partitionBy("record_id").orderBy(order)
    marked = rows.withColumn("segment", F.coalesce(F.sum(F.when(flush, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("record_id", "segment").orderBy(order)) - 1
    return marked.withColumn("chunk", F.floor(place / size))


def response_islands(events: DataFrame, order: str = "event_index") -> DataFrame:
    """Adds island: answers in a row share one until a wait or a failure; and is_last, the answer before such a one."""
    w = Window.partitionBy("record_id").orderBy(order)
    stops = event_kind(F.col("kind")).isin("wait", "failure")
    following = event_kind(F.lead("kind").over(w))
    return events.withColumns(
        {
            "island": F.sum(stops.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "is_last": (event_kind(F.col("kind")) == "answer") & F.coalesce(following.isin("wait", "failure"), F.lit(False)),
        }
    )


def visible_until(queries: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds visible_s to queries (record_id, t): the last observation that they may see, at most t."""
    q = queries.withColumns({"side": F.lit(1), "seen": F.lit(None).cast("double")})
    o = observations.select("record_id", "t", F.lit(0).alias("side"), F.col("t").alias("seen"))
    w = Window.partitionBy("record_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return q.unionByName(o, allowMissingColumns=True).withColumn("visible_s", F.max("seen").over(w)).where("side = 1").drop("side", "seen")


def token_budget(configured: Column, limit: Column, used: Column) -> Column:
    """The tokens that may be made; null where the input leaves no room."""
    left = limit - used
    return F.when(left > 0, F.least(configured, left))


def text_tokens(ids: Column, video_id: Column) -> Column:
    """How many ids aren't the video placeholder's; unknown if that id is."""
    return F.when(video_id.isNotNull(), F.size(F.filter(ids, lambda x: x != video_id)))


def frame_phase(times: Column, dispatch: Column) -> Column:
    before, after = F.exists(times, lambda t: t < dispatch), F.exists(times, lambda t: t >= dispatch)
    return F.when(dispatch.isNull(), "qa_history_processing").when(before & after, "qa_mixed_boundary").otherwise("qa_query")


def memory_increment(before: Column, after: Column) -> Column:
    """(baseline, peak, increment, attribution_ok) from two samples (bytes array, ok)."""
    low, high = F.array_max(before["bytes"]), F.array_max(F.concat(before["bytes"], after["bytes"]))
    return F.struct(low.alias("baseline_bytes"), high.alias("peak_bytes"), (high - low).alias("peak_increment_bytes"), (before["ok"] & after["ok"]).alias("attribution_ok"))


def result_rows(records: DataFrame, predictions: DataFrame, failures: DataFrame, kept: list[str]) -> DataFrame:
    """Result rows: every record, failed ones with their ground truth too, with prediction, status and reason."""
    joined = records.select("record_id", *kept).join(predictions, "record_id", "left").join(failures, "record_id", "left")
    return joined.withColumns({"prediction": F.coalesce("prediction", F.lit("")), "status": F.when(F.col("failed_reason").isNotNull(), "failed").otherwise("completed")})

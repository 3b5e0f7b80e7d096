"""The streaming queries: the tables arrive as files, late rows among them, and stateful operators follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.operators import episodes
from tidelog.plans import standins as s
from tidelog.plans.standins import DAY, with_views
from tidelog.plans.text_queries import ASSEMBLY
from tidelog.plans.window_queries import FOLD
from tidelog.sources.folders import shared_dir, stored
from tidelog.streaming import records, windows
from tidelog.streaming.commits import CommitLog
from tidelog.streaming.episodes import COLUMNS, assemble_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def stream_episode_assembly(spark, d):
    """Writes the log to the shared folder, streams it from there until all is read, and returns the episodes."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = s.turns(spark, d).withColumn("is_final", F.lit(False)).select(*COLUMNS)
    ends = log.groupBy("record_id").agg((F.max("event_index") + 1).alias("event_index")).withColumn("kind", F.lit("end"))
    whole = log.unionByName(ends, allowMissingColumns=True).select(*COLUMNS)
    whole.write.parquet(f"{base}/log")
    stream = spark.readStream.schema(whole.schema).parquet(f"{base}/log")
    run = assemble_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("record_id", "response_id", "start_s", "end_s", "parts")


QUERIES["stream_episode_assembly"] = stream_episode_assembly
ORACLES["stream_episode_assembly"] = (
    ASSEMBLY.replace("any_value(whole) AS whole, sum(length(body))::BIGINT AS body_chars", "CASE WHEN any_value(whole) OR true THEN any_value(rid) END AS response_id")
    .replace("row_number() OVER (PARTITION BY record_id ORDER BY min(turn)) - 1 AS episode, ", "")
)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = 3


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def arrive(log: DataFrame, delay_s: float, folder: str) -> Iterator[int]:
    """Writes a log (record_id, event_index, ts, ...) to the folder in order of arrival, in STEPS parts.

    A row arrives up to delay_s late, so parts overlap in event time. After each part the caller is told. At last a
    row of no record comes from the time after all others, and brings the watermark past every timer. The log is
    computed once, however many parts are taken from it.
    """
    log = stored(log.withColumn("__at", F.unix_millis("ts") + F.pmod(F.xxhash64("record_id", "event_index"), F.lit(int(delay_s * 1000)))))
    least, most = log.agg(F.min("__at"), F.max("__at")).first()
    if least is None:
        return
    step = F.floor((F.col("__at") - least) * STEPS / (most - least + 1))
    for k in range(STEPS):
        log.where(step == k).drop("__at").write.mode("append").parquet(folder)
        yield k
    after = log.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("record_id"), F.timestamp_millis(F.lit(most + int(delay_s * 1000) * 4 + 10 * 86_400_000)).alias("ts"), F.lit("clock").alias("kind"))
    log.limit(0).drop("__at").unionByName(after, allowMissingColumns=True).write.mode("append").parquet(folder)
    yield STEPS


def follow(spark: SparkSession, log: DataFrame, delay_s: float, operator: Callable[[DataFrame], DataFrame], write: Callable | None = None, restarts: int = 0) -> str:
    """Streams the log's arrivals through the operator, a run for each part, each from the last one's checkpoint.

    write(rows, batch number) takes what comes out; else it goes to the parquet folder that is returned. A run that
    fails is started again from its checkpoint, so often in all.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with rocks(spark):
        for _ in arrive(log, delay_s, f"{base}/log"):
            stream = spark.readStream.schema(log.schema).parquet(f"{base}/log").withWatermark("ts", f"{int(delay_s)} seconds")
            out = operator(stream).writeStream.option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True)
            out = out.foreachBatch(write) if write else out.format("parquet").option("path", f"{base}/out")
            try:
                out.start().awaitTermination()
            except StreamingQueryException:
                if not restarts:
                    raise
                restarts -= 1
                out.start().awaitTermination()
    return f"{base}/out"


def window_log(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are point triggers, signups states that last half an hour a unit of value, clicks answers."""
    log = s.event_log(spark, d)
    until = F.when(F.col("kind") == "telemetry", F.col("t") + F.col("value") * 1800)
    of = Window.partitionBy("record_id")
    log = log.withColumns({"__last": F.max("event_index").over(of), "__until": F.max("t").over(of)})
    row = F.struct("event_index", F.when(F.col("kind") == "answer", "answer").when(F.col("kind").isin("trigger", "telemetry"), "trigger").alias("kind"), "t", until.alias("state_end_s"))
    end = F.struct((F.col("__last") + 1).alias("event_index"), F.lit("end").alias("kind"), (F.col("__until") + 1).alias("t"), F.lit(None).cast("double").alias("state_end_s"))
    both = F.when(F.col("event_index") == F.col("__last"), F.array(row, end)).otherwise(F.array(row))
    return log.select("record_id", F.inline(both)).where("kind is not null").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint")))


def window_stream(spark: SparkSession, d: str, view: str) -> DataFrame:
    out = follow(spark, window_log(spark, d), 6 * 3600.0, lambda log: windows.assign_stream(log, DAY, view))
    return spark.read.schema(windows.ASSIGNED).parquet(out).select("record_id", "position", "source", F.coalesce("event_index", F.lit(-1)).alias("event_index"))


STATES = """marks AS (SELECT record_id, event_index, t AS start_s, CASE WHEN kind = 'telemetry' THEN greatest(t + value * 1800, t) END AS state_end FROM ev WHERE kind IN ('trigger', 'telemetry')),
specs AS (SELECT *, coalesce(state_end, least(start_s + 86400::DOUBLE, coalesce(next_s, 1e300::DOUBLE))) AS end_s, coalesce(state_end, next_s, start_s + 86400::DOUBLE) AS eventual_end_s FROM
  (SELECT a.record_id, CAST(row_number() OVER (PARTITION BY a.record_id ORDER BY a.event_index) - 1 AS INT) AS position, a.start_s, a.state_end, (SELECT min(b.start_s) FROM marks b WHERE b.record_id = a.record_id AND b.start_s > a.start_s) AS next_s FROM marks a)),
ans AS (SELECT record_id, event_index AS episode, t FROM ev WHERE kind = 'answer')"""
STREAMED = f"{with_views('ev', recursive=True)}, {STATES}, {FOLD} SELECT record_id, position, source, coalesce(episode, -1) AS event_index FROM strict"


def stream_window_assignment(spark, d):
    """Strict windows, points and states, as the watermark closes them."""
    return window_stream(spark, d, "strict")


def stream_eventual_windows(spark, d):
    return window_stream(spark, d, "eventual")


def flat_log(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a log with the fields that assembly reads: sequence numbers that disagree with arrival, silent
    decisions, final marks, snapshots, and telemetry that makes some events ineligible or late."""
    c = s.table(spark, d, "conversations")
    turn, at = F.col("turn").cast("int"), (F.col("conv_id") * 7 + F.col("turn") * 3).cast("int")
    number = F.when(F.col("conv_id") % 3 == 0, turn * 2).when((F.col("conv_id") % 3 == 1) & (turn % 2 == 0), 100 - turn)
    told = F.struct(
        (at % 7 != 0).alias("eligible_for_scoring"), F.when(turn >= 5, False).otherwise(F.lit(None).cast("boolean")).alias("within_evaluation_end"),
        F.when(turn >= 5, "after_evaluation_end").when(at % 14 == 0, "unobservable_close_time").alias("suppression_reason"), (at % 17 == 0).alias("provider_output_suppressed"), (at % 19 == 0).alias("shutdown_drain"),
    )
    return c.select(
        F.col("conv_id").alias("record_id"), turn.alias("event_index"), F.when(F.col("role") == "assistant", "output.answer").when(F.col("role") == "user", F.when(turn % 4 == 0, "WAIT").otherwise("Answer")).otherwise("telemetry").alias("kind"),
        F.col("turn").cast("double").alias("logical_time_s"), "text", F.when(at % 11 != 0, F.concat(F.lit("r"), (turn % 2).cast("string"))).alias("response_id"), number.cast("string").alias("sequence_id"),
        F.when(turn % 4 == 1, "delta").when(turn % 4 == 3, "SNAPSHOT").otherwise("complete").alias("text_mode"), (at % 5 == 0).alias("is_final"), F.when(at % 13 == 0, "Silent").alias("response_decision"),
        F.when(at % 3 == 0, 1_700_000_000_000_000_001 + F.col("turn")).alias("first_token_perf_ns"), told.alias("telemetry"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn") * 5).alias("ts"),
    )


def assembled(log: DataFrame) -> DataFrame:
    out = episodes.assemble(episodes.resolve(log))
    return out.select("record_id", F.col("episode").cast("bigint").alias("episode"), "response_id", F.col("start_video_time_s").alias("start_s"), F.col("end_video_time_s").alias("end_s"), F.size("source_event_ids").cast("bigint").alias("parts"), "first_token_perf_ns", "assembly_mode", F.array_join(F.transform("source_event_indices", lambda k: k.cast("string")), ",").alias("events"))


def committed_assembly(spark: SparkSession, log: DataFrame, settings: dict, stop_at: int | None = None) -> CommitLog:
    """The log through whole_records and assembly, a numbered commit a micro-batch.

    With stop_at the writer fails between data and marker, once, in that batch or a later one, and the stream ends; it
    is started again from its checkpoint.
    """
    ends = log.groupBy("record_id").agg((F.max("event_index") + 1).alias("event_index"), F.max("ts").alias("ts")).withColumn("kind", F.lit("end"))
    marked = log.unionByName(ends.where("record_id % 4 <> 0"), allowMissingColumns=True)  # the others are over when they have been idle
    shape: StructType = assembled(log.limit(0)).schema
    commits = CommitLog(spark, f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}", shape, settings=settings)
    failed: list[int] = []

    def stop(number: int) -> None:
        if stop_at is not None and number >= stop_at and not failed:
            failed.append(number)
            raise InterruptedError(f"stopped in batch {number}")

    def write(rows: DataFrame, number: int) -> None:
        commits.commit(assembled(records.unpacked(rows, marked.schema, "ts")), number, stop)

    follow(spark, marked, 60.0, lambda stream: records.whole_records(stream, "ts", 30.0, 120.0), write, restarts=stop_at is not None)
    return commits


FLAT_SQL = """WITH t AS (
  SELECT conv_id AS record_id, turn, conv_id * 7 + turn * 3 AS a, trim(coalesce(text, '')) AS body, role,
    CASE WHEN conv_id % 3 = 0 THEN turn * 2 WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN 100 - turn END AS number FROM conversations
), k AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY number IS NULL, number, turn) AS place,
    CASE WHEN a % 11 <> 0 THEN 'r' || (turn % 2)::VARCHAR ELSE '' END AS rid, turn % 2 = 1 AS part, a % 5 = 0 AS final,
    CASE WHEN role = 'assistant' OR role = 'user' AND turn % 4 <> 0 THEN 'answer' WHEN role = 'user' THEN 'wait' ELSE 'telemetry' END AS kind,
    NOT (a % 17 = 0 OR a % 7 = 0 OR turn >= 5) AS eligible,
    (turn >= 5 OR a % 14 = 0) AND turn % 4 = 1 AND a % 17 <> 0 AND a % 19 <> 0 AS late FROM t
), f AS (
  SELECT *, kind = 'wait' OR a % 13 = 0 AS silent, kind = 'answer' AND a % 13 <> 0 AND body <> '' AS said FROM k
), g AS (
  SELECT *, said AND part AND rid <> '' AS fragment, said AND NOT (part AND rid <> '') AND eligible AS whole FROM f
), h AS (
  SELECT *, sum((silent OR whole)::INT) OVER (PARTITION BY record_id ORDER BY place) AS seg FROM g
), i AS (
  SELECT *, CASE WHEN whole THEN 0 ELSE coalesce(sum(final::INT) OVER (PARTITION BY record_id, seg, rid, whole ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS go FROM h WHERE whole OR fragment AND (eligible OR late)
), j AS (
  SELECT *, whole OR bool_or(eligible) OVER (PARTITION BY record_id, seg, rid, whole, go ORDER BY place) AS live FROM i
), e AS (
  SELECT record_id, seg, rid, whole, go, min_by(turn, place) AS first, max_by(turn, place) AS last, count(*) AS parts, string_agg(turn::VARCHAR, ',' ORDER BY place) AS events,
    min_by(CASE WHEN a % 3 = 0 THEN 1700000000000000001 + turn END, place) FILTER (a % 3 = 0) AS first_token_perf_ns FROM j WHERE live GROUP BY ALL
)
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY first, first) - 1 AS episode, CASE WHEN rid <> '' THEN rid ELSE 'legacy-' || first::VARCHAR END AS response_id, first::DOUBLE AS start_s, last::DOUBLE AS end_s, parts, first_token_perf_ns,
  CASE WHEN whole AND first % 2 = 0 THEN 'complete' WHEN whole THEN 'legacy_complete' WHEN first % 4 = 1 THEN 'delta' ELSE 'snapshot' END AS assembly_mode, events FROM e"""


def assembly_all_fields(spark, d):
    """Batch assembly with sequence numbers, silent decisions, final marks, ineligible and late events."""
    return assembled(flat_log(spark, d))


def stream_assembly_all_fields(spark, d):
    """The same from a stream whose records are closed by timers."""
    return committed_assembly(spark, flat_log(spark, d), {"grace_s": 30, "idle_s": 120}).table()


def stream_commits_resumed(spark, d):
    """The same with a writer that fails between data and marker and goes on."""
    return committed_assembly(spark, flat_log(spark, d), {"grace_s": 30, "idle_s": 120}, stop_at=1).table()


for each in (stream_window_assignment, stream_eventual_windows, assembly_all_fields, stream_assembly_all_fields, stream_commits_resumed):
    QUERIES[each.__name__] = each
ORACLES["stream_window_assignment"] = STREAMED
ORACLES["stream_eventual_windows"] = STREAMED.replace("x.t < w.end_s", "x.t < w.eventual_end_s").replace("list_filter(coalesce(eps, []), lambda x: NOT list_contains(used, x.e) AND x.t < w.start_s)[-1].e AS bef", "CAST(NULL AS INT) AS bef").replace("position, start_s, end_s FROM specs", "position, start_s, eventual_end_s FROM specs").replace("'in_window'", "'eventual'")
for name in ("assembly_all_fields", "stream_assembly_all_fields", "stream_commits_resumed"):
    ORACLES[name] = FLAT_SQL

"""Queries over projections of model processes, from events, line items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import episodes, projections
from tidelog.plans import standins as s
from tidelog.plans.standins import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


PHASE = "CASE l_returnflag WHEN 'A' THEN 'history' WHEN 'R' THEN 'mixed_boundary' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'query' END END"


@query(f"SELECT stage, count(*) AS n FROM (SELECT CASE phase WHEN 'history' THEN 'qa_history_processing' WHEN 'mixed_boundary' THEN 'qa_mixed_boundary' WHEN 'query' THEN 'qa_query_answer' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'proactive_stream_chunk' ELSE 'qa_prefix_state' END END AS stage FROM (SELECT {PHASE} AS phase, l_linenumber FROM lineitem)) GROUP BY stage")
def call_stages(spark, d):
    li = s.table(spark, d, "lineitem")
    task = F.when(F.col("l_linenumber") % 3 == 0, "proactive").when(F.col("l_linenumber") % 3 == 1, "qa")
    return li.select(projections.stage_label(F.expr(PHASE), task).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_suppkey AS record_id, l_linenumber AS call, CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN 'o' || (l_partkey % 20)::VARCHAR END AS name, l_partkey % 10 AS i, CAST(l_quantity AS BIGINT) AS w, l_linenumber + 3 AS h FROM lineitem),
n AS (SELECT *, CASE WHEN name IS NULL OR name = '' THEN 'frame-' || i::VARCHAR ELSE name END AS id FROM f)
SELECT record_id, call, count(*) AS submitted_frame_occurrences, count(DISTINCT id) AS unique_submitted_frames, count(*) - count(DISTINCT id) AS duplicate_frame_occurrences, CAST(sum(w * h) AS BIGINT) AS submitted_pixels FROM n GROUP BY ALL""")
def frame_submission_totals(spark, d):
    key = F.col("l_partkey")
    frames = s.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("record_id"), F.col("l_linenumber").alias("call"), F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("o"), (key % 20).cast("string"))).alias("observation_id"), (key % 10).alias("frame_index"),
        F.col("l_quantity").cast("bigint").alias("width"), (F.col("l_linenumber") + 3).alias("height"),
    )
    return projections.submission_totals(projections.frame_submissions(frames))


@query(f"{with_views('ev')} SELECT record_id, t AS logical_time_s, CASE WHEN event_index % 4 = 0 THEN 'o' || event_id::VARCHAR ELSE 'frame-' || event_index::VARCHAR END AS observation_id, ns AS arrival_perf_ns, lead(CASE WHEN event_index % 5 > 0 THEN ns - 7 END) OVER (PARTITION BY record_id ORDER BY t, event_index) AS frame_deadline_perf_ns, 1 AS core_delivered_frame_count FROM ev WHERE kind = 'observation'")
def observation_event_rows(spark, d):
    log = s.event_log(spark, d).where("kind = 'observation'")
    k = F.col("event_index")
    rows = log.select("record_id", "t", F.when(k % 4 == 0, F.concat(F.lit("o"), F.col("event_id").cast("string"))).alias("observation_id"), k.alias("frame_index"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.when(k % 5 > 0, F.col("ns") - 7).alias("scheduled_arrival_perf_ns"), F.col("ns").alias("arrival_perf_ns"))
    return projections.observation_events(rows).select("record_id", "logical_time_s", *(f"telemetry.{c}" for c in ("observation_id", "arrival_perf_ns", "frame_deadline_perf_ns", "core_delivered_frame_count")))


@query("""WITH c AS (SELECT conv_id AS record_id, turn, role, CASE turn % 6 WHEN 1 THEN ' ** WAIT!! ' WHEN 3 THEN ' ... …' WHEN 5 THEN '' ELSE text END AS said FROM conversations)
SELECT record_id, turn, CASE WHEN role = 'assistant' AND source <> '' THEN 'wait' WHEN role = 'assistant' THEN 'answer' ELSE 'wait' END AS kind, CASE WHEN role = 'assistant' AND source <> '' THEN source END AS silence_source,
 CASE WHEN role = 'assistant' AND source <> '' THEN 'WAIT' ELSE said END AS text, CASE WHEN role = 'assistant' AND source <> '' THEN NULL ELSE turn * 10 END AS first_token_perf_ns, CASE WHEN role = 'assistant' AND source <> '' THEN turn * 10 END AS control_first_token_perf_ns
FROM (SELECT *, CASE WHEN said IS NULL OR trim(said) = '' THEN 'empty_output' WHEN turn % 6 = 3 THEN 'provider_empty_continuation' WHEN turn % 6 = 1 THEN 'text_wait' ELSE '' END AS source FROM c)""")
def silent_answers(spark, d):
    """Conversations some of whose answers only say to wait, or nothing."""
    turn = F.col("turn").cast("bigint")
    said = F.when(turn % 6 == 1, " ** WAIT!! ").when(turn % 6 == 3, " ... …").when(turn % 6 == 5, "").otherwise(F.col("text"))
    log = s.table(spark, d, "conversations").select(F.col("conv_id").alias("record_id"), turn.alias("turn"), F.when(F.col("role") == "assistant", "answer").otherwise("wait").alias("kind"), said.alias("text"), (turn * 10).alias("first_token_perf_ns"))
    return projections.silenced(log).drop("response_decision")


@query(f"""{with_views('ev')}, i AS (SELECT record_id, CASE WHEN record_id % 7 > 0 THEN min(t) + 86400 * (record_id % 5) END AS told_s FROM ev GROUP BY record_id),
m AS (SELECT ev.*, coalesce(kind <> 'answer' AND t >= told_s - 1e-9::DOUBLE, false) AS may FROM ev JOIN i USING (record_id))
SELECT record_id, event_index AS call, coalesce(may AND event_index = min(event_index) FILTER (may) OVER (PARTITION BY record_id), false) AS instructed FROM m""")
def instructed_calls(spark, d):
    """Each event as a call; the instruction comes some days after a record's first, or never."""
    log = s.event_log(spark, d)
    at = log.groupBy("record_id").agg(F.min("t").alias("first")).select("record_id", F.when(F.col("record_id") % 7 > 0, F.col("first") + 86400 * (F.col("record_id") % 5)).alias("instruction_time_s"))
    calls = log.select("record_id", F.col("event_index").alias("call"), F.col("t").alias("visible_until_s"), (F.col("kind") == "answer").alias("has_query"))
    return projections.instruction_calls(calls, at).select("record_id", "call", "instructed")


@query(f"""{with_views('ev')}, r AS (SELECT record_id, event_index AS place, CASE WHEN kind = 'answer' THEN 'query' ELSE 'observation' END AS kind, CASE WHEN event_id % 11 = 0 THEN t - 90000 ELSE t END AS t, max(t) OVER (PARTITION BY record_id) - 100000 AS end_s FROM ev),
q AS (SELECT *, max(CASE WHEN kind = 'observation' THEN t END) OVER (PARTITION BY record_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT coalesce(problem, 'none') AS problem, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM (SELECT *, CASE WHEN kind = 'observation' AND t < seen - 1e-9::DOUBLE THEN 'unordered_observation' WHEN kind = 'query' AND seen > t + 1e-9::DOUBLE THEN 'future_observation' WHEN kind = 'query' AND t > end_s + 1e-9::DOUBLE THEN 'query_after_interval' END AS problem FROM q) GROUP BY ALL""")
def causality_checks(spark, d):
    log = s.event_log(spark, d)
    end = F.max("t").over(projections.Window.partitionBy("record_id")) - 100000
    rows = log.withColumn("end_s", end).select("record_id", F.col("event_index").alias("place"), F.when(F.col("kind") == "answer", "query").otherwise("observation").alias("kind"), F.when(F.col("event_id") % 11 == 0, F.col("t") - 90000).otherwise(F.col("t")).alias("t"), "end_s")
    return projections.causality_problems(rows).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query("""WITH e AS (SELECT o_custkey AS record_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey // 40 END AS dispatch FROM orders),
s AS (SELECT record_id, count(DISTINCT dispatch) AS n FROM e GROUP BY record_id)
SELECT c_custkey AS record_id, coalesce(n, 0) AS dispatches, CASE WHEN n > 1 THEN 'sent_twice' WHEN c_custkey % 4 > 0 AND coalesce(n, 0) = 0 THEN 'never_sent' END AS problem FROM customer LEFT JOIN s ON record_id = c_custkey""")
def question_dispatches(spark, d):
    """Customers as records, their orders as events that may carry a dispatch."""
    records = s.table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 4 > 0, "completed").otherwise("failed").alias("status"))
    events = s.table(spark, d, "orders").select(F.col("o_custkey").alias("record_id"), F.when(F.col("o_orderkey") % 3 > 0, F.expr("o_orderkey div 40")).alias("query_dispatch_perf_ns"))
    return projections.dispatch_problems(records, events)


@query("""WITH e AS (SELECT event_id, event_id % 8 AS m, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN m IN (0, 1, 5) THEN k END AS first_token_perf_ns, CASE WHEN m IN (0, 2) THEN k % 2 = 0 END AS eligible_for_scoring, CASE WHEN m IN (0, 3) THEN 'r' || k::VARCHAR END AS response_id FROM e""")
def variant_telemetry(spark, d):
    """Telemetry of any shape, made from the events' properties: a field of another type is lost, its neighbours not."""
    kept = F.expr("""CASE event_id % 8
      WHEN 0 THEN to_json(named_struct('first_token_perf_ns', k, 'eligible_for_scoring', k % 2 = 0, 'response_id', concat('r', k)))
      WHEN 1 THEN to_json(named_struct('first_token_perf_ns', k, 'eligible_for_scoring', 'yes', 'response_id', k))
      WHEN 2 THEN to_json(named_struct('first_token_perf_ns', cast(k AS string), 'eligible_for_scoring', k % 2 = 0, 'response_id', array(k)))
      WHEN 3 THEN to_json(named_struct('first_token_perf_ns', k + 0.5D, 'eligible_for_scoring', 1, 'response_id', concat('r', k)))
      WHEN 4 THEN '[1, 2]' WHEN 5 THEN to_json(named_struct('first_token_perf_ns', k, 'other', named_struct('deep', array(props)))) WHEN 6 THEN '"text"' END""")
    rows = s.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    log = rows.select("event_id", F.try_parse_json(kept).alias("telemetry"))
    found = episodes.resolve(log.withColumn("record_id", F.col("event_id")))
    return found.select(F.col("record_id").alias("event_id"), "first_token_perf_ns", "eligible_for_scoring", "response_id")

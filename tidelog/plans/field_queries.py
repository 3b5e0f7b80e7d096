"""Queries over fields of events, calls, frames, records and runs, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.functions import timeplan
from tidelog.operators import enrich, gates, scoring, telemetry, validation
from tidelog.plans import standins as s
from tidelog.plans.standins import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def sent_events(spark, d):
    """Orders as events: sent for two of three, received a second later, completed for one of four."""
    k = F.col("o_orderkey")
    ns = s.micros(F.col("o_orderdate")) * 1000
    return s.table(spark, d, "orders").select(
        k.alias("record_id"), F.col("o_custkey").alias("customer"), ns.alias("ns"), F.when(k % 3 > 0, ns).alias("query_dispatch_perf_ns"), F.when(k % 2 == 0, ns + 1_000_000_000).alias("core_event_receive_perf_ns"),
        F.when(k % 4 == 0, ns + 2_000_000_000).alias("response_completion_perf_ns"), F.lit(None).cast("double").alias("response_total_ms"), F.when(k % 5 == 0, ns - 5).alias("semantic_query_arrival_perf_ns"),
        F.lit(True).alias("eligible_for_scoring"), (k % 2 == 1).alias("session_close_event"), F.lit(None).cast("string").alias("suppression_reason"),
    )


SENT = """WITH e AS (SELECT o_orderkey AS record_id, o_custkey AS customer, epoch_us(o_orderdate) * 1000 AS ns, CASE WHEN o_orderkey % 3 > 0 THEN epoch_us(o_orderdate) * 1000 END AS sent, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) * 1000 + 1000000000 END AS got,
 CASE WHEN o_orderkey % 4 = 0 THEN epoch_us(o_orderdate) * 1000 + 2000000000 END AS done, CASE WHEN o_orderkey % 5 = 0 THEN epoch_us(o_orderdate) * 1000 - 5 END AS meant FROM orders) """


@query(SENT + "SELECT record_id, coalesce(sent, ns + 1) AS sent_ns, coalesce(got, ns + 7) AS received_ns, coalesce(done, ns + 7) AS completed_ns, (coalesce(done, ns + 7) - coalesce(sent, ns + 1)) / 1e6 AS total_ms FROM e")
def stamped_queries(spark, d):
    stamped = enrich.stamp_query(sent_events(spark, d), F.col("ns") + 1, F.col("ns") + 7)
    return stamped.select("record_id", F.col("query_dispatch_perf_ns").alias("sent_ns"), F.col("core_event_receive_perf_ns").alias("received_ns"), F.col("response_completion_perf_ns").alias("completed_ns"), F.col("response_total_ms").alias("total_ms"))


@query(SENT + "SELECT record_id, CASE WHEN sent IS NOT NULL THEN coalesce(meant, CASE WHEN record_id % 7 = 0 THEN ns + 11 END, ns + 13) END AS arrival_ns FROM e")
def semantic_arrivals(spark, d):
    found = enrich.semantic_arrival(sent_events(spark, d), F.when(F.col("record_id") % 7 == 0, F.col("ns") + 11), F.col("ns") + 13)
    return found.select("record_id", F.col("semantic_query_arrival_perf_ns").alias("arrival_ns"))


@query(SENT + "SELECT customer AS record_id, min(coalesce(meant, sent)) AS dispatch FROM e GROUP BY customer HAVING min(coalesce(meant, sent)) IS NOT NULL")
def question_boundaries(spark, d):
    return telemetry.question_boundary(sent_events(spark, d).withColumn("record_id", F.col("customer")))


@query(SENT + "SELECT record_id, record_id % 2 = 1 AND ns + record_id % 3 >= ns + 1 AS shutdown_drain, NOT (record_id % 2 = 1 AND record_id % 3 >= 1) AS eligible FROM e")
def shutdown_drains(spark, d):
    calls = F.array(F.struct((F.col("ns") + 9).alias("start_perf_ns")), F.struct((F.col("ns") + F.col("record_id") % 3).alias("start_perf_ns")))
    marked = enrich.mark_drain(sent_events(spark, d).withColumn("model_calls", calls), F.col("ns") + 1)
    return marked.select("record_id", "shutdown_drain", F.col("eligible_for_scoring").alias("eligible"))


@query(SENT + "SELECT suppression_reason, eligible_for_scoring, count(*) AS n FROM (SELECT 'failed_record_cleanup' AS suppression_reason, false AS eligible_for_scoring FROM e) GROUP BY ALL")
def failed_cleanups(spark, d):
    return enrich.failed_cleanup(sent_events(spark, d)).groupBy("suppression_reason", "eligible_for_scoring").agg(F.count("*").alias("n"))


EARLY = with_views("ev") + ", f AS (SELECT record_id, min(t) + 86400 AS told FROM ev GROUP BY record_id) "


@query(EARLY + "SELECT event_id, CASE WHEN kind = 'answer' AND t < told - 1e-9 THEN 'telemetry' ELSE kind END AS kind, kind = 'answer' AND t < told - 1e-9 AS suppressed FROM ev JOIN f USING (record_id)")
def suppressed_before_instruction(spark, d):
    log = s.event_log(spark, d).withColumn("logical_time_s", F.col("t"))
    told = log.groupBy("record_id").agg((F.min("t") + s.DAY).alias("told"))
    found = enrich.suppress_before(log.join(told, "record_id").withColumn("provider_output_suppressed", F.lit(None).cast("boolean")), F.col("told"))
    return found.select("event_id", "kind", F.col("provider_output_suppressed").alias("suppressed"))


@query(
    EARLY
    + """, p AS (SELECT event_id, kind, t, told, ns, CASE WHEN event_id % 3 > 0 THEN ns END AS token, event_id % 5 = 0 AS closes, (ns - ns % 1000000000) AS run FROM ev JOIN f USING (record_id)),
 q AS (SELECT *, kind = 'answer' AND closes AND token IS NULL AS lost, CASE WHEN kind = 'answer' AND NOT (closes AND token IS NULL) THEN 2 + greatest(0, coalesce(token, ns + 500) - run) / 1e9 ELSE t END AS answered_s FROM p)
SELECT event_id, answered_s, CASE WHEN lost THEN 'unobservable_close_time' WHEN kind = 'answer' AND answered_s >= 2.5 - 1e-9 THEN 'after_evaluation_end' END AS reason, NOT (lost OR (kind = 'answer' AND answered_s >= 2.5 - 1e-9)) AS eligible FROM q"""
)
def restamped_answers(spark, d):
    log = s.event_log(spark, d).withColumns(
        {
            "logical_time_s": F.col("t"), "first_token_perf_ns": F.when(F.col("event_id") % 3 > 0, F.col("ns")), "core_event_receive_perf_ns": F.col("ns") + 500, "session_close_event": F.col("event_id") % 5 == 0,
            "within_evaluation_end": F.lit(True), "eligible_for_scoring": F.lit(True), "suppression_reason": F.lit(None).cast("string"),
        }
    )
    found = enrich.restamp_answers(log, F.col("ns") - F.col("ns") % 1_000_000_000, F.lit(2.0), F.lit(2.5))
    return found.select("event_id", F.col("logical_time_s").alias("answered_s"), F.col("suppression_reason").alias("reason"), F.col("eligible_for_scoring").alias("eligible"))


@query(with_views("ev") + "SELECT event_id, kind, 'old' AS run FROM ev WHERE record_id % 4 <> 0 UNION ALL SELECT event_id, kind, 'new' FROM ev WHERE record_id % 4 = 0 AND kind = 'answer'")
def carried_over_events(spark, d):
    log = s.event_log(spark, d)
    again = log.where("record_id % 4 = 0").select("record_id").distinct()
    new = log.where("record_id % 4 = 0 and kind = 'answer'").withColumn("run", F.lit("new"))
    return validation.carry_over(log.withColumn("run", F.lit("old")), again, new, "record_id").select("event_id", "kind", "run")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest_attempts(spark, d):
    return validation.newest_attempt(s.table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN (p_size % 5 <> 7)::BIGINT + (p_size % 5 <> 3)::BIGINT + 1 END AS text_tokens, CASE WHEN 40 - p_size > 0 THEN least(16, 40 - p_size) END::BIGINT AS budget FROM part".replace("(p_size % 5 <> 7)::BIGINT", "1"))
def token_counts(spark, d):
    n = F.col("p_size")
    ids = F.array(F.lit(7), n % 5, F.lit(9))
    return s.table(spark, d, "part").select("p_partkey", enrich.text_tokens(ids, F.when(n % 3 > 0, F.lit(3))).cast("bigint").alias("text_tokens"), enrich.token_budget(F.lit(16), F.lit(40), n).cast("bigint").alias("budget"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'qa_history_processing' WHEN 10 < p_size AND 30 >= p_size THEN 'qa_mixed_boundary' ELSE 'qa_query' END AS phase FROM part")
def frame_phases(spark, d):
    return s.table(spark, d, "part").select("p_partkey", enrich.frame_phase(F.array(F.lit(10), F.lit(30)), F.when(F.col("p_size") % 4 > 0, F.col("p_size"))).alias("phase"))


@query("SELECT p_partkey, greatest(p_size, 20)::BIGINT AS baseline, greatest(p_size, 20, p_size % 7 * 9)::BIGINT AS peak, (greatest(p_size, 20, p_size % 7 * 9) - greatest(p_size, 20))::BIGINT AS increment, p_size % 2 = 0 AND p_size % 3 = 0 AS ok FROM part")
def memory_increments(spark, d):
    n = F.col("p_size")
    sample = lambda values, ok: F.struct(F.array(*values).alias("bytes"), ok.alias("ok"))
    got = enrich.memory_increment(sample([n, F.lit(20)], n % 2 == 0), sample([n % 7 * 9], n % 3 == 0))
    return s.table(spark, d, "part").select("p_partkey", *(got[a].cast("bigint").alias(b) for a, b in (("baseline_bytes", "baseline"), ("peak_bytes", "peak"), ("peak_increment_bytes", "increment"))), got["attribution_ok"].alias("ok"))


@query("SELECT c_custkey AS record_id, c_mktsegment, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_name END, '') AS prediction, CASE WHEN c_custkey % 6 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN c_custkey % 6 = 0 THEN 'timeout' END AS failed_reason FROM customer")
def result_row_table(spark, d):
    c = s.table(spark, d, "customer").withColumn("record_id", F.col("c_custkey"))
    said = c.where("record_id % 4 > 0").select("record_id", F.col("c_name").alias("prediction"))
    failed = c.where("record_id % 6 = 0").select("record_id", F.lit("timeout").alias("failed_reason"))
    return enrich.result_rows(c, said, failed, ["c_mktsegment"]).select("record_id", "c_mktsegment", "prediction", "status", "failed_reason")


@query("""WITH r AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'malformed' ELSE 'valid' END AS state FROM supplier)
SELECT count(*) FILTER (state <> 'valid') = 0 AS complete, count(*) AS records, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'malformed') AS malformed,
 (SELECT string_agg(record_id, ',' ORDER BY record_id) FROM (SELECT record_id FROM r WHERE state = 'missing' ORDER BY record_id LIMIT 10)) AS missing_sample FROM r""")  # fmt: skip
def trigger_metadata(spark, d):
    k = F.col("record_id")
    windows = F.array(F.struct(F.lit(1.0).alias("start_s"), F.lit(2.0).alias("end_s")))
    note = F.struct(F.lit("point").alias("trigger_type"))
    notes = F.when(k % 5 == 0, None).when(k % 7 == 0, F.array(note, note)).otherwise(F.array(note))
    records = s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id")).select("record_id", windows.alias("windows"), notes.alias("trigger_annotations"))
    told = validation.trigger_metadata_status(records)
    return told.select("complete", F.col("record_count").alias("records"), F.col("valid_record_count").alias("valid"), F.col("missing_record_count").alias("missing"), F.col("malformed_record_count").alias("malformed"), F.array_join(F.col("missing_sample").cast("array<string>"), ",").alias("missing_sample"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Native Streaming' ELSE 'Non-native' END AS visual_state, CASE WHEN n_nationkey % 6 = 0 THEN 'autonomous_primary' ELSE 'polling_baseline' END AS track,
 n_nationkey % 6 = 0 AND n_nationkey % 4 > 0 AS primary_eligible FROM nation""")  # fmt: skip
def execution_tracks(spark, d):
    k = F.col("n_nationkey")
    able = s.table(spark, d, "nation").select("n_nationkey", (k % 2 == 0).alias("persistent_session"), (k % 3 == 0).alias("autonomous"), F.when(k % 4 > 0, "wall_clock").otherwise("logical").alias("pacing"))
    return gates.execution_track(able).select("n_nationkey", "visual_state", F.col("proactive_track").alias("track"), F.col("proactive_primary_eligible").alias("primary_eligible"))


FOUND = {"mail": r"[A-Za-z0-9.]+@[a-z0-9]+\.[a-z]+", "digits": "[0-9]{6,}", "key": "(?i)secret|token"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern FROM documents WHERE regexp_matches(text, '{v}')" for k, v in FOUND.items()))
def secret_scan(spark, d):
    return validation.secrets(s.table(spark, d, "documents").select("doc_id", F.col("text").alias("value")), FOUND).select("doc_id", "pattern")


@query("SELECT doc_id, least(greatest(doc_id % 30 / 10.0 - 1, 0), 1)::DOUBLE AS score, regexp_replace('http://h/' || coalesce(lang, '') || repeat('/', CAST(doc_id % 4 AS INT)), '/+$', '') AS url FROM documents")
def clamped_scores(spark, d):
    url = F.concat(F.lit("http://h/"), F.coalesce("lang", F.lit("")), F.repeat(F.lit("/"), (F.col("doc_id") % 4).cast("int")))
    return s.table(spark, d, "documents").select("doc_id", tx.clamp_score(F.col("doc_id") % 30 / 10 - 1).alias("score"), tx.base_url(url).alias("url"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN greatest(1, floor(p_size / 7.0 + 0.5)) END::BIGINT AS frames, 1000 + p_size::BIGINT * 250000000 AS scheduled_ns, greatest(0, p_size - 10)::DOUBLE AS from_s, p_size + 2.5::DOUBLE AS to_s,
 CASE WHEN p_size % 3 > 0 THEN (p_size - 1) / (p_size % 3)::DOUBLE END AS duration_s FROM part""")  # fmt: skip
def time_plan_fields(spark, d):
    n = F.col("p_size").cast("double")
    evidence = timeplan.qa_evidence(n, n + 2.5)
    return s.table(spark, d, "part").select(
        "p_partkey", timeplan.frame_total(F.when(F.col("p_size") % 4 > 0, n / 7)).cast("bigint").alias("frames"), timeplan.scheduled_ns(n / 4 + 3, F.lit(1000).cast("bigint"), F.lit(3.0)).alias("scheduled_ns"),
        evidence["start_s"].alias("from_s"), evidence["end_s"].alias("to_s"), timeplan.duration(F.col("p_size"), F.col("p_size") % 3).cast("double").alias("duration_s"),
    )


@query("""WITH c AS (SELECT conv_id AS record_id, turn, text, CASE WHEN role = 'assistant' THEN 'answer' WHEN role = 'user' THEN 'wait' ELSE 'telemetry' END AS kind FROM conversations)
SELECT record_id, sha256(arg_max(text, turn)) AS prediction_sha256 FROM c WHERE kind = 'answer' AND turn % 5 <> 4 AND trim(text, chr(32) || chr(9) || chr(10)) <> '' GROUP BY record_id""")  # fmt: skip
def last_answer_predictions(spark, d):
    sent = s.turns(spark, d).withColumn("query_dispatch_perf_ns", F.when(F.col("event_index") % 5 != 4, F.col("event_index").cast("bigint")))
    return scoring.last_answers(sent).select("record_id", tx.sha256(F.col("prediction")).alias("prediction_sha256"))


@query(with_views("calls") + "SELECT record_id, count(*) AS n, sum(input_text_tokens) AS tokens, min(start_perf_ns) AS first_ns FROM calls GROUP BY record_id")
def calls_of_events(spark, d):
    flat = s.model_calls(spark, d)
    nested = flat.groupBy("record_id").agg(F.struct(F.collect_list(F.struct("line", "start_perf_ns", "input_text_tokens")).alias("model_calls")).alias("telemetry"))
    return telemetry.calls(nested).groupBy("record_id").agg(F.count("*").alias("n"), F.sum("input_text_tokens").alias("tokens"), F.min("start_perf_ns").alias("first_ns"))


@query("SELECT l_suppkey AS record_id, count(*) AS n, sum(l_linenumber)::BIGINT AS places FROM lineitem GROUP BY l_suppkey")
def frames_of_events(spark, d):
    frames = s.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("record_id")).agg(F.struct(F.collect_list(F.struct("l_linenumber")).alias("frame_telemetry")).alias("telemetry"))
    return telemetry.frame_rows(frames).groupBy("record_id").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("places"))


@query("""SELECT arg_max('backend' || o_orderkey % 3, o_orderkey) FILTER (o_orderkey % 2 = 0) AS backend, arg_max(o_custkey, o_orderkey) FILTER (o_orderkey % 5 = 0)::DOUBLE AS interval_ms, bool_and(coalesce(o_orderkey % 7 > 0, false)) AS attribution_ok, count(*) AS samples
 FROM orders WHERE o_orderkey % 3 > 0""")  # fmt: skip
def gpu_summaries(spark, d):
    k = F.col("o_orderkey")
    gpu = F.struct(F.when(k % 2 == 0, F.concat(F.lit("backend"), k % 3)).alias("backend"), F.when(k % 5 == 0, F.col("o_custkey").cast("double")).alias("sample_interval_ms"), (k % 7 > 0).alias("attribution_ok"))
    events = s.table(spark, d, "orders").select(k.alias("event_index"), F.struct(F.when(k % 3 > 0, gpu).alias("gpu")).alias("telemetry"))
    return telemetry.gpu_summary(events).select("backend", F.col("sample_interval_ms").alias("interval_ms"), "attribution_ok", "samples")


@query("""SELECT count(*) AS seen, count(*) FILTER (o_orderkey % 4 = 1) AS on_time, count(*) FILTER (o_orderkey % 4 = 1) / count(*) FILTER (o_orderkey % 4 > 0)::DOUBLE AS rate, count(*) FILTER (o_orderkey % 4 > 0) / count(*)::DOUBLE AS coverage,
 count(*) FILTER (o_orderkey % 3 = 0) / count(*)::DOUBLE AS completion FROM orders""")  # fmt: skip
def observation_rate_summary(spark, d):
    k = F.col("o_orderkey")
    seen = s.table(spark, d, "orders").select(F.when(k % 4 > 0, k % 4 == 1).alias("on_time"), F.when(k % 3 == 0, k).alias("commit_perf_ns"))
    return telemetry.observation_rates(seen).select(F.col("observation_count").alias("seen"), F.col("on_time_count").alias("on_time"), F.col("on_time_frame_rate").alias("rate"), F.col("on_time_frame_coverage").alias("coverage"), F.col("stream_completion_rate").alias("completion"))


@query("SELECT string_agg(c_mktsegment || '=' || n, ';' ORDER BY c_mktsegment) AS counts FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
def counts_as_map(spark, d):
    counts = s.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return telemetry.as_map(counts, "c_mktsegment").select(F.array_join(entries, ";").alias("counts"))


@query("SELECT count(*) FILTER (o_orderkey % 10 = 0) AS null_ids, count(o_custkey) FILTER (o_orderkey % 10 > 0) - count(DISTINCT o_custkey) FILTER (o_orderkey % 10 > 0) AS repeated_ids, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS open_statuses FROM orders")
def record_membership(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("open")
    rows = s.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey")).alias("record_id"), status.alias("status"))
    return validation.membership(rows)


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN 'left' ELSE 'right' END AS side FROM customer WHERE c_custkey % 9 IN (0, 1)")
def table_differences(spark, d):
    c = s.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return validation.differences(c.where("c_custkey % 9 <> 1"), c.where("c_custkey % 9 <> 0"))


JUDGED = "CASE WHEN c_custkey % 3 = 0 THEN 'SSR' WHEN c_custkey % 3 = 1 THEN ' crr ' ELSE 'OTHER' END"


@query(f"SELECT c_custkey AS call, (c_custkey % 2 = 0)::INT::DOUBLE AS score, CASE WHEN upper(trim({JUDGED})) IN ('SSR', 'CRR') THEN 'exact_fallback_no_vlm' ELSE 'exact_match' END AS score_method, upper(trim({JUDGED})) IN ('SSR', 'CRR') AS has_error FROM customer")
def judge_routing(spark, d):
    k = F.col("c_custkey")
    rows = s.table(spark, d, "customer").select(k.alias("call"), F.when(k % 3 == 0, "SSR").when(k % 3 == 1, " crr ").otherwise("OTHER").alias("task_type"), F.col("c_name").alias("question"), F.lit("Yes").alias("expected"), F.when(k % 2 == 0, "yes").otherwise("no").alias("prediction"))
    return scoring.judge(rows, "auto").select("call", "score", "score_method", F.col("judge_error").isNotNull().alias("has_error"))


SUMMARY = (
    with_views("ev")
    + """, log AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN ns END AS committed, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS lag, CASE WHEN event_id % 7 > 0 THEN event_id % 5 > 0 END AS on_time, CASE WHEN event_id % 4 = 0 THEN ns END AS sent,
 CASE WHEN event_id % 3 = 0 THEN ns + 1000000 END AS first, CASE WHEN event_id % 8 = 0 THEN ns + 5000000 END AS done, CASE WHEN event_id % 5 = 0 THEN 9.0::DOUBLE END AS told FROM ev),
 rec AS (SELECT DISTINCT record_id, record_id % 2 = 0 AS qa, record_id % 3 = 0 AS failed FROM ev), qas AS (SELECT record_id FROM rec WHERE qa),
 seen AS (SELECT log.*, qas.record_id IS NOT NULL AS qa FROM log LEFT JOIN qas USING (record_id) WHERE kind = 'observation'),
 q AS (SELECT CASE WHEN min(first) >= sent THEN (min(first) - sent) / 1e6 END AS ttft, CASE WHEN max(done) >= sent THEN (max(done) - sent) / 1e6 ELSE max(told) END AS total FROM log WHERE kind IN ('answer', 'wait') AND sent IS NOT NULL GROUP BY record_id, sent),
 b AS (SELECT record_id, min(sent) AS dispatch, min(ns) FILTER (kind = 'observation') AS seen_ns FROM log WHERE record_id IN (SELECT record_id FROM qas) GROUP BY record_id HAVING min(sent) IS NOT NULL),
 h AS (SELECT count(*) AS asked, quantile_cont(CASE WHEN dispatch >= seen_ns THEN (dispatch - seen_ns) / 1e9 END, 0.5) AS elapsed FROM b),
 c AS (SELECT l_suppkey AS record_id, CASE WHEN l_returnflag = 'A' THEN 'mixed_boundary' ELSE l_returnflag END AS stage, epoch_us(l_shipdate) * 1000 + l_linenumber % 2 * 1900000000000000000 AS s, l_linenumber AS n,
  CAST(l_quantity AS BIGINT) AS tokens, CASE WHEN l_discount > 0 THEN l_partkey END AS put FROM lineitem),
 p AS (SELECT c.*, s + tokens * 86400000000000 AS e, CASE WHEN dispatch IS NOT NULL THEN CASE WHEN s + tokens * 86400000000000 <= dispatch THEN 'history' WHEN stage = 'mixed_boundary' OR (s < dispatch AND dispatch < s + tokens * 86400000000000) THEN 'mixed' ELSE 'query' END END AS phase FROM c LEFT JOIN b USING (record_id)),
 spans AS (SELECT 'all' AS part, s, e FROM p UNION ALL SELECT phase, s, e FROM p WHERE phase IN ('history', 'mixed')),
 busy AS (SELECT part, sum(greatest(0, e - greatest(s, coalesce(before, s)))) / 1e9 AS len FROM (SELECT *, max(e) OVER (PARTITION BY part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans) GROUP BY part),
 u AS (SELECT count(DISTINCT (record_id, event_id % 50)) AS n FROM ev WHERE event_id % 3 > 0),
 o AS (SELECT count(*) AS n, count(*) FILTER (on_time) AS on_time, count(on_time) AS timed, count(committed) AS committed, count(lag) AS lags, quantile_cont(value, 0.5) AS processing, quantile_cont(lag, 0.95) AS lag, quantile_cont(value, 0.5) FILTER (qa) AS qa_processing FROM seen),
 w AS (SELECT count(*) AS n, count(CASE WHEN event_id % 5 > 0 THEN 1 END) AS timed, quantile_cont(CASE WHEN event_id % 5 > 0 THEN value END, 0.5) AS latency FROM ev WHERE kind = 'answer' AND event_id % 2 = 0 AND event_id % 3 > 0),
 k AS (SELECT count(*) AS n, sum(tokens)::BIGINT AS tokens, sum(put)::BIGINT AS put, count(put) / count(*) AS put_share, sum(n)::BIGINT AS frames, count(*) FILTER (phase = 'history') AS history, count(*) FILTER (phase = 'mixed') AS mixed,
  (sum(tokens) FILTER (phase = 'history'))::BIGINT AS history_tokens, (sum(n) FILTER (phase = 'mixed'))::BIGINT AS mixed_frames FROM p)
SELECT (SELECT quantile_cont(ttft, 0.5) FROM q) AS ttft_p50, (SELECT count(total) / count(*) FROM q) AS total_coverage, (SELECT max(total) FROM q) AS total_max, w.latency AS latency_p50, w.timed / w.n AS latency_coverage, o.processing AS processing_p50, o.lag AS lag_p95,
 o.on_time / o.timed AS on_time_rate, o.committed / o.n AS completion_rate, greatest(0, o.n - u.n)::BIGINT AS dropped, greatest(0, k.frames - u.n)::BIGINT AS duplicates, (SELECT sum(event_id % 3) FROM ev)::BIGINT AS images,
 k.tokens AS input_tokens, k.put AS output_tokens, k.put_share AS output_coverage, k.n AS call_count, (SELECT len FROM busy WHERE part = 'all') AS busy_s, (SELECT len FROM busy WHERE part = 'history') AS history_busy_s, (SELECT len FROM busy WHERE part = 'mixed') AS mixed_busy_s,
 (SELECT count(*) FROM qas) AS questions, h.asked AS boundaries, h.elapsed AS elapsed_p50, o.qa_processing AS qa_processing_p50, k.history AS history_calls, k.mixed AS mixed_calls, k.history_tokens AS history_tokens, k.mixed_frames AS mixed_frames,
 (SELECT count(*) FILTER (failed) / count(*) FROM rec) AS failure_rate, (SELECT count(*) FILTER (event_id % 3 = 0) / count(*) FROM ev WHERE kind = 'answer') AS first_token_coverage, (SELECT count(DISTINCT p_partkey % 9) FROM part) AS devices,
 (SELECT max(p_size) FROM part)::BIGINT AS peak, (SELECT string_agg(stage || '=' || n, ';' ORDER BY stage) FROM (SELECT stage, count(*) AS n FROM c GROUP BY stage)) AS stages FROM o, w, u, h, k"""
)


@query(SUMMARY)
def telemetry_summary(spark, d):
    e, ns = F.col("event_id"), F.col("ns")
    ev = s.event_log(spark, d)
    none = F.lit(None)
    log = ev.withColumns(
        {
            "commit_perf_ns": F.when(e % 3 > 0, ns), "frame_processing_ms": F.col("value"), "frame_lag_ms": F.when(e % 2 == 0, F.col("value") * 2), "on_time": F.when(e % 7 > 0, e % 5 > 0), "arrival_perf_ns": ns,
            "query_id": none.cast("string"), "query_dispatch_perf_ns": F.when(e % 4 == 0, ns), "semantic_query_arrival_perf_ns": none.cast("bigint"), "first_token_perf_ns": F.when(e % 3 == 0, ns + 1_000_000),
            "response_completion_perf_ns": F.when(e % 8 == 0, ns + 5_000_000), "ttft_ms": none.cast("double"), "response_total_ms": F.when(e % 5 == 0, 9.0), "failure_stage": none.cast("string"),
            "transport_uploaded_image_count": e % 3, "transport_uploaded_image_total_bytes": e,
        }
    )
    k = F.col("record_id")
    records = ev.select("record_id").distinct().select(k, F.when(k % 2 == 0, "qa").otherwise("proactive").alias("task"), F.when(k % 3 == 0, "failed").otherwise("completed").alias("status"), none.cast("string").alias("failed_reason"))
    li = s.table(spark, d, "lineitem")
    start, tokens = s.micros(F.col("l_shipdate")) * 1000 + F.col("l_linenumber") % 2 * F.lit(1_900_000_000_000_000_000), F.col("l_quantity").cast("bigint")
    calls = li.select(
        F.col("l_suppkey").alias("record_id"), F.when(F.col("l_returnflag") == "A", "mixed_boundary").otherwise(F.col("l_returnflag")).alias("stage"), start.alias("start_perf_ns"), (start + tokens * 86_400_000_000_000).alias("end_perf_ns"),
        tokens.alias("input_text_tokens"), F.when(F.col("l_discount") > 0, F.col("l_partkey")).alias("output_tokens"), F.col("l_linenumber").alias("submitted_frame_occurrences"), none.cast("bigint").alias("submitted_pixels"), none.cast("bigint").alias("num_cached_tokens"),
    )
    frames = ev.select("record_id", (e % 50).cast("string").alias("observation_id"), (e % 3).alias("submitted_occurrences"))
    said = log.where("kind = 'answer'")
    windows = said.select(F.when(e % 2 == 0, "in_window").otherwise("none").alias("source"), (e % 3 > 0).alias("is_answered"), F.when(e % 5 > 0, F.col("value")).alias("latency_ms"))
    device = F.struct((F.col("p_partkey") % 9).cast("string").alias("uuid"), F.col("p_size").cast("bigint").alias("peak_bytes"))
    gpu = s.table(spark, d, "part").select(F.col("p_partkey").alias("event_index"), F.struct(F.struct(F.lit("nvml").alias("backend"), F.lit(100.0).alias("sample_interval_ms"), F.lit(True).alias("attribution_ok"), F.array(device).alias("devices")).alias("gpu")).alias("telemetry"))
    told = telemetry.summarize(log, calls, frames, records, windows, said, telemetry.gpu_summary(gpu), telemetry.gpu_devices(gpu))
    fields = {
        "responsiveness": {"ttft_ms.p50": "ttft_p50", "response_total_ms.coverage": "total_coverage", "response_total_ms.max": "total_max", "proactive_response_latency_ms.p50": "latency_p50", "frame_processing_ms.p50": "processing_p50", "frame_lag_ms.p95": "lag_p95", "on_time_frame_rate": "on_time_rate", "stream_completion_rate": "completion_rate"},
        "visual_workload": {"dropped_frames": "dropped", "duplicate_frame_occurrences": "duplicates", "transport_uploaded_images": "images"},
        "text_and_inference": {"input_text_tokens": "input_tokens", "output_tokens": "output_tokens", "model_call_count": "call_count", "inference_wall_time_s": "busy_s"},
        "qa_history_processing": {"inference_wall_time_s": "history_busy_s", "mixed_boundary_inference_wall_time_s": "mixed_busy_s", "record_count": "questions", "query_boundary_count": "boundaries", "history_elapsed_wall_time_s.p50": "elapsed_p50", "frame_processing_ms.p50": "qa_processing_p50", "model_call_count": "history_calls", "mixed_boundary_model_call_count": "mixed_calls", "input_text_tokens": "history_tokens", "mixed_boundary_submitted_frame_occurrences": "mixed_frames"},
        "reliability": {"records.failure_rate": "failure_rate"},
        "telemetry_coverage": {"proactive_response_latency": "latency_coverage", "output_tokens": "output_coverage", "response_first_token": "first_token_coverage"},
    }
    stages = F.array_sort(F.transform(F.map_entries("text_and_inference.calls_by_stage"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))))
    whole = {"dropped", "duplicates"}
    return told.select(
        *((F.col(f"{group}.{path}").cast("bigint") if name in whole else F.col(f"{group}.{path}")).alias(name) for group, paths in fields.items() for path, name in paths.items()),
        F.size("gpu_memory.devices").cast("bigint").alias("devices"), F.array_max("gpu_memory.devices.peak_bytes").alias("peak"), F.array_join(stages, ";").alias("stages"),
    )

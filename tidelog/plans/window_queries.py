"""Queries over windows, episodes and observations, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import timeplan
from tidelog.operators import assignment, enrich, scoring, sweep, telemetry, validation, views, windows
from tidelog.plans import standins as s
from tidelog.plans.standins import DAY, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BASE = with_views("ev", "trig", "ans", "obs", "specs")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def specs_of(spark, d):
    return windows.window_specs(s.triggers(spark, d), DAY)


def r6(c):
    return F.round(c, 6)


@query(f"{BASE} SELECT record_id, position, start_s, end_s, next_trigger_s, inter_trigger_gap_s, crowded_window, eventual_end_s, end_s - start_s AS effective_window_duration_s FROM specs")
def window_specs(spark, d):
    return specs_of(spark, d)


@query(f"{BASE} SELECT count(*) AS window_count, count(*) FILTER (crowded_window) AS crowded_window_count, count(*) FILTER (NOT crowded_window) AS non_crowded_window_count, round(min(inter_trigger_gap_s), 6) AS min_gap_s, round(sum(end_s - start_s), 3) AS duration_s FROM specs")
def window_density_summary(spark, d):
    return windows.density_summary(specs_of(spark, d)).withColumns({"min_gap_s": r6("min_gap_s"), "duration_s": F.round("duration_s", 3)})


INSIDE = "inside AS (SELECT record_id, position, episode, t FROM (SELECT specs.record_id, position, episode, t, row_number() OVER (PARTITION BY specs.record_id, position ORDER BY episode) AS r FROM specs JOIN ans ON ans.record_id = specs.record_id AND t >= start_s AND t < end_s) WHERE r = 1)"


@query(f"{BASE}, {INSIDE} SELECT * FROM inside")
def inwindow_first_match(spark, d):
    return assignment.first_inside(specs_of(spark, d), s.answers(spark, d))


FOLD = """
w AS (SELECT record_id, position, start_s, end_s FROM specs),
eps AS (SELECT record_id, list({'e': episode, 't': t} ORDER BY episode) AS eps FROM ans GROUP BY record_id),
walk AS (
  SELECT record_id, -1 AS position, CAST([] AS INT[]) AS used, '' AS source, CAST(NULL AS INT) AS episode FROM (SELECT DISTINCT record_id FROM w)
  UNION ALL
  SELECT record_id, position, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, CASE WHEN inw IS NOT NULL THEN 'in_window' WHEN pick IS NOT NULL THEN 'before_window' ELSE 'no_output' END, pick
  FROM (SELECT *, coalesce(inw, bef) AS pick FROM (
    SELECT w.record_id, w.position, used,
      list_filter(coalesce(eps, []), lambda x: NOT list_contains(used, x.e) AND x.t >= w.start_s AND x.t < w.end_s)[1].e AS inw,
      list_filter(coalesce(eps, []), lambda x: NOT list_contains(used, x.e) AND x.t < w.start_s)[-1].e AS bef
    FROM walk JOIN w ON w.record_id = walk.record_id AND w.position = walk.position + 1 LEFT JOIN eps ON eps.record_id = w.record_id))
), strict AS (SELECT record_id, position, source, episode FROM walk WHERE position >= 0)"""
RECURSIVE = with_views("ev", "trig", "ans", "obs", "specs", recursive=True)


@query(f"{RECURSIVE}, {FOLD} SELECT record_id, position, source, coalesce(episode, -1) AS episode FROM strict")
def strict_assignment_full(spark, d):
    return assignment.assign_strict(specs_of(spark, d), s.answers(spark, d)).fillna({"episode": -1})


EVENTUAL = "eventual AS (SELECT specs.record_id, specs.position, CASE WHEN min(episode) IS NULL THEN 'no_output' ELSE 'eventual' END AS source, min(episode) AS episode FROM specs LEFT JOIN ans ON ans.record_id = specs.record_id AND t >= start_s AND t < eventual_end_s GROUP BY ALL)"


@query(f"{BASE}, {EVENTUAL} SELECT record_id, position, source, coalesce(episode, -1) AS episode FROM eventual")
def eventual_assignment(spark, d):
    return assignment.assign_eventual(specs_of(spark, d), s.answers(spark, d)).fillna({"episode": -1})


def scored(spark, d, view):
    specs, said = specs_of(spark, d), s.answers(spark, d)
    assigned = assignment.assign_strict(specs, said) if view == "strict" else assignment.assign_eventual(specs, said)
    seen = windows.observability(specs, s.observations(spark, d), "end_s" if view == "strict" else "eventual_end_s")
    rows = seen.join(assigned, ["record_id", "position"]).join(said.select("record_id", "episode", "value"), ["record_id", "episode"], "left")
    hit = F.col("source").isin("in_window", "eventual")
    return rows.withColumns({"score": F.when(hit, (F.col("value") > 50).cast("double")).otherwise(0.0), "is_answered": F.col("episode").isNotNull()})


VIEW = "count(*) AS window_count, coalesce(sum(score), 0)::DOUBLE AS score_sum, count(*) FILTER (score >= 1) AS fully_correct_count, round(coalesce(sum(score)::DOUBLE / count(*), 0), 6) AS accuracy, count(*) FILTER (is_answered) AS answered_count, count(*) FILTER (source = 'no_output') AS no_output_count, count(*) FILTER (source = 'before_window') AS before_window_count, count(*) FILTER (observable) AS observable_count, count(*) FILTER (NOT observable) AS unobservable_count, round(count(*) FILTER (observable)::DOUBLE / count(*), 6) AS observable_coverage"


def rows_sql(source: str, end: str) -> str:
    return f"rows AS (SELECT specs.*, a.source, a.episode, a.episode IS NOT NULL AS is_answered, CASE WHEN a.source IN ('in_window', 'eventual') AND ans.value > 50 THEN 1.0 ELSE 0.0 END AS score, EXISTS (SELECT 1 FROM obs WHERE obs.record_id = specs.record_id AND obs.t >= specs.start_s AND obs.t < specs.{end}) AS observable FROM specs JOIN {source} a USING (record_id, position) LEFT JOIN ans ON ans.record_id = specs.record_id AND ans.episode = a.episode)"


def rounded(df):
    return df.withColumns({"accuracy": r6("accuracy"), "observable_coverage": r6("observable_coverage")})


@query(f"{RECURSIVE}, {FOLD}, {rows_sql('strict', 'end_s')} SELECT {VIEW} FROM rows")
def strict_view_summary(spark, d):
    return rounded(views.view_summary(scored(spark, d, "strict")))


@query(f"{RECURSIVE}, {FOLD}, {rows_sql('strict', 'end_s')} SELECT record_id, {VIEW} FROM rows GROUP BY record_id")
def strict_view_by_record(spark, d):
    return rounded(views.view_summary(scored(spark, d, "strict"), ("record_id",)))


@query(f"{RECURSIVE}, {FOLD}, {rows_sql('strict', 'end_s')} SELECT crowded_window, {VIEW} FROM rows GROUP BY crowded_window")
def crowding_views(spark, d):
    return rounded(views.view_summary(scored(spark, d, "strict"), ("crowded_window",)))


@query(f"{RECURSIVE}, {FOLD}, {rows_sql('strict', 'end_s')} SELECT source, count(*) AS n FROM rows GROUP BY source")
def source_distribution(spark, d):
    return views.source_distribution(scored(spark, d, "strict"))


@query(f"{BASE}, {EVENTUAL}, {rows_sql('eventual', 'eventual_end_s')} SELECT {VIEW} FROM rows")
def eventual_view_summary(spark, d):
    return rounded(views.view_summary(scored(spark, d, "eventual")))


OUT = "o AS (SELECT ans.record_id, ans.t, ans.episode, NOT EXISTS (SELECT 1 FROM specs w WHERE w.record_id = ans.record_id AND ans.t >= w.start_s AND ans.t < w.{end}) AS outside, EXISTS (SELECT 1 FROM specs w WHERE w.record_id = ans.record_id AND w.start_s > ans.t) AS later FROM ans)"


@query(f"{BASE}, {OUT.format(end='end_s')} SELECT count(*) FILTER (outside AND later) AS false_alarm_count, count(*) AS answered_episode_count, round(count(*) FILTER (outside AND later)::DOUBLE / count(*), 6) AS false_alarm_rate, count(*) FILTER (outside) AS outside_count FROM o")
def false_alarm_rate(spark, d):
    return views.false_alarms(s.answers(spark, d), specs_of(spark, d)).withColumn("false_alarm_rate", r6("false_alarm_rate"))


@query(f"{BASE}, {OUT.format(end='end_s')} SELECT record_id, episode, t FROM o WHERE outside")
def outside_intrusion(spark, d):
    return views.episodes_outside(s.answers(spark, d), specs_of(spark, d)).where("outside").select("record_id", "episode", "t")


@query(f"{BASE}, {OUT.format(end='eventual_end_s')} SELECT record_id, episode, t FROM o WHERE outside")
def eventual_outside(spark, d):
    return views.episodes_outside(s.answers(spark, d), specs_of(spark, d), "eventual_end_s").where("outside").select("record_id", "episode", "t")


@query(f"{RECURSIVE}, {FOLD} SELECT count(*) AS window_count, count(*) FILTER (source <> 'in_window') AS missed_window_count, round(count(*) FILTER (source <> 'in_window')::DOUBLE / count(*), 6) AS miss_rate FROM strict")
def miss_rate(spark, d):
    return views.misses(assignment.assign_strict(specs_of(spark, d), s.answers(spark, d))).withColumn("miss_rate", r6("miss_rate"))


@query(f"{BASE} SELECT specs.record_id, position, greatest(count(t) - 1, 0) AS redundant FROM specs LEFT JOIN ans ON ans.record_id = specs.record_id AND t >= start_s AND t < end_s GROUP BY ALL")
def redundant_responses(spark, d):
    return views.redundancy(specs_of(spark, d), s.answers(spark, d))


@query(f"{BASE} SELECT specs.record_id, position, greatest(count(t) - 1, 0) AS redundant FROM specs LEFT JOIN ans ON ans.record_id = specs.record_id AND t >= start_s AND t < eventual_end_s GROUP BY ALL")
def eventual_redundant(spark, d):
    return views.redundancy(specs_of(spark, d), s.answers(spark, d), "eventual_end_s")


@query(f"{BASE} SELECT specs.record_id, position, count(t) AS observed_frame_count, count(t) > 0 AS observable FROM specs LEFT JOIN obs ON obs.record_id = specs.record_id AND t >= start_s AND t < end_s GROUP BY ALL")
def window_observability(spark, d):
    return windows.observability(specs_of(spark, d), s.observations(spark, d)).select("record_id", "position", "observed_frame_count", "observable")


ARRIVAL = "arrival AS (SELECT specs.record_id, position, start_s, arg_min(obs.ns, obs.event_index) AS arrival_ns FROM specs LEFT JOIN obs ON obs.record_id = specs.record_id AND obs.t >= start_s GROUP BY ALL)"


@query(f"{BASE}, {ARRIVAL} SELECT record_id, position, start_s, coalesce(arrival_ns, -1) AS arrival_ns FROM arrival")
def trigger_asof_arrival(spark, d):
    return sweep.first_from(s.triggers(spark, d), s.observations(spark, d), "event_index", "arrival_ns").fillna({"arrival_ns": -1})


@query(f"{BASE}, {INSIDE}, {ARRIVAL}, l AS (SELECT CASE WHEN ans.ns >= arrival_ns THEN (ans.ns - arrival_ns) / 1e6::DOUBLE END AS ms FROM inside JOIN arrival USING (record_id, position) JOIN ans ON ans.record_id = inside.record_id AND ans.episode = inside.episode) SELECT count(*) AS population_count, count(ms) AS observed_count, round(count(ms)::DOUBLE / count(*), 6) AS coverage, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(max(ms), 3) AS max FROM l")
def response_latency_distribution(spark, d):
    said = s.answers(spark, d).withColumnRenamed("ns", "response_ns")
    hits = assignment.first_inside(specs_of(spark, d), said).join(said.select("record_id", "episode", "response_ns"), ["record_id", "episode"])
    rows = hits.join(s.triggers(spark, d), ["record_id", "position"])
    out = views.distribution(scoring.latency(rows, s.observations(spark, d)), "latency_ms")
    return out.withColumns({"coverage": r6("coverage"), "p50": F.round("p50", 3), "p95": F.round("p95", 3), "max": F.round("max", 3)})


@query(f"{BASE}, e AS (SELECT record_id, max(end_s) AS evaluation_end_s, min(start_s) AS instruction_s FROM specs GROUP BY record_id) SELECT record_id, evaluation_end_s, greatest(0, instruction_s - 5) AS start_s, least(evaluation_end_s, instruction_s + 100000) AS end_s, greatest(0, evaluation_end_s - (instruction_s + 100000)) AS grace_s FROM e")
def evidence_interval(spark, d):
    e = specs_of(spark, d).groupBy("record_id").agg(F.max("end_s").alias("last"), F.min("start_s").alias("instruction_s"))
    end, duration = timeplan.evaluation_end(F.col("last"), F.col("instruction_s")), F.col("instruction_s") + 100000
    span = timeplan.proactive_evidence(F.col("instruction_s"), end, duration)
    return e.select("record_id", end.alias("evaluation_end_s"), span["start_s"].alias("start_s"), span["end_s"].alias("end_s"), timeplan.grace(end, duration).alias("grace_s"))


@query(f"{BASE} SELECT record_id, position, CASE WHEN start_s < lag(start_s) OVER (PARTITION BY record_id ORDER BY position) THEN 'unordered' WHEN end_s < start_s THEN 'reversed' END AS problem FROM specs")
def record_validation(spark, d):
    return validation.window_problems(specs_of(spark, d).select("record_id", "position", "start_s", "end_s")).select("record_id", "position", "problem")


@query(f"{BASE} SELECT record_id, bool_or(end_s - start_s <= 3600) AS dense, count(*) AS windows FROM specs GROUP BY record_id")
def sampling_stress_split(spark, d):
    spans = specs_of(spark, d).groupBy("record_id").agg(F.collect_list(F.struct("start_s", "end_s")).alias("w"))
    return spans.select("record_id", validation.is_dense(F.col("w"), 3600.0).alias("dense"), F.size("w").cast("bigint").alias("windows"))


@query(f"{BASE} SELECT record_id, event_index, ns, coalesce(lead(ns) OVER (PARTITION BY record_id ORDER BY event_index), -1) AS frame_deadline_perf_ns, coalesce(ns + CAST(value * 1e9 * 60 AS BIGINT) <= lead(ns) OVER (PARTITION BY record_id ORDER BY event_index), false) AS on_time, value * 60000 AS processing_ms FROM obs".replace("value * 60000 AS processing_ms", "round(CAST(value * 1e9 * 60 AS BIGINT) / 1e6::DOUBLE, 3) AS processing_ms"))
def frame_deadline_on_time(spark, d):
    o = enrich.frame_deadlines(s.observations(spark, d).withColumn("observation_id", F.col("event_index")), "ns")
    commits = o.select("record_id", "observation_id", (F.col("ns") + F.round(F.col("value") * 1e9 * 60).cast("bigint")).alias("commit_perf_ns"))
    out = enrich.reconcile_commits(o.withColumns({"arrival_perf_ns": F.col("ns"), "scheduled_arrival_perf_ns": F.col("ns")}), commits)
    return out.select("record_id", "event_index", "ns", "frame_deadline_perf_ns", "on_time", F.round("frame_processing_ms", 3).alias("processing_ms")).fillna({"frame_deadline_perf_ns": -1, "on_time": False})


@query("""WITH ev AS (SELECT user_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS event_index, event_type = 'error' AS flush FROM events),
seg AS (SELECT *, coalesce(sum(flush::INT) OVER (PARTITION BY record_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM ev)
SELECT record_id, event_index, segment, CAST(floor((row_number() OVER (PARTITION BY record_id, segment ORDER BY event_index) - 1) / 3) AS BIGINT) AS chunk FROM seg""")
def chunking(spark, d):
    return enrich.chunks(s.event_log(spark, d), 3, F.col("kind") == "wait").select("record_id", "event_index", "segment", "chunk")


@query(f"{BASE} SELECT record_id, event_index, CAST(sum((kind = 'wait')::INT) OVER (PARTITION BY record_id ORDER BY event_index) AS BIGINT) AS island, kind = 'answer' AND coalesce(lead(kind) OVER (PARTITION BY record_id ORDER BY event_index) = 'wait', false) AS is_last FROM ev")
def response_islands(spark, d):
    return enrich.response_islands(s.event_log(spark, d)).select("record_id", "event_index", "island", "is_last")


@query(f"{BASE} SELECT record_id, event_index % 7 AS observation_id, max(ns) AS commit_perf_ns FROM (SELECT record_id, event_index, ns FROM obs UNION ALL SELECT record_id, event_index, ns + 5 FROM ev WHERE kind = 'wait') GROUP BY ALL")
def commit_reconcile(spark, d):
    ev = s.event_log(spark, d).withColumn("observation_id", F.col("event_index") % 7)
    return enrich.last_commits(ev.where("kind = 'observation'").withColumn("commit_perf_ns", F.col("ns")), ev.where("kind = 'wait'").withColumn("commit_perf_ns", F.col("ns") + 5))


@query(f"{BASE} SELECT q.record_id, q.t, max(o.t) AS visible_s FROM ans q LEFT JOIN obs o ON o.record_id = q.record_id AND o.t <= q.t GROUP BY ALL")
def visible_frames(spark, d):
    return enrich.visible_until(s.answers(spark, d).select("record_id", "t"), s.observations(spark, d).select("record_id", "t"))


@query(f"{BASE}, g AS (SELECT record_id, 'dispatch:' || CAST(ns // 86400000000000 AS VARCHAR) AS query, min(ns // 86400000000000) AS b, min(CASE WHEN value > 20 THEN ns END) AS f, max(ns) AS c, min(value) AS tf, max(value) AS tt FROM ev WHERE kind IN ('answer', 'wait') GROUP BY ALL) SELECT record_id, query, CASE WHEN f >= b THEN (f - b) / 1e6::DOUBLE ELSE tf END AS ttft_ms, CASE WHEN c >= b THEN (c - b) / 1e6::DOUBLE ELSE tt END AS response_total_ms FROM g")
def query_group_ttft(spark, d):
    day = F.expr("ns div 86400000000000")
    ev = s.event_log(spark, d).withColumns({"query_dispatch_perf_ns": day, "query_id": F.lit(None).cast("string"), "semantic_query_arrival_perf_ns": F.lit(None).cast("bigint"), "first_token_perf_ns": F.when(F.col("value") > 20, F.col("ns")), "response_completion_perf_ns": F.col("ns"), "ttft_ms": F.col("value"), "response_total_ms": F.col("value")})
    return telemetry.query_groups(ev)


@query(f"{BASE} SELECT (SELECT count(*) FROM obs) AS core_delivered_frames, u AS unique_submitted_frames, o AS submitted_frame_occurrences, greatest(0, o - u) AS duplicate_frame_occurrences, greatest(0, (SELECT count(*) FROM obs) - u) AS dropped_frames, round(greatest(0, (SELECT count(*) FROM obs) - u)::DOUBLE / (SELECT count(*) FROM obs), 6) AS dropped_frame_rate FROM (SELECT count(DISTINCT (record_id, event_index % 11)) FILTER (value > 30) AS u, count(*) AS o FROM obs)")
def unique_frames_dropped(spark, d):
    o = s.observations(spark, d)
    frames = o.select("record_id", (F.col("event_index") % 11).alias("observation_id"), (F.col("value") > 30).cast("int").alias("submitted_occurrences"))
    return telemetry.frame_workload(o, frames, o.agg(F.count("*").alias("submitted_frame_occurrences"))).withColumn("dropped_frame_rate", r6("dropped_frame_rate"))


@query(f"{BASE} SELECT round(count(nullif(kind, 'wait'))::DOUBLE / count(*), 6) AS kinds, round(count(CASE WHEN value > 50 THEN value END)::DOUBLE / count(*), 6) AS high_values FROM ev")
def coverage_ratios(spark, d):
    ev = s.event_log(spark, d).select(F.nullif("kind", F.lit("wait")).alias("k"), F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return telemetry.coverage(ev, {"kinds": "k", "high_values": "v"}).select(r6("kinds").alias("kinds"), r6("high_values").alias("high_values"))

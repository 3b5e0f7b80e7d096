"""Queries over records and their logs: run-time latency, event sources, drift, files, reviews, exact percentiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import episodes, quantiles, scoring, validation, windows
from tidelog.plans import standins as s
from tidelog.plans.standins import DAY, with_views
from tidelog.plans.stream_queries import STATES
from tidelog.sources import filehash
from tidelog.sources.folders import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Run-time latency: episodes in order of time, each to the first free window that holds it.

GREEDY = """
eps AS (SELECT record_id, episode, t, ns, row_number() OVER (PARTITION BY record_id ORDER BY t, episode) AS k FROM (SELECT record_id, event_index AS episode, t, ns FROM ev WHERE kind = 'answer')),
wins AS (SELECT record_id, list({'p': position, 's': start_s, 'e': end_s} ORDER BY position) AS wins FROM specs GROUP BY record_id),
walk AS (
  SELECT record_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS position, CAST(NULL AS INT) AS episode FROM wins
  UNION ALL
  SELECT record_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick, episode FROM (
    SELECT eps.record_id, eps.k, used, eps.episode, list_filter(wins, lambda w: NOT list_contains(used, w.p) AND w.s <= eps.t AND eps.t < w.e)[1].p AS pick
    FROM walk JOIN eps ON eps.record_id = walk.record_id AND eps.k = walk.k + 1 JOIN wins ON wins.record_id = eps.record_id)
), placed AS (SELECT walk.record_id, walk.position, walk.episode, ns, start_s FROM walk JOIN eps USING (record_id, episode) JOIN specs ON specs.record_id = walk.record_id AND specs.position = walk.position WHERE walk.position IS NOT NULL),
seen AS (SELECT placed.*, (SELECT arg_min({'t': o.t, 'ns': o.ns}, o.event_index) FROM ev o WHERE o.kind = 'observation' AND o.record_id = placed.record_id AND o.t >= placed.start_s - 1e-9::DOUBLE) AS o FROM placed)"""


def marked_specs(spark: SparkSession, d: str) -> DataFrame:
    """Windows of purchases (points) and signups (states of half an hour a unit of value), which overlap."""
    log = s.event_log(spark, d).where("kind in ('trigger', 'telemetry')")
    until = F.when(F.col("kind") == "telemetry", F.col("t") + F.col("value") * 1800)
    marks = log.select("record_id", "event_index", F.col("t").alias("start_s"), until.alias("state_end_s"), F.col("kind").eqNullSafe("telemetry").alias("is_state"))
    place = (F.row_number().over(windows.Window.partitionBy("record_id").orderBy("event_index")) - 1).cast("int")
    return windows.window_specs(marks.withColumn("position", place).drop("event_index"), DAY, starts_ascend=False)


@query(f"{with_views('ev', recursive=True)}, {STATES}, {GREEDY} SELECT record_id, episode, position, o.t AS trigger_video_time_s, o.ns AS trigger_arrival_ns, ns AS response_arrival_ns, round((ns - o.ns) / 1e6::DOUBLE, 3) AS latency_ms FROM seen WHERE ns >= o.ns")
def runtime_window_latency(spark, d):
    said = s.event_log(spark, d).where("kind = 'answer'").select("record_id", F.col("event_index").alias("episode"), "t", F.col("ns").alias("core_event_receive_perf_ns"))
    return scoring.run_time_latency(marked_specs(spark, d), said, s.observations(spark, d)).withColumn("latency_ms", F.round("latency_ms", 3))


@query("""WITH t AS (SELECT l_orderkey AS record_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INT) AS position, l_quantity::DOUBLE AS start_s FROM lineitem)
SELECT record_id, position, start_s, (SELECT arg_min(b.start_s, b.position) FROM t b WHERE b.record_id = a.record_id AND b.position > a.position AND b.start_s > a.start_s) AS next_trigger_s FROM t a""")
def next_trigger_by_position(spark, d):
    """Line items as triggers whose starts (quantities) are in no order."""
    place = (F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")) - 1).cast("int")
    rows = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), place.alias("position"), F.col("l_quantity").cast("double").alias("start_s"))
    return windows.next_triggers(rows).select("record_id", "position", "start_s", "next_trigger_s")


@query("SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, {q}) AS {c}_{round(q * 1000)}" for c in ("l_extendedprice", "l_quantity") for q in (0.05, 0.5, 0.95, 0.999)) + " FROM lineitem")
def price_percentiles(spark, d):
    """Exact percentiles of a smooth and of a heavily tied column."""
    rows, out = s.table(spark, d, "lineitem"), {}
    for c in ("l_extendedprice", "l_quantity"):
        for q, value in zip((0.05, 0.5, 0.95, 0.999), quantiles.exact_percentiles(rows, c, [0.05, 0.5, 0.95, 0.999]), strict=True):
            out[f"{c}_{round(q * 1000)}"] = value
    return spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in out.items()))


# Files: customers written as a file for each nation, and a manifest that lies about some.


@query("""WITH f AS (SELECT 'nation=' || c_nationkey::VARCHAR AS path, c_nationkey AS k, sha256(string_agg(c_custkey::VARCHAR || ' ' || c_name || chr(10), '' ORDER BY c_custkey)) AS found FROM customer GROUP BY c_nationkey),
m AS (SELECT path, CASE WHEN k % 5 = 1 THEN sha256(found) ELSE found END AS told FROM f WHERE k % 7 <> 3 UNION ALL SELECT 'nation=' || (n_nationkey + 100)::VARCHAR, sha256(n_name) FROM nation WHERE n_nationkey % 6 = 0)
SELECT path, told, found, CASE WHEN found IS NULL THEN 'missing' WHEN told IS NULL THEN 'unlisted' WHEN told = found THEN 'same' ELSE 'changed' END AS state FROM m FULL JOIN f USING (path)""")
def file_hash_states(spark, d):
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    lines = s.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" "), "c_name").alias("value"))
    lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey").write.partitionBy("nation").text(folder)
    found = filehash.hashed_files(spark, folder).select(F.substring_index("path", "/", 1).alias("path"), "found")
    key = F.substring_index("path", "=", -1).cast("int")
    told = found.where(key % 7 != 3).select("path", F.when(key % 5 == 1, F.sha2(F.col("found").cast("binary"), 256)).otherwise(F.col("found")).alias("told"))
    gone = s.table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.concat(F.lit("nation="), (F.col("n_nationkey") + 100).cast("string")).alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("told"))
    return filehash.file_states(found, told.unionByName(gone))


# Conversations as records with their events inside, some of which differ from the log.

CHANGES = "CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN 'same' WHEN conv_id % 8 = 2 THEN 'swapped' WHEN conv_id % 8 = 6 THEN 'changed' WHEN conv_id % 8 = 3 THEN 'cut' ELSE 'same' END"


def conversation_events(spark: SparkSession, d: str) -> DataFrame:
    c = s.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("record_id"), F.col("turn").cast("int").alias("event_index"), F.col("role").alias("kind"), "text", F.struct(F.length("text").alias("chars"), (F.col("turn") * 2).cast("int").alias("mark")).alias("telemetry"))


@query(f"""WITH e AS (SELECT conv_id, turn, {CHANGES} AS how, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS record_id, CASE WHEN max(how) IS NOT NULL THEN max(n) - (max(how) = 'cut')::INT END AS embedded, max(n) AS logged,
  CASE WHEN max(how) IS NULL THEN 'not_embedded' WHEN max(how) = 'same' OR max(how) = 'swapped' AND max(n) < 2 THEN 'same' ELSE 'differs' END AS state FROM e GROUP BY conv_id""")
def event_drift(spark, d):
    log = conversation_events(spark, d)
    event = F.struct("kind", "text", F.when(F.expr("record_id % 8 = 6"), F.struct(F.col("telemetry.chars").alias("chars"), (F.col("telemetry.mark") + 1).alias("mark"))).otherwise(F.col("telemetry")).alias("telemetry"))
    held = log.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_index", event.alias("e")))), lambda x: x["e"]).alias("e"))
    how = F.expr(CHANGES.replace("conv_id", "record_id"))
    events = F.when(how == "swapped", F.reverse("e")).when(how == "cut", F.slice("e", 1, F.size("e") - 1)).when(how.isNotNull(), F.col("e"))
    return validation.event_drift(held.select("record_id", events.alias("events")), log)


@query("""WITH c AS (SELECT conv_id AS record_id, turn, role, text, conv_id % 3 AS m FROM conversations),
e AS (SELECT record_id, CASE WHEN m = 0 THEN 'embedded' WHEN m = 1 THEN 'legacy' ELSE 'none' END AS source, turn, m, role, text, coalesce(lower(trim(text)), '') IN ('', 'wait') OR turn % 5 = 0 AND m = 1 AS quiet FROM c)
SELECT record_id, source, count(*) FILTER (m < 2) AS events, count(*) FILTER (m = 0 AND role = 'assistant' OR m = 1 AND NOT quiet) AS answers, count(*) FILTER (m = 0 AND role = 'user' OR m = 1 AND quiet) AS waits,
  coalesce(sum(CASE WHEN m = 0 THEN length(text) WHEN m = 1 THEN CASE WHEN quiet THEN 4 ELSE length(text) END END), 0)::BIGINT AS chars,
  coalesce(string_agg(CASE WHEN m = 1 THEN 'legacy-step-' || turn::VARCHAR ELSE 'e' || turn::VARCHAR END, ',' ORDER BY turn) FILTER (m < 2), '') AS ids FROM e GROUP BY record_id, source""")
def event_source_resolution(spark, d):
    """A third of the conversations have their own events, a third steps from before event logs, a third neither."""
    c = s.table(spark, d, "conversations")
    part = F.col("conv_id") % 3
    kind = F.when(F.col("role") == "assistant", "answer").when(F.col("role") == "user", "wait").otherwise("telemetry")
    own = F.struct(F.concat(F.lit("e"), F.col("turn").cast("string")).alias("event_id"), kind.alias("kind"), F.col("turn").cast("double").alias("logical_time_s"), "text", F.struct(F.lit(None).cast("double").alias("ttft_ms"), F.lit(True).alias("on_time")).alias("telemetry"))
    step = F.struct(F.col("turn").cast("double").alias("step_t"), F.when(F.col("turn") % 5 == 0, " Wait ").otherwise(F.col("text")).alias("prediction"), F.lit(1.5).alias("ttft_ms"))
    gathered = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("turn", what.alias("x")))), lambda r: r["x"])
    held = c.withColumn("part", part).groupBy(F.col("conv_id").alias("record_id"), "part").agg(gathered(own).alias("own"), gathered(step).alias("steps"))
    records = held.select("record_id", F.when(F.col("part") == 0, F.col("own")).when(F.col("part") == 1, F.slice("own", 1, 0)).alias("events"), F.when(F.col("part") <= 1, F.col("steps")).alias("model_steps"))
    found = episodes.events_of(records).groupBy("record_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "answer").alias("answers"), F.count_if(F.col("kind") == "wait").alias("waits"), F.sum(F.length("text")).alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "event_id"))), lambda e: e["event_id"]), ",").alias("ids"),
    )
    return episodes.event_source(records, False).join(found, "record_id", "left").fillna({"events": 0, "answers": 0, "waits": 0, "chars": 0, "ids": ""})


# Reviews: orders by priority and status, with a disposition and a tier.

REVIEWS = "r AS (SELECT o_orderpriority AS dataset, o_orderstatus AS mode, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 't' || (o_custkey % 4)::VARCHAR END AS task_type, CASE o_orderkey % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'edit' WHEN 2 THEN 'valid' END AS disposition, CASE WHEN o_totalprice > 100000 THEN 'human_reviewed' ELSE 'machine_screened' END AS tier FROM orders)"
SET = "SELECT '{0}' AS rollup, {1}, count(*) AS record_count, count(*) FILTER (disposition IS DISTINCT FROM 'remove') AS included_count, count(disposition) AS review_count FROM r {2}"
DIMENSIONS = ("dataset", "disposition", "mode", "task_type", "tier")


def _set(*by: str) -> str:
    return SET.format(":".join(sorted(by)) or "all", ", ".join(c if c in by else f"CAST(NULL AS VARCHAR) AS {c}" for c in DIMENSIONS).replace("disposition", "r.disposition", 1) if "disposition" in by else ", ".join(c if c in by else f"CAST(NULL AS VARCHAR) AS {c}" for c in DIMENSIONS), f"GROUP BY {', '.join('r.' + c for c in by)}" if by else "")


@query(f"WITH {REVIEWS} " + " UNION ALL ".join(_set(*by).replace("count(disposition)", "count(r.disposition)").replace("(disposition IS", "(r.disposition IS") for by in validation.ROLLUPS))
def review_rollups(spark, d):
    o, key = s.table(spark, d, "orders"), F.col("o_orderkey")
    reviews = o.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("mode"), F.when(key % 9 != 0, F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string"))).alias("task_type"),
        F.when(key % 5 == 0, "remove").when(key % 5 == 1, "edit").when(key % 5 == 2, "valid").alias("disposition"), F.when(F.col("o_totalprice") > 100000, "human_reviewed").otherwise("machine_screened").alias("tier"),
    )
    return validation.review_rollups(reviews)

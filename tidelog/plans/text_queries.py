"""Queries over texts, calls, id lists and gates, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.functions import timeplan
from tidelog.operators import episodes, gates, scoring, telemetry, validation
from tidelog.plans import standins as s
from tidelog.plans.standins import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def norm_sql(x: str) -> str:
    shown = f"replace(replace(regexp_replace(coalesce({x}, ''), '<think>.*?</think>\\s*', '', 'gis'), '<think>', ''), '</think>', '')"
    first = f"regexp_replace({shown}, '\\n\\s*(?:user|assistant|system)\\s*\\n.*$', '', 'is')"
    return f"trim(regexp_replace(lower(trim(regexp_replace({first}, '^\\s*[:：]\\s*', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({norm_sql('text')}) AS digest, length({norm_sql('text')}) AS chars FROM documents")
def normalize_text(spark, d):
    said = tx.normalize(F.col("text"))
    return s.table(spark, d, "documents").select("doc_id", tx.sha256(said).alias("digest"), F.length(said).cast("bigint").alias("chars"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(spark, d):
    return s.table(spark, d, "documents").select("doc_id", tx.sha256(F.col("text")).alias("digest"))


#: Sentences with a letter L and a second one M, by doc_id; the same list builds the Spark rows and the SQL rows.
SAID = ["L", " L ", ": L", "(L)", "[L].", "The answer is L.", "L. on the desk", "L or M", "option L, not M", "I saw a cat", "L) yes and M) no", "<think>M</think> L", "wait", "", "Answer: L\nuser\nM", "L, M", "choice chosen L", "nothing to see"]


def said_rows(spark, d):
    letter = lambda n: F.char(F.lit(65) + (F.col("doc_id") / n).cast("int") % 5)
    texts = F.array(*map(F.lit, SAID))
    base = s.table(spark, d, "documents").select("doc_id", F.element_at(texts, (F.col("doc_id") % len(SAID) + 1).cast("int")).alias("x"), letter(18).alias("one"), letter(90).alias("two"))
    labels = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, "ABCDE"))).otherwise(F.array(*map(F.lit, "ABCD")))
    return base.select("doc_id", F.regexp_replace(F.regexp_replace("x", r"\bM\b", F.col("two")), r"\bL\b", F.col("one")).alias("said"), labels.alias("labels"), F.col("one").alias("right"))


SAID_SQL = (
    "said AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\\bM\\b', chr(CAST(65 + doc_id // 90 % 5 AS INT)), 'g'), '\\bL\\b', chr(CAST(65 + doc_id // 18 % 5 AS INT)), 'g') AS said, "
    "CASE WHEN doc_id % 3 = 0 THEN ['A','B','C','D','E'] ELSE ['A','B','C','D'] END AS labels, chr(CAST(65 + doc_id // 18 % 5 AS INT)) AS expected FROM (SELECT doc_id, ["
    + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in SAID)
    + f"][doc_id % {len(SAID)} + 1] AS x FROM documents)), n AS (SELECT *, upper({norm_sql('said')}) AS u FROM said)"
)
PAIR = r"\b([A-Z])\s*(?:[/,;]|\bOR\b|\bAND\b)\s*([A-Z])\b"
NAMED = r"\b(?:ANSWER|OPTION|CHOICE)\b\s*(?:IS|:|CHOSEN)?\s*([A-Z])\b"
CHOICE_SQL = f"""c AS (SELECT *, nullif(regexp_extract(u, '^\\s*[\\[(]?([A-Z])[\\])]?[.)]?\\s*$', 1), '') AS bare, nullif(regexp_extract(u, '{NAMED}', 1), '') AS named, nullif(regexp_extract(u, '^\\s*[\\[(]?([A-Z])[.)\\]]?\\s+', 1), '') AS lead,
  list_distinct(list_filter(list_concat(list_concat(regexp_extract_all(u, '(?:^|[^A-Za-z0-9_])([A-Z])[.):]', 1), regexp_extract_all(u, '{NAMED}', 1)), list_concat(regexp_extract_all(u, '{PAIR}', 1), regexp_extract_all(u, '{PAIR}', 2))), lambda x: list_contains(labels, x))) AS mentioned,
  regexp_matches(regexp_replace(u, '^.*?{NAMED}', '', 's'), '\\b(?:OR|AND)\\s+[A-Z]\\b') AS more FROM n),
k AS (SELECT *, CASE WHEN list_contains(labels, bare) THEN bare END AS strict_choice, CASE WHEN len(mentioned) <= 1 THEN coalesce(CASE WHEN list_contains(labels, named) AND NOT more THEN named END, CASE WHEN list_contains(labels, bare) THEN bare END, CASE WHEN list_contains(labels, lead) THEN lead END) END AS recoverable_choice FROM c)"""


@query(f"WITH {SAID_SQL}, {CHOICE_SQL} SELECT doc_id, coalesce(strict_choice, '') AS choice FROM k")
def extract_choice_strict(spark, d):
    return said_rows(spark, d).select("doc_id", F.coalesce(tx.strict_choice(F.col("said"), F.col("labels")), F.lit("")).alias("choice"))


@query(f"WITH {SAID_SQL}, {CHOICE_SQL} SELECT doc_id, coalesce(recoverable_choice, '') AS choice FROM k")
def extract_choice_recoverable(spark, d):
    return said_rows(spark, d).select("doc_id", F.coalesce(tx.recoverable_choice(F.col("said"), F.col("labels")), F.lit("")).alias("choice"))


@query(f"WITH {SAID_SQL}, {CHOICE_SQL} SELECT count(*) AS record_count, sum((coalesce(recoverable_choice = expected, false) AND list_contains(labels, expected))::INT)::DOUBLE AS score_sum, round(avg((coalesce(recoverable_choice = expected, false) AND list_contains(labels, expected))::INT), 6) AS accuracy, round(avg((coalesce(strict_choice = expected, false) AND list_contains(labels, expected))::INT), 6) AS strict_accuracy FROM k")
def qa_accuracy(spark, d):
    rows = said_rows(spark, d).select(F.col("doc_id").alias("record_id"), F.transform("labels", lambda x: F.concat(x, F.lit(". text"))).alias("options"), F.col("right").alias("answer"), F.col("said").alias("prediction"))
    out = scoring.question_metrics(scoring.score_questions(rows, parser="recoverable"))
    return out.withColumns({"accuracy": F.round("accuracy", 6), "strict_accuracy": F.round("strict_accuracy", 6)})


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'A,B,C,D' ELSE chr(CAST(65 + doc_id % 26 AS INT)) END AS labels FROM documents")
def option_labels(spark, d):
    letter = F.char(F.lit(65) + (F.col("doc_id") % 26).cast("int"))
    options = F.when(F.col("doc_id") % 4 == 0, F.array(F.lower(letter), F.lit("12"))).otherwise(F.array(F.concat(F.lit(" "), letter, F.lit(") x")), F.concat(letter, F.lit(" y"))))
    return s.table(spark, d, "documents").select("doc_id", F.array_join(tx.option_labels(options), ",").alias("labels"))


@query(f"WITH b AS (SELECT DISTINCT {norm_sql('text')} AS n FROM benchmark) SELECT count(*) AS documents, count(*) FILTER ({norm_sql('a.text')} = {norm_sql('b.text')} AND {norm_sql('a.text')} <> '') AS equal_next FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def exact_judge(spark, d):
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("expected")), "doc_id")
    return pairs.agg(F.count("*").alias("documents"), F.count_if(tx.exact_match(F.col("text"), F.col("expected"))).alias("equal_next"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY {norm_sql('text')} ORDER BY doc_id) > 1 AS cached, CASE WHEN {norm_sql('text')} <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS score, 'exact_match' AS score_method FROM documents")
def judge_cache_hits(spark, d):
    docs = s.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("call"), F.lit("SSR").alias("task_type"), F.lit("q").alias("question"), F.col("text").alias("expected"), F.col("text").alias("prediction"))
    return scoring.judge(rows).select(F.col("call").alias("doc_id"), "cached", "score", "score_method")


SCORES = ["0.75", "1", " 0.5 ", "`0.25`", "Score: 0.9", "2.0", "1.5", "none", "", "0.3 or 0.4", "nan", "-1"]


@query("SELECT doc_id, [0.75, 1, 0.5, 0.25, 0.9, -1, -1, -1, -1, 0.3, -1, -1][doc_id % 12 + 1]::DOUBLE AS score FROM documents")
def parse_judge_score(spark, d):
    raw = F.element_at(F.array(*map(F.lit, SCORES)), (F.col("doc_id") % 12 + 1).cast("int"))
    return s.table(spark, d, "documents").select("doc_id", F.coalesce(tx.unit_score(raw), F.lit(-1.0)).alias("score"))


@query(f"SELECT conv_id AS record_id, turn AS event_index FROM conversations WHERE role = 'assistant' AND {norm_sql('text')} NOT IN ('', 'wait')")
def answered_turns(spark, d):
    return s.turns(spark, d).where("kind = 'answer'").where(tx.is_answered(F.col("text"))).select("record_id", F.col("event_index").cast("bigint").alias("event_index"))


ASSEMBLY = """WITH t AS (SELECT conv_id AS record_id, turn, role, trim(text) AS body, 'r' || CAST(turn % 3 AS VARCHAR) AS rid, turn % 2 = 1 AS part FROM conversations),
f AS (SELECT *, role = 'user' AS silent, role = 'assistant' AND NOT part AND body <> '' AS whole, role = 'assistant' AND part AND body <> '' AS cand FROM t),
g AS (SELECT *, sum((silent OR whole)::INT) OVER (PARTITION BY record_id ORDER BY turn) AS seg FROM f),
j AS (SELECT record_id, seg, rid, whole, turn, body, row_number() OVER (PARTITION BY record_id, seg, rid, whole ORDER BY turn) AS k FROM g WHERE whole OR cand)
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY min(turn)) - 1 AS episode, min(turn)::DOUBLE AS start_s, max(turn)::DOUBLE AS end_s, count(*) AS parts, any_value(whole) AS whole, sum(length(body))::BIGINT AS body_chars FROM j GROUP BY record_id, seg, rid, whole"""


@query(ASSEMBLY)
def episode_assembly_batch(spark, d):
    log = s.turns(spark, d)
    out = episodes.assemble(episodes.resolve(log))
    size = log.select("record_id", "event_index", F.length(F.trim("text")).alias("n"))
    chars = out.select("record_id", "episode", F.explode("source_event_indices").alias("event_index")).join(size, ["record_id", "event_index"]).groupBy("record_id", "episode").agg(F.sum("n").alias("body_chars"))
    return out.join(chars, ["record_id", "episode"]).select("record_id", F.col("episode").cast("bigint").alias("episode"), F.col("start_video_time_s").alias("start_s"), F.col("end_video_time_s").alias("end_s"), F.size("source_event_ids").cast("bigint").alias("parts"), (F.col("assembly_mode") == "complete").alias("whole"), "body_chars")


CALLS = with_views("calls")


@query(f"{CALLS}, m AS (SELECT *, max(end_perf_ns) OVER (PARTITION BY record_id ORDER BY start_perf_ns, end_perf_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM calls), i AS (SELECT *, sum((top IS NULL OR start_perf_ns > top)::INT) OVER (PARTITION BY record_id ORDER BY start_perf_ns, end_perf_ns ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT record_id, round(sum(len) / 1e9::DOUBLE, 6) AS inference_wall_time_s FROM (SELECT record_id, island, max(end_perf_ns) - min(start_perf_ns) AS len FROM i GROUP BY ALL) GROUP BY record_id")
def interval_union_seconds(spark, d):
    return telemetry.busy_seconds(s.model_calls(spark, d), ("record_id",)).withColumn("inference_wall_time_s", F.round("inference_wall_time_s", 6))


@query("SELECT l_returnflag AS stage, count(*) AS n FROM lineitem GROUP BY ALL")
def calls_by_stage(spark, d):
    return telemetry.calls_by_stage(s.model_calls(spark, d))


@query(f"{CALLS} SELECT stage, count(*) AS model_call_count, sum(input_text_tokens) AS input_text_tokens, round(sum(output_tokens), 2) AS output_tokens, round(count(input_text_tokens)::DOUBLE / count(*), 6) AS input_text_tokens_coverage, round(count(output_tokens)::DOUBLE / count(*), 6) AS output_tokens_coverage, 1.0::DOUBLE AS interval_coverage FROM calls GROUP BY stage")
def call_totals(spark, d):
    out = telemetry.call_totals(s.model_calls(spark, d), ("stage",))
    return out.withColumns({"output_tokens": F.round("output_tokens", 2), "input_text_tokens_coverage": F.round("input_text_tokens_coverage", 6), "output_tokens_coverage": F.round("output_tokens_coverage", 6)})


@query(f"{CALLS}, b AS (SELECT o_orderkey AS record_id, epoch_us(o_orderdate) * 1000 + 5184000000000000 AS dispatch FROM orders) SELECT phase, count(*) AS n FROM (SELECT CASE WHEN end_perf_ns <= dispatch THEN 'history' WHEN start_perf_ns < dispatch AND dispatch < end_perf_ns THEN 'mixed' ELSE 'query' END AS phase FROM calls JOIN b USING (record_id)) GROUP BY phase")
def call_boundary_class(spark, d):
    boundary = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), (s.micros(F.col("o_orderdate")) * 1000 + 5_184_000_000_000_000).alias("dispatch"))
    return telemetry.classify_calls(s.model_calls(spark, d), boundary).groupBy("phase").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS device, max(l_quantity) AS peak_bytes, max(l_extendedprice) AS baseline_bytes, bool_and(l_tax < 0.08) AS attribution_ok, count(*) AS samples FROM lineitem GROUP BY l_suppkey")
def gpu_device_rollup(spark, d):
    li = s.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device"), F.col("l_quantity").alias("peak_bytes"), F.col("l_extendedprice").alias("baseline_bytes"), (F.col("l_tax") < 0.08).alias("attribution_ok"))
    return telemetry.device_rollup(li, ("peak_bytes", "baseline_bytes"))


@query("SELECT count(*) AS record_count, count(*) FILTER (o_orderstatus = 'F') AS completed_count, count(*) FILTER (o_orderstatus = 'O') AS failed_count, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS record_completion_rate, round(count(*) FILTER (o_orderstatus = 'O')::DOUBLE / count(*), 6) AS failure_rate, 0::BIGINT AS timeout_count, 0::BIGINT AS retry_count FROM orders")
def status_rollup(spark, d):
    rows = s.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").alias("status"))
    return telemetry.reliability(rows).withColumns({"record_completion_rate": F.round("record_completion_rate", 6), "failure_rate": F.round("failure_rate", 6)})


@query("SELECT o_orderpriority AS failure_type, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def failure_types(spark, d):
    return telemetry.failure_types(s.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "failed").alias("status"), F.col("o_orderpriority").alias("failed_reason")))


@query("SELECT doc_id, n FROM (SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def duplicate_ids(spark, d):
    return validation.keep_smallest(s.table(spark, d, "documents"), "text", "doc_id").where("n > 1").select(F.col("kept").alias("doc_id"), "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def orphan_events(spark, d):
    live = s.table(spark, d, "orders").where("o_orderstatus <> 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return validation.orphans(s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), live, "l_orderkey")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def resume_pending(spark, d):
    o = s.table(spark, d, "orders")
    return validation.pending(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), "o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY -c_custkey) - 1 AS pos, c_name FROM customer WHERE c_custkey % 7 = 3")
def subset_select_ordered(spark, d):
    c = s.table(spark, d, "customer")
    ids = c.where("c_custkey % 7 = 3").select("c_custkey", F.expr("cast(row_number() over (order by -c_custkey) - 1 as bigint)").alias("pos"))
    return validation.select_subset(ids, c.select("c_custkey", "c_name"), "c_custkey").orderBy("pos")


@query("SELECT o_custkey + 1000000 AS c_custkey FROM orders WHERE o_orderkey % 5 = 0")
def subset_unknown_ids(spark, d):
    ids = s.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return validation.unknown_ids(ids, s.table(spark, d, "customer"), "c_custkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) = 1 AS is_best FROM supplier")
def leaderboard_best_in_group(spark, d):
    return gates.leaderboard(s.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal")


@query("SELECT o_orderkey, list_transform(range(0, CAST(floor((2 + o_orderkey % 4 * 0.25 + 1e-9) * 2) AS BIGINT) + 1), lambda i: round(o_orderkey % 100 + i / 2.0::DOUBLE, 9)) || CASE WHEN o_orderkey % 4 IN (1, 3) THEN [round(o_orderkey % 100 + 2 + o_orderkey % 4 * 0.25, 9)::DOUBLE] ELSE [] END AS plan FROM orders".replace("|| CASE", "|| CASE").replace("AS plan", "AS plan0").replace("SELECT o_orderkey,", "SELECT o_orderkey, len(plan0) AS steps, round(list_sum(plan0), 6) AS total FROM (SELECT o_orderkey,") + ")")
def timestamp_plan(spark, d):
    start = (F.col("o_orderkey") % 100).cast("double")
    plan = timeplan.timestamp_plan(start, start + 2 + (F.col("o_orderkey") % 4) * 0.25, F.lit(2.0))
    return s.table(spark, d, "orders").select("o_orderkey", F.size(plan).cast("bigint").alias("steps"), F.round(F.aggregate(plan, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT o_orderkey, CAST(floor(((o_orderkey % 10) * 0.7 + 1e-9) / 0.7 + 1e-12) AS BIGINT) + 1 AS polls FROM orders")
def poll_schedule(spark, d):
    start = F.lit(1.0)
    return s.table(spark, d, "orders").select("o_orderkey", F.size(timeplan.poll_schedule(start, start + (F.col("o_orderkey") % 10) * 0.7, F.lit(0.7))).cast("bigint").alias("polls"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + 1.5 WHEN 1 THEN o_orderkey % 60 * 60 + 30.25 ELSE o_orderkey % 60 + 0.5 END::DOUBLE AS seconds FROM orders")
def parse_timestamp(spark, d):
    k = F.col("o_orderkey")
    part = lambda n: (k % n).cast("string")
    text = F.when(k % 3 == 0, F.concat(part(24), F.lit(":"), part(60), F.lit(":1.5"))).when(k % 3 == 1, F.concat(part(60), F.lit(":30.25"))).otherwise(F.concat(part(60), F.lit(".5")))
    return s.table(spark, d, "orders").select("o_orderkey", timeplan.parse_timestamp(text).alias("seconds"))


@query("SELECT p_partkey, greatest(0, least(39, CAST(floor(p_size * 0.37 * 10 + 0.5) AS BIGINT))) AS frame, CASE WHEN p_size * 16 <= 320 THEN p_size * 9 ELSE greatest(1, CAST(floor(p_size * 9 * 320 / (p_size * 16)::DOUBLE + 0.5) AS BIGINT)) END::BIGINT AS height, least(p_size * 16, 320)::BIGINT AS width FROM part")
def frame_index_resize(spark, d):
    size = timeplan.resized(F.col("p_size") * 9, F.col("p_size") * 16, F.lit(320))
    return s.table(spark, d, "part").select("p_partkey", timeplan.frame_index(F.col("p_size") * F.lit(0.37), F.lit(10.0), F.lit(40).cast("bigint")).alias("frame"), size["height"].alias("height"), size["width"].alias("width"))


@query("""SELECT n_nationkey, list_sort(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'synthetic_run' END, CASE WHEN n_nationkey % 3 = 0 THEN 'logical_pacing_diagnostic' END,
 CASE WHEN n_nationkey % 5 = 0 THEN 'incomplete_telemetry:submitted_frames' END, CASE WHEN n_nationkey % 7 = 0 THEN 'incomplete_telemetry:gpu_memory_attribution' END, CASE WHEN n_nationkey % 11 = 0 THEN 'judge_incomplete' END], lambda x: x IS NOT NULL)) AS r0 FROM nation""".replace("SELECT n_nationkey,", "SELECT n_nationkey, array_to_string(r0, ';') AS reasons, len(r0) = 0 AS official_eligible FROM (SELECT n_nationkey,") + ")")
def eligibility_reasons(spark, d):
    k = F.col("n_nationkey")
    full = {n: F.lit(1.0) for n in (*gates.ALWAYS, *gates.QUESTIONS)} | {"submitted_frames": F.when(k % 5 == 0, 0.5).otherwise(1.0)}
    runs = s.table(spark, d, "nation").select(
        "n_nationkey", F.lit("qa").alias("task"), (k % 2 == 0).alias("synthetic"), F.lit(False).alias("provisional"), F.when(k % 3 == 0, "logical").otherwise("wall_clock").alias("pacing"), F.lit(False).alias("proactive_primary_eligible"),
        F.lit(False).alias("triggers_complete"), F.lit("Non-native").alias("visual_state"), F.create_map(*[x for n, v in full.items() for x in (F.lit(n), v)]).alias("coverage"), (k % 7 != 0).alias("gpu_attribution_ok"), F.when(k % 11 == 0, 1).otherwise(0).alias("judge_errors"),
    )
    return gates.ineligibility(runs).select("n_nationkey", F.array_join("reasons", ";").alias("reasons"), "official_eligible")


@query("SELECT count(*) FILTER (n = 2) AS shared, count(*) FILTER (n = 0) AS missing, 0::BIGINT AS foreign FROM (SELECT (o_orderkey % 3 < 2)::INT + (o_orderkey % 3 = 1)::INT AS n FROM orders)".replace("AS foreign", 'AS "foreign"'))
def subset_partition_check(spark, d):
    o = s.table(spark, d, "orders").select("o_orderkey")
    return validation.is_partition([o.where("o_orderkey % 3 < 2"), o.where("o_orderkey % 3 = 1")], o, "o_orderkey")

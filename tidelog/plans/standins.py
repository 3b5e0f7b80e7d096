"""Views of the star-schema test tables that stand in for records, windows and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tolerance of point windows over these tables: a day, as a user's events are hours apart.
DAY = 86_400.0
KINDS = {"view": "observation", "click": "answer", "error": "wait", "signup": "telemetry", "purchase": "trigger"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp's wall clock, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id (the user), event_index, t in seconds, ns, kind, value, event_id."""
    e = table(spark, sf_dir, "events")
    us = micros(F.col("ts"))
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in KINDS.items()))
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return e.select(F.col("user_id").alias("record_id"), place.alias("event_index"), (us / F.lit(1e6)).alias("t"), (us * 1000).alias("ns"), kind.alias("kind"), "value", "event_id")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = event_log(spark, sf_dir).where("kind = 'trigger'")
    place = (F.row_number().over(Window.partitionBy("record_id").orderBy("t")) - 1).cast("int")
    return hits.select("record_id", place.alias("position"), F.col("t").alias("start_s"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = event_log(spark, sf_dir).where("kind = 'answer'")
    place = (F.row_number().over(Window.partitionBy("record_id").orderBy("event_index")) - 1).cast("int")
    return hits.select("record_id", place.alias("episode"), "t", "ns", "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where("kind = 'observation'").select("record_id", "t", "event_index", "ns", F.col("ns").alias("arrival_ns"), "value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an event log: an assistant's turn is a fragment, a user's a wait, a system's telemetry."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "answer").when(F.col("role") == "user", "wait").otherwise("telemetry")
    return c.select(
        F.col("conv_id").alias("record_id"), F.col("turn").cast("int").alias("event_index"), kind.alias("kind"), F.col("turn").cast("double").alias("logical_time_s"), "text",
        F.concat(F.lit("r"), (F.col("turn") % 3).cast("string")).alias("response_id"), F.when(F.col("turn") % 2 == 1, "delta").otherwise("complete").alias("text_mode"),
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model calls of their order: from the ship date, a day for each unit of quantity."""
    li = table(spark, sf_dir, "lineitem")
    start = micros(F.col("l_shipdate")) * 1000
    return li.select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("stage"), start.alias("start_perf_ns"),
        (start + (F.col("l_quantity") * F.lit(86_400_000_000_000)).cast("bigint")).alias("end_perf_ns"), F.col("l_quantity").alias("input_text_tokens"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("output_tokens"), "l_suppkey", "l_tax",
    )


#: The same views for DuckDB.
SQL = {
    "ev": "ev AS (SELECT user_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS event_index, epoch_us(ts) / 1e6::DOUBLE AS t, epoch_us(ts) * 1000 AS ns, "
    "CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'answer' WHEN 'error' THEN 'wait' WHEN 'signup' THEN 'telemetry' WHEN 'purchase' THEN 'trigger' END AS kind, value, event_id FROM events)",
    "trig": "trig AS (SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY t) - 1 AS INT) AS position, t AS start_s FROM ev WHERE kind = 'trigger')",
    "ans": "ans AS (SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY event_index) - 1 AS INT) AS episode, t, ns, value FROM ev WHERE kind = 'answer')",
    "obs": "obs AS (SELECT record_id, t, event_index, ns, value FROM ev WHERE kind = 'observation')",
    "specs": "specs AS (SELECT *, least(start_s + 86400::DOUBLE, coalesce(next_trigger_s, 1e300::DOUBLE)) AS end_s, next_trigger_s - start_s AS inter_trigger_gap_s, coalesce(next_trigger_s - start_s < 86400, false) AS crowded_window, "
    "coalesce(next_trigger_s, start_s + 86400::DOUBLE) AS eventual_end_s FROM (SELECT *, lead(start_s) OVER (PARTITION BY record_id ORDER BY start_s) AS next_trigger_s FROM trig))",
    "calls": "calls AS (SELECT l_orderkey AS record_id, l_linenumber AS line, l_returnflag AS stage, epoch_us(l_shipdate) * 1000 AS start_perf_ns, epoch_us(l_shipdate) * 1000 + CAST(l_quantity * 86400000000000 AS BIGINT) AS end_perf_ns, "
    "l_quantity AS input_text_tokens, CASE WHEN l_discount > 0 THEN l_extendedprice END AS output_tokens, l_suppkey, l_tax FROM lineitem)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in names)}"

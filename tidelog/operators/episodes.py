"""Response episodes: fragments of an event log put together into whole responses.

An episode is a maximal run of fragments with one response id that nothing closed: a wait, a failure, a silent
decision or a whole answer closes all open episodes of its record, a final fragment closes its own. Closing is
monotone in the record's order, so running counts number the episodes and a single shuffle by record is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import join_fragments, strip

#: Why a late fragment may still finish an episode that is open.
LATE_REASONS = ("after_evaluation_end", "unobservable_close_time")
#: The columns that assembly reads; see :func:`resolve`.
FLAT = {
    "kind": "string", "logical_time_s": "double", "text": "string", "event_id": "string", "response_id": "string", "sequence_id": "string", "text_mode": "string", "is_final": "boolean", "response_decision": "string",
    "first_token_perf_ns": "bigint", "response_scoring_perf_ns": "bigint", "evaluation_time_source": "string", "completion_perf_ns": "bigint",
    "provider_output_suppressed": "boolean", "eligible_for_scoring": "boolean", "within_evaluation_end": "boolean", "suppression_reason": "string", "shutdown_drain": "boolean", "query_dispatch_perf_ns": "bigint",
}
#: Columns that only telemetry has, and names other than their own under which telemetry has them, in order.
TELEMETRY_ONLY = ("provider_output_suppressed", "eligible_for_scoring", "within_evaluation_end", "suppression_reason", "shutdown_drain")
ALIASES = {"completion_perf_ns": ("response_completion_perf_ns", "arrival_perf_ns")}


def variant_field(value: Column, name: str, kind: str) -> Column:
    """A field of a VARIANT if it has this type, else null: numbers aren't read from text, nor whole ones from others."""
    told = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    fits = {"bigint": told == "BIGINT", "double": told.isin("BIGINT", "DOUBLE") | told.startswith("DECIMAL"), "boolean": told == "BOOLEAN", "string": told == "STRING"}
    return F.when(fits[kind], F.try_variant_get(value, f"$.{name}", kind))


def resolve(events: DataFrame) -> DataFrame:
    """Events with the columns of FLAT, each from the event or else from its telemetry; absent ones are null.

    Telemetry is a struct, or a VARIANT of any shape, whose fields count where they have their type. Its text_mode
    also replaces the default mode, complete.
    """
    loose = "telemetry" in events.columns and events.schema["telemetry"].dataType.simpleString() == "variant"
    inner = {f.name for f in events.schema["telemetry"].dataType.fields} if "telemetry" in events.columns and hasattr(events.schema["telemetry"].dataType, "fields") else set()
    out = {}
    for name, kind in FLAT.items():
        names = ALIASES.get(name, (name,))
        told = [variant_field(F.col("telemetry"), n, kind) for n in names] if loose else [F.col(f"telemetry.{n}").cast(kind) for n in names if n in inner]
        own = [F.col(name).cast(kind)] if name in events.columns and name not in TELEMETRY_ONLY else []
        if name == "text_mode" and own and told:
            out[name] = F.when(own[0].isNull() | (own[0] == "complete"), F.coalesce(told[0], own[0])).otherwise(own[0])
        else:
            out[name] = F.coalesce(*own, *told, F.lit(None).cast(kind))
    kept = [c for c in ("record_id", "event_index") if c in events.columns]
    return events.select(*kept, *(c.alias(n) for n, c in out.items()))


def event_kind(kind: Column) -> Column:
    return F.lower(F.substring_index(kind, ".", -1))


def is_eligible() -> Column:
    """Whether an event may enter a scored episode; only a stated true or false counts."""
    off = F.col("provider_output_suppressed").eqNullSafe(True) | F.col("eligible_for_scoring").eqNullSafe(False) | F.col("within_evaluation_end").eqNullSafe(False)
    return ~off


def is_late_continuation() -> Column:
    return (
        F.col("text_mode").isin("delta", "snapshot")
        & F.col("suppression_reason").isin(*LATE_REASONS)
        & ~F.col("provider_output_suppressed").eqNullSafe(True)
        & ~F.col("shutdown_drain").eqNullSafe(True)
    )


def sequence_number(sequence: Column) -> Column:
    """A sequence id as a number, if it is written as one, else null."""
    return F.when(F.regexp_like(F.trim(sequence), F.lit(r"^\d+(\.\d+)?$")), F.trim(sequence).cast("double"))


def order_events(events: DataFrame) -> DataFrame:
    """Adds place: numbered events by their number, the others after them, ties by event_index."""
    number = sequence_number(F.col("sequence_id"))
    return events.withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy(number.isNull(), number, "event_index")))


def assemble(events: DataFrame) -> DataFrame:
    """The episodes of resolved events (record_id, event_index and the columns of FLAT), numbered from 0 by record."""
    body = strip(F.coalesce("text", F.lit("")))
    mode = F.lower(F.coalesce("text_mode", F.lit("complete")))
    rows = order_events(events).withColumns(
        {
            "k": event_kind(F.col("kind")),
            "body": body,
            "mode": F.when(mode.isin("delta", "snapshot"), mode).otherwise("complete"),
            "rid": F.coalesce("response_id", F.lit("")),
            "eligible": is_eligible(),
        }
    )
    silent = F.col("k").isin("wait", "failure") | F.coalesce(F.lower("response_decision") == "silent", F.lit(False))
    answer = ~silent & (F.col("k") == "answer") & (F.col("body") != "")
    fragment = answer & (F.col("mode") != "complete") & (F.col("rid") != "")
    whole = answer & ~fragment & F.col("eligible")
    candidate = fragment & (F.col("eligible") | F.coalesce(is_late_continuation(), F.lit(False)))
    in_record = Window.partitionBy("record_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"whole": whole, "candidate": candidate}).withColumn("segment", F.sum((silent | F.col("whole")).cast("int")).over(in_record))
    rows = rows.where("whole or candidate")
    ids = Window.partitionBy("record_id", "segment", "rid", "whole").orderBy("place")
    closed = F.coalesce(F.sum(F.coalesce("is_final", F.lit(False)).cast("int")).over(ids.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("turn", F.when(F.col("whole"), F.lit(0)).otherwise(closed))
    open_ = Window.partitionBy("record_id", "segment", "rid", "whole", "turn").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("live", F.col("whole") | F.max("eligible").over(open_)).where("live")
    part = F.struct(
        "place", "event_index", "body", "mode", F.coalesce("logical_time_s", F.lit(0.0)).alias("t"), F.coalesce("event_id", F.concat(F.lit("event-"), F.col("event_index").cast("string"))).alias("event_id"),
        F.col("first_token_perf_ns").alias("first"), F.col("response_scoring_perf_ns").alias("scoring"), F.col("evaluation_time_source").alias("source"), F.col("completion_perf_ns").alias("completion"), F.col("query_dispatch_perf_ns").alias("dispatch"),
    )
    groups = rows.groupBy("record_id", "segment", "rid", "whole", "turn").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    grown = F.aggregate("parts", F.lit(""), lambda acc, p: F.when(p["mode"] == "snapshot", p["body"]).otherwise(join_fragments(acc, p["body"])))
    stamped = F.get(F.filter("parts", lambda p: p["scoring"].isNotNull() | p["first"].isNotNull()), 0)
    first_part, last_part = F.element_at("parts", 1), F.element_at("parts", -1)
    index = first_part["event_index"]
    single = F.when(first_part["mode"] == "complete", "complete").otherwise("legacy_complete")
    out = groups.select(
        "record_id",
        F.when(F.col("rid") != "", F.col("rid")).otherwise(F.concat(F.lit("legacy-"), index.cast("string"))).alias("response_id"),
        F.when(F.col("whole"), first_part["body"]).otherwise(grown).alias("text"),
        first_part["t"].alias("start_video_time_s"),
        last_part["t"].alias("end_video_time_s"),
        F.get(F.filter("parts", lambda p: p["first"].isNotNull()), 0)["first"].alias("first_token_perf_ns"),
        F.coalesce(stamped["scoring"], stamped["first"]).alias("scoring_perf_ns"),
        F.when(stamped["scoring"].isNotNull(), stamped["source"]).when(stamped["first"].isNotNull(), F.coalesce(F.when(F.col("whole"), stamped["source"]), F.lit("first_token_perf_ns"))).alias("scoring_time_source"),
        F.try_element_at(F.filter("parts", lambda p: p["completion"].isNotNull()), F.lit(-1))["completion"].alias("completion_perf_ns"),
        F.transform("parts", lambda p: p["event_id"]).alias("source_event_ids"),
        F.transform("parts", lambda p: p["event_index"]).alias("source_event_indices"),
        F.when(F.col("whole"), single).otherwise(first_part["mode"]).alias("assembly_mode"),
        F.exists("parts", lambda p: p["dispatch"].isNotNull()).alias("dispatched"),
    )
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("start_video_time_s", F.element_at("source_event_indices", 1))) - 1
    return out.withColumn("episode", number)


#: The fields of events that stand for the steps of records from before event logs.
LEGACY_EVENT = "struct<event_id: string, kind: string, logical_time_s: double, text: string, telemetry: struct<ttft_ms: double>>"


def _legacy(steps: Column) -> Column:
    """Steps (step_t, prediction, ttft_ms) as events: one that says nothing or wait is a wait."""
    from tidelog.functions.text import is_answered

    def event(step: Column, k: Column) -> Column:
        says = is_answered(step["prediction"])
        said = F.struct(
            F.concat(F.lit("legacy-step-"), k.cast("string")).alias("event_id"),
            F.when(says, "answer").otherwise("wait").alias("kind"),
            F.coalesce(step["step_t"], F.lit(0.0)).alias("logical_time_s"),
            F.when(says, step["prediction"]).otherwise("WAIT").alias("text"),
            F.struct(step["ttft_ms"].alias("ttft_ms")).alias("telemetry"),
        )
        return F.when(step.isNotNull(), said)

    return F.filter(F.transform(steps, event), lambda e: e.isNotNull())


def legacy_events(records: DataFrame) -> DataFrame:
    """Events of records (record_id, model_steps) from before event logs."""
    rows = records.select("record_id", F.posexplode(_legacy(F.col("model_steps"))).alias("event_index", "event"))
    return rows.select("record_id", "event_index", "event.*")


def event_source(records: DataFrame, given: bool) -> DataFrame:
    """(record_id, source): where a record's events come from. A log that is given holds for all records, also for
    those that it has no events of; else a record's own events do, if there are any, else its legacy steps, else none."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in records.columns else F.lit(False)
    source = F.lit("sidecar") if given else F.when(has("events"), "embedded").when(has("model_steps"), "legacy").otherwise("none")
    return records.select("record_id", source.alias("source"))


def events_of(records: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """The events of records (record_id[, events][, model_steps]) by :func:`event_source`, with event_index.

    One pass: a record's array is its own events or those of its steps, and is unpacked once. Fields that one kind of
    event lacks are null.
    """
    if sidecar is not None:
        return sidecar
    legacy = _legacy(F.col("model_steps")) if "model_steps" in records.columns else F.lit(None).cast(f"array<{LEGACY_EVENT}>")
    if "events" not in records.columns:
        return legacy_events(records) if "model_steps" in records.columns else records.select("record_id", F.explode(legacy).alias("event")).select("record_id", F.lit(0).alias("event_index"), "event.*")
    kind = records.schema["events"].dataType.elementType

    def widened(step: Column) -> Column:
        def part(f) -> Column:
            if f.name == "telemetry" and hasattr(f.dataType, "fields"):
                inner = [(step["telemetry"]["ttft_ms"] if g.name == "ttft_ms" else F.lit(None)).cast(g.dataType).alias(g.name) for g in f.dataType.fields]
                return F.struct(*inner).alias(f.name)
            return (step[f.name] if f.name in ("event_id", "kind", "logical_time_s", "text") else F.lit(None)).cast(f.dataType).alias(f.name)

        return F.struct(*(part(f) for f in kind.fields))

    own = F.when(F.size("events") > 0, F.col("events")).otherwise(F.transform(legacy, widened))
    rows = records.select("record_id", F.posexplode(own).alias("event_index", "event"))
    return rows.select("record_id", "event_index", "event.*")


def failure_reason(events: DataFrame) -> DataFrame:
    """(record_id, failed_reason): the reasons of a record's failure events, in order, joined by '; '."""
    failed = events.where(event_kind(F.col("kind")) == "failure").where(F.col("failed_reason").isNotNull())
    reasons = F.transform(F.sort_array(F.collect_list(F.struct("event_index", "failed_reason"))), lambda r: r["failed_reason"])
    return failed.groupBy("record_id").agg(F.array_join(reasons, "; ").alias("failed_reason"))

"""Validation: record checks, subsets, duplicates, membership and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unsound(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)


def question_problems(records: DataFrame) -> DataFrame:
    """Adds problems to question records: what is wrong with each, as an array."""
    checks = [
        F.when(F.coalesce(_unsound(F.col("question_time_s")), F.lit(True)), "question_time"),
        F.when(F.coalesce(_unsound(F.col("evidence_anchor_s")), F.lit(True)), "evidence_anchor"),
        F.when(F.col("evidence_anchor_s") > F.col("question_time_s"), "anchor_after_question"),
    ]
    return records.withColumn("problems", F.array_compact(F.array(*checks)))


def window_problems(windows: DataFrame) -> DataFrame:
    """Adds problem to windows (record_id, position, start_s, end_s[, is_state]): unsound, reversed, unordered, empty_state."""
    before = F.lag("start_s").over(Window.partitionBy("record_id").orderBy("position"))
    state = F.col("is_state") if "is_state" in windows.columns else F.lit(False)
    problem = (
        F.when(_unsound(F.col("start_s")) | _unsound(F.col("end_s")), "unsound")
        .when(F.col("end_s") < F.col("start_s"), "reversed")
        .when(F.col("start_s") < before, "unordered")
        .when(state & (F.col("end_s") <= F.col("start_s")), "empty_state")
    )
    return windows.withColumn("problem", problem)


def proactive_problems(records: DataFrame) -> DataFrame:
    """Adds problems to monitoring records (record_id, instruction_time_s, deadline_s, windows, trigger_annotations)."""
    w, notes = F.col("windows"), F.col("trigger_annotations")
    size = F.size(F.coalesce(w, F.array().cast(records.schema["windows"].dataType)))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(size - 1, F.lit(0))), F.slice(w, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: b["start_s"] < a["start_s"])
    checks = [
        F.when(F.coalesce(_unsound(F.col("instruction_time_s")), F.lit(True)), "instruction_time"),
        F.when(_unsound(F.col("deadline_s")), "deadline"),
        F.when(F.col("deadline_s") < F.col("instruction_time_s"), "deadline_before_instruction"),
        F.when(F.exists(w, lambda x: _unsound(x["start_s"]) | _unsound(x["end_s"])), "window_time"),
        F.when(F.exists(w, lambda x: x["end_s"] < x["start_s"]), "window_reversed"),
        F.when(F.exists(pairs, lambda x: x), "windows_unordered"),
        F.when((F.size(notes) > 0) & (F.size(notes) != size), "annotation_count"),
        F.when(F.exists(notes, lambda a: a.isNull()), "annotation_not_an_object"),
        F.when(F.exists(F.arrays_zip(notes.alias("note"), w.alias("window")), lambda x: (x["note"]["trigger_type"] == "state_interval") & (x["window"]["end_s"] <= x["window"]["start_s"])), "empty_state_interval"),
    ]
    return records.withColumn("problems", F.array_compact(F.array(*checks)))


def trigger_metadata_status(records: DataFrame) -> DataFrame:
    """Whether all records carry aligned annotations: counts, and samples of ten ids."""
    notes, size = F.col("trigger_annotations"), F.size(F.coalesce(F.col("windows"), F.array().cast(records.schema["windows"].dataType)))
    state = (
        F.when(notes.isNull(), "missing")
        .when(F.size(notes) != size, "malformed")
        .when(F.exists(notes, lambda a: a.isNull()), "malformed")
        .otherwise("valid")
    )
    marked = records.select("record_id", state.alias("state"))
    sample = lambda s: F.slice(F.sort_array(F.array_compact(F.collect_list(F.when((F.col("state") == s) & (F.col("rank") <= 10), F.col("record_id"))))), 1, 10)
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy("state", F.pmod(F.xxhash64("record_id"), F.lit(64))).orderBy("record_id")))
    return ranked.agg(
        (F.count_if(F.col("state") != "valid") == 0).alias("complete"),
        F.count("*").alias("record_count"),
        F.count_if(F.col("state") == "valid").alias("valid_record_count"),
        F.count_if(F.col("state") == "missing").alias("missing_record_count"),
        F.count_if(F.col("state") == "malformed").alias("malformed_record_count"),
        sample("missing").alias("missing_sample"),
        sample("malformed").alias("malformed_sample"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keep_smallest(rows: DataFrame, content: str, key: str) -> DataFrame:
    """(content, kept, n): of rows with equal content the smallest key stays."""
    return rows.groupBy(content).agg(F.min(key).alias("kept"), F.count("*").alias("n"))


def select_subset(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records of an id list (key, pos), in its order by pos; unknown ids are :func:`unknown_ids`."""
    return ids.join(records, key)


def unknown_ids(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return ids.join(records.select(key), key, "left_anti")


def orphans(events: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return events.join(records.select(key), key, "left_anti")


def pending(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do: the targets that have no terminal result."""
    return targets.join(done.select(key), key, "left_anti")


def carry_over(previous: DataFrame, again: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An event log after a rerun: earlier events of records that weren't run again, and the new ones."""
    return previous.join(again.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def newest_attempt(rows: DataFrame, key: str, attempt: str) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(attempt)))).where("__rank = 1").drop("__rank")


def membership(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: how many ids are null or repeat, and how many statuses aren't terminal."""
    return records.agg(
        F.count_if(F.col(key).isNull()).alias("null_ids"),
        (F.count(key) - F.count_distinct(key)).alias("repeated_ids"),
        F.count_if(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))).alias("open_statuses"),
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other; empty if they are equal."""
    same = right.select(*left.columns)
    return left.exceptAll(same).withColumn("side", F.lit("left")).unionByName(same.exceptAll(left).withColumn("side", F.lit("right")))


def event_drift(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, embedded, logged, state): a record's own events against those of the log, in order.

    records: (record_id, events: an array of structs, null if there are none). events: (record_id, event_index and the
    fields of the structs); event_index orders a record's events. Both sides come down to a number of events and two
    64-bit sums over (place, event), so no record's events are gathered; fields that are null and fields that are
    absent are alike. State is same, differs, or not_embedded.
    """
    fields = [f.name for f in records.schema["events"].dataType.elementType.fields]
    text = lambda row: F.to_json(row, {"ignoreNullFields": "true"})
    digest = [F.bit_xor(F.xxhash64("place", "event", F.lit(k))).alias(f"x{k}") for k in range(2)]
    own = records.where("events is not null").select("record_id", F.posexplode_outer("events").alias("place", "event"))
    own = own.withColumn("event", text(F.col("event"))).groupBy("record_id").agg(F.count("place").alias("embedded"), *(F.when(F.count("place") > 0, d).alias(f"own{k}") for k, d in enumerate(digest)))
    place = (F.row_number().over(Window.partitionBy("record_id").orderBy("event_index")) - 1).cast("int")
    log = events.select("record_id", place.alias("place"), text(F.struct(*fields)).alias("event"))
    log = log.groupBy("record_id").agg(F.count("*").alias("logged"), *digest)
    both = records.select("record_id").join(own, "record_id", "left").join(log, "record_id", "left").withColumn("logged", F.coalesce("logged", F.lit(0)))
    same = (F.col("embedded") == F.col("logged")) & ((F.col("logged") == 0) | ((F.col("own0") == F.col("x0")) & (F.col("own1") == F.col("x1"))))
    return both.select("record_id", "embedded", "logged", F.when(F.col("embedded").isNull(), "not_embedded").when(same, "same").otherwise("differs").alias("state"))


#: What reviewed records are counted by, each on its own.
ROLLUPS = (("dataset", "mode"), ("task_type",), ("disposition",), ("tier",), ())


def review_rollups(reviews: DataFrame, removed: str = "remove") -> DataFrame:
    """Counts of reviews (dataset, mode, task_type, disposition, tier) by each of ROLLUPS in one pass.

    rollup names the columns of a row's count, joined by ':' ('all' for none); the others are null. included_count
    leaves out the records whose disposition is removed; a disposition that is null is a record without a review.
    """
    names = sorted({c for by in ROLLUPS for c in by})
    sets = [[F.col(c) for c in by] for by in ROLLUPS]
    counted = reviews.groupingSets(sets, *names).agg(
        *(F.grouping(c).alias(f"without_{c}") for c in names),
        F.count("*").alias("record_count"),
        F.count_if(~F.col("disposition").eqNullSafe(removed)).alias("included_count"),
        F.count("disposition").alias("review_count"),
    )
    told = F.concat_ws(":", *(F.when(F.col(f"without_{c}") == 0, c) for c in names))
    return counted.select(F.when(told == "", "all").otherwise(told).alias("rollup"), *names, "record_count", "included_count", "review_count")


def is_partition(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """One row: ids that several parts have, that no part has, and that only parts have."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.unionAll(p.select(key))
    counted = every.groupBy(key).agg(F.count("*").alias("n"))
    both = counted.join(whole.select(key).distinct().withColumn("known", F.lit(True)), key, "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("shared"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("foreign"))


def is_dense(windows: Column, limit_s: float = 1.0) -> Column:
    """Whether some window lasts no longer than the limit."""
    return F.exists(windows, lambda w: w["end_s"] - w["start_s"] <= limit_s)


def secrets(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(pattern, and the columns of lines) for every text line that a named pattern finds, in one pass."""
    found = F.array_compact(F.array(*(F.when(F.regexp_like("value", F.lit(pattern)), name) for name, pattern in patterns.items())))
    return lines.withColumn("pattern", F.explode(found))

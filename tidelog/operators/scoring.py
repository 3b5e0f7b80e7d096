"""Scoring: exact and routed judging with a memo, question answering, proactive windows and response latency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.functions.timeplan import EPSILON
from tidelog.operators import views
from tidelog.operators.assignment import assign_at_run_time, assign_eventual, assign_strict
from tidelog.operators.episodes import assemble, event_kind
from tidelog.operators.sweep import first_from
from tidelog.operators.windows import observability
from tidelog.sources.folders import stored

#: Fixed value: the task types whose answers are compared by meaning.
SEMANTIC_TASKS = ("CRR", "SSR")


def answered(episodes: DataFrame) -> DataFrame:
    """Episodes that say something, numbered anew by record, with t, their start."""
    kept = episodes.where(tx.is_answered(F.col("text"))).withColumn("t", F.col("start_video_time_s"))
    return kept.withColumn("episode", (F.row_number().over(Window.partitionBy("record_id").orderBy("episode")) - 1).cast("int"))


def judge(rows: DataFrame, mode: str = "exact", semantic: tuple[str, ...] = SEMANTIC_TASKS, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds score, score_method, judge_error and cached to rows (call, task_type, question, expected, prediction).

    Calls that are alike after normalization are judged once: the distinct ones go to the judge, and `cached` marks
    all but the first in the order of `call`. A model judge maps distinct rows to the same rows with reply (its raw
    text, null if unavailable). Mode auto sends the semantic task types to it, vlm all, exact none.
    """
    kind = F.upper(F.trim(F.coalesce("task_type", F.lit(""))))
    wants = F.lit(True) if mode == "vlm" else kind.isin(*semantic) if mode == "auto" and semantic else F.lit(False)
    made = ["normal_question", "normal_expected", "normal_prediction"]
    keyed = rows.withColumns({m: tx.normalize(F.col(m.removeprefix("normal_"))) for m in made})
    exact = F.when((F.col("normal_prediction") != "") & (F.col("normal_prediction") == F.col("normal_expected")), 1.0).otherwise(0.0)
    empty = F.col("normal_prediction") == ""
    keyed = keyed.withColumns({"memo": F.sha2(F.to_json(F.array(kind, *made)), 256), "exact": exact, "empty": empty, "wants": wants}).drop(*made)
    keyed = keyed.withColumn("first_call", F.min("call").over(Window.partitionBy("memo")))
    told = ["score", "score_method", "judge_error"]
    if model is None:
        missing = F.col("wants") & F.lit(mode in ("auto", "vlm"))
        method = F.when(~missing, "exact_match").otherwise("exact_fallback_no_vlm" if mode == "auto" else "vlm_unavailable")
        score = F.when(missing & F.lit(mode == "vlm"), 0.0).otherwise(F.col("exact"))
        judged = keyed.withColumns({"score": score, "score_method": method, "judge_error": F.when(missing, "judge endpoint is not configured")})
    else:
        distinct = keyed.where("wants and call = first_call").select("memo", "first_call", "task_type", "question", "expected", "prediction", "wants", "empty").dropDuplicates(["memo"])
        replied, value = model(distinct), tx.unit_score(F.col("reply"))
        method = F.when(F.col("empty"), "vlm_empty_prediction").when(F.col("reply").isNull(), "vlm_unavailable").when(value.isNull(), "vlm_invalid_response").otherwise("vlm")
        error = F.when(~F.col("empty") & F.col("reply").isNull(), "judge is unavailable").when(~F.col("empty") & value.isNull(), "judge gave no score")
        answers = replied.select("memo", F.when(F.col("empty"), 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("score"), method.alias("score_method"), error.alias("judge_error"))
        plain = keyed.where("not wants").withColumns({"score": F.col("exact"), "score_method": F.lit("exact_match"), "judge_error": F.lit(None).cast("string")})
        judged = plain.unionByName(keyed.where("wants").join(answers, "memo"))
    return judged.withColumn("cached", F.col("call") > F.col("first_call")).select(*rows.columns, *told, "cached")


def query_predictions(episodes: DataFrame) -> DataFrame:
    """(record_id, prediction): the last episode that came after a query was sent."""
    return episodes.where("dispatched").groupBy("record_id").agg(F.max_by("text", "episode").alias("prediction"))


def last_answers(events: DataFrame) -> DataFrame:
    """(record_id, prediction): the text of the last sent answer that isn't a wait."""
    sent = events.where((event_kind(F.col("kind")) == "answer") & F.col("query_dispatch_perf_ns").isNotNull()).where(tx.is_answered(F.col("text")))
    return sent.groupBy("record_id").agg(F.max_by("text", "event_index").alias("prediction"))


def score_questions(records: DataFrame, predictions: DataFrame | None = None, parser: str = "strict") -> DataFrame:
    """Adds prediction, choices and scores to records (record_id, options, answer[, prediction]).

    An assembled prediction goes before a stored one. Failed records count as wrong.
    """
    if predictions is not None:
        stored = F.col("stored") if "prediction" in records.columns else F.lit(None).cast("string")
        base = records.withColumnRenamed("prediction", "stored") if "prediction" in records.columns else records
        records = base.join(predictions, "record_id", "left").withColumn("prediction", F.coalesce("prediction", stored))
    labels = tx.option_labels(F.col("options"))
    rows = records.withColumns({"labels": labels, "expected": F.upper(tx.strip(F.col("answer")))})
    rows = rows.withColumns({"strict_choice": tx.strict_choice(F.col("prediction"), F.col("labels")), "recoverable_choice": tx.recoverable_choice(F.col("prediction"), F.col("labels"))})
    right = lambda c: F.when(F.col(c).eqNullSafe(F.col("expected")) & F.array_contains("labels", F.col("expected")), 1.0).otherwise(0.0)
    return rows.withColumns({"strict_score": right("strict_choice"), "score": right(f"{parser}_choice")})


def question_metrics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    count = F.count("*")
    return scored.groupBy(*by).agg(
        count.alias("record_count"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_sum"),
        views.ratio(F.coalesce(F.sum("score"), F.lit(0.0)), count, 0.0).alias("accuracy"),
        views.ratio(F.coalesce(F.sum("strict_score"), F.lit(0.0)), count, 0.0).alias("strict_accuracy"),
    )


def latency(rows: DataFrame, observations: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Adds latency_ms to rows (record_id, position, start_s, response_ns): from the trigger's arrival to the response.

    The trigger arrives with the first observation (record_id, t, event_index, arrival_ns), in the order of the log,
    at or after the window's start. A response before it has no latency.
    """
    arrived = first_from(rows.select("record_id", "position", "start_s"), observations, "event_index", "arrival_ns", tolerance=tolerance).drop("start_s")
    gap = (F.col("response_ns") - F.col("arrival_ns")) / F.lit(1e6)
    return rows.join(arrived, ["record_id", "position"], "left").withColumn("latency_ms", F.when(gap >= 0, gap))


def run_time_latency(specs: DataFrame, episodes: DataFrame, observations: DataFrame) -> DataFrame:
    """What a run notes of a response as it comes: (record_id, episode, position, trigger_video_time_s,
    trigger_arrival_ns, response_arrival_ns, latency_ms).

    episodes: (record_id, episode, t) and any of scoring_perf_ns, first_token_perf_ns, core_event_receive_perf_ns and
    arrival_perf_ns, which tell the response's arrival, in this order. The trigger arrives with the first observation
    (record_id, t, event_index, arrival_ns) in the order of the log from 1e-9 s before the window's start on. Rows
    without either arrival, or with a response before its trigger, drop out.
    """
    told = [F.col(c) for c in ("scoring_perf_ns", "first_token_perf_ns", "core_event_receive_perf_ns", "arrival_perf_ns") if c in episodes.columns]
    placed = assign_at_run_time(specs, episodes).join(episodes.select("record_id", "episode", F.coalesce(*told).alias("response_arrival_ns")), ["record_id", "episode"])
    starts = placed.join(specs.select("record_id", "position", "start_s"), ["record_id", "position"])
    seen = observations.where("arrival_ns is not null").withColumn("seen", F.struct(F.col("t").alias("t"), F.col("arrival_ns").alias("ns")))
    arrived = first_from(starts.select("record_id", "position", "start_s"), seen, "event_index", "seen", tolerance=EPSILON).drop("start_s")
    both = placed.join(arrived, ["record_id", "position"]).where(F.col("response_arrival_ns") >= F.col("seen.ns"))
    gap = (F.col("response_arrival_ns") - F.col("seen.ns")) / F.lit(1e6)
    return both.select("record_id", "episode", "position", F.col("seen.t").alias("trigger_video_time_s"), F.col("seen.ns").alias("trigger_arrival_ns"), "response_arrival_ns", gap.alias("latency_ms"))


def last_predictions(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, prediction) of every record: the episode after the question, else the last answer that was sent and
    isn't a wait, else what the record has stored, else nothing said ('')."""
    stored = F.col("prediction") if "prediction" in records.columns else F.lit(None).cast("string")
    base = records.select("record_id", stored.alias("stored"))
    made = query_predictions(assemble(events)).withColumnRenamed("prediction", "made")
    last = last_answers(events).withColumnRenamed("prediction", "last")
    return base.join(made, "record_id", "left").join(last, "record_id", "left").select("record_id", F.coalesce("made", "last", "stored", F.lit("")).alias("prediction"))


def score_windows(records: DataFrame, specs: DataFrame, events: DataFrame, boundary: str = "half_open", mode: str = "exact", semantic: tuple[str, ...] = SEMANTIC_TASKS, model=None) -> dict[str, DataFrame]:
    """Scores proactive windows: strict and eventual rows, the answered episodes and the judged calls.

    records: (record_id, task_type, instruction). specs: window specs with expected_answer. events: resolved events
    with event_index, and arrival_perf_ns if observations have one. Episodes and assignments are stored, as all that
    follows reads them.
    """
    episodes = stored(assemble(events))
    said = stored(answered(episodes))
    arrival = F.col("arrival_perf_ns") if "arrival_perf_ns" in events.columns else F.lit(None).cast("bigint")
    seen = events.where(event_kind(F.col("kind")) == "observation").select("record_id", F.coalesce("logical_time_s", F.lit(0.0)).alias("t"), "event_index", arrival.alias("arrival_ns"))
    parts = {"strict": (stored(assign_strict(specs, said, boundary)), "end_s"), "eventual": (stored(assign_eventual(specs, said)), "eventual_end_s")}
    text = said.select("record_id", "episode", F.col("text").alias("prediction"), "response_id", F.col("t").alias("response_start_s"), F.col("end_video_time_s").alias("response_end_s"), F.coalesce("scoring_perf_ns", "first_token_perf_ns").alias("response_ns"), "source_event_ids")
    rows = {}
    for n, (view, (assigned, end)) in enumerate(parts.items()):
        full = observability(specs, seen, end).join(assigned, ["record_id", "position"]).join(text, ["record_id", "episode"], "left").join(records.select("record_id", "task_type", F.col("instruction").alias("question")), "record_id", "left")
        full = full.withColumns({"view": F.lit(view), "call": F.struct(F.lit(n).alias("view"), "record_id", "position"), "is_answered": F.col("episode").isNotNull(), "requested": F.col("source").isin("in_window", "eventual")})
        rows[view] = latency(full, seen).withColumn("latency_ms", F.when(F.col("requested"), F.col("latency_ms")))
    columns = ["call", "task_type", "question", F.col("expected_answer").alias("expected"), "prediction"]
    calls = rows["strict"].where("requested").select(*columns).unionByName(rows["eventual"].where("requested").select(*columns))
    judged = judge(calls, mode, semantic, model).select("call", "score", "score_method", "judge_error", "cached")
    for view in rows:
        rows[view] = rows[view].join(judged, "call", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "score_method": F.coalesce("score_method", "source")}).drop("call")
    return {**rows, "episodes": episodes, "answered": said}


def proactive_metrics(scored: dict[str, DataFrame], specs: DataFrame, boundary: str = "half_open") -> dict[str, DataFrame]:
    """The metric tables of score_windows' result, one job each when read."""
    strict, said = scored["strict"], scored["answered"].select("record_id", "t")
    inside = strict.where("source = 'in_window'")
    both = strict.select("view", "score_method", "judge_error").unionByName(scored["eventual"].select("view", "score_method", "judge_error"))
    return {
        "views": views.score_views(strict, scored["eventual"]),
        "views_by_record": views.score_views(strict, scored["eventual"], ("record_id",)),
        "sources": views.source_distribution(strict),
        "false_alarms": views.false_alarms(said, specs, boundary),
        "misses": views.misses(strict),
        "redundant": views.redundancy(specs, said, inclusive=boundary == "inclusive").agg(F.coalesce(F.sum("redundant"), F.lit(0)).alias("redundant_response_count")),
        "eventual_outside": views.episodes_outside(said, specs, "eventual_end_s").agg(F.count_if("outside").alias("eventual_outside_count")),
        "eventual_redundant": views.redundancy(specs, said, "eventual_end_s").agg(F.coalesce(F.sum("redundant"), F.lit(0)).alias("eventual_redundant_count")),
        "delay": views.distribution(inside, "latency_ms"),
        "judge": both.groupBy("view", "score_method").agg(F.count("*").alias("n"), F.count("judge_error").alias("errors")),
    }

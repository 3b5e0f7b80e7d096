"""Gates: whether a run may be published, and on which track it ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coverage that a publishable run needs.
ALWAYS = ("model_call_intervals", "submitted_frames", "submitted_pixels", "input_text_tokens", "output_tokens")
STREAMING = ("frame_commit", "frame_processing")
QUESTIONS = ("query_ttft", "query_response_total")
RESPONSES = ("proactive_response_latency", "response_first_token")
FULL = 1.0 - 1e-12


def ineligibility(runs: DataFrame) -> DataFrame:
    """Adds reasons (sorted) and official_eligible to runs.

    runs: task, synthetic, provisional, pacing, proactive_primary_eligible, triggers_complete, visual_state, coverage
    (map of name to share), gpu_attribution_ok, judge_errors.
    """

    def missing(names: tuple[str, ...], applies: Column, may_lack: bool = False) -> list[Column]:
        out = []
        for name in names:
            value = F.try_element_at("coverage", F.lit(name))
            short = F.coalesce(value < FULL, F.lit(not may_lack))
            out.append(F.when(applies & short, f"incomplete_telemetry:{name}"))
        return out

    proactive = F.col("task") == "proactive"
    reasons = [
        F.when(F.col("synthetic"), "synthetic_run"),
        F.when(F.col("provisional"), "provisional_data_release"),
        F.when(F.col("pacing") == "logical", "logical_pacing_diagnostic"),
        F.when(proactive & ~F.coalesce("proactive_primary_eligible", F.lit(False)), "proactive_not_native_autonomous_wall_clock"),
        F.when(proactive & ~F.coalesce("triggers_complete", F.lit(False)), "missing_or_invalid_trigger_annotations"),
        *missing(ALWAYS, F.lit(True)),
        *missing(STREAMING, F.coalesce(F.col("visual_state") == "Native Streaming", F.lit(False))),
        *missing(QUESTIONS, F.col("task") == "qa"),
        *missing(RESPONSES, F.col("task") != "qa", may_lack=True),
        F.when(~F.coalesce("gpu_attribution_ok", F.lit(False)), "incomplete_telemetry:gpu_memory_attribution"),
        F.when(F.coalesce(F.col("judge_errors") > 0, F.lit(False)), "judge_incomplete"),
    ]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    return runs.withColumn("reasons", found).withColumn("official_eligible", F.size("reasons") == 0)


def execution_track(capabilities: DataFrame) -> DataFrame:
    """Adds the track to capabilities (persistent_session, autonomous, pacing)."""
    native = F.col("persistent_session")
    return capabilities.withColumns(
        {
            "visual_state": F.when(native, "Native Streaming").otherwise("Non-native"),
            "proactive_track": F.when(native & F.col("autonomous"), "autonomous_primary").otherwise("polling_baseline"),
            "proactive_primary_eligible": native & F.col("autonomous") & (F.col("pacing") == "wall_clock"),
        }
    )


def leaderboard(rows: DataFrame, group: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Adds place and is_best within each group; ties share both, rows without a value come last."""
    from pyspark.sql import Window

    order = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    place = F.rank().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("place", place).withColumn("is_best", (F.col("place") == 1) & F.col(metric).isNotNull())

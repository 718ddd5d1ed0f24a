"""Rollups of spans into sessions, actions and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import action_id, present

# The order in which spans are written: by end, children before their root.
WRITTEN = "struct(end_us, trace_no, if(kind = 'root', 1, 0) as is_root, span_seq)"


ROOT_CHANNEL = "if(kind = 'root', channel, null)"


def _when_set(value: str) -> str:
    return f"coalesce(max_by({value}, if({present(value)} is not null, {WRITTEN}, null)), '')"


def rollup_sessions(spans: DataFrame) -> DataFrame:
    """One row per session. Every part is an aggregate with a partial step, so a hot session costs no more."""
    return spans.groupBy("session_id").agg(
        F.expr("'' as user_id"),
        F.expr(f"{_when_set('model')} as model_name"),
        F.expr(f"{_when_set(ROOT_CHANNEL)} as channel_id"),
        F.expr("timestamp_micros(min(start_us)) as start_time"),
        F.expr(
            f"timestamp_micros(max_by(end_us, if(kind = 'root' and end_us is not null, {WRITTEN}, null))) as end_time"
        ),
        F.expr("count(1) as total_actions"),
        F.expr("sum(tokens) as total_tokens"),
    )


def actions(spans: DataFrame, *more: str) -> DataFrame:
    """The flat action row of every ended span; unknown text is empty, unknown numbers are null.

    ``more`` are expressions over the span, added as columns.
    """
    return spans.where("end_us is not null").selectExpr(
        f"{action_id('event_id')} as id",
        "session_id",
        "action_type",
        "coalesce(name, '') as action_name",
        "coalesce(model, '') as model_name",
        "input as input_params",
        "output as output_result",
        "prompt_tokens",
        "completion_tokens",
        "duration_ms",
        "'' as user_id",
        "coalesce(if(kind = 'root', channel, null), '') as channel_id",
        "timestamp_micros(end_us) as created_at",
        "event_id",
        *more,
    )


def rollup_actions(action_rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, tokens and duration along any of the access keys; ``day`` is the day of creation."""
    keys = [F.to_date("created_at").alias("day") if key == "day" else F.col(key) for key in by]
    return action_rows.groupBy(*keys).agg(
        F.expr("count(1) as actions"),
        F.expr("coalesce(sum(prompt_tokens), 0) as prompt_tokens"),
        F.expr("coalesce(sum(completion_tokens), 0) as completion_tokens"),
        F.expr("sum(duration_ms) as duration_ms"),
    )


def summarize_traces(spans: DataFrame) -> DataFrame:
    """Per trace: spans by kind, starts nobody ended, close reason, duration, tokens, and the last known cost and context."""
    return spans.groupBy("session_id", "trace_no", "trace_id").agg(
        F.expr("max(if(kind = 'root', close_reason, null)) as closed_by"),
        F.expr("max(if(kind = 'root', duration_ms, null)) as duration_ms"),
        F.expr("count_if(kind = 'llm') as llm_spans"),
        F.expr("count_if(kind = 'tool') as tool_spans"),
        F.expr("count_if(kind = 'subagent') as subagent_spans"),
        F.expr("count_if(kind <> 'root' and close_reason <> 'ended') as unmatched_starts"),
        F.expr("sum(tokens) as tokens"),
        *[F.expr(f"max(if(kind = 'root', {name}, null)) as {name}") for name in ("cost_usd", "context_limit", "context_used")],
    )

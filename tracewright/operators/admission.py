"""Why an event was admitted or skipped, and quality counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.pairing import match_tools, tool_events
from tracewright.operators.scan import PLAIN, Split
from tracewright.operators.traces import SUBAGENT, annotate, by_session, named, timed
from tracewright.options import Options

_SUB = "event_name in (" + ", ".join(f"'{n}'" for n in SUBAGENT) + ")"


def classify_events(events: DataFrame, options: Options = Options()) -> DataFrame:
    """Every event with its ``reason``: ``ok`` or why it was skipped. Routed events keep their routes."""
    events = timed(events)
    # Events without a session never enter a window: their key would gather them in one task.
    homeless = F.col("host_key").isNull()
    outside = events.where(homeless).selectExpr(
        "event_seq",
        "event_name",
        f"case when {_SUB} and event_name <> 'subagent_ended' and nullif(child_session_key, '') is null "
        f"then 'no_child_session_key' when {_SUB} then 'no_subagent_container' else 'no_session_key' end as reason",
    )

    def plan(part: DataFrame, known: Options, split: Split = PLAIN) -> DataFrame:
        seen = annotate(part, known, split)
        tools = match_tools(tool_events(seen), split).selectExpr(
            "event_seq", "event_name", "if(matched, 'ok', 'no_matching_tool_span') as reason"
        )
        rest = seen.where("not (reached and event_name in ('before_tool_call', 'after_tool_call'))").selectExpr(
            "event_seq",
            "event_name",
            "case when event_name = 'llm_output' then if(reached and out_no = 1, 'ok', 'no_active_llm_span') "
            "when reached then 'ok' "
            "when event_name in ('before_tool_call', 'after_tool_call') then 'no_span_container' "
            f"when {_SUB} then 'no_subagent_container' else 'no_active_trace' end as reason",
        )
        return tools.unionByName(rest)

    return outside.unionByName(by_session(events.where(~homeless), options, plan))


def skip_reasons(events: DataFrame, options: Options = Options()) -> DataFrame:
    return classify_events(events, options).groupBy("event_name", "reason").agg(F.count(F.lit(1)).alias("events"))


# What is counted of each row.
QUALITY = {
    "missing_session": "nullif(session_key, '') is null and event_name not like 'subagent%'",
    "missing_call_id": "event_name in ('before_tool_call', 'after_tool_call') and nullif(tool_call_id, '') is null",
    "malformed_params": "params is not null and try_parse_json(params) is null",
    "bad_numbers": "duration_ms < 0 or cost_usd < 0 or isnan(cost_usd)",
    "missing_usage": "event_name = 'llm_output' and usage is null",
}


def quality_metrics() -> list:
    """The counts that need no memory of other rows, as aggregates: for one batch, or observed while it is written."""
    return [F.expr("count(1) as event_rows"), *[F.expr(f"count_if({test}) as {name}") for name, test in QUALITY.items()]]


def quality_report(events: DataFrame) -> DataFrame:
    """One row of counts over raw or canonical events: missing keys, malformed values, repeated sequence numbers."""
    corrupt = "count_if(_corrupt_record is not null)" if "_corrupt_record" in events.columns else "0L"
    # Repeats are found per number first, so that no group travels whole.
    per_seq = events.groupBy("event_seq").agg(
        F.expr("count(1) as copies"),
        *[F.expr(f"count_if({test}) as {name}") for name, test in QUALITY.items()],
        F.expr(f"{corrupt} as corrupt_rows"),
    )
    return per_seq.agg(
        F.expr("sum(copies) as event_rows"),
        F.expr("sum(copies - 1) as duplicate_rows"),
        *[F.expr(f"sum({name}) as {name}") for name in (*QUALITY, "corrupt_rows")],
    )

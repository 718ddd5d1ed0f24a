"""Spans and traces out of annotated events, in one grouping.

Every event that reached a trace takes a slot of that trace: a tool call, a sub-agent run, or the trace
itself. One grouping by slot then holds everything a span needs, so the events are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import payloads as P
from tracewright.functions import scalars as S
from tracewright.functions.text import redact_json, redact_text
from tracewright.operators.pairing import match_tools
from tracewright.operators.scan import PLAIN, Scan, Split, beside, running
from tracewright.operators.traces import TRACE, annotate, by_session
from tracewright.options import Options

POSITION = "struct(ts_us, event_seq)"
BOUNDS = ["start_us", "start_seq", "close_us", "closed_by", "first_end_us", "run_ended", "stale_from_us"]

# Which events feed what. Only the first output of a trace is accepted.
OPENED = "event_name = 'llm_input'"
ACCEPTED = "(event_name = 'llm_output' and out_no = 1)"
RUN_END = "event_name = 'agent_end'"
USAGE = "event_name = 'model.usage'"
CONTEXT = f"({OPENED} or {ACCEPTED} or {RUN_END})"
LIFECYCLE = "event_name in ('subagent_spawning', 'subagent_spawned', 'subagent_delivery_target', 'subagent_ended')"
TOOL = "event_name in ('before_tool_call', 'after_tool_call')"
ACTIVITY = f"({OPENED} or {ACCEPTED} or {TOOL} or {LIFECYCLE})"


def _last(value: str, condition: str) -> str:
    return f"max_by({value}, if({condition} and {value} is not null, {POSITION}, null))"


def _first(value: str, condition: str) -> str:
    return f"min_by({value}, if({condition} and {value} is not null, {POSITION}, null))"


def _only(value: str, condition: str) -> str:
    """For values at most one row of the group supplies."""
    return f"max(if({condition}, {value}, null))"


def trace_aggregates() -> dict[str, str]:
    """What a trace knows when it closes. All are plain aggregates, combined before the shuffle."""
    provider = S.provider_or_raw("provider")
    channel, fallback, trigger = S.present("channel_id"), S.present("message_provider"), S.present("trigger")
    opening = {
        name: _only(name, OPENED)
        for name in ("prompt", "system_prompt", "images_count", "history_messages", "session_id", "run_id", "agent_id")
    }
    return {
        **opening,
        "input_model": _only(f"struct(model, {provider} as provider)", OPENED),
        "first_channel": _only(f"coalesce({channel}, {fallback})", OPENED),
        "first_trigger": _only(trigger, OPENED),
        # One aggregate per field, not one struct: a query that needs no payload then moves none.
        "output_us": _only("ts_us", ACCEPTED),
        "output_model": _only("model", ACCEPTED),
        "output_provider": _only(provider, ACCEPTED),
        "output_texts": _only("assistant_texts", ACCEPTED),
        "output_last": _only("last_assistant", ACCEPTED),
        "output_usage": _only("usage", ACCEPTED),
        **{
            f"run_{name}": f"max_by({name}, if({RUN_END}, {POSITION}, null))"
            for name in ("success", "error", "duration_ms", "messages")
        },
        "explicit_channel": _last(channel, CONTEXT),
        "fallback_channel": _first(fallback, CONTEXT),
        "trigger": _last(trigger, CONTEXT),
        "cost_usd": _last("cost_usd", USAGE),
        "cost_usd_sum": f"cast(sum(if({USAGE}, cast(cost_usd as decimal(30, 12)), null)) as double)",
        "context_limit": _last("context.limit", USAGE),
        "context_used": _last("context.used", USAGE),
        "cost_model": _last(S.present("model"), USAGE),
        "cost_provider": _last(f"if({S.present('provider')} is null, null, {provider})", USAGE),
        "cost_duration_ms": _last("duration_ms", USAGE),
        "cost_usage": _last("usage", USAGE),
        "last_activity_us": _only("ts_us", ACTIVITY),
        "diagnostics": f"count_if({USAGE})",
    }


def collect_traces(annotated: DataFrame) -> DataFrame:
    """One row per trace with its bounds, context, output, run end and cost."""
    rows = annotated.where("reached").groupBy(*TRACE).agg(*_named(_bounds()), *_named(trace_aggregates()))
    return finish_traces(rows)


def _bounds() -> dict[str, str]:
    return {name: f"max({name})" for name in BOUNDS}


def _named(expressions: dict[str, str]) -> list:
    return [F.expr(f"{text} as {name}") for name, text in expressions.items()]


def finish_traces(rows: DataFrame) -> DataFrame:
    """Resolve the columns with a precedence."""
    return rows.selectExpr(
        "*",
        f"{S.trace_id('host_key', 'start_us', 'start_seq')} as trace_id",
        f"{S.trace_name('input_model.model', 'first_channel')} as trace_name",
        "coalesce(explicit_channel, fallback_channel) as channel",
        "output_us is not null as has_output",
        "if(output_us is not null, output_model, input_model.model) as model",
        "if(output_us is not null, output_provider, input_model.provider) as provider",
        "closed_by = 'agent_end' as finalized",
    )


def trace_metadata(options: Options) -> str:
    """Metadata of a finalised trace, each key by its precedence; the run end's duration replaces the cost's."""
    return P.json_object(
        {
            "created_from": S.literal(options.created_from),
            "costUsd": "cost_usd",
            "contextLimit": "context_limit",
            "contextUsed": "context_used",
            "success": "run_success",
            "durationMs": "run_duration_ms",
            "model": "coalesce(model, cost_model)",
            "provider": "coalesce(provider, cost_provider)",
            "channel": "channel",
            "channelId": "channel",
            "trigger": "trigger",
            "usage": P.chosen_usage("output_usage", "cost_usage"),
            "error": S.present(redact_text("run_error")),
        }
    )


def opening_metadata(options: Options) -> str:
    return P.json_object(
        {
            "created_from": S.literal(options.created_from),
            "provider": "input_model.provider",
            "model": "input_model.model",
            "sessionId": "session_id",
            "runId": "run_id",
            "agentId": "agent_id",
            "channel": "first_channel",
            "channelId": "first_channel",
            "trigger": "first_trigger",
        }
    )


USAGE_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in S.TOKEN_NAMES.values()) + ">"
SPAN_FIELDS = {
    "name": "string", "start_us": "bigint", "start_seq": "bigint", "end_us": "bigint", "close_reason": "string",
    "model": "string", "provider": "string", "channel": "string", "parent_seq": "bigint", "input": "string",
    "output": "string", "metadata": "string", "error_info": "string", "usage": USAGE_TYPE,
    "cost_usd": "double", "context_limit": "bigint", "context_used": "bigint",
}
# JSON of unknown shape, redacted once per row before the spans are made.
OPEN_JSON = {
    "clean_history": "history_messages",
    "clean_assistant": "if(has_output, output_last, to_json(" + P.last_assistant("run_messages") + "))",
    "clean_params": "coalesce(if(left(ltrim(tool_end_params), 1) = '{', tool_end_params, null), tool_start_params)",
    "clean_result": "tool_end_result",
}


def root_span(options: Options) -> dict[str, str]:
    text = P.trace_output_text("has_output", "output_texts", "run_messages")
    output = P.json_object({"output": text}, {"lastAssistant": "clean_assistant"})
    return {
        "name": "trace_name",
        "start_us": "start_us",
        "start_seq": "start_seq",
        "end_us": "close_us",
        "close_reason": "closed_by",
        "channel": "channel",
        **{name: name for name in ("cost_usd", "context_limit", "context_used")},
        "input": P.json_object(
            {
                "prompt": redact_text("prompt"),
                "systemPrompt": redact_text("system_prompt"),
                "imagesCount": "images_count",
            }
        ),
        "output": f"if(finalized and ({text}) is not null, {output}, null)",
        "metadata": f"case when finalized then {trace_metadata(options)} "
        f"when closed_by = 'stale' then '{{\"staleCleanup\":true}}' else {opening_metadata(options)} end",
        "error_info": f"case when finalized then {P.error_info('AgentError', 'run_error')} "
        f"when closed_by = 'stale' then {P.stale_error('host_key', 'close_us - stale_from_us')} end",
    }


def llm_span() -> dict[str, str]:
    texts = f"transform(output_texts, t -> {redact_text('t')})"
    return {
        "name": "input_model.model",
        "start_us": "start_us",
        "start_seq": "start_seq",
        "end_us": "if(has_output, output_us, close_us)",
        "close_reason": "if(has_output, 'ended', closed_by)",
        "model": "model",
        "provider": "provider",
        "channel": "channel",
        "input": P.json_object(
            {
                "prompt": redact_text("prompt"),
                "systemPrompt": redact_text("system_prompt"),
                "imagesCount": "images_count",
            },
            {"historyMessages": "clean_history"},
        ),
        "output": f"if(has_output, "
        f"{P.json_object({'assistantTexts': texts}, {'lastAssistant': 'clean_assistant'})}, null)",
        "usage": S.map_usage("output_usage"),
    }


def _orphan_us(phase: str) -> str:
    """When a child span nobody ended is closed: at the run end if it was open then, else with its trace."""
    return f"if(run_ended and {phase} = 0, first_end_us, close_us)"


def _orphan_reason(phase: str) -> str:
    return f"if(run_ended and {phase} = 0, 'agent_end', closed_by)"


def tool_span() -> dict[str, str]:
    def merged(name: str) -> str:
        return f"coalesce({S.present(f'tool_end_{name}')}, {S.present(f'tool_start_{name}')})"

    return {
        "name": "tool_start_tool_name",
        "start_us": "tool_start_ts_us",
        "start_seq": "tool_start_event_seq",
        "end_us": f"coalesce(tool_end_ts_us, tool_start_replaced_us, {_orphan_us('slot_phase')})",
        "close_reason": "case when tool_end_ts_us is not null then 'ended' "
        f"when tool_start_replaced_us is not null then 'duplicate_id' else {_orphan_reason('slot_phase')} end",
        "parent_seq": "tool_start_parent_seq",
        "input": "clean_params",
        "output": P.tool_output("tool_end_error", "clean_result"),
        "metadata": P.json_object(
            {
                "durationMs": "tool_end_duration_ms",
                "agentId": merged("agent_id"),
                "sessionId": merged("session_id"),
                "runId": merged("run_id"),
                "toolCallId": merged("call_id"),
            }
        ),
        "error_info": P.error_info("ToolError", "tool_end_error"),
    }


def _given(value: str, *events: str) -> str:
    names = ", ".join(f"'{event}'" for event in events)
    return f"if(event_name in ({names}), {value}, null)"


# What each life-cycle event reports about its run; later events overwrite, absent values do not.
SUBAGENT_METADATA = {
    "status": "if(event_name = 'subagent_reset', null, substring(event_name, 10))",
    "requesterSessionKey": "requester_session_key",
    "childSessionKey": "child_session_key",
    "runId": "run_id",
    "agentId": _given("agent_id", "subagent_spawned"),
    "mode": _given("mode", "subagent_spawned"),
    "threadRequested": _given("thread_requested", "subagent_spawned"),
    "childRunId": "child_run_id",
    "spawnMode": "spawn_mode",
    "expectsCompletionMessage": "expects_completion_message",
    "originChannel": "requester_origin.channel",
    "originAccountId": "requester_origin.accountId",
    "originTo": "requester_origin.to",
    "originThreadId": "requester_origin.threadId",
    "targetSessionKey": "target_session_key",
    "targetKind": _given("target_kind", "subagent_ended"),
    "reason": _given("reason", "subagent_ended"),
    "outcome": "outcome",
    "sendFarewell": "send_farewell",
    "endedAt": "ended_at",
    "accountId": "account_id",
}

# What the span's input holds, by the event that created the span.
_SPAWN, _SPAWNED, _DELIVERY, _END = (
    "subagent_spawning", "subagent_spawned", "subagent_delivery_target", "subagent_ended",
)
SUBAGENT_INPUT = {
    "childSessionKey": _given("child_session_key", _SPAWN, _SPAWNED, _DELIVERY),
    "agentId": _given("agent_id", _SPAWN, _SPAWNED),
    "label": _given("label", _SPAWN),
    "mode": _given("mode", _SPAWN, _SPAWNED),
    "requester": _given("requester", _SPAWN),
    "threadRequested": _given("thread_requested", _SPAWN),
    "requesterSessionKey": _given("requester_session_key", _DELIVERY),
    "targetSessionKey": _given("target_session_key", _END),
    "targetKind": _given("target_kind", _END),
    "reason": _given("reason", _END),
}


def subagent_aggregates() -> dict[str, str]:
    name = S.subagent_name("event_name", "agent_id", "target_kind")
    created = f"struct(ts_us, event_seq, {name} as name, parent_seq, phase)"
    creation = f"{LIFECYCLE} and event_seq = link_seq"
    ends = "event_name in ('subagent_ended', 'subagent_reset')"
    return {
        "sub_start": _only(created, creation),
        "sub_input": _only(P.json_object(SUBAGENT_INPUT), creation),
        "sub_end": f"min(if({ends}, struct(ts_us, event_seq, event_name), null))",
        "sub_error": f"min_by(error, if({ends}, {POSITION}, null))",
        **{f"sub_{key}": _last(value, LIFECYCLE) for key, value in SUBAGENT_METADATA.items()},
    }


def subagent_span() -> dict[str, str]:
    orphan = _orphan_us("sub_start.phase")
    own = f"(sub_end is not null and sub_end.ts_us <= {orphan})"
    error = "if(sub_end.event_name = 'subagent_ended', sub_error, null)"
    return {
        "name": "sub_start.name",
        "start_us": "sub_start.ts_us",
        "start_seq": "sub_start.event_seq",
        "end_us": f"if({own}, sub_end.ts_us, {orphan})",
        "close_reason": f"case when {own} and sub_end.event_name = 'subagent_ended' then 'ended' "
        f"when {own} then 'reset' else {_orphan_reason('sub_start.phase')} end",
        "parent_seq": "sub_start.parent_seq",
        "input": "sub_input",
        "output": f"if({S.present(error)} is not null, {P.json_object({'error': redact_text(error)})}, null)",
        "metadata": P.json_object({key: f"sub_{key}" for key in SUBAGENT_METADATA}),
        "error_info": P.error_info("SubagentError", error),
    }


def with_links(events: DataFrame) -> DataFrame:
    """The columns routing adds, null where no routing was done."""
    missing = {c: F.lit(None).cast("long") for c in ("parent_seq", "link_seq") if c not in events.columns}
    return events.withColumns(missing) if missing else events


def group_slots(annotated: DataFrame, split: Split = PLAIN, whole: bool = False) -> DataFrame:
    """One row per slot: the trace itself, a tool call, a sub-agent run."""
    slots = match_tools(with_links(annotated).where("reached"), split, whole)
    sub = f"(link_seq is not null and ({LIFECYCLE} or event_name = 'subagent_reset'))"
    rows = slots.where(f"not {TOOL} or matched").selectExpr(
        *[c for c in slots.columns if c != "slot_no"],
        f"case when {TOOL} then slot_kind when {sub} then 'subagent' else 'trace' end as slot",
        f"if({sub}, link_seq, slot_no) as slot_no",
        f"if({TOOL}, phase, 0) as slot_phase",
        f"if({TOOL}, session_key, null) as slot_session",
    )
    shared = ["ts_us", "params", "agent_id", "session_id", "run_id", "call_id"]
    starts = [*shared, "event_seq", "tool_name", "replaced_us", "parent_seq"]
    ends = [*shared, "result", "error", "duration_ms"]
    return rows.groupBy(*TRACE, "slot", "slot_session", "slot_phase", "slot_name", "slot_no").agg(
        *_named(
            {
                **_bounds(),
                **trace_aggregates(),
                **{f"tool_start_{name}": _only(name, "event_name = 'before_tool_call'") for name in starts},
                **{f"tool_end_{name}": _only(name, "event_name = 'after_tool_call'") for name in ends},
                **subagent_aggregates(),
            }
        )
    )


def build_spans(annotated: DataFrame, options: Options = Options(), split: Split = PLAIN, whole: bool = False) -> DataFrame:
    """One row per span: root and model span of every trace, its tool calls, its sub-agent runs. ``whole``: every field is
    wanted, as in ``annotate``."""
    rows = finish_traces(group_slots(annotated, split, whole))
    rows = rows.withColumns({name: redact_json(raw) for name, raw in OPEN_JSON.items()})
    rows = rows.selectExpr(
        "*",
        "explode(case when slot = 'trace' then array('root', 'llm') "
        "when slot = 'subagent' then if(sub_start is not null, array('subagent'), array()) "
        "when tool_start_ts_us is not null then array('tool') end) as kind",
    )
    made = {"root": root_span(options), "llm": llm_span(), "tool": tool_span(), "subagent": subagent_span()}

    # One conditional column per field, so that a query pays only for the fields it reads.
    def field(name: str, type_name: str) -> str:
        cases = " ".join(f"when '{kind}' then {fields[name]}" for kind, fields in made.items() if name in fields)
        return f"cast(case kind {cases} end as {type_name}) as {name}"

    spans = rows.selectExpr(*TRACE, "trace_id", "kind", *[field(n, t) for n, t in SPAN_FIELDS.items()])
    return number_spans(spans, split)


def number_spans(spans: DataFrame, split: Split = PLAIN) -> DataFrame:
    """Number a trace's spans in creation order, root 0, and derive labels, ids and totals."""
    ranked = spans.selectExpr("*", "case kind when 'root' then 0 when 'llm' then 1 else 2 end as _rank")
    order = ["start_us", "start_seq", "_rank"]

    def count(part: DataFrame) -> DataFrame:
        return running(part, TRACE, order, [Scan("_count", "sum", F.lit(1))], split)

    numbered = beside(ranked, [*TRACE, *order], [], count) if split.active else count(ranked)
    numbered = numbered.withColumn("span_seq", F.expr("cast(_count - 1 as bigint)"))
    return numbered.selectExpr(
        "host_key as session_id",
        "trace_no",
        "trace_id",
        "kind",
        "span_seq",
        f"{S.span_id('trace_id', 'span_seq')} as span_id",
        f"{S.event_id('trace_id', 'span_seq')} as event_id",
        f"{S.span_type('kind')} as span_type",
        f"{S.action_type('kind')} as action_type",
        *SPAN_FIELDS,
        "usage.prompt_tokens as prompt_tokens",
        "usage.completion_tokens as completion_tokens",
        "cast(floor((end_us - start_us) / 1000) as bigint) as duration_ms",
        f"{S.token_total('usage.prompt_tokens', 'usage.completion_tokens')} as tokens",
        f"if(kind = 'root', null, {S.span_id('trace_id', '0')}) as parent_span_id",
    )


def nest_spans(spans: DataFrame) -> DataFrame:
    """Parent of a span created under a sub-agent run: that run's span, found by the event that created it."""
    key = ["session_id", "trace_no", "parent_seq"]
    runs = spans.where("kind = 'subagent'").selectExpr(
        "session_id", "trace_no", "start_seq as parent_seq", "span_id as _run_span"
    )
    plain = spans.where("parent_seq is null")
    nested = spans.where("parent_seq is not null").join(runs, key, "left")
    nested = nested.withColumn("parent_span_id", F.coalesce("_run_span", "parent_span_id")).drop("_run_span")
    return plain.unionByName(nested)


def assemble(events: DataFrame, options: Options = Options()) -> DataFrame:
    """Spans of a batch of events; hot sessions are split by time."""

    def plan(part: DataFrame, known: Options, split: Split) -> DataFrame:
        return build_spans(annotate(part, known, split), known, split)

    return by_session(events, options, plan)

"""Reading hook events: raw envelopes with an event payload and a context, into the canonical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tracewright.functions.scalars import present, resolve_id
from tracewright.schemas import HOOK_EVENTS, RAW_HOOKS

_LIFECYCLE = "hook like 'subagent%'"


def _canonical() -> dict[str, str]:
    event, ctx = "event.", "ctx."
    child = f"if(hook = 'subagent_ended', {present('ctx.childSessionKey')}, " \
        f"{resolve_id('event.childSessionKey', 'ctx.childSessionKey')})"
    requester = f"if(hook = 'subagent_delivery_target', " \
        f"{resolve_id('event.requesterSessionKey', 'ctx.requesterSessionKey')}, {present('ctx.requesterSessionKey')})"
    run = f"if(hook in ('subagent_spawning', 'llm_output', 'agent_end'), {present('ctx.runId')}, " \
        f"{resolve_id('event.runId', 'ctx.runId')})"
    return {
        "event_seq": "seq",
        "ts": "ts",
        "event_name": "hook",
        # Life-cycle events name their sessions themselves; diagnostics carry the key in the payload.
        "session_key": f"case when hook = 'model.usage' then {present('event.sessionKey')} "
        f"when {_LIFECYCLE} then null else {present('ctx.sessionKey')} end",
        "agent_id": f"if({_LIFECYCLE}, event.agentId, ctx.agentId)",
        "session_id": f"if(hook = 'llm_input', {present('event.sessionId')}, {present('ctx.sessionId')})",
        "run_id": run,
        "channel_id": present(ctx + "channelId"),
        "message_provider": present(ctx + "messageProvider"),
        "trigger": present(ctx + "trigger"),
        "requester_session_key": requester,
        "child_session_key": child,
        "target_session_key": present(event + "targetSessionKey"),
        "tool_call_id": resolve_id("event.toolCallId", "ctx.toolCallId"),
        "result": "to_json(event.result)",
        "last_assistant": "to_json(event.lastAssistant)",
        **{
            snake: f"event.{camel}"
            for snake, camel in {
                "tool_name": "toolName", "model": "model", "provider": "provider", "prompt": "prompt",
                "system_prompt": "systemPrompt", "images_count": "imagesCount",
                "history_messages": "historyMessages", "assistant_texts": "assistantTexts",
                "usage": "usage", "params": "params",
                "error": "error", "duration_ms": "durationMs", "success": "success", "messages": "messages",
                "cost_usd": "costUsd", "context": "context", "label": "label", "mode": "mode",
                "requester": "requester", "thread_requested": "threadRequested", "target_kind": "targetKind",
                "reason": "reason", "outcome": "outcome", "send_farewell": "sendFarewell", "ended_at": "endedAt",
                "account_id": "accountId", "child_run_id": "childRunId", "spawn_mode": "spawnMode",
                "expects_completion_message": "expectsCompletionMessage", "requester_origin": "requesterOrigin",
                "message": "message",
            }.items()
        },
    }


def canonical(raw: DataFrame) -> DataFrame:
    """Raw envelopes as canonical events: each id from the payload, else from the context, empty as missing."""
    return raw.selectExpr(*[f"{text} as {name}" for name, text in _canonical().items()])


def read_raw(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema; rows that do not parse keep their text in ``_corrupt_record``."""
    reader = (spark.readStream if streaming else spark.read).schema(RAW_HOOKS)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_hook_events(
    spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """Canonical hook events, as a batch or a stream: from raw JSON lines, or from a canonical columnar table."""
    if fmt == "json":
        raw = read_raw(spark, path, streaming, max_files)
        return canonical(raw.where("_corrupt_record is null"))
    reader = (spark.readStream if streaming else spark.read).schema(HOOK_EVENTS)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def union_hooks(parts: list[DataFrame]) -> DataFrame:
    """The hook kinds as one stream of events; columns a kind does not have are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

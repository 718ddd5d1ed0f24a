"""Input and output schemas."""

from __future__ import annotations

from pyspark.sql import types as T

USAGE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("input", "output", "cacheRead", "cacheWrite", "total")]
)
CONTEXT = T.StructType([T.StructField("limit", T.LongType()), T.StructField("used", T.LongType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
ORIGIN = T.StructType([T.StructField(n, T.StringType()) for n in ("channel", "accountId", "to", "threadId")])

# The canonical event table: one row per hook or diagnostic event.
HOOK_EVENTS = T.StructType(
    [
        T.StructField("event_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_name", T.StringType()),
        *[
            T.StructField(n, T.StringType())
            for n in (
                "session_key", "agent_id", "session_id", "run_id", "channel_id", "message_provider", "trigger",
                "requester_session_key", "child_session_key", "target_session_key", "tool_name", "tool_call_id",
                "model", "provider", "prompt", "system_prompt",
            )
        ],
        T.StructField("images_count", T.IntegerType()),
        T.StructField("history_messages", T.StringType()),
        T.StructField("assistant_texts", T.ArrayType(T.StringType())),
        T.StructField("last_assistant", T.StringType()),
        T.StructField("usage", USAGE),
        T.StructField("params", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("context", CONTEXT),
        T.StructField("label", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("requester", T.StringType()),
        T.StructField("thread_requested", T.BooleanType()),
        T.StructField("target_kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("send_farewell", T.BooleanType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("child_run_id", T.StringType()),
        T.StructField("spawn_mode", T.StringType()),
        T.StructField("expects_completion_message", T.BooleanType()),
        T.StructField("requester_origin", ORIGIN),
        T.StructField("message", T.StringType()),
    ]
)

# The raw record: an envelope with the hook's event payload and its context, as the host delivers them.
RAW_EVENT = T.StructType(
    [
        *[
            T.StructField(n, T.StringType())
            for n in (
                "sessionKey", "agentId", "sessionId", "runId", "requesterSessionKey", "childSessionKey",
                "targetSessionKey", "toolName", "toolCallId", "model", "provider", "prompt", "systemPrompt",
                "historyMessages", "params", "error", "label", "mode", "requester",
                "targetKind", "reason", "outcome", "endedAt", "accountId", "childRunId", "spawnMode", "message",
            )
        ],
        # Any JSON value: a string must stay distinct from the number it spells.
        T.StructField("result", T.VariantType()),
        T.StructField("lastAssistant", T.VariantType()),
        T.StructField("imagesCount", T.IntegerType()),
        T.StructField("assistantTexts", T.ArrayType(T.StringType())),
        T.StructField("usage", USAGE),
        T.StructField("durationMs", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("costUsd", T.DoubleType()),
        T.StructField("context", CONTEXT),
        T.StructField("threadRequested", T.BooleanType()),
        T.StructField("sendFarewell", T.BooleanType()),
        T.StructField("expectsCompletionMessage", T.BooleanType()),
        T.StructField("requesterOrigin", ORIGIN),
    ]
)
RAW_CONTEXT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "sessionKey", "agentId", "sessionId", "runId", "channelId", "messageProvider", "trigger",
            "requesterSessionKey", "childSessionKey", "toolCallId",
        )
    ]
)
RAW_HOOKS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("hook", T.StringType()),
        T.StructField("event", RAW_EVENT),
        T.StructField("ctx", RAW_CONTEXT),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Output tables.
EVENTS_TABLE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("record", T.StringType()),
        T.StructField("record_attributes", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("resource_attributes", T.StringType()),
        T.StructField("start_timestamp", T.TimestampType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("trace", T.StringType()),
    ]
)
ACTIONS_TABLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("action_name", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("input_params", T.StringType()),
        T.StructField("output_result", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("event_id", T.StringType()),
    ]
)
SESSIONS_TABLE = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("total_actions", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

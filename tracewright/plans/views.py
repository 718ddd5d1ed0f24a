"""Hook-event views over the given tables.

Plain columns are written once, in SQL both engines read, so that the oracle sees the same events; nested
columns are spelled per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.schemas import HOOK_EVENTS

# --- hooks_e: columns of an event row (event_id, ts, user_id, event_type, value, k) ---
_LLM = "event_type in ('view', 'signup')"
_TOOL = "event_type in ('click', 'purchase')"
EVENT_COLUMNS = {
    "event_seq": "event_id",
    "ts": "ts",
    "event_name": "case event_type when 'view' then 'llm_input' when 'signup' then 'llm_output' "
    "when 'click' then 'before_tool_call' when 'purchase' then 'after_tool_call' else 'agent_end' end",
    # One tool end in twenty has lost its session key.
    "session_key": "case when event_type = 'purchase' and event_id % 20 = 0 then null else cast(user_id as string) end",
    "agent_id": "concat('a', cast(user_id as string))",
    "model": f"case when {_LLM} then concat('m', cast(k % 4 as string)) end",
    "provider": f"case when {_LLM} then case k % 4 when 0 then 'openai-codex' when 1 then ' OpenAI ' "
    "when 2 then 'anthropic' else 'Codex' end end",
    "channel_id": "case when (event_type = 'view' and k % 2 = 0) or (event_type = 'error' and k % 5 = 0) "
    "then concat('c', cast(k % 3 as string)) end",
    "message_provider": "case when event_type in ('view', 'signup', 'error') "
    "then concat('p', cast(k % 3 as string)) end",
    "trigger": "case when event_type in ('view', 'error') and k % 4 = 1 then 'cron' "
    "when event_type in ('view', 'error') and k % 4 = 2 then '' end",
    "prompt": "case when event_type = 'view' then concat('ask ', cast(event_id as string)) end",
    "tool_name": f"case when {_TOOL} then concat('t', cast(k % 3 as string)) end",
    "tool_call_id": f"case when {_TOOL} and k % 2 = 0 then concat('call', cast(k % 10 as string)) "
    f"when {_TOOL} and k % 10 = 1 then '' end",
    "params": f"case when {_TOOL} and k % 3 <> 1 then concat('{{\"q\":', cast(k as string), '}}') end",
    "result": "case when event_type <> 'purchase' then null "
    "when k % 4 = 0 then concat('{\"ok\":', cast(k as string), '}') when k % 4 = 1 then cast(k as string) "
    "when k % 4 = 2 then concat('\"v', cast(k as string), '\"') end",
    "error": "case when event_type = 'purchase' and k % 7 = 0 then concat('tool failed ', cast(k as string)) "
    "when event_type = 'purchase' and k % 7 = 1 then '' "
    "when event_type = 'error' and k % 2 = 1 then concat('agent failed ', cast(k as string)) end",
    "duration_ms": "case when event_type = 'purchase' then cast(floor(value) as bigint) "
    "when event_type = 'error' and k % 3 <> 0 then cast(floor(value * 10) as bigint) end",
    "success": "case when event_type = 'error' then k % 2 = 0 end",
    "last_assistant": "case when event_type = 'signup' and k % 3 = 0 "
    "then concat('\"done ', cast(k as string), '\"') end",
}
# Usage counts of a signup row, null altogether when k is a multiple of five.
USAGE_COLUMNS = {
    "input": "cast(floor(value) as bigint)",
    "output": "k",
    "cacheRead": "case when k % 3 = 1 then k end",
    "cacheWrite": "cast(null as bigint)",
    "total": "case when k % 3 = 0 then cast(floor(value) as bigint) + k end",
}
_USAGE = (
    "if(event_type = 'signup' and k % 5 <> 0, named_struct("
    + ", ".join(f"'{name}', {text}" for name, text in USAGE_COLUMNS.items())
    + "), null)"
)
_NESTED = {
    "usage": _USAGE,
    "assistant_texts": "case when event_type <> 'signup' then null when k % 11 = 0 then array() "
    "when k % 2 = 0 then array(concat('hello ', k)) else array(concat('hello ', k), concat('bye ', k)) end",
    "messages": "case when event_type <> 'error' then null "
    "when k % 3 = 1 then array(struct('user' as role, 'q' as content), "
    "struct('assistant' as role, concat('a', k) as content)) "
    "when k % 3 = 2 then array(struct('assistant' as role, 'first' as content), "
    "struct('user' as role, concat('u', k) as content)) end",
}

# --- hooks_diag: one usage diagnostic per chosen signup row ---
DIAGNOSTIC_WHERE = "event_type = 'signup' and k % 4 = 0"
DIAGNOSTIC_COLUMNS = {
    "event_seq": "event_id + 1000000000000",
    "event_name": "'model.usage'",
    "session_key": "cast(user_id as string)",
    "model": "case when k % 8 = 0 then concat('d', cast(k % 3 as string)) end",
    "provider": "case when k % 8 = 4 then ' Codex ' end",
    "cost_usd": "case when k % 3 <> 2 then value / 1000 end",
    "duration_ms": "case when k % 3 = 0 then k end",
}

# --- hooks_sub: tool rows that become sub-agent events; users 3n, 3n+1, 3n+2 form two-level chains ---
LIFECYCLE_WHERE = "event_type in ('click', 'purchase') and k % 10 = 9 and user_id % 3 < 2"
_CHILD = "cast(user_id + 1 as string)"
LIFECYCLE_COLUMNS = {
    "event_seq": "event_id",
    "ts": "ts",
    "event_name": "case when event_type = 'purchase' then 'subagent_ended' when k % 20 = 9 then 'subagent_spawning' "
    "when event_id % 2 = 0 then 'subagent_spawned' else 'subagent_delivery_target' end",
    "requester_session_key": "cast(user_id as string)",
    "child_session_key": f"case when event_type = 'click' then {_CHILD} end",
    # One end in eight names no session at all.
    "target_session_key": f"case when event_type = 'purchase' and event_id % 8 <> 0 then {_CHILD} end",
    "agent_id": "case when event_type = 'click' then concat('w', cast(k % 3 as string)) end",
    "mode": "case when event_type = 'click' then 'run' end",
    "target_kind": "case when event_type = 'purchase' then 'subagent' end",
    "reason": "case when event_type = 'purchase' then 'completed' end",
    "outcome": "case when event_type = 'purchase' then case when k % 20 = 9 then 'ok' else 'error' end end",
    "error": "case when event_type = 'purchase' and k % 20 = 19 then concat('sub failed ', cast(k as string)) end",
}

# --- hooks_c: conversation turns as model events, with markers, blocks and references injected ---
INFO_BLOCK = '\\n\\nConversation info (untrusted metadata):\\n\\n{\\n  "message_id": "'
SENDER_BLOCK = '"\\n}\\n\\nSender (untrusted metadata):\\n\\n{\\n  "label": "'
INJECTED_TEXT = (
    "case turn % 5 "
    "when 0 then concat('[[reply_to_current]] ', text, ' media:/tmp/', cast(conv_id as string), '_', "
    "cast(turn as string), '.png') "
    "when 1 then concat(text, ' see file:///tmp/', cast(conv_id as string), '.mp4') "
    "when 2 then concat(text, ' ![x](/tmp/a/../', cast(conv_id as string), '.jpg)') "
    f"when 3 then concat(text, '{INFO_BLOCK}', cast(conv_id as string), '{SENDER_BLOCK}', "
    "cast(turn as string), '\"\\n}\\n\\nafter') "
    "else concat(text, '\\n\\n\\n\\nend media:https://example.com/', cast(conv_id as string), '.webp') end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Times carry no zone in the tables; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame) -> DataFrame:
    """The canonical columns, null where the view has none."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) as {f.name}"
            for f in HOOK_EVENTS.fields
        ]
    )


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of files, with the schema of the batch table.

    All files that are there come in one micro-batch: files are in no order of time, so with one file at a time the rows of
    the later files would come behind the watermark and be left out.
    """
    schema = table(spark, sf_dir, name).schema
    # A pattern that fits this one name: without one, a streamed path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _base(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    events = (stream if streaming else table)(spark, sf_dir, "events")
    return events.selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "user_id",
        "event_type",
        "value",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )


def _select(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return conform(rows.selectExpr(*[f"{text} as {name}" for name, text in columns.items()]))


def hooks_e(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Model, tool and run events from ``events``."""
    return _select(_base(spark, sf_dir, streaming), {**EVENT_COLUMNS, **_NESTED})


def hooks_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hooks_e`` where every event has its session key."""
    return _select(_base(spark, sf_dir), {**EVENT_COLUMNS, **_NESTED, "session_key": "cast(user_id as string)"})


def hooks_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hooks_e`` with a usage diagnostic one microsecond after some model outputs."""
    nested = {
        "ts": "timestamp_micros(unix_micros(ts) + 1)",
        "context": "named_struct('limit', 128000L, 'used', cast(floor(value) as bigint))",
        "usage": _USAGE,
    }
    base = _base(spark, sf_dir)
    return _select(base, {**EVENT_COLUMNS, **_NESTED}).unionByName(
        _select(base.where(DIAGNOSTIC_WHERE), {**DIAGNOSTIC_COLUMNS, **nested})
    )


def hooks_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hooks_e`` where some tool events are sub-agent events; every other event has its session key."""
    base = _base(spark, sf_dir)
    rest = {**EVENT_COLUMNS, **_NESTED, "session_key": "cast(user_id as string)"}
    return _select(base.where(f"not ({LIFECYCLE_WHERE})"), rest).unionByName(
        _select(base.where(LIFECYCLE_WHERE), LIFECYCLE_COLUMNS)
    )


def conversations(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """Turns with the injected text."""
    rows = (stream if streaming else table)(spark, sf_dir, "conversations")
    return rows.selectExpr("conv_id", "turn", "role", f"{INJECTED_TEXT} as text")


def hooks_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model events; the system turn belongs to the first input of its conversation."""
    rows = conversations(spark, sf_dir)
    # One aggregate instead of joining the system turns back: both are per conversation.
    openings = rows.groupBy("conv_id").agg(
        *_exprs(
            "max(case when role = 'system' then text end) as system_text",
            "min(case when role = 'user' then turn end) as first_turn",
        )
    )
    talk = rows.where("role in ('user', 'assistant')").join(openings, "conv_id")
    return _select(
        talk,
        {
            "event_seq": "conv_id * 1000 + turn",
            "ts": "timestamp_micros(1704067200000000 + conv_id * 3600000000 + turn * 60000000)",
            "event_name": "if(role = 'user', 'llm_input', 'llm_output')",
            "session_key": "cast(conv_id as string)",
            "model": "'m0'",
            "provider": "'anthropic'",
            "prompt": "if(role = 'user', text, null)",
            "system_prompt": "if(role = 'user' and turn = first_turn, system_text, null)",
            "assistant_texts": "if(role = 'assistant', array(text), null)",
        },
    )


def _exprs(*texts: str) -> list:
    from pyspark.sql import functions as F

    return [F.expr(text) for text in texts]

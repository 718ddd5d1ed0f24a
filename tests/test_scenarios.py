"""Single runs, event by event, with the spans they must give."""

from __future__ import annotations

import json

from helpers import frame

from tracewright.operators.admission import quality_report, skip_reasons
from tracewright.operators.rollups import rollup_sessions
from tracewright.operators.spans import assemble, collect_traces
from tracewright.operators.traces import annotate
from tracewright.options import Options
from tracewright.sources.hooks import read_hook_events

SECOND = 1_000_000
USAGE = (10, 20, 5, 3, 30)


def run(*events: dict) -> list[dict]:
    out = []
    for i, event in enumerate(events):
        out.append({"seq": i + 1, "us": (i + 1) * SECOND, "session": "s", **event})
    return out


def spans_of(spark, events, options=Options()):
    rows = assemble(frame(spark, events), options).collect()
    return {(r["kind"], r["start_seq"]): r for r in rows}


def test_full_run(spark):
    events = run(
        {"name": "llm_input", "model": "gpt-4", "provider": "openai-codex", "channel_id": "discord", "trigger": "cron",
         "prompt": "hi [[reply_to x]] there"},
        {"name": "before_tool_call", "tool": "search", "call": "c1", "params": '{"q":"media:/tmp/a.png"}'},
        {"name": "after_tool_call", "tool": "search", "call": "c1", "result": "3", "duration_ms": 9},
        {"name": "llm_output", "model": "gpt-4", "provider": "openai-codex", "assistant_texts": ["a", "b"],
         "usage": USAGE},
        {"name": "agent_end", "success": True, "duration_ms": 77},
    )
    spans = spans_of(spark, events)
    root, llm, tool = spans[("root", 1)], spans[("llm", 1)], spans[("tool", 2)]
    assert root["name"] == "gpt-4 \u00b7 discord" and root["close_reason"] == "agent_end"
    meta = json.loads(root["metadata"])
    assert (meta["provider"], meta["channel"], meta["trigger"], meta["durationMs"]) == ("openai", "discord", "cron", 77)
    assert meta["usage"] == {"input": 10, "output": 20, "cacheRead": 5, "cacheWrite": 3, "total": 30}
    assert json.loads(root["output"]) == {"output": "a\n\nb"}
    assert json.loads(root["input"]) == {"prompt": "hi there"}
    assert llm["usage"].asDict() == {"prompt_tokens": 10, "completion_tokens": 20, "total_tokens": 30,
                                     "cache_read_tokens": 5, "cache_write_tokens": 3}
    assert json.loads(tool["input"]) == {"q": "media:<image-ref>"}
    assert json.loads(tool["output"]) == {"result": 3}
    assert json.loads(tool["metadata"]) == {"durationMs": 9, "toolCallId": "c1"}
    assert [s["span_seq"] for s in (root, llm, tool)] == [0, 1, 2]


def test_output_falls_back_to_the_last_assistant_message(spark):
    events = run(
        {"name": "llm_input", "model": "m"},
        {"name": "model.usage", "usage": (200, 100, 30, 10, 340), "cost_usd": 0.02, "duration_ms": 5},
        {"name": "agent_end", "success": True,
         "messages": [("user", "q"), ("assistant", "one"), ("assistant", "two"), ("user", "z")]},
    )
    root = spans_of(spark, events)[("root", 1)]
    assert json.loads(root["output"]) == {"output": "", "lastAssistant": {"role": "assistant", "content": "two"}}
    meta = json.loads(root["metadata"])
    assert meta["costUsd"] == 0.02 and meta["usage"]["total"] == 340
    # The run end's duration replaces the diagnostic's, even when it is missing.
    assert "durationMs" not in meta


def test_empty_output_is_not_a_fallback(spark):
    events = run(
        {"name": "llm_input", "model": "m"},
        {"name": "llm_output", "model": "m", "assistant_texts": []},
        {"name": "agent_end", "success": False, "error": "boom", "messages": [("assistant", "one")]},
    )
    root = spans_of(spark, events)[("root", 1)]
    assert json.loads(root["output"]) == {"output": ""}
    assert json.loads(root["error_info"]) == {"exceptionType": "AgentError", "message": "boom", "traceback": "boom"}


def test_idle_traces(spark):
    idle = run({"name": "llm_input", "model": "m"}, {"name": "agent_end", "us": 361 * SECOND})
    root = spans_of(spark, idle)[("root", 1)]
    assert root["close_reason"] == "stale" and json.loads(root["metadata"]) == {"staleCleanup": True}
    assert json.loads(root["error_info"])["exceptionType"] == "StaleTrace"
    # An exact timeout is not stale.
    exact = run({"name": "llm_input", "model": "m"}, {"name": "agent_end", "us": 301 * SECOND})
    assert spans_of(spark, exact)[("root", 1)]["close_reason"] == "agent_end"
    # Activity in between keeps it alive; a second output does not.
    alive = run(
        {"name": "llm_input", "model": "m"},
        {"name": "before_tool_call", "tool": "t", "us": 121 * SECOND},
        {"name": "agent_end", "us": 361 * SECOND},
    )
    assert spans_of(spark, alive)[("root", 1)]["close_reason"] == "agent_end"
    second = run(
        {"name": "llm_input", "model": "m"},
        {"name": "llm_output", "us": 2 * SECOND},
        {"name": "llm_output", "us": 200 * SECOND},
        {"name": "agent_end", "us": 361 * SECOND},
    )
    assert spans_of(spark, second)[("root", 1)]["close_reason"] == "stale"


def test_sweep_closes_at_a_tick(spark):
    options = Options(stale_timeout_ms=2000, sweep_ms=1000)
    events = run({"name": "llm_input", "model": "m"}, {"name": "agent_end", "us": int(4.1 * SECOND)})
    root = spans_of(spark, events, options)[("root", 1)]
    assert (root["close_reason"], root["end_us"]) == ("stale", 4 * SECOND)


def test_late_output_lands_within_grace(spark):
    events = run(
        {"name": "llm_input", "model": "m"},
        {"name": "agent_end", "us": 2 * SECOND},
        {"name": "llm_output", "us": 2 * SECOND + 500_000},
    )
    assert spans_of(spark, events)[("llm", 1)]["close_reason"] == "agent_end"
    assert spans_of(spark, events, Options(grace_ms=1000))[("llm", 1)]["close_reason"] == "ended"


def test_sessions_count_each_token_once(spark):
    events = run(
        {"name": "llm_input", "model": "m", "message_provider": "slack"},
        {"name": "llm_output", "model": "n", "usage": USAGE},
        {"name": "agent_end"},
    )
    row = rollup_sessions(assemble(frame(spark, events))).first()
    assert (row["total_tokens"], row["total_actions"], row["model_name"], row["channel_id"]) == (30, 2, "n", "slack")


def test_last_cost_wins_and_sum_is_kept(spark):
    events = run(
        {"name": "llm_input", "model": "m"},
        {"name": "model.usage", "cost_usd": 0.5, "usage": USAGE},
        {"name": "model.usage", "cost_usd": 0.25},
    )
    row = collect_traces(annotate(frame(spark, events))).first()
    assert (row["cost_usd"], row["cost_usd_sum"], row["cost_usage"]["total"]) == (0.25, 0.75, 30)


def test_skip_reasons(spark):
    events = run(
        {"name": "llm_output"},
        {"name": "before_tool_call", "tool": "t"},
        {"name": "llm_input", "model": "m"},
        {"name": "after_tool_call", "tool": "t"},
        {"name": "agent_end", "session": ""},
        {"name": "subagent_spawning", "session": None, "child": ""},
        {"name": "subagent_spawning", "session": None, "child": "x"},
    )
    got = {(r["event_name"], r["reason"]) for r in skip_reasons(frame(spark, events)).collect()}
    assert got == {
        ("llm_output", "no_active_llm_span"),
        ("before_tool_call", "no_span_container"),
        ("llm_input", "ok"),
        ("after_tool_call", "no_matching_tool_span"),
        ("agent_end", "no_session_key"),
        ("subagent_spawning", "no_child_session_key"),
        ("subagent_spawning", "no_subagent_container"),
    }


def test_reading_raw_envelopes(spark, tmp_path):
    lines = [
        {"seq": 1, "ts": "2024-01-01T00:00:00Z", "hook": "after_tool_call",
         "event": {"toolName": "t", "toolCallId": "", "result": {"a": [1]}}, "ctx": {"sessionKey": "s", "toolCallId": "c"}},
        {"seq": 2, "ts": "2024-01-01T00:00:01Z", "hook": "subagent_ended",
         "event": {"targetSessionKey": "x", "childSessionKey": "no"}, "ctx": {"childSessionKey": "y", "sessionKey": "z"}},
        {"seq": 3, "ts": "2024-01-01T00:00:02Z", "hook": "model.usage", "event": {"sessionKey": "s", "costUsd": 0.5}},
        {"seq": 4, "ts": "2024-01-01T00:00:03Z", "hook": "after_tool_call", "event": {"result": "3"}},
    ]
    (tmp_path / "hooks.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    rows = {r["event_seq"]: r for r in read_hook_events(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[4]["result"] == '"3"'
    assert (rows[1]["tool_call_id"], rows[1]["result"], rows[1]["session_key"]) == ("c", '{"a":[1]}', "s")
    assert (rows[2]["session_key"], rows[2]["child_session_key"], rows[2]["target_session_key"]) == (None, "y", "x")
    assert (rows[3]["session_key"], rows[3]["cost_usd"]) == ("s", 0.5)


def test_quality_counts(spark):
    events = run({"name": "before_tool_call", "tool": "t", "params": "{x"}, {"name": "llm_output", "session": ""})
    row = quality_report(frame(spark, [*events, events[0]])).first()
    assert (row["event_rows"], row["duplicate_rows"], row["missing_session"], row["malformed_params"]) == (3, 1, 1, 2)

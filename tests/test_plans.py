"""The physical plans the headline queries must keep."""

from __future__ import annotations

import pytest

from tracewright.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(spark, name: str) -> str:
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["session_rollup", "tool_pairs_fifo", "tool_pairs_by_id", "trace_summary", "stale_traces_5m"])
def test_events_are_shuffled_once(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def test_rollup_reads_only_what_it_needs(spark):
    plan = plan_of(spark, "session_rollup")
    # No Python stage, and no payload column survives to the windows.
    assert "ArrowEvalPython" not in plan
    for column in ("prompt#", "assistant_texts#", "messages#", "params#", "result#", "error#", "last_assistant#"):
        assert column not in plan, column


def test_text_work_does_not_shuffle(spark):
    for name in ("redact_texts", "provider_normalized", "usage_tokens", "media_refs"):
        assert "Exchange" not in plan_of(spark, name)


def test_windows_over_whole_rows_carry_payloads_as_one(spark):
    """Where rows are stored whole, no window or sort writes their many columns one by one; the rows are the same."""
    from helpers import frame
    from tracewright.operators.pairing import match_tools
    from tracewright.operators.traces import annotate
    from tracewright.options import Options

    rows = [
        {"seq": 1, "name": "llm_input", "session": "s", "us": 1, "prompt": "p"},
        {"seq": 2, "name": "before_tool_call", "session": "s", "us": 2, "tool": "t", "params": "{}"},
        {"seq": 3, "name": "after_tool_call", "session": "s", "us": 3, "tool": "t", "result": "1"},
        {"seq": 4, "name": "llm_input", "session": "s", "us": 4},
        {"seq": 5, "name": "llm_input", "session": None, "us": 5},
    ]
    events, options = frame(spark, rows), Options(as_of_us=9)
    for plan in (lambda df, **how: annotate(df, options, **how), lambda df, **how: match_tools(annotate(df, options), **how)):
        whole, plain = plan(events, whole=True), plan(events)
        assert whole.columns == plain.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))
    node = annotate(events, options, whole=True)._jdf.queryExecution().optimizedPlan()
    widths = []
    while node.children().nonEmpty():
        if node.nodeName() == "Window":
            widths.append(node.output().size())
        node = node.children().head()
    assert widths and max(widths) < 40 < len(events.columns)

"""Long chains of sub-agents: the same rows as the sequential model, in few rounds."""

from __future__ import annotations

import random

from helpers import frame
from test_simulator import NEVER, SECOND, compare

from tracewright.operators import routing
from tracewright.operators.routing import resolve_lifecycles
from tracewright.operators.traces import own_traces, timed


def chain(length: int, root: str = "root", first: int = 1, start: int = 0, end: int | None = None) -> list[dict]:
    """A root trace, and each session spawned by the one before; the root's run ends before spawn number ``end``."""
    events = [{"seq": first, "us": start, "name": "llm_input", "session": root, "model": "m"}]
    for i in range(1, length + 1):
        if i == end:
            events.append({"seq": first + len(events), "us": start + i * SECOND, "name": "agent_end", "session": root})
        requester = root if i == 1 else f"{root}-{i - 1}"
        event = {"name": "subagent_spawning", "requester": requester, "child": f"{root}-{i}", "agent": "w"}
        events.append({"seq": first + len(events), "us": start + i * SECOND + 1, **event})
    return events


def resolved(spark, events: list[dict]):
    known = timed(frame(spark, events))
    return resolve_lifecycles(known, own_traces(known, NEVER)).orderBy("event_seq").collect()


def test_a_chain_of_256_takes_few_rounds(spark, monkeypatch):
    calls = []
    real = routing._look_up
    monkeypatch.setattr(routing, "_look_up", lambda *a: calls.append(a) or real(*a))
    stored = []
    cut = routing.cut
    monkeypatch.setattr(routing, "cut", lambda *a: stored.append(a) or cut(*a))
    rows = resolved(spark, chain(256))
    assert len(rows) == 256 and all(r["creates"] and r["root"] == "root" for r in rows)
    assert [r["link_seq"] for r in rows] == list(range(2, 258))
    assert [r["parent_seq"] for r in rows] == [None, *range(2, 257)]
    assert len(calls) == 3  # the own traces, one round, one that finds nothing left to move
    assert len(stored) <= 14  # log2(256) steps of the chain and a few


def test_a_chain_stops_where_its_trace_has_closed(spark):
    rows = resolved(spark, chain(40, end=20))
    assert [r["creates"] for r in rows] == [True] * 19 + [False] * 21
    assert {r["root"] for r in rows[19:]} == {None}


def test_a_chain_without_a_trace_and_one_that_names_itself(spark):
    lost = [e for e in chain(9, "lost") if e["name"] != "llm_input"]
    own = [{"seq": 100, "us": 0, "name": "subagent_spawning", "requester": "x", "child": "x"}]
    assert not any(r["creates"] for r in resolved(spark, lost + own))


def test_chains_as_the_model_reads_them(spark):
    """Chains that branch, spawn again, end in the middle, and whose sessions call tools or open traces of their own."""
    rng = random.Random(5)
    events: list[dict] = []
    for group in range(4):
        names, now = [f"g{group}"], group * SECOND
        add = [{"name": "llm_input", "session": names[0], "model": "m"}]
        for i in range(60):
            at = rng.choice(names[-3:])
            if rng.random() < 0.75:
                names.append(f"g{group}c{i}" if rng.random() < 0.9 else rng.choice(names))
                add.append({"name": "subagent_spawning", "requester": at, "child": names[-1], "agent": "w"})
            elif rng.random() < 0.6:
                add.append({"name": "before_tool_call", "session": at, "tool": "t", "call": f"c{i}"})
            elif rng.random() < 0.4:
                add.append({"name": "llm_input", "session": at, "model": "m"})
            elif rng.random() < 0.7:
                add.append({"name": "subagent_ended", "requester": at, "child": at, "target": at, "kind": "subagent"})
            else:
                add.append({"name": "agent_end", "session": rng.choice(names[:4])})
        for event in add:
            now += rng.choice([0, 1, 2]) * SECOND
            events.append({"us": now, **event})
    for i, event in enumerate(sorted(events, key=lambda e: e["us"]), 1):
        event["seq"] = i
    compare(spark, events, NEVER, None)

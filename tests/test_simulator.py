"""Random event sequences through the Spark plans and through the sequential model."""

from __future__ import annotations

import random

import pytest
from helpers import frame
from simulator import Simulator

from tracewright.operators.correlation import correlate, resolve_missing
from tracewright.operators.scan import Split, as_of
from tracewright.operators.spans import build_spans, nest_spans
from tracewright.operators.traces import annotate, by_session, timed, trace_table
from tracewright.options import Options

SECOND = 1_000_000
TIMEOUT = 10


def random_events(seed: int, groups: int, length: int, lost: bool = True, runs: bool = True) -> list[dict]:
    rng = random.Random(seed)
    events, seq = [], 0
    for group in range(groups):
        sessions = [f"g{group}s{i}" for i in range(3)]
        now = rng.randrange(50) * SECOND
        for _ in range(length):
            # Ties, exact timeouts and longer gaps all occur.
            now += rng.choice([0, 1, 1, 2, 3, 5, TIMEOUT, TIMEOUT + 1]) * SECOND
            seq += 1
            name = rng.choice(
                ["llm_input"] * 3
                + ["llm_output"] * 2
                + ["before_tool_call"] * 6
                + ["after_tool_call"] * 6
                + ["agent_end"]
                + (["subagent_spawning"] * 2 + ["subagent_spawned", "subagent_delivery_target"] if runs else [])
                + (["subagent_ended"] * 2 if runs else [])
            )
            session = rng.choice(sessions)
            event = {"seq": seq, "us": now, "name": name}
            if name.startswith("subagent"):
                event["requester"] = rng.choice([*sessions, None])
                event["child"] = rng.choice([*sessions, None]) if rng.random() < 0.9 else ""
                if name == "subagent_ended":
                    event["target"], event["kind"] = rng.choice([*sessions, None]), rng.choice(["subagent", None])
                event["agent"] = rng.choice(["w", None])
            else:
                event["session"] = session
                event["agent"] = rng.choice([f"a{session}", f"shared{group}", None])
            if name == "llm_input":
                event["model"] = f"m{rng.randrange(2)}"
            if "tool_call" in name:
                event["tool"] = rng.choice(["t0", "t1"])
                event["call"] = rng.choice([None, None, "", "c0", "c1"])
                if name == "after_tool_call" and lost and rng.random() < 0.15:
                    event["session"] = rng.choice([None, ""])
            events.append(event)
    rng.shuffle(events)
    return events


def spark_spans(spark, events, options):
    routed = correlate(frame(spark, events), options)
    spans = by_session(
        routed, options, lambda part, known, split: build_spans(annotate(part, known, split), known, split)
    )
    return sorted(
        nest_spans(spans)
        .select("session_id", "kind", "name", "start_seq", "parent_seq", "start_us", "end_us", "close_reason")
        .collect()
    )


def model_spans(events, timeout_us):
    spans = Simulator(timeout_us).run(events)
    rows = [(s.session, s.kind, s.name, s.start_seq, s.parent_seq, s.start_us, s.end_us, s.reason) for s in spans]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))


def compare(spark, events, options, timeout_us):
    got = sorted((tuple(r) for r in spark_spans(spark, events, options)), key=lambda r: (r[0], r[1], r[2], r[3]))
    want = model_spans(events, timeout_us)
    missing, extra = [r for r in want if r not in set(got)], [r for r in got if r not in set(want)]
    assert not missing and not extra, f"missing {missing[:5]} extra {extra[:5]} of {len(want)}"
    assert len(got) == len(want)


NEVER = Options(stale_timeout_ms=None)
STALE = Options(stale_timeout_ms=TIMEOUT * 1000)


def test_pairing_without_staleness(spark):
    compare(spark, random_events(1, 40, 60, lost=False, runs=False), NEVER, None)


def test_pairing_with_staleness(spark):
    compare(spark, random_events(2, 40, 60, lost=False, runs=False), STALE, TIMEOUT * SECOND)


def test_routing_without_staleness(spark):
    compare(spark, random_events(3, 40, 40, lost=False), NEVER, None)


def test_routing_with_staleness(spark):
    compare(spark, random_events(4, 30, 30, lost=False), STALE, TIMEOUT * SECOND)


def test_everything_without_staleness(spark):
    compare(spark, random_events(5, 3, 80), NEVER, None)


def test_everything_with_staleness(spark):
    compare(spark, random_events(6, 2, 40), STALE, TIMEOUT * SECOND)


@pytest.mark.parametrize("groups", [1, 4])
def test_lost_sessions(spark, groups):
    events = random_events(7 + groups, groups, 120 // groups, runs=False)
    model = Simulator(None)
    model.run(events)
    timed_events = timed(frame(spark, events))
    traces = trace_table(annotate(timed_events, NEVER))
    got = {
        r["event_seq"]: (r["resolved"], r["fallback"])
        for r in resolve_missing(timed_events, traces, None, NEVER).collect()
    }
    assert got == {seq: (session or None, how) for seq, (session, how) in model.resolved.items()}


def test_split_scans_give_the_same(spark):
    events = random_events(11, 3, 80, lost=False, runs=False)
    compare(spark, events, STALE.but(max_group_rows=20), TIMEOUT * SECOND)


def test_repeated_events_count_once(spark):
    events = random_events(13, 3, 40)
    repeats = [dict(e) for e in events[::3]]
    got = spark_spans(spark, events + repeats, NEVER)
    assert got == spark_spans(spark, events, NEVER)
    plain = random_events(14, 3, 40, lost=False, runs=False)
    want = spark_spans(spark, plain, STALE)
    assert spark_spans(spark, plain + plain[::2], STALE) == want
    assert spark_spans(spark, plain + plain[::2], STALE.but(max_group_rows=20)) == want


def test_many_events_of_one_moment_are_dealt_evenly(spark):
    """A million rows of one session and one microsecond: chunks are even, and the scan is that of a window."""
    from pyspark.sql import functions as F

    from tracewright.operators import scan

    rows = spark.range(1_000_000).selectExpr("'s' as host_key", "7L as ts_us", "id as event_seq", "id % 1000 as v")
    split = scan.chunks_for(1_000_000, 250_000)
    dealt = rows.repartitionByRange(split.chunks, "host_key", "ts_us", "event_seq").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) < 250_000
    scans = [scan.Scan("total", "sum", F.col("v")), scan.Scan("before", "last", F.when(F.col("v") % 7 == 0, F.col("v")), "before")]
    found = [
        scan.running(rows, ["host_key"], ["ts_us", "event_seq"], scans, s).agg(F.sum(F.xxhash64("event_seq", "total", "before").cast("decimal(38,0)"))).first()
        for s in (scan.PLAIN, split)
    ]
    assert found[0] == found[1]


def test_repeats_at_other_times_count_once_on_both_paths(spark):
    """Every fifth event is delivered again seven seconds later; the first delivery counts."""
    events = random_events(15, 3, 40, lost=False, runs=False)
    again = [{**e, "us": e["us"] + 7 * SECOND} for e in events[::5]]
    want = spark_spans(spark, events, STALE.but(as_of_us=10**12))
    for limit in (1_000_000, 20):
        assert spark_spans(spark, events + again, STALE.but(as_of_us=10**12, max_group_rows=limit)) == want


def test_split_scans_store_no_payload(spark, monkeypatch):
    from tracewright.operators import scan

    stored, plain = [], scan.cut

    def watched(session, df):
        stored.append(set(df.columns))
        return plain(session, df)

    monkeypatch.setattr(scan, "cut", watched)
    events = frame(spark, random_events(11, 3, 80, lost=False, runs=False))
    spans = by_session(events, STALE.but(max_group_rows=20), lambda p, o, s: build_spans(annotate(p, o, s), o, s))
    assert spans.count() and len(stored) > 4
    payloads = {"prompt", "assistant_texts", "messages", "params", "result", "error", "input", "output", "metadata", "error_info"}
    assert not set().union(*stored) & payloads


def test_split_look_ups_give_the_same(spark):
    rng = random.Random(5)
    times = rng.sample(range(10_000), 600)
    rows = [(rng.choice("aab"), t * 1000, i, f"v{i}") for i, t in enumerate(times)]
    facts = spark.createDataFrame(rows[:300], "key string, ts_us long, event_seq long, v string")
    probes = spark.createDataFrame(rows[300:], "key string, ts_us long, event_seq long, v string").drop("v")
    order = ["ts_us", "event_seq"]
    plain = as_of(probes, facts, "key", order, "v", "found")
    split = as_of(probes, facts, "key", order, "v", "found", Split(5))
    want = {
        seq: max(((t, v) for k, t, _, v in rows[:300] if k == key and t < us), default=(0, None))[1]
        for key, us, seq, _ in rows[300:]
    }
    assert {r["event_seq"]: r["found"] for r in plain.collect()} == want
    assert {r["event_seq"]: r["found"] for r in split.collect()} == want

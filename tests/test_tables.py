"""Writing the output tables again changes nothing; streams give what batches give."""

from __future__ import annotations

import random

import pytest
from helpers import frame
from test_simulator import random_events

from tracewright.operators.correlation import correlate
from tracewright.operators.rollups import rollup_sessions
from tracewright.operators.spans import assemble, build_spans, nest_spans
from tracewright.operators.traces import annotate, by_session
from tracewright.options import Options
from tracewright.schemas import ACTIONS_TABLE, EVENTS_TABLE, SESSIONS_TABLE
from tracewright.sources import tables as T
from tracewright.sources.hooks import read_hook_events
from tracewright.streaming.assemble import assemble_traces

OPTIONS = Options(stale_timeout_ms=10_000)


def types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_appending_twice_changes_nothing(spark, tmp_path):
    spans = assemble(frame(spark, random_events(21, 5, 30, lost=False, runs=False)), OPTIONS)
    for _ in range(2):
        T.write_events(spans, str(tmp_path / "events"))
        T.write_actions(spans, str(tmp_path / "actions"))
    n = T.final(spans).count()
    events = spark.read.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "actions"))
    assert (events.count(), stored.count()) == (n, n)
    assert types(events.drop("event_date").schema) == types(EVENTS_TABLE)
    assert types(stored.drop("event_date", *T.SLOTS).schema) == types(ACTIONS_TABLE)
    assert types(rollup_sessions(spans).schema) == types(SESSIONS_TABLE)


def test_a_later_write_completes_open_traces_across_midnight(spark, tmp_path):
    day = 86_400_000_000
    events = [
        {"seq": 1, "name": "llm_input", "session": "s", "us": day - 2_000_000},
        {"seq": 2, "name": "before_tool_call", "session": "s", "tool": "t", "call": "c", "us": day - 1_000_000},
        {"seq": 3, "name": "after_tool_call", "session": "s", "tool": "t", "call": "c", "us": day + 1_000_000},
        {"seq": 4, "name": "llm_output", "session": "s", "us": day + 2_000_000},
        {"seq": 5, "name": "agent_end", "session": "s", "us": day + 3_000_000},
    ]
    paths = [str(tmp_path / name) for name in ("events", "actions")]
    for until in (2, 3, 5, 5):
        spans = assemble(frame(spark, events[:until]), OPTIONS)
        T.write_events(spans, paths[0])
        T.write_actions(spans, paths[1])
    want = {r["event_id"]: r["end_us"] for r in spans.collect()}
    for path, end in zip(paths, ("timestamp", "created_at"), strict=True):
        rows = spark.read.parquet(path).selectExpr("event_id", f"unix_micros({end}) as end_us", "event_date").collect()
        assert len(rows) == 3 and {r["event_id"]: r["end_us"] for r in rows} == want
        assert {str(r["event_date"]) for r in rows} == {"1970-01-01"}


def test_both_tables_are_written_from_stored_spans(spark, tmp_path, monkeypatch):
    """Each write makes its spans once; the two tables read them by column instead of making them again."""
    from tracewright.plans import queries

    given = []
    monkeypatch.setattr(queries.T, "write_events", lambda spans, path, options: given.append(spans))
    monkeypatch.setattr(queries.T, "write_actions", lambda spans, path: given.append(spans))
    rows = spark.range(40).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + id * 60000000000) as ts", "id % 3 as user_id",
        "element_at(array('view', 'click', 'purchase', 'signup', 'error'), int(id % 5) + 1) as event_type",
        "double(id) as value", "concat('{\"k\":', id, '}') as props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    queries._written_twice(spark, str(tmp_path))
    assert len(given) == 4 and all(spans.count() for spans in given)
    for spans in given:
        plan = spans._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "Window" not in plan and "Aggregate" not in plan


def test_rows_that_come_twice_are_written_once(spark, tmp_path):
    spans = assemble(frame(spark, random_events(22, 5, 30, lost=False, runs=False)), OPTIONS)
    n = T.final(spans).count()
    for _ in range(2):
        T.write_events(spans.unionByName(spans), str(tmp_path / "events"))
        T.write_actions(spans.unionByName(spans), str(tmp_path / "actions"))
    assert n and [spark.read.parquet(str(tmp_path / name)).count() for name in ("events", "actions")] == [n, n]


def test_access_paths_reach_the_scan(spark, tmp_path):
    spans = assemble(frame(spark, random_events(22, 5, 30, lost=False, runs=False)), OPTIONS)
    T.write_actions(spans, str(tmp_path / "actions"))
    rows = T.actions_by(spark.read.parquet(str(tmp_path / "actions")), session="g0s0", until="1970-02-01 00:00:00")
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(session_id,g0s0)" in plan
    assert rows.count() == T.final(spans).where("session_id = 'g0s0'").count()


def scanned(df) -> tuple[int, int, int]:
    """Rows of a plain scan, and how many files and rows it read."""
    rows = len(df.collect())
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return rows, *(metrics.apply(name).value() for name in ("numFiles", "numOutputRows"))


def test_each_access_path_reads_its_share(spark, tmp_path):
    """Actions of 4 days, 3 types and 40 sessions; each path reads the folders that can hold its rows."""
    path, day = str(tmp_path / "actions"), 86_400_000_000
    types = ("llm", "tool", "agent")
    rows = [
        (f"e{i}", f"s{i % 40}", types[i % 3], f"u{i % 7}", i % 4 * day + i * 1000, "x") for i in range(1200)
    ]
    names = "event_id string, session_id string, action_type string, user_id string, us bigint, input_params string"
    df = spark.createDataFrame(rows, names).selectExpr(
        "*", "timestamp_micros(us) as created_at", "to_date(timestamp_micros(us)) as event_date"
    )
    for _ in range(2):  # the second time adds nothing
        T.append(df.drop("us"), path, "event_id", "created_at", tuple(T.SLOTS), ("session_id", "user_id"))
    stored = T.read_actions(spark, path)
    assert stored.count() == 1200
    n, files, _ = scanned(stored.where("length(input_params) = 1"))
    folders = stored.select("event_date", *T.SLOTS).distinct().count()
    assert n == 1200 and files == folders > 12
    found = {
        "session": T.actions_by(stored, session="s7"),
        "type": T.actions_by(stored, action_type="tool"),
        "both": T.actions_by(stored, session="s7", action_type="tool"),
        "until": T.actions_by(stored, until="1970-01-02 00:00:00"),
        "user": T.actions_by(stored, user="nobody"),
    }
    got = {name: scanned(rows) for name, rows in found.items()}
    assert {name: n for name, (n, _, _) in got.items()} == {"session": 30, "type": 400, "both": 10, "until": 300, "user": 0}
    assert got["session"][1] < files / 2 and got["type"][1] < files * 0.7  # two types may share a folder
    assert got["both"][1] < files / 4 and got["until"][1] <= files / 2
    assert got["user"][2] == 0  # no row group is read


def test_stored_sessions_by_user_skip_row_groups(spark, tmp_path):
    rows = [(f"s{i}", f"u{i % 50}", "m", "c", i, i + 1, 1, 2) for i in range(2000)]
    names = [f.name for f in SESSIONS_TABLE.fields]
    seconds = ("start_time", "end_time")
    df = spark.createDataFrame(rows, names).selectExpr(
        *[f"timestamp_seconds({f.name}) as {f.name}" if f.name in seconds else f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in SESSIONS_TABLE]
    )
    for _ in range(2):
        T.write_sessions(df, str(tmp_path / "sessions"))
    stored = T.read_sessions(spark, str(tmp_path / "sessions"))
    n, _, read = scanned(T.sessions_by(stored, user="u7"))
    assert n == 40 and read < 2000
    assert scanned(T.sessions_by(stored, user="u07"))[2] == 0
    assert stored.where("total_actions <> 2").count() == 0 and stored.count() == 2000


@pytest.mark.parametrize(
    "options, runs", [(OPTIONS, True), (OPTIONS.but(grace_ms=3_000, sweep_ms=4_000), False)], ids=["plain", "grace"]
)
def test_stream_equals_batch(spark, tmp_path, options, runs):
    """Lost sessions in both; sub-agents in the first."""
    events = sorted(random_events(23, 3, 30, runs=runs), key=lambda e: (e["us"], e["seq"]))
    # Three files; within the delay the order is shuffled.
    rng = random.Random(1)
    by_arrival = sorted(events, key=lambda e: e["us"] + rng.randrange(4_000_000))
    third = len(events) // 3 + 1
    for i in range(3):
        part = frame(spark, by_arrival[i * third : (i + 1) * third])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        for name in (tmp_path / f"in{i}").glob("*.parquet"):
            (source / f"{i}-{name.name}").write_bytes(name.read_bytes())
            stream = read_hook_events(spark, str(source), streaming=True, fmt="parquet", max_files=1)
            run = assemble_traces(
                stream, str(tmp_path / "out"), str(tmp_path / "cp"), options, "5 seconds", available_now=True
            )
            run.awaitTermination()
    horizon = max(e["us"] for e in events) - 5_000_000
    known = options.but(as_of_us=horizon)
    routed = correlate(frame(spark, [e for e in events if e["us"] <= horizon]), known)
    spans = nest_spans(by_session(routed, known, lambda p, o, s: build_spans(annotate(p, o, s), o, s)))
    over = f"close_reason <> 'end_of_input' and (close_reason <> 'agent_end' or end_us <= {horizon})"
    closed = spans.where(f"kind = 'root' and {over}").select("trace_id")
    want = {tuple(r) for r in spans.join(closed, "trace_id", "left_semi").select("event_id", "end_us").collect()}
    rows = T.read_batches(spark, str(tmp_path / "out"), "events")
    got = [tuple(r) for r in rows.selectExpr("event_id", "unix_micros(timestamp)").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    totals = T.read_sessions(spark, str(tmp_path / "out"), "sessions")
    assert totals.agg({"total_actions": "sum"}).first()[0] == len(got)

"""State of streams: what is written follows what is new, batches appear whole, lost batches leave nothing behind."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from helpers import frame
from pyspark.sql import functions as F

from tracewright.operators.rollups import rollup_sessions
from tracewright.operators.spans import assemble
from tracewright.options import Options
from tracewright.plans.queries import QUERIES
from tracewright.plans.views import conform
from tracewright.sources import store
from tracewright.sources import tables as T
from tracewright.streaming import assemble as streams
from tracewright.streaming.assemble import process_batch

SECOND = 1_000_000
NEVER = Options(stale_timeout_ms=None)


def size_of(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def written_by(root: Path, step) -> int:
    """Bytes of the files of the state that a step adds."""
    before = {p for p in root.rglob("*.parquet")}
    step()
    return sum(p.stat().st_size for p in root.rglob("*.parquet") if p not in before and p.parts[len(root.parts)] in streams.STATE)


def opening(session: str, seq: int, us: int) -> list[dict]:
    return [
        {"seq": seq, "name": "llm_input", "session": session, "us": us, "model": "m", "prompt": f"{random.Random(seq).getrandbits(800):x}"},
        {"seq": seq + 1, "name": "before_tool_call", "session": session, "us": us + 1, "tool": "t", "call": "c"},
    ]


def ending(session: str, seq: int, us: int) -> list[dict]:
    return [
        {"seq": seq, "name": "after_tool_call", "session": session, "us": us, "tool": "t", "call": "c"},
        {"seq": seq + 1, "name": "agent_end", "session": session, "us": us + 1},
        {"seq": seq + 2, "name": "model.usage", "session": "clock", "us": us + 2},
    ]


def test_idle_traces_are_not_written_again(spark, tmp_path):
    idle = spark.range(10_000).selectExpr(
        "id as event_seq", "'llm_input' as event_name", "concat('idle', id) as session_key", "concat('a', id) as agent_id",
        "timestamp_micros(id) as ts", "concat(sha2(string(id), 512), sha2(string(-id), 512)) as prompt",
    )
    root = str(tmp_path / "out")
    first = written_by(tmp_path / "out", lambda: process_batch(conform(idle), 0, root, 0, NEVER))
    small = []
    for k in range(1, 4):
        events = opening(f"s{k}", 100_000 + 10 * k, (100 + k) * SECOND) + ending(f"s{k}", 100_005 + 10 * k, (100 + k) * SECOND + 10)
        # One idle trace goes on in each batch.
        events += [{"seq": 100_009 + 10 * k, "name": "before_tool_call", "session": f"idle{k}", "us": (100 + k) * SECOND + 20, "tool": "t"}]
        small.append(written_by(tmp_path / "out", lambda e=events, n=k: process_batch(frame(spark, e), n, root, 0, NEVER)))
    assert max(small) < first / 10
    state = store.last_commit(spark, root)
    opened = streams.latest(store.read_parts(spark, state, "open", streams.OPEN), "session_key")
    assert opened.count() == 10_000
    assert T.read_sessions(spark, root, "sessions").count() == 3


def test_idle_traces_close_when_their_time_is_up(spark, tmp_path):
    root, options = str(tmp_path / "out"), Options(stale_timeout_ms=5_000)
    process_batch(frame(spark, opening("s", 1, 0) + opening("r", 11, 2 * SECOND)), 0, root, 0, options)
    for k, us in enumerate((4, 6, 8)):
        process_batch(frame(spark, [{"seq": 50 + k, "name": "model.usage", "session": "clock", "us": us * SECOND}]), k + 1, root, 0, options)
    rows = T.read_batches(spark, root, "events").selectExpr("get_json_object(trace, '$.parent_id') as parent", "unix_micros(timestamp) as us", "batch_id")
    roots = {(r["batch_id"], r["us"]) for r in rows.where("parent is null").collect()}
    assert roots == {(2, 5 * SECOND + 1), (3, 7 * SECOND + 1)}


def test_a_stopped_batch_shows_nothing_and_is_repeated_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    process_batch(frame(spark, opening("s", 1, 0)), 0, root, 0, NEVER)
    events = frame(spark, ending("s", 5, 5 * SECOND))

    def tables():
        return [T.read_batches(spark, root, n).count() for n in ("events", "actions")] + [T.read_sessions(spark, root, "sessions").count()]

    stops = ["actions", "upsert", "add_part", "commit"]
    for name in stops:
        with monkeypatch.context() as patched:

            def fail(*args, **kwargs):
                raise RuntimeError("lost")

            patched.setattr(streams, name, fail)
            with pytest.raises(RuntimeError):
                process_batch(events, 1, root, 0, NEVER)
        assert tables() == [0, 0, 0]
    process_batch(events, 1, root, 0, NEVER)
    assert tables() == [3, 3, 1]
    process_batch(events, 1, root, 0, NEVER)  # repeated after its commit
    assert tables() == [3, 3, 1]
    with pytest.raises(ValueError):
        process_batch(events, 5, root, 0, NEVER)
    left = {p.name for t in streams.STATE for p in (tmp_path / "out" / t).iterdir()}
    store.tidy(spark, root, streams.STATE)
    kept = {p.name for t in streams.STATE for p in (tmp_path / "out" / t).iterdir()}
    assert len(kept) < len(left)
    process_batch(frame(spark, opening("s", 21, 9 * SECOND) + ending("s", 25, 10 * SECOND)), 2, root, 0, NEVER)
    assert tables() == [6, 6, 1]


def test_parts_merge_in_tiers(spark, tmp_path):
    root, state, sizes = str(tmp_path), store.Commit(), []
    for k in range(30):
        rows = spark.createDataFrame([(f"a{k % 7}", "s", k, k, k, k % 7 == 3)], streams.AGENTS)
        store.add_part(rows, state, root, "agents", streams.keyed("agent"), "agent")
        sizes.append(len(state.parts["agents"]))
    assert max(sizes) <= 2 * store.FAN_IN
    rows = streams.latest(store.read_parts(spark, state, "agents", streams.AGENTS), "agent").collect()
    assert {r["agent"]: r["version"] for r in rows} == {f"a{i}": max(k for k in range(30) if k % 7 == i) for i in range(7) if i != 3}


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    spans = assemble(frame(spark, [e for i in range(40) for e in opening(f"s{i}", 10 * i, 0) + ending(f"s{i}", 10 * i + 5, 9 * SECOND)]), NEVER)
    rows = rollup_sessions(spans)
    path = str(tmp_path / "sessions")
    T.write_sessions(rows, path)
    before = store.last_commit(spark, path).buckets["rows"]
    T.write_sessions(rows.where("session_id = 's7'"), path)
    after = store.last_commit(spark, path).buckets["rows"]
    assert [b for b in after if after[b] != before[b]] == [str(spark.sql(f"select pmod(xxhash64('s7'), {store.BUCKETS})").first()[0])]
    stored = {r["session_id"]: r for r in T.read_sessions(spark, path).collect()}
    once = {r["session_id"]: r for r in rows.collect()}
    assert len(stored) == len(once)
    assert stored["s7"]["total_actions"] == 2 * once["s7"]["total_actions"]
    assert all(stored[s] == once[s] for s in once if s != "s7")


def test_a_re_spawned_child_is_reset_in_the_old_root_across_batches(spark, tmp_path):
    """The child moves to another root in the second batch; in the third, only the first root is touched."""
    def at(us, seq, name, **more):
        return {"us": us * SECOND, "seq": seq, "name": name, **more}

    events = [
        [at(0, 1, "llm_input", session="r1", model="m"), at(0, 2, "llm_input", session="r2", model="m"),
         at(1, 3, "subagent_spawning", requester="r1", child="c", agent="w")],
        [at(2, 4, "subagent_spawning", requester="r2", child="c", agent="w"), at(3, 5, "before_tool_call", session="c", tool="t", call="x")],
        [at(4, 6, "llm_output", session="r1", model="m"), at(5, 7, "agent_end", session="r1")],
        [at(6, 8, "after_tool_call", session="c", tool="t", call="x"), at(7, 9, "agent_end", session="r2"), at(8, 10, "model.usage", session="z")],
    ]
    root = str(tmp_path / "out")
    for k, part in enumerate(events):
        process_batch(frame(spark, part), k, root, 0, NEVER)
    from tracewright.operators.correlation import correlate
    from tracewright.operators.spans import build_spans, nest_spans
    from tracewright.operators.traces import annotate, by_session

    routed = correlate(frame(spark, [e for part in events for e in part]), NEVER)
    spans = nest_spans(by_session(routed, NEVER, lambda p, o, s: build_spans(annotate(p, o, s), o, s)))
    want = {tuple(r) for r in T.event_rows(spans).where("event_id is not null").select("event_id", "record", "timestamp", "trace").collect()}
    got = {tuple(r) for r in T.read_batches(spark, root, "events").select("event_id", "record", "timestamp", "trace").collect()}
    assert got == want and len(got) == 7


def test_the_oldest_key_is_forgotten(spark, tmp_path):
    """A budget of 2,048 keys against a plain model: first in, first out, by shard."""
    from tracewright.streaming.media import first_seen

    rng = random.Random(3)
    batches = [[(f"e{rng.randrange(40)}", f"/p{min(int(rng.expovariate(1 / 900)), 9000)}", 10_000 * b + i) for i in range(6_000)] for b in range(3)]
    source = tmp_path / "in"
    for budget, shards in ((2048, 16), (40, 4)):
        known, want = {}, []
        shard_of = {}
        keys = spark.createDataFrame(sorted({r[:2] for b in batches for r in b}), "entity string, path string")
        for r in keys.selectExpr("entity", "path", f"pmod(xxhash64(to_json(struct(entity, path))), {shards}) as s").collect():
            shard_of[r.entity, r.path] = r.s
        for row in (r for b in batches for r in b):
            own = known.setdefault(shard_of[row[:2]], {})
            if row[:2] not in own:
                own[row[:2]] = None
                want.append(row)
                if len(own) > budget // shards:
                    del own[next(iter(own))]
        root = tmp_path / f"run{budget}"
        for number, batch in enumerate(batches):
            if budget == 2048:
                spark.createDataFrame(batch, "entity string, path string, ts long").coalesce(1).write.parquet(str(source / f"b={number}"))
        stream = spark.readStream.schema("entity string, path string, ts long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        found = first_seen(stream.parquet(str(source)), ["entity", "path"], "ts", budget, shards)
        run = found.writeStream.format("parquet").option("checkpointLocation", str(root / "cp")).trigger(availableNow=True)
        run.start(str(root / "out")).awaitTermination()
        got = sorted((r.entity, r.path, r.ts) for r in spark.read.parquet(str(root / "out")).collect())
        assert got == sorted(want)
        assert len(want) > len(keys.collect())  # some keys were forgotten and came again


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["stream_media_dedup", "stream_media_budget"])
def test_a_streamed_table_is_a_file_or_a_folder_in_any_order(spark, tmp_path, files, name):
    # A day apart, the later conversations in the first files: one file at a time would leave out the earlier ones.
    rows = [(conv, 0, "user", "look") for conv in range(96)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").orderBy(F.desc("conv_id"))
    df.coalesce(1).write.option("maxRecordsPerFile", 96 // files).parquet(str(tmp_path / "written"))
    if files == 1:
        part = next((tmp_path / "written").glob("part-*.parquet"))
        (tmp_path / "conversations.parquet").write_bytes(part.read_bytes())
    else:
        df.coalesce(1).write.option("maxRecordsPerFile", 96 // files).parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(conv, f"/tmp/{conv}_0.png") for conv in range(96)]

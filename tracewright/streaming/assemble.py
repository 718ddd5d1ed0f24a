"""Traces out of a stream of hook events.

Every micro-batch settles the events up to the watermark: it runs the batch plan over the new events and over the events of
the open traces they can touch, and writes the traces that closed. A stream gives what a batch over the same events gives,
lost sessions and sub-agents included, splits hot sessions the same way, and survives the loss of any executor.

What goes from batch to batch, all under one commit with the output (``sources/store.py``):

arrived   new events, written once when they come; a part is read until the watermark has passed it
pending   the events of open traces, each written once when it settles, with the trace that owns it
open      one row for each open trace: when it closes if nothing more comes, and the child sessions linked to it
agents    the session last seen for each agent, unless its trace closed since; the one last seen anywhere is a value
sessions  the rolled up sessions, upserted by bucket

A batch reads the small tables ``open`` and ``agents`` whole, but of ``pending`` only the traces of sessions its events name,
of the roots these are linked to, of what lost tool ends may belong to, and of those whose time is up. It writes what is new,
and merges parts in tiers. Other open traces are neither read nor written.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions.scalars import present
from tracewright.operators.admission import quality_metrics
from tracewright.operators.correlation import Memory, correlate, remembered
from tracewright.operators.rollups import actions, rollup_sessions
from tracewright.operators.routing import RESET
from tracewright.operators.scan import cut
from tracewright.operators.spans import build_spans, nest_spans, with_links
from tracewright.operators.traces import (
    ENDED,
    INPUT,
    LAST_SEQ,
    SPAWNING,
    SUBAGENT,
    TOOL_END,
    annotate,
    by_session,
    last_open_moment,
    named,
    timed,
)
from tracewright.options import Options
from tracewright.schemas import HOOK_EVENTS
from tracewright.sources.store import Commit, add_part, commit, last_commit, new_folder, read_parts, tidy, upsert
from tracewright.sources.tables import SESSIONS_NEAR, event_rows, merge_sessions, write_batch

EVENT_COLUMNS = [f.name for f in HOOK_EVENTS.fields]
LONG, TEXT, FLAG = T.LongType(), T.StringType(), T.BooleanType()
ARRIVED = T.StructType([*HOOK_EVENTS.fields, T.StructField("ts_us", LONG), T.StructField("late", FLAG)])
PENDING = T.StructType(
    [
        *HOOK_EVENTS.fields, T.StructField("ts_us", LONG), T.StructField("ghost", FLAG), T.StructField("owner", TEXT),
        T.StructField("owner_seq", LONG),
    ]
)
OPEN = T.StructType(
    [
        T.StructField("session_key", TEXT), T.StructField("start_us", LONG), T.StructField("start_seq", LONG),
        T.StructField("wake_us", LONG), T.StructField("children", T.ArrayType(TEXT)), T.StructField("version", LONG),
        T.StructField("gone", FLAG),
    ]
)
AGENTS = T.StructType(
    [
        T.StructField("agent", TEXT), T.StructField("session", TEXT), T.StructField("ts_us", LONG),
        T.StructField("event_seq", LONG), T.StructField("version", LONG), T.StructField("gone", FLAG),
    ]
)
STATE = ("arrived", "pending", "open", "agents", "sessions")
# So few owners are named in the filter of the scan, where file statistics can use them.
NAMED_OWNERS = 500
BEFORE_ALL = -(1 << 62)


def latest(rows: DataFrame, key: str, keep_gone: bool = False) -> DataFrame:
    """The newest row of each key."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("row"))
    newest = newest.select(key, "row.*").select(*rows.columns)
    return newest if keep_gone else newest.where("not gone")


def keyed(name: str):
    """What a merge of parts keeps of a table with one valid row for each key."""
    return lambda rows, oldest: latest(rows, name, keep_gone=not oldest)


def still_open(horizon_us: int) -> str:
    """A run that ended takes events until its grace is over, which may lie behind the horizon."""
    return f"(closed_by = 'end_of_input' or (closed_by = 'agent_end' and cut_us > {horizon_us}))"


def named_keys(events: DataFrame) -> DataFrame:
    """Every session that an event names, in whatever role."""
    roles = ("session_key", "requester_session_key", "child_session_key", "target_session_key")
    return events.select(F.explode(F.array(*[F.expr(present(c)) for c in roles])).alias("key")).where("key is not null").distinct()


def touched_traces(opened: DataFrame, keys: DataFrame, horizon_us: int) -> DataFrame:
    """Open traces of the keys' sessions, roots that a key's session is linked to, and traces whose time is up."""
    by_child = opened.select("session_key", F.explode("children").alias("key")).join(keys, "key", "left_semi")
    own = opened.join(keys.withColumnRenamed("key", "session_key"), "session_key", "left_semi")
    due = opened.where(F.col("wake_us") <= horizon_us)
    hit = by_child.select("session_key").unionByName(own.select("session_key")).unionByName(due.select("session_key"))
    return opened.join(hit.distinct(), "session_key", "left_semi")


def pending_events(pending: DataFrame, touched: DataFrame) -> DataFrame:
    """The events of the touched traces. One that was kept for what it resets is dropped where it is there as itself."""
    owners = touched.selectExpr("session_key as owner", "start_seq as owner_seq")
    few = owners.limit(NAMED_OWNERS + 1).collect()
    if len(few) <= NAMED_OWNERS:
        pending = pending.where(F.col("owner").isin([r["owner"] for r in few])) if few else pending.limit(0)
    held = pending.join(owners, ["owner", "owner_seq"], "left_semi").drop("owner", "owner_seq")
    first = F.expr("row_number() over (partition by event_seq order by ghost)")
    return held.withColumn("_copy", first).where("_copy = 1").drop("_copy")


def idle_traces(opened: DataFrame, touched: DataFrame) -> DataFrame:
    """The open traces that take no part in a batch, as look-ups read traces."""
    position = "struct<ts_us:bigint,event_seq:bigint>"
    return opened.join(touched, "session_key", "left_anti").selectExpr(
        "session_key", "1L as trace_no", "start_us", "start_seq", f"cast(null as {position}) as next_start",
        "cast(null as bigint) as cut_us", "cast(null as bigint) as close_us", "'end_of_input' as closed_by",
        f"cast(null as {position}) as forgotten",
    )


def open_rows(seen: DataFrame, horizon_us: int, options: Options) -> DataFrame:
    """One row for each trace that is still open, without version."""
    child = f"if(event_name = '{ENDED}', coalesce({present('target_session_key')}, {present('child_session_key')}), " \
        f"{present('child_session_key')})"
    rows = seen.where(f"reached and {still_open(horizon_us)}").groupBy(F.col("host_key").alias("session_key")).agg(
        F.max("start_us").alias("start_us"),
        F.max("start_seq").alias("start_seq"),
        F.max("stale_from_us").alias("idle_us"),
        F.max("cut_us").alias("cut_us"),
        F.collect_set(F.when(named(*SUBAGENT, RESET), F.expr(child))).alias("children"),
    )
    wake = F.coalesce(F.col("cut_us"), last_open_moment(F.col("idle_us"), options) + 1)
    return rows.select("session_key", "start_us", "start_seq", wake.cast("long").alias("wake_us"), "children")


def closings(seen: DataFrame, horizon_us: int) -> DataFrame:
    """The position at which each session's last closed trace closed."""
    position = f"if(closed_by = 'replaced', next_start, struct(cut_us as ts_us, {LAST_SEQ} as event_seq))"
    closed = seen.where(named(INPUT)).where(f"not {still_open(horizon_us)}")
    return closed.groupBy(F.col("host_key").alias("session")).agg(F.max(F.expr(position)).alias("closing"))


def agent_rows(facts: DataFrame, agents: DataFrame, closed: DataFrame) -> DataFrame:
    """What changes in the memory of agents: those seen in this batch, and those whose session closed."""
    newest = facts.where("agent is not null").groupBy("agent").agg(F.max(F.struct("ts_us", "event_seq", "session")).alias("at"))
    newest = newest.select("agent", "at.session", "at.ts_us", "at.event_seq")
    dropped = "coalesce(closing >= struct(ts_us, event_seq), false)"
    changed = newest.join(closed, "session", "left").withColumn("gone", F.expr(dropped))
    older = agents.join(newest, "agent", "left_anti").join(closed, "session").where(dropped)
    columns = ["agent", "session", "ts_us", "event_seq", "gone"]
    return changed.select(*columns).unionByName(older.withColumn("gone", F.lit(True)).select(*columns))


def last_seen(facts: DataFrame, before: dict | None, closed: DataFrame) -> dict | None:
    """The session last seen anywhere, unless its trace closed since."""
    row = facts.agg(F.max(F.struct("ts_us", "event_seq", "session")).alias("at")).first()["at"]
    found = before if row is None else row.asDict()
    if found is None:
        return None
    closing = closed.where(F.col("session") == found["session"]).first()
    dropped = closing is not None and tuple(closing["closing"]) >= (found["ts_us"], found["event_seq"])
    return None if dropped else found


def process_batch(batch: DataFrame, batch_id: int, root: str, delay_ms: int, options: Options) -> None:
    """One micro-batch: settle what the watermark allows, write the tables and the state, then commit all of it."""
    spark = batch.sparkSession
    state = last_commit(spark, root)
    if state is not None and state.number >= batch_id:
        return  # repeated after its commit
    draft = (state or Commit()).next()
    if draft.number != batch_id:
        raise ValueError(f"{root}: batch {draft.number} is due, not {batch_id}; was another checkpoint used?")
    before_us = draft.values.get("horizon_us", BEFORE_ALL)

    # Events behind the watermark came too late: their trace may be written already.
    fresh = timed(batch.select(*EVENT_COLUMNS)).drop("host_key").withColumn("late", F.col("ts_us") <= before_us)
    path = new_folder(root, "arrived")
    counts = Observation(f"batch-{batch_id}-{path[-32:]}")
    fresh.select(*ARRIVED.fieldNames()).observe(counts, *quality_metrics(), F.expr("count_if(late) as late_rows")).write.parquet(path)
    quality = [(name, int(n or 0)) for name, n in counts.get.items()]
    write_batch(spark.createDataFrame(quality, "metric string, events long").coalesce(1), f"{root}/quality", batch_id)
    came = spark.read.schema(ARRIVED).parquet(path)
    write_batch(came.where("late").select(*EVENT_COLUMNS, F.lit("behind_watermark").alias("late_reason")), f"{root}/late", batch_id)
    high = came.where("not late").agg(F.max("ts_us")).first()[0]
    arrived = draft.values.get("arrived", []) + ([[path, high]] if high is not None else [])
    high_us = max(v for v in (high, draft.values.get("high_us"), 0) if v is not None)
    horizon = max(high_us - delay_ms * 1000, before_us)
    known = options.but(as_of_us=horizon)

    parts = [p for p, _ in arrived]
    new = spark.read.schema(ARRIVED).parquet(*parts) if parts else spark.createDataFrame([], ARRIVED)
    new = new.where((F.col("ts_us") > before_us) & (F.col("ts_us") <= horizon) & ~F.col("late")).drop("late")
    new = new.withColumn("ghost", F.lit(False))
    opened = cut(spark, latest(read_parts(spark, draft, "open", OPEN), "session_key"))
    agents = latest(read_parts(spark, draft, "agents", AGENTS), "agent").drop("version", "gone")
    last = draft.values.get("last")

    keys = named_keys(new)
    lost = new.where(named(TOOL_END) & F.expr(f"{present('session_key')} is null"))
    any_lost = bool(lost.take(1))
    if any_lost:
        called = lost.selectExpr(f"{present('agent_id')} as agent").distinct()
        keys = keys.unionByName(agents.join(called, "agent", "left_semi").selectExpr("session as key"))
        keys = keys.unionByName(spark.createDataFrame([(last["session"],)] if last else [], "key string")).distinct()
    touched = cut(spark, touched_traces(opened, keys, horizon))
    while True:
        held = pending_events(read_parts(spark, draft, "pending", PENDING), touched)
        events = cut(spark, new.unionByName(held))
        memory = None
        if any_lost:
            seen_last = [(last["session"], last["ts_us"], last["event_seq"])] if last else []
            memory = Memory(
                before_us,
                agents,
                spark.createDataFrame(seen_last, "session string, ts_us long, event_seq long").withColumn("agent", F.lit(None).cast("string")),
                idle_traces(opened, touched),
            )
        routed = correlate(events, known, memory=memory)
        if not any_lost:
            break
        # A lost end may belong to a session that nothing else named: its traces are read too, then.
        found = routed.where(named(TOOL_END) & (F.col("ts_us") > before_us)).selectExpr("session_key as key").where("key is not null")
        keys = keys.unionByName(found).distinct()
        wider = cut(spark, touched_traces(opened, keys, horizon))
        if wider.count() == touched.count():
            break
        touched = wider

    # Both are stored with all columns.
    seen = cut(spark, by_session(with_links(routed), known, partial(annotate, whole=True)))
    is_open = still_open(horizon)
    # Stored before nesting, which reads them three times.
    spans = nest_spans(cut(spark, by_session(seen.where(f"not {is_open}"), known, partial(build_spans, whole=True))))
    write_batch(event_rows(spans, options), f"{root}/events", batch_id)
    write_batch(actions(spans), f"{root}/actions", batch_id)
    upsert(cut(spark, rollup_sessions(spans)), draft, root, "sessions", "session_id", merge_sessions, near=SESSIONS_NEAR)

    # The state after this batch.
    opens = cut(spark, open_rows(seen, horizon, options))
    gone = touched.join(opens, "session_key", "left_anti").drop("version").withColumn("gone", F.lit(True))
    changed = opens.withColumn("gone", F.lit(False)).unionByName(gone).withColumn("version", F.lit(batch_id).cast("long"))
    add_part(changed.select(*OPEN.fieldNames()), draft, root, "open", keyed("session_key"), "session_key")

    reset = F.col("event_name") == RESET
    names = [F.when(reset, SPAWNING).otherwise(F.col(c)).alias(c) if c == "event_name" else F.col(c) for c in EVENT_COLUMNS]
    kept = seen.where(f"reached and {is_open}").where(F.col("ts_us") > before_us)
    kept = kept.select(*names, "ts_us", reset.alias("ghost"), F.col("host_key").alias("owner"), F.col("start_seq").alias("owner_seq"))

    def live(rows: DataFrame, oldest: bool) -> DataFrame:
        owners = latest(read_parts(spark, draft, "open", OPEN), "session_key")
        return rows.join(owners.selectExpr("session_key as owner", "start_seq as owner_seq"), ["owner", "owner_seq"], "left_semi").select(*rows.columns)

    add_part(kept, draft, root, "pending", live, "owner")

    fresh_rows = seen.where(F.col("ts_us") > before_us)
    facts = remembered(fresh_rows, None, present("session_key")).drop("seen")
    everywhere = facts.unionByName(
        fresh_rows.where(named(*SUBAGENT) & F.col("link_seq").isNotNull()).selectExpr(
            "ts_us", "event_seq", "cast(null as string) as agent", "host_key as session"
        )
    )
    closed = cut(spark, closings(seen, horizon))
    changed = agent_rows(facts, agents, closed).withColumn("version", F.lit(batch_id).cast("long"))
    add_part(changed.select(*AGENTS.fieldNames()), draft, root, "agents", keyed("agent"), "agent")

    waiting = [[p, until] for p, until in arrived if until > horizon]
    draft.dropped.extend(p for p, until in arrived if until <= horizon)
    if high is None:
        draft.dropped.append(path)
    draft.values = {"horizon_us": horizon, "high_us": high_us, "last": last_seen(everywhere, last, closed), "arrived": waiting}
    commit(spark, root, draft)


def assemble_traces(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    options: Options,
    delay: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Write closed traces into ``root``/events, /actions and /sessions; idempotent by batch. Read them with
    ``read_batches`` and ``read_sessions``, which see whole batches only. /quality holds the counts of each batch, observed
    while its events were stored.

    ``delay`` is how late an event may come; events later than that, or with the time of the horizon itself, go to
    /late with a reason. ``root`` and ``checkpoint`` must be shared folders, used by one stream at a time.
    """
    delay_ms = parse_delay(delay)
    tidy(stream.sparkSession, root, STATE)

    def handle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, delay_ms, options)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def parse_delay(text: str) -> int:
    """``"10 minutes"`` and the like in milliseconds."""
    match = re.fullmatch(r"\s*(\d+)\s*(millisecond|second|minute|hour|day)s?\s*", text)
    if not match:
        raise ValueError(f"not a delay: {text!r}")
    unit = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(match.group(1)) * unit[match.group(2)]

"""Tool ends that lost their session, and the whole correlation of a batch.

A tool end without a session goes to the session last seen for its agent while that session's trace is
open; else to the only open trace; else to the session last active anywhere, while its trace is open.
"Last seen" counts tool ends resolved before, so the answer is found by repetition like the links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import present
from tracewright.operators.routing import resolve_lifecycles, route, trace_facts
from tracewright.operators.scan import PLAIN, Scan, Split, as_of, cut, global_split, running, split_for
from tracewright.operators.traces import (
    AGENT_END,
    INPUT,
    LAST_SEQ,
    ORDER,
    OUTPUT,
    SUBAGENT,
    TOOL_END,
    TOOL_START,
    annotate,
    at_end,
    first_delivery,
    named,
    timed,
    trace_table,
)
from tracewright.options import Options

SEEN = "struct<session:string,ts_us:bigint,event_seq:bigint>"


@dataclass(frozen=True)
class Memory:
    """What is known of the events before the ones at hand, where these continue an earlier part of the input.

    ``until_us``: events up to there were handled before; those still at hand are there for their traces only.
    ``agents``: (agent, session, ts_us, event_seq), the session last seen for each agent, unless dropped since.
    ``last``: the same, at most one row, of the session last seen anywhere.
    ``others``: traces (as ``trace_table`` has them) that are open throughout and have no event at hand.
    """

    until_us: int
    agents: DataFrame
    last: DataFrame
    others: DataFrame


def remembered(events: DataFrame, lifecycles: DataFrame | None, session: str = "host_key") -> DataFrame:
    """Every event that makes its session the last seen one, for its agent and overall."""
    direct = events.where(named(INPUT, OUTPUT, TOOL_START, TOOL_END, AGENT_END) & F.expr(f"{session} is not null"))
    rows = direct.selectExpr(*ORDER, f"{present('agent_id')} as agent", f"{session} as session")
    if lifecycles is not None:
        runs = lifecycles.where("link_seq is not null and root is not null")
        rows = rows.unionByName(runs.selectExpr(*ORDER, "cast(null as string) as agent", "root as session"))
    return rows.withColumn("seen", F.expr("struct(session, ts_us, event_seq)"))


def open_changes(traces: DataFrame) -> DataFrame:
    """+1 where a trace opens and -1 where it closes, with a number that tells which."""
    opens = traces.selectExpr("start_us as ts_us", "start_seq as event_seq", "1 as change", "start_seq as which")
    closes = traces.where("closed_by <> 'end_of_input'").selectExpr(
        "if(closed_by = 'replaced', next_start.ts_us, cut_us) as ts_us",
        f"if(closed_by = 'replaced', next_start.event_seq, {LAST_SEQ}) as event_seq",
        "-1 as change",
        "-start_seq as which",
    )
    return opens.unionByName(closes)


def resolve_missing(
    events: DataFrame,
    traces: DataFrame,
    lifecycles: DataFrame | None,
    options: Options,
    split: Split = PLAIN,
    memory: Memory | None = None,
) -> DataFrame:
    """Tool ends without a session: ``event_seq``, the ``resolved`` session or null, and the ``fallback`` used."""
    spark = events.sparkSession
    lost = events.where(named(TOOL_END) & F.col("host_key").isNull()).selectExpr(
        *ORDER, f"{present('agent_id')} as agent"
    )
    seen = remembered(events, lifecycles)
    by_agent = seen.where("agent is not null")
    if memory is not None:
        as_seen = F.expr("struct(session, ts_us, event_seq)")
        seen = seen.where(F.col("ts_us") > memory.until_us)
        by_agent = seen.where("agent is not null").unionByName(memory.agents.withColumn("seen", as_seen))
        seen = seen.unionByName(memory.last.withColumn("seen", as_seen))
        traces = traces.unionByName(memory.others)

    # Once, over everything: the last known session of the agent and overall, and the traces open then.
    with_agent = as_of(
        lost.where("agent is not null"), by_agent, "agent", ORDER, "seen", "known_agent", split
    )
    lost_marked = lost.where("agent is null").withColumn("known_agent", F.lit(None).cast(SEEN)).unionByName(with_agent)
    timeline = (
        lost_marked.withColumn("_probe", F.lit(True))
        .unionByName(seen.select(*ORDER, "seen"), allowMissingColumns=True)
        .unionByName(open_changes(traces), allowMissingColumns=True)
    )
    everywhere = global_split(timeline, options.max_group_rows)
    placed = running(
        timeline,
        [],
        ORDER,
        [
            Scan("known_last", "last", F.col("seen"), "before"),
            Scan("open_count", "sum", F.col("change"), "before"),
            Scan("open_which", "sum", F.col("which").cast("decimal(38,0)"), "before"),
        ],
        everywhere,
    ).where("_probe")
    single = traces.selectExpr("cast(start_seq as decimal(38,0)) as _which", "session_key as single")
    state = (
        placed.join(
            single, (F.col("open_count") == 1) & (F.col("open_which") == F.col("_which")), "left"
        )
        .select(*ORDER, "agent", "known_agent", "known_last", "single")
        .withColumns({"resolved": F.lit(None).cast("string"), "fallback": F.lit(None).cast("string")})
    )
    state = cut(spark, state)
    facts = trace_facts(traces).join(
        traces.selectExpr("start_seq as _start", "forgotten"), F.col("event_seq") == F.col("_start")
    )
    facts = facts.selectExpr("key", *ORDER, "struct(open_trace, forgotten) as home")
    facts = cut(spark, facts)

    while True:
        # Ends resolved in the round before count as seen, too.
        mine = state.where("resolved is not null").withColumn(
            "seen", F.expr("struct(resolved as session, ts_us, event_seq)")
        )
        own = [c for c in state.columns]
        by_agent = as_of(
            state.where("agent is not null"), mine.where("agent is not null"), "agent", ORDER, "seen", "_a", split
        )
        rows = by_agent.unionByName(state.where("agent is null"), allowMissingColumns=True)
        rows = running(
            rows.withColumn("_seen", F.expr("if(resolved is null, null, struct(resolved as session, ts_us, event_seq))")),
            [],
            ORDER,
            [Scan("_c", "last", F.col("_seen"), "before")],
            everywhere,
        )
        later = "case when {0} is null then {1} when {1} is null then {0} " \
            "when struct({0}.ts_us, {0}.event_seq) > struct({1}.ts_us, {1}.event_seq) then {0} else {1} end"
        rows = cut(
            spark,
            rows.selectExpr(
                *own, f"{later.format('known_agent', '_a')} as by_agent", f"{later.format('known_last', '_c')} as by_last"
            ),
        )
        probes = rows.selectExpr(
            *ORDER, "stack(2, 'a', by_agent.session, 'c', by_last.session) as (role, key)"
        ).where("key is not null")
        homes = (
            as_of(probes, facts, "key", ORDER, "home", "home_found", split)
            .groupBy(F.col("event_seq").alias("_seq"))
            .agg(*[F.max(F.when(F.col("role") == r, F.col("home_found"))).alias(f"home_{r}") for r in ("a", "c")])
        )

        def valid(home: str, candidate: str) -> str:
            """The candidate's trace is open and nothing dropped the session since it was seen."""
            trace = f"{home}.open_trace"
            return (
                f"({home} is not null and ({trace}.cut_us is null or ts_us <= {trace}.cut_us) and "
                f"({home}.forgotten is null or "
                f"struct({candidate}.ts_us, {candidate}.event_seq) > {home}.forgotten))"
            )

        agent_ok, last_ok = valid("home_a", "by_agent"), valid("home_c", "by_last")
        renewed = rows.join(homes, F.col("event_seq") == F.col("_seq"), "left").selectExpr(
            *[c for c in own if c not in ("resolved", "fallback")],
            "resolved as _old",
            f"case when {agent_ok} then by_agent.session when single is not null then single "
            f"when {last_ok} then by_last.session end as resolved",
            f"case when {agent_ok} then 'agentId' when single is not null then 'single active trace' "
            f"when {last_ok} then 'last active session' end as fallback",
        )
        renewed = cut(spark, renewed)
        moved = renewed.where("not (_old <=> resolved)").take(1)
        state = renewed.drop("_old")
        if not moved:
            return state.select("event_seq", "resolved", "fallback")


def memory_spans(events: DataFrame, traces: DataFrame, split: Split = PLAIN) -> DataFrame:
    """Each event that makes its session the last seen one of its agent, until the agent's next event, and
    whether the session was dropped from memory in between because its trace closed."""
    seen = remembered(events, None).where("agent is not null").drop("seen")
    lasting = running(seen, ["agent"], ORDER, [Scan("until", "last", F.struct(*ORDER), "after")], split)
    lasting = lasting.where("until is not null").selectExpr(
        "agent", "session as key", "ts_us as seen_us", "event_seq as seen_seq", "until.ts_us", "until.event_seq"
    )
    facts = traces.selectExpr(
        "session_key as key",
        "start_us as ts_us",
        "start_seq as event_seq",
        f"struct(forgotten, if(cut_us is null, null, struct(cut_us as ts_us, {LAST_SEQ} as event_seq)) as closing) "
        "as home",
    )
    found = as_of(lasting, facts, "key", ORDER, "home", "home_found", split)
    closed = "home_found.closing < struct(ts_us, event_seq)"
    dropped = f"if({closed}, home_found.closing, home_found.forgotten) >= struct(seen_us as ts_us, seen_seq as event_seq)"
    return found.selectExpr(
        "agent",
        "key as session",
        "seen_seq as event_seq",
        "event_seq as until_seq",
        f"coalesce({dropped}, false) as dropped",
    )


def correlation_split(events: DataFrame, options: Options) -> Split:
    """The split that fits every key events are looked up by."""
    keys = ["host_key", "agent_id", "requester_session_key", "child_session_key", "target_session_key"]
    return split_for(timed(events), keys, options.max_group_rows)


def correlate(
    events: DataFrame, options: Options = Options(), find_missing: bool = True, memory: Memory | None = None
) -> DataFrame:
    """Events with the session whose trace they belong to: lost sessions resolved, child sessions routed.

    With a stale timeout, routed events keep their host trace alive and the host's closing ends routes, so
    traces and routes are found in turn until no trace changes.
    """
    events = timed(events)
    options = at_end(events, options)
    spark = events.sparkSession
    subagents = bool(events.where(named(*SUBAGENT)).take(1))
    lost = find_missing and bool(events.where(named(TOOL_END) & F.col("host_key").isNull()).take(1))
    if not subagents and not lost:
        return events
    # Rows are joined by their number below. Repeats are looked for by the numbers alone and dropped only if there are any.
    if events.groupBy("event_seq").count().where("count > 1").limit(1).count():
        events = first_delivery(events)
    split = correlation_split(events, options)
    # The first round lets no trace go stale: links then reach as far as they can, and a few rounds cut them
    # back. Starting from stale traces would lengthen them by one event per round.
    current, known, lifecycles, rules = events, None, None, options.but(stale_timeout_ms=None)
    while True:
        traces = cut(spark, trace_table(annotate(current, rules, split), split))
        if known is not None and not traces.exceptAll(known).take(1):
            return current
        lifecycles = resolve_lifecycles(events, traces, split, lifecycles) if subagents else None
        current = events
        if lost:
            found = resolve_missing(events, traces, lifecycles, options, split, memory)
            current = apply_resolved(events, found)
        if subagents:
            current = route(current, lifecycles, split)
        if options.stale_timeout_ms is None:
            return current
        known, rules = traces, options


def apply_resolved(events: DataFrame, found: DataFrame) -> DataFrame:
    """Give the resolved tool ends their session."""
    lost = named(TOOL_END) & F.col("host_key").isNull()
    keyed = found.selectExpr("event_seq as _seq", "resolved")
    resolved = events.where(lost).join(keyed, F.col("event_seq") == F.col("_seq"), "left")
    resolved = resolved.withColumns({"session_key": F.col("resolved"), "host_key": F.col("resolved")})
    return events.where(~lost).unionByName(cut(events.sparkSession, resolved.select(*events.columns)))

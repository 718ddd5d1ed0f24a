"""Which root trace the events of a child session belong to, and sub-agent life cycles.

A sub-agent run links its child session to the root trace of the session that asked for it. While the link
lives, the child's tool calls and its own sub-agents go to that root trace, under the run's span. A link
dies when the run ends or is spawned again, or when the root trace closes.

Whether a link can be made depends on earlier links, so links are found by repetition: each round looks
every key up in the links of the round before. A round fixes everything that depends only on what earlier
rounds fixed, and the rounds end when nothing moves, so the result is exact. Between rounds, spawns that wait for
one another in a chain take the root trace at the chain's head by pointer jumping, so that a chain of n spawns
takes about log2(n) small joins and two rounds, not n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import present
from tracewright.operators.scan import BROADCAST_KEYS, PLAIN, Split, as_of, cut
from tracewright.operators.traces import ENDED, ORDER, SPAWNING, SUBAGENT, TOOL_END, TOOL_START, named

RESET = "subagent_reset"
LINK = "struct<root:string,root_seq:bigint,next_start:struct<ts_us:bigint,event_seq:bigint>,cut_us:bigint,link_seq:bigint>"


def trace_facts(traces: DataFrame) -> DataFrame:
    return traces.selectExpr(
        "session_key as key",
        "start_us as ts_us",
        "start_seq as event_seq",
        "struct(session_key as root, start_seq as root_seq, next_start, cut_us, cast(null as bigint) as link_seq) "
        "as open_trace",
    )


def _look_up(probes: DataFrame, facts: DataFrame, value: str, roles: list[str], split: Split) -> DataFrame:
    """The last fact before each event for the key of each role: one row per event, one column per role."""
    found = as_of(probes, facts, "key", ORDER, value, "found", split)
    return found.groupBy(F.col("event_seq").alias("_seq")).agg(
        *[F.max(F.when(F.col("role") == role, F.col("found"))).alias(f"found_{role}") for role in roles]
    )


def _probes(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    pairs = ", ".join(f"'{role}', {key}" for role, key in roles.items())
    return rows.selectExpr(*ORDER, f"stack({len(roles)}, {pairs}) as (role, key)").where("key is not null")


def _alive(link: str) -> str:
    """A link or trace that is still open at the event's position."""
    return (
        f"({link} is not null and {link}.root is not null and ({link}.cut_us is null or ts_us <= {link}.cut_us) "
        f"and ({link}.next_start is null or struct(ts_us, event_seq) < {link}.next_start))"
    )


def lifecycle_keys(events: DataFrame) -> DataFrame:
    """Sub-agent events with the sessions they name; ``life_key`` is the session whose run they are about."""
    child = present("child_session_key")
    target = f"if(event_name = '{ENDED}', coalesce({present('target_session_key')}, {child}), null)"
    # A ghost is a spawn that is read for what it resets alone: its run is in another trace, which is not here.
    ghost = "coalesce(ghost, false)" if "ghost" in events.columns else "false"
    return events.where(named(*SUBAGENT)).selectExpr(
        "*",
        f"{present('requester_session_key')} as requester_key",
        f"{child} as child_key",
        f"{target} as target_key",
        f"if(event_name = '{ENDED}', {target}, {child}) as life_key",
        f"((event_name = '{ENDED}' or {child} is not null) and not {ghost}) as usable",
    )


def resolve_lifecycles(
    events: DataFrame, traces: DataFrame, split: Split = PLAIN, start: DataFrame | None = None
) -> DataFrame:
    """Every sub-agent event with the run it belongs to (``link_seq``, the event that created the run), the
    root session it is routed to, the enclosing run, and the run it resets.

    ``start`` is an earlier answer for slightly different traces; beginning there saves rounds.
    """
    spark = events.sparkSession
    keyed = lifecycle_keys(events)
    own = _look_up(
        _probes(keyed, {"r": "requester_key", "c": "child_key", "t": "target_key"}),
        trace_facts(traces),
        "open_trace",
        ["r", "c", "t"],
        split,
    )
    names = [c for c in keyed.columns]
    static = keyed.join(own, F.col("event_seq") == F.col("_seq"), "left").selectExpr(
        *names,
        "coalesce("
        + ", ".join(f"if({_alive(f'found_{role}')}, found_{role}, null)" for role in ("r", "c", "t"))
        + ") as own",
    )
    # First round: no links yet, so every event that finds an open trace makes one.
    state = static.selectExpr(
        "*",
        "usable and own is not null as creates",
        "own.root as root",
        "own.root_seq as root_seq",
        "own.next_start as root_next",
        "own.cut_us as root_cut",
        "cast(null as bigint) as parent_seq",
        "event_seq as link_seq",
        f"cast(null as {LINK}) as resets",
    )
    if start is not None:
        earlier = start.selectExpr("event_seq as _seq", *STATE)
        state = state.drop(*STATE).join(earlier, F.col("event_seq") == F.col("_seq")).drop("_seq")
    state = cut(spark, state)
    while True:
        spawn, end = f"event_name = '{SPAWNING}'", f"event_name = '{ENDED}'"
        facts = state.where(f"life_key is not null and ({end} or {spawn} or creates)").selectExpr(
            "life_key as key",
            *ORDER,
            # An end, or a spawn without a home, leaves the key without a link.
            f"struct(if(creates and not {end}, struct(root, root_seq, root_next as next_start, root_cut as cut_us, "
            f"event_seq as link_seq), cast(struct(null, null, null, null, null) as {LINK})) as link, "
            f"if(usable and {spawn} and not creates, event_seq, null) as homeless) as fact",
        )
        hosts = _look_up(
            _probes(state, {"r": "requester_key", "c": "life_key"}), facts, "fact", ["r", "c"], split
        )
        host, current = "found_r.link", "found_c.link"
        # A spawn drops the child's old link first, so a session that spawns itself is not nested in it.
        itself = f"({spawn} and requester_key <=> child_key)"
        nested = f"({_alive(host)} and not {itself})"
        attached = f"({_alive(current)} and not {spawn})"
        container = f"if({nested}, {host}, own)"
        joined = state.join(hosts, F.col("event_seq") == F.col("_seq"), "left")
        home = f"if({attached}, {current}, {container})"
        renewed = joined.selectExpr(
            *[c for c in state.columns if c not in STATE and c != "resets"],
            *[f"{c} as old_{c}" for c in STATE],
            f"usable and not {attached} and {container} is not null as creates",
            *[
                f"if(usable, {home}.{source}, null) as {name}"
                for name, source in (
                    ("root", "root"), ("root_seq", "root_seq"), ("root_next", "next_start"), ("root_cut", "cut_us"),
                )
            ],
            f"if(usable and not {attached} and {nested}, {host}.link_seq, null) as parent_seq",
            f"if({attached}, {current}.link_seq, if(usable and {container} is not null, event_seq, null)) as link_seq",
            f"if({spawn} and {_alive(current)}, {current}, null) as resets",
            f"if(usable and {spawn} and own is null and not {itself}, found_r.homeless, null) as waits_for",
        )
        renewed = cut(spark, renewed)
        differs = " or ".join(f"not (old_{c} <=> {c})" for c in STATE)
        moved = renewed.where(differs).take(1)
        state = renewed.drop(*[f"old_{c}" for c in STATE])
        if not moved:
            return state.drop("waits_for")
        state = follow_chains(state)


def follow_chains(state: DataFrame) -> DataFrame:
    """Spawns that wait for a spawn without a home take the home at the head of their chain, if it is still open for them.

    A trace that is open for an event is open for all events before it, so the spawns between need no look of their own.
    What a round has settled is not touched: a settled spawn waits for settled ones only, and none of these has a home.
    """
    spark = state.sparkSession
    of_head = [c for c in STATE if c not in ("parent_seq", "link_seq")]
    heads = state.where("creates").select(F.col("event_seq").alias("_head"), *[F.col(c).alias(f"_{c}") for c in of_head])
    waiting = state.where("waits_for is not null and not creates").selectExpr(*ORDER, "waits_for as at")
    started = waiting.join(heads, F.col("at") == F.col("_head"), "left_semi")
    if not started.take(1):
        return state.drop("waits_for")
    chain = cut(spark, waiting)
    while True:
        onward = chain.selectExpr("event_seq as _at", "at as _next")
        further = chain.join(onward, F.col("at") == F.col("_at"), "left")
        further = cut(spark, further.selectExpr(*ORDER, "coalesce(_next, at) as at", "_next is not null as jumped"))
        chain = further.drop("jumped")
        if not further.where("jumped").take(1):
            break
    link = "struct(_root as root, _root_next as next_start, _root_cut as cut_us)"
    found = chain.join(heads, F.col("at") == F.col("_head")).where(_alive(link))
    found = found.select(F.col("event_seq").alias("_seq"), *[f"_{c}" for c in of_head])
    taken = {c: f"if(_seq is null, {c}, _{c})" for c in of_head}
    taken |= {"parent_seq": "if(_seq is null, parent_seq, waits_for)", "link_seq": "coalesce(_seq, link_seq)"}
    joined = state.join(found, F.col("event_seq") == F.col("_seq"), "left")
    kept = [c for c in state.columns if c != "waits_for"]
    return cut(spark, joined.selectExpr(*[f"{taken[c]} as {c}" if c in taken else c for c in kept]))


STATE = ["creates", "root", "root_seq", "root_next", "root_cut", "parent_seq", "link_seq"]


def links(lifecycles: DataFrame) -> DataFrame:
    """What each child session is linked to, from which event on."""
    return lifecycles.where(
        f"life_key is not null and (event_name in ('{ENDED}', '{SPAWNING}') or creates)"
    ).selectExpr(
        "life_key as key",
        *ORDER,
        f"if(creates and event_name <> '{ENDED}', struct(root, root_seq, root_next as next_start, "
        f"root_cut as cut_us, event_seq as link_seq), cast(struct(null, null, null, null, null) as {LINK})) as link",
    )


def route_tools(tools: DataFrame, lifecycles: DataFrame, split: Split = PLAIN) -> DataFrame:
    """Tool events with their host session and enclosing run.

    Only sessions that are ever a child need a look-up, and only their rows are stored; the others stay where
    they are.
    """
    facts = links(lifecycles)
    children = cut(tools.sparkSession, facts.select(F.col("key").alias("session_key")).distinct())
    if children.count() <= BROADCAST_KEYS:
        children = F.broadcast(children)
    plain = tools.join(children, "session_key", "left_anti")
    probes = tools.join(children, "session_key", "left_semi").withColumn("key", F.col("session_key"))
    found = as_of(probes, facts, "key", ORDER, "link", "found", split)
    alive = _alive("found")
    routed = found.selectExpr(
        *[c for c in tools.columns if c not in ("host_key", "parent_seq")],
        f"if({alive}, found.root, host_key) as host_key",
        f"if({alive}, found.link_seq, null) as parent_seq",
    )
    return plain.withColumn("parent_seq", F.lit(None).cast("long")).unionByName(cut(tools.sparkSession, routed))


def route(events: DataFrame, lifecycles: DataFrame, split: Split = PLAIN) -> DataFrame:
    """All events with ``host_key``, ``parent_seq`` and ``link_seq``; a re-spawn adds a reset of the old run.

    ``lifecycles`` must be stored already, as ``resolve_lifecycles`` returns it.
    """
    columns = events.columns
    tools = named(TOOL_START, TOOL_END)
    none = F.lit(None).cast("long")
    others = events.where(~tools & ~named(*SUBAGENT)).withColumns({"parent_seq": none, "link_seq": none})
    routed_tools = route_tools(events.where(tools), lifecycles, split).withColumn("link_seq", none)
    kept = [c for c in columns if c != "host_key"]
    subagents = lifecycles.selectExpr(
        *kept, "if(link_seq is null, null, root) as host_key", "parent_seq", "link_seq"
    )
    resets = lifecycles.where("resets is not null").selectExpr(
        *[f"'{RESET}' as event_name" if c == "event_name" else c for c in kept],
        "resets.root as host_key",
        "cast(null as bigint) as parent_seq",
        "resets.link_seq as link_seq",
    )
    return others.unionByName(routed_tools).unionByName(subagents).unionByName(resets)

"""Which trace an event belongs to, when that trace closes, and which events it still accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.scan import PLAIN, Scan, Split, beside, by_heat, cut, measure, packed, running
from tracewright.options import Options

INPUT, OUTPUT, TOOL_START, TOOL_END = "llm_input", "llm_output", "before_tool_call", "after_tool_call"
AGENT_END, USAGE = "agent_end", "model.usage"
SPAWNING, SPAWNED = "subagent_spawning", "subagent_spawned"
DELIVERY, ENDED = "subagent_delivery_target", "subagent_ended"
SUBAGENT = (SPAWNING, SPAWNED, DELIVERY, ENDED)

ORDER = ["ts_us", "event_seq"]
# Names an event: routing adds resets that share the number of the event that caused them.
ROW = ["event_seq", "event_name"]
# Stands behind every event of its microsecond.
LAST_SEQ = 9_223_372_036_854_775_807
TRACE = ["host_key", "trace_no"]


def named(*names: str) -> Column:
    return F.col("event_name").isin(*names)


def timed(events: DataFrame) -> DataFrame:
    """Events with their time in microseconds and the session whose trace they belong to."""
    columns = {}
    if "ts_us" not in events.columns:
        columns["ts_us"] = F.unix_micros(F.col("ts").cast("timestamp"))
    if "host_key" not in events.columns:
        columns["host_key"] = F.nullif(F.col("session_key"), F.lit(""))
    return events.withColumns(columns) if columns else events


def number_traces(events: DataFrame, split: Split = PLAIN) -> DataFrame:
    """Each model input opens the next trace of its session; ``trace_no`` 0 is before the first one."""
    opens = named(INPUT)
    return running(
        events,
        ["host_key"],
        ORDER,
        [
            Scan("trace_no", "sum", F.when(opens, F.lit(1)).otherwise(F.lit(0))),
            Scan("next_start", "last", F.when(opens, F.struct(*ORDER)), "after"),
        ],
        split,
    ).withColumn("next_start_us", F.col("next_start.ts_us"))


def last_open_moment(activity_us: Column, options: Options) -> Column:
    """The last microsecond at which a trace idle since ``activity_us`` is still open."""
    if options.stale_timeout_ms is None:
        return F.lit(None).cast("long")
    limit = activity_us + F.lit(options.stale_timeout_ms * 1000)
    if options.sweep_ms is None:
        return limit
    sweep = options.sweep_ms * 1000
    return (F.floor(limit / F.lit(sweep)).cast("long") + 1) * F.lit(sweep) - 1


def bound_traces(numbered: DataFrame, options: Options, split: Split = PLAIN) -> DataFrame:
    """Add the trace's bounds and close reason, and whether the event still reached the open trace.

    A trace closes by the first of: a run end (plus grace), too long without activity, a new model input
    in its session, the end of the data. ``options.as_of_us`` must be set: time passes for idle traces
    until there, whichever sessions the later events are in.
    """
    ts = F.col("ts_us")
    other = named(INPUT, TOOL_START, TOOL_END, *SUBAGENT)
    output, end = named(OUTPUT), named(AGENT_END)
    inside = running(
        numbered,
        TRACE,
        ORDER,
        [
            Scan("_prev_other", "max", F.when(other, ts), "before"),
            # Only the first output of a trace is activity: the earliest one seen so far.
            Scan("_first_out", "min", F.when(output, ts), "before"),
            Scan("out_no", "sum", F.when(output, F.lit(1)).otherwise(F.lit(0))),
            Scan("phase", "sum", F.when(end, F.lit(1)).otherwise(F.lit(0)), "before"),
        ],
        split,
    )
    inside = inside.withColumn("_idle_from", F.greatest("_prev_other", "_first_out"))
    inside = inside.withColumn("_limit", last_open_moment(F.col("_idle_from"), options))
    gap = ts > F.col("_limit")
    whole = running(
        inside,
        TRACE,
        ORDER,
        [
            Scan("start_us", "min", F.when(named(INPUT), ts), "all"),
            Scan("start_seq", "min", F.when(named(INPUT), F.col("event_seq")), "all"),
            Scan("first_end_us", "min", F.when(end, ts), "all"),
            Scan("_gap_us", "min", F.when(gap, F.col("_limit")), "all"),
            Scan("_gap_from", "min", F.when(gap, F.col("_idle_from")), "all"),
            Scan("_last_other", "max", F.when(other, ts), "all"),
            Scan("_only_out", "min", F.when(output, ts), "all"),
        ],
        split,
    )
    as_of = F.lit(options.as_of_us)
    tail = last_open_moment(F.greatest("_last_other", "_only_out"), options)
    horizon = F.coalesce(F.col("next_start_us"), as_of)
    stale = F.coalesce(F.col("_gap_us"), F.when(horizon > tail, tail))
    ended = F.col("first_end_us").isNotNull() & (stale.isNull() | (F.col("first_end_us") <= stale))
    end_cut = F.col("first_end_us") + F.lit(options.grace_ms * 1000)
    sweep_step = 0 if options.sweep_ms is None else 1
    replaced = F.col("next_start_us").isNotNull()
    bounded = whole.select(
        "*",
        F.when(ended, end_cut).otherwise(stale).alias("cut_us"),
        F.when(ended & (F.col("next_start_us") <= end_cut), F.lit("replaced"))
        .when(ended, F.lit("agent_end"))
        .when(stale.isNotNull(), F.lit("stale"))
        .when(replaced, F.lit("replaced"))
        .otherwise(F.lit("end_of_input"))
        .alias("closed_by"),
        ended.alias("run_ended"),
        F.coalesce("_gap_from", F.greatest("_last_other", "_only_out")).alias("stale_from_us"),
    )
    close = (
        F.when(F.col("closed_by") == "replaced", F.col("next_start_us"))
        .when(F.col("closed_by") == "agent_end", F.col("cut_us"))
        .when(F.col("closed_by") == "stale", F.col("cut_us") + sweep_step)
        .otherwise(as_of)
    )
    in_trace = F.col("trace_no") > 0
    reached = in_trace & (F.col("cut_us").isNull() | (ts <= F.col("cut_us")))
    reason = (
        F.when(~in_trace, F.lit("before_first_trace"))
        .when(reached, F.lit(None))
        .when(F.col("run_ended"), F.lit("after_agent_end"))
        .otherwise(F.lit("after_stale"))
    )
    return bounded.select(
        *[c for c in bounded.columns if not c.startswith("_")],
        close.alias("close_us"),
        reached.alias("reached"),
        reason.alias("late_reason"),
    )


def at_end(events: DataFrame, options: Options) -> Options:
    """Options with the moment the input ends: where not given, the time of its last event."""
    if options.as_of_us is not None:
        return options
    return options.but(as_of_us=timed(events).agg(F.max("ts_us")).first()[0] or 0)


def annotate(events: DataFrame, options: Options = Options(), split: Split = PLAIN, whole: bool = False) -> DataFrame:
    """Events that have a session, with their trace number, its bounds and whether they reached it. ``whole``: every column of
    the events is wanted, so the windows carry those they do not read as one."""
    options = at_end(events, options)
    keyed = timed(events).where(F.col("host_key").isNotNull())

    def bound(part: DataFrame) -> DataFrame:
        return bound_traces(number_traces(part, split), options, split)

    if not split.active:
        return packed(keyed, [*ROW, "ts_us", "host_key"], bound) if whole else bound(keyed)
    return beside(keyed, ROW, ["ts_us", "host_key"], bound)


def first_delivery(events: DataFrame) -> DataFrame:
    """Each event once, as it was delivered first. Its number and name tell an event."""
    order = F.expr("row_number() over (partition by event_seq, event_name order by ts_us)")
    return events.withColumn("_delivery", order).where("_delivery = 1").drop("_delivery")


def by_session(events: DataFrame, options: Options, plan) -> DataFrame:
    """Run ``plan(events, options, split)`` with the end of the input known and hot sessions split by time.

    Events that were delivered again, at whatever time, count once; they are looked for first, by number and name alone.
    """
    events = timed(events)
    largest, last, repeated = measure(events, "host_key", "ts_us", ROW)
    if repeated:
        events = first_delivery(events)
        largest, last, _ = measure(events, "host_key", "ts_us", ROW)
    if options.as_of_us is None:
        options = options.but(as_of_us=last or 0)
    return by_heat(
        events,
        "host_key",
        largest,
        options.max_group_rows,
        lambda part, split: plan(part, options, split),
    )


def annotate_by_heat(events: DataFrame, options: Options = Options()) -> DataFrame:
    """``annotate`` with hot sessions split by time."""
    return by_session(events, options, annotate)


def gap_sessions(events: DataFrame, gap_ms: int, options: Options = Options()) -> DataFrame:
    """Runs of events without a gap longer than ``gap_ms``; a gap of exactly that length does not split.

    Not ``session_window``: that merges all rows of a key in one task.
    """

    def plan(part: DataFrame, known: Options, split: Split) -> DataFrame:
        part = part.where(F.col("host_key").isNotNull()).select("host_key", *ORDER)
        gaps = running(part, ["host_key"], ORDER, [Scan("_before", "max", F.col("ts_us"), "before")], split)
        fresh = F.expr(f"if(_before is null or ts_us - _before > {gap_ms * 1000}, 1, 0)")
        numbered = running(gaps.withColumn("_fresh", fresh), ["host_key"], ORDER, [Scan("run_no", "sum", F.col("_fresh"))], split)
        return numbered.groupBy("host_key", "run_no").agg(
            F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("events")
        )

    return by_session(events, options, plan)


def own_traces(events: DataFrame, options: Options = Options()) -> DataFrame:
    """The traces of every session by its own events, stored: look-ups read them several times."""
    rows = by_session(events, options, lambda part, known, split: trace_table(annotate(part, known, split), split))
    return cut(events.sparkSession, rows)


def trace_table(annotated: DataFrame, split: Split = PLAIN) -> DataFrame:
    """One row per trace, from the event that opened it.

    ``forgotten`` is the position at which its session was last dropped from the correlation memory: right
    after the input that replaced a trace, or behind the last event of a trace that closed by itself.
    """
    opened = annotated.where(named(INPUT)).select(
        F.col("host_key").alias("session_key"),
        "trace_no",
        *["start_us", "start_seq", "next_start", "cut_us", "close_us", "closed_by"],
    )
    before = running(
        opened,
        ["session_key"],
        ["start_us", "start_seq"],
        [Scan("_before", "last", F.struct("closed_by", "cut_us"), "before")],
        split,
    )
    return before.selectExpr(
        *opened.columns,
        "case when _before is null then null "
        "when _before.closed_by = 'replaced' then struct(start_us as ts_us, start_seq as event_seq) "
        f"else struct(_before.cut_us as ts_us, {LAST_SEQ} as event_seq) end as forgotten",
    )

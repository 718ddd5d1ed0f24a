"""Tool starts matched with tool ends, by call id and else first-in-first-out by tool name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import present
from tracewright.operators.scan import PLAIN, Scan, Split, beside, packed, running
from tracewright.operators.traces import ORDER, ROW, TOOL_END, TOOL_START, TRACE, named

# Open tool calls are kept per trace and own session, and all forgotten at a run end (the phase).
SCOPE = [*TRACE, "phase", "session_key"]


def tool_events(annotated: DataFrame) -> DataFrame:
    return annotated.where(named(TOOL_START, TOOL_END) & F.col("reached"))


def match_tools(reached: DataFrame, split: Split = PLAIN, whole: bool = False) -> DataFrame:
    """Events that reached a trace, with the slot each tool event takes; other events pass through.

    A start and the end that closes it share ``slot_kind``, ``slot_name`` and ``slot_no``. ``matched`` is
    false for an end no start was open for; ``replaced_us`` is when a repeated call id replaced the start. ``whole``: as in
    ``annotate``.
    """
    read = [*SCOPE, *ORDER, "tool_call_id", "tool_name"]
    if not split.active:
        return packed(reached, [*ROW, *read], lambda part: _match(part, split)) if whole else _match(reached, split)
    return beside(reached, ROW, read, lambda part: _match(part, split))


def _match(reached: DataFrame, split: Split) -> DataFrame:
    tools = reached.withColumn("call_id", F.expr(present("tool_call_id")))
    start, end = named(TOOL_START), named(TOOL_END)

    attempts = running(
        tools,
        [*SCOPE, "call_id"],
        ORDER,
        [
            Scan("attempt", "sum", F.when(start, F.lit(1)).otherwise(F.lit(0))),
            Scan("_next_us", "last", F.when(start, F.col("ts_us")), "after"),
        ],
        split,
    )
    ends = running(
        attempts,
        [*SCOPE, "call_id", "attempt"],
        ORDER,
        [Scan("_end_no", "sum", F.when(end, F.lit(1)).otherwise(F.lit(0)))],
        split,
    )
    with_id = F.col("call_id").isNotNull()
    by_id = end & with_id & (F.col("attempt") > 0) & (F.col("_end_no") == 1)

    # A queue without a queue: the n-th useful end takes the n-th start. An end met by an empty queue is
    # wasted; the number wasted so far is the running maximum of (ends - starts).
    queued = running(
        ends.withColumn("_by_id", by_id),
        [*SCOPE, "tool_name"],
        ORDER,
        [
            Scan("_starts", "sum", F.when(start & ~with_id, F.lit(1)).otherwise(F.lit(0))),
            Scan("_ends", "sum", F.when(end & ~F.col("_by_id"), F.lit(1)).otherwise(F.lit(0))),
        ],
        split,
    )
    excess = F.col("_ends") - F.col("_starts")
    waste = running(
        queued,
        [*SCOPE, "tool_name"],
        ORDER,
        [Scan("_wasted", "max", excess), Scan("_wasted_before", "max", excess, "before")],
        split,
    )
    wasted = F.greatest(F.lit(0), F.col("_wasted"))
    useful = wasted == F.greatest(F.lit(0), F.coalesce(F.col("_wasted_before"), F.lit(0)))
    id_slot = F.col("_by_id") | (start & with_id)
    out = waste.select(
        "*",
        F.when(id_slot, F.lit("id")).when(start | end, F.lit("fifo")).alias("slot_kind"),
        F.when(id_slot, F.col("call_id")).when(start | end, F.col("tool_name")).alias("slot_name"),
        F.when(id_slot, F.col("attempt"))
        .when(start, F.col("_starts"))
        .when(end, F.col("_ends") - wasted)
        .alias("slot_no"),
        (start | F.col("_by_id") | (end & useful)).alias("matched"),
        F.when(start & with_id, F.col("_next_us")).alias("replaced_us"),
    )
    return out.drop("attempt", *[c for c in out.columns if c.startswith("_")])


def pair_tools(matched: DataFrame, start_columns: list[str], end_columns: list[str]) -> DataFrame:
    """One row per tool start, with structs ``start`` and ``end``; ``end`` is null when none closed it.

    Two rows at most share a slot, so the grouping has no hot group, whatever the session.
    """
    start, end = named(TOOL_START), named(TOOL_END)
    slot = [*SCOPE, "slot_kind", "slot_name", "slot_no"]
    paired = (
        matched.where("matched")
        .groupBy(*slot)
        .agg(
            F.max(F.when(start, F.struct(*start_columns))).alias("start"),
            F.max(F.when(end, F.struct(*end_columns))).alias("end"),
        )
    )
    return paired.where(F.col("start").isNotNull())

"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import media as M
from tracewright.functions import payloads as P
from tracewright.functions import scalars as S
from tracewright.functions.text import redact_json, redact_text, redact_tool_messages
from tracewright.operators.admission import quality_report, skip_reasons
from tracewright.operators.correlation import correlate, correlation_split, memory_spans, resolve_missing
from tracewright.operators.pairing import match_tools, pair_tools, tool_events
from tracewright.operators.rollups import actions, rollup_actions, rollup_sessions, summarize_traces
from tracewright.operators.routing import resolve_lifecycles, route
from tracewright.operators.scan import Split, checkpoint_dir, cut, stored
from tracewright.operators.spans import assemble, build_spans, collect_traces, nest_spans
from tracewright.operators.traces import annotate, annotate_by_heat, by_session, number_traces, own_traces, timed
from tracewright.operators.traces import gap_sessions as activity_runs
from tracewright.options import Options
from tracewright.plans import views as V
from tracewright.sources import tables as T
from tracewright.sources.hooks import canonical, read_hook_events, union_hooks
from tracewright.streaming.assemble import assemble_traces
from tracewright.streaming.media import new_media, new_media_by_count

Query = Callable[[SparkSession, str], DataFrame]

# Gaps in ``events`` are long: half a day lets about half of the traces live until something closes them.
HALF_DAY = Options(stale_timeout_ms=12 * 3600 * 1000)
MINUTES_5 = Options()
NEVER_STALE = Options(stale_timeout_ms=None)
HOME = "/home/agent"

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _annotated(spark, sf_dir, options=HALF_DAY, view=V.hooks_e) -> DataFrame:
    return annotate_by_heat(view(spark, sf_dir), options)


def _spans(spark, sf_dir, options=HALF_DAY, view=V.hooks_e) -> DataFrame:
    return assemble(view(spark, sf_dir), options)


def _traces(spark, sf_dir, options=HALF_DAY, view=V.hooks_e) -> DataFrame:
    return by_session(
        view(spark, sf_dir), options, lambda part, known, split: collect_traces(annotate(part, known, split))
    )


def _time(name: str, alias: str) -> str:
    return f"timestamp_micros({name}) as {alias}"


# --- sessions, traces, spans ---


@query
def session_rollup(spark, sf_dir):
    return rollup_sessions(_spans(spark, sf_dir))


@query
def trace_numbering(spark, sf_dir):
    numbered = by_session(
        V.hooks_e(spark, sf_dir),
        NEVER_STALE,
        lambda part, known, split: number_traces(part.where("host_key is not null"), split),
    )
    return numbered.selectExpr("host_key as session_key", "event_seq", "trace_no", "next_start_us")


@query
def span_sequence(spark, sf_dir):
    return _spans(spark, sf_dir).selectExpr("session_id", "trace_no", "kind", "start_seq", "span_seq")


@query
def llm_pairs(spark, sf_dir):
    return _traces(spark, sf_dir).selectExpr(
        "host_key as session_key",
        "trace_no",
        "start_seq",
        _time("start_us", "start_time"),
        _time("output_us", "output_time"),
        "model",
        "provider",
        "output_usage.input as input_tokens",
    )


def _pairs(spark, sf_dir, options, kind) -> DataFrame:
    def plan(part, known, split):
        matched = match_tools(tool_events(annotate(part, known, split)), split)
        return pair_tools(
            matched.where(f"slot_kind = '{kind}'"), ["event_seq", "ts_us", "replaced_us"], ["event_seq", "ts_us"]
        )

    return by_session(V.hooks_e(spark, sf_dir), options, plan)


@query
def tool_pairs_by_id(spark, sf_dir):
    return _pairs(spark, sf_dir, NEVER_STALE, "id").selectExpr(
        "session_key", "trace_no", "slot_name as call_id", "start.event_seq as start_seq", "end.event_seq as end_seq"
    )


@query
def tool_pairs_fifo(spark, sf_dir):
    return _pairs(spark, sf_dir, NEVER_STALE, "fifo").selectExpr(
        "session_key", "trace_no", "slot_name as tool_name", "start.event_seq as start_seq", "end.event_seq as end_seq"
    )


@query
def tool_duplicate_close(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, NEVER_STALE, "id")
    return pairs.where("end is null and start.replaced_us is not null").selectExpr(
        "session_key", "trace_no", "start.event_seq as start_seq", _time("start.replaced_us", "replaced_time")
    )


@query
def orphan_close(spark, sf_dir):
    spans = _spans(spark, sf_dir).where("kind in ('tool', 'llm') and close_reason <> 'ended'")
    return spans.selectExpr("session_id", "kind", "start_seq", "close_reason", _time("end_us", "end_time"))


def _closed(spark, sf_dir, options, reason) -> DataFrame:
    rows = _annotated(spark, sf_dir, options)
    return rows.where(f"event_name = 'llm_input' and closed_by = '{reason}'").selectExpr(
        "host_key as session_key", "trace_no", "event_seq as start_seq", _time("close_us", "close_time")
    )


@query
def replaced_traces(spark, sf_dir):
    return _closed(spark, sf_dir, HALF_DAY, "replaced")


@query
def stale_traces_5m(spark, sf_dir):
    return _closed(spark, sf_dir, MINUTES_5, "stale")


@query
def stale_traces_sweep(spark, sf_dir):
    return _closed(spark, sf_dir, Options(sweep_ms=60_000), "stale")


@query
def finalized_traces(spark, sf_dir):
    return _closed(spark, sf_dir, HALF_DAY, "agent_end")


@query
def end_of_input_close(spark, sf_dir):
    return _closed(spark, sf_dir, HALF_DAY, "end_of_input")


@query
def gap_sessions(spark, sf_dir):
    rows = activity_runs(V.hooks_e(spark, sf_dir), 300_000)
    return rows.selectExpr(
        "host_key as session_key", _time("first_us", "first_time"), _time("last_us", "last_time"), "events"
    )


@query
def late_events(spark, sf_dir):
    rows = _annotated(spark, sf_dir, HALF_DAY.but(grace_ms=3_600_000))
    return rows.groupBy("event_name", F.coalesce("late_reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query
def last_activity(spark, sf_dir):
    return _traces(spark, sf_dir).selectExpr(
        "host_key as session_key", "trace_no", _time("last_activity_us", "last_activity"), "closed_by"
    )


# --- projections and scalars ---


@query
def provider_normalized(spark, sf_dir):
    rows = V.hooks_e(spark, sf_dir).where("provider is not null")
    return rows.selectExpr("event_seq", f"{S.provider_or_raw('provider')} as provider")


@query
def context_carry_forward(spark, sf_dir):
    return _traces(spark, sf_dir).selectExpr("host_key as session_key", "trace_no", "channel", "trigger")


def _raw(spark, sf_dir) -> DataFrame:
    """``hooks_e`` as raw envelopes: tool ids partly in the payload, partly in the context."""
    from tracewright.schemas import RAW_CONTEXT, RAW_EVENT

    def pack(fields, given):
        return "named_struct(" + ", ".join(
            f"'{f.name}', cast({given.get(f.name, 'null')} as {f.dataType.simpleString()})" for f in fields
        ) + ")"

    event = {
        "toolName": "tool_name", "model": "model", "provider": "provider", "prompt": "prompt", "usage": "usage",
        "toolCallId": "if(event_seq % 3 = 0, tool_call_id, if(event_seq % 3 = 1, '', null))",
        "runId": "if(event_seq % 4 = 0, concat('e', event_seq), null)",
        "durationMs": "duration_ms", "success": "success", "error": "error", "params": "params", "result": "parse_json(result)",
    }
    ctx = {
        "sessionKey": "coalesce(session_key, '')", "agentId": "agent_id", "channelId": "channel_id",
        "messageProvider": "message_provider", "trigger": "trigger", "toolCallId": "tool_call_id",
        "runId": "if(event_seq % 4 < 2, concat('c', event_seq), '')",
    }
    return V.hooks_e(spark, sf_dir).selectExpr(
        "event_seq as seq",
        "ts",
        "event_name as hook",
        f"{pack(RAW_EVENT.fields, event)} as event",
        f"{pack(RAW_CONTEXT.fields, ctx)} as ctx",
    )


@query
def id_resolution(spark, sf_dir):
    return canonical(_raw(spark, sf_dir)).select(
        "event_seq", "event_name", "session_key", "tool_call_id", "run_id", "channel_id", "trigger", "result"
    )


@query
def usage_tokens(spark, sf_dir):
    rows = V.hooks_e(spark, sf_dir).where("event_name = 'llm_output'")
    return rows.selectExpr("event_seq", f"{S.map_usage('usage')} as tokens").selectExpr("event_seq", "tokens.*")


@query
def span_labels(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return spans.groupBy("kind", "span_type", "action_type").agg(F.count(F.lit(1)).alias("spans"))


@query
def trace_names(spark, sf_dir):
    return _traces(spark, sf_dir).selectExpr("host_key as session_key", "trace_no", "trace_name")


@query
def clean_numbers(spark, sf_dir):
    raw = V.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "case c_custkey % 5 when 0 then double('NaN') when 1 then double('infinity') else c_acctbal end as number",
    )
    return raw.selectExpr("c_custkey", f"{S.clean_number('number')} as clean")


@query
def token_totals(spark, sf_dir):
    raw = V.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 7 = 0 then double('NaN') when c_custkey % 7 = 1 then null else c_acctbal end as prompt",
        "if(c_custkey % 3 = 0, null, c_acctbal / 2) as completion",
    )
    return raw.selectExpr("c_custkey", f"{S.token_total('prompt', 'completion')} as tokens")


@query
def ids(spark, sf_dir):
    return _spans(spark, sf_dir).selectExpr(
        "session_id", "trace_id", "span_id", "event_id", "parent_span_id", f"{S.action_id('event_id')} as action_id"
    )


@query
def skip_reasons_by_event(spark, sf_dir):
    return skip_reasons(V.hooks_e(spark, sf_dir), HALF_DAY)


# --- correlation ---


@query
def missing_session_resolved(spark, sf_dir):
    events = timed(V.hooks_e(spark, sf_dir))
    split = correlation_split(events, NEVER_STALE)
    return resolve_missing(events, own_traces(events, NEVER_STALE), None, NEVER_STALE, split)


@query
def agent_forget(spark, sf_dir):
    events = timed(V.hooks_e(spark, sf_dir))
    return memory_spans(events, own_traces(events, NEVER_STALE), correlation_split(events, NEVER_STALE))


def _lifecycles(spark, sf_dir) -> tuple[DataFrame, DataFrame, Split]:
    events = timed(V.hooks_sub(spark, sf_dir))
    split = correlation_split(events, NEVER_STALE)
    return events, resolve_lifecycles(events, own_traces(events, NEVER_STALE), split), split


@query
def subagent_lifecycles(spark, sf_dir):
    _, lifecycles, _ = _lifecycles(spark, sf_dir)
    return lifecycles.selectExpr(
        "event_seq", "event_name", "life_key", "creates", "root as root_session", "root_seq as root_trace",
        "link_seq", "parent_seq", "resets.link_seq as resets_link",
    )


@query
def host_routing(spark, sf_dir):
    events, lifecycles, split = _lifecycles(spark, sf_dir)
    routed = route(events, lifecycles, split).where("event_name in ('before_tool_call', 'after_tool_call')")
    return routed.groupBy("session_key", "host_key", "parent_seq", "event_name").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_seq").alias("first_seq"), F.max("event_seq").alias("last_seq")
    )


@query
def routed_spans(spark, sf_dir):
    """Spans with child sessions routed and nested; no trace goes stale."""
    routed = correlate(V.hooks_sub(spark, sf_dir), NEVER_STALE)
    spans = by_session(
        routed, NEVER_STALE, lambda part, known, split: build_spans(annotate(part, known, split), known, split)
    )
    columns = ["session_id", "trace_no", "kind", "start_seq", "name", "close_reason", "span_seq", "span_id"]
    # Stored before nesting, which reads them three times.
    slim = cut(spark, spans.select(*columns, "parent_span_id", "parent_seq", "end_us"))
    return nest_spans(slim).selectExpr(*columns, "parent_span_id", _time("end_us", "end_time"))


@query
def diagnostics_attached(spark, sf_dir):
    rows = _annotated(spark, sf_dir, HALF_DAY, V.hooks_diag)
    return rows.where("event_name = 'model.usage' and reached").selectExpr(
        "event_seq", "host_key as session_key", "trace_no", "cost_usd"
    )


@query
def cost_meta(spark, sf_dir):
    return _traces(spark, sf_dir, HALF_DAY, V.hooks_diag).where("diagnostics > 0").selectExpr(
        "host_key as session_key", "trace_no", "cost_usd", "round(cost_usd_sum, 6) as cost_usd_sum", "context_limit",
        "context_used", "cost_model", "cost_provider", "cost_duration_ms", "cost_usage.input as usage_input",
        "cost_usage.output as usage_output", "cost_usage.total as usage_total", "diagnostics",
    )


@query
def trace_usage(spark, sf_dir):
    usage = P.chosen_usage("output_usage", "cost_usage")
    rows = _traces(spark, sf_dir, HALF_DAY, V.hooks_diag)
    return rows.selectExpr("host_key as session_key", "trace_no", f"{usage} as u").selectExpr(
        "session_key", "trace_no", "u.input as input", "u.output as output", "u.total as total"
    )


# --- rollups and tables ---


@query
def trace_summary(spark, sf_dir):
    return summarize_traces(_spans(spark, sf_dir, HALF_DAY, V.hooks_diag)).drop("trace_id")


@query
def action_rollup_type(spark, sf_dir):
    return rollup_actions(actions(_spans(spark, sf_dir)), ["action_type", "model_name"])


@query
def action_rollup_day(spark, sf_dir):
    rows = rollup_actions(actions(_spans(spark, sf_dir)), ["day", "action_type"])
    return rows.withColumn("day", F.col("day").cast("string"))


@query
def sessions_by_start(spark, sf_dir):
    rows = rollup_sessions(_spans(spark, sf_dir))
    found = T.sessions_by(rows, since="2024-01-02 00:00:00", until="2024-01-04 00:00:00")
    return found.select("session_id", "start_time", "total_actions")


@query
def actions_by_session(spark, sf_dir):
    rows = T.actions_by(actions(_spans(spark, sf_dir)), session="7", action_type="tool")
    return rows.select("session_id", "action_name", "duration_ms", "created_at")


def _event_rows(spark, sf_dir) -> DataFrame:
    return T.event_rows(_spans(spark, sf_dir), HALF_DAY)


@query
def store_summary(spark, sf_dir):
    return T.store_summary(_event_rows(spark, sf_dir))


@query
def newest_events(spark, sf_dir):
    return T.newest(_event_rows(spark, sf_dir))


@query
def event_keys(spark, sf_dir):
    return T.json_keys(_event_rows(spark, sf_dir), ["record", "trace", "resource_attributes"])


@query
def events_append_dedup(spark, sf_dir):
    """The half of the event rows that ends on even days is stored already; each new row comes twice."""
    rows = _event_rows(spark, sf_dir).withColumn("event_date", F.to_date("timestamp"))
    stored = rows.where("day(event_date) % 2 = 0")
    fresh = T.without_known(rows.unionByName(rows), stored, "event_id", "event_date")
    return fresh.selectExpr(
        "event_id", "cast(event_date as string) as event_date", "record_type", "start_timestamp", "timestamp"
    )


def _written_twice(spark, sf_dir) -> str:
    """The tables after a write of the first half of the month's events and a write of all of them."""
    root = _scratch(spark, "tables")
    events = V.hooks_e(spark, sf_dir)
    for number, part in enumerate((events.where("ts < '2024-01-15 12:00:00'"), events)):
        # Stored, as both tables are made of them.
        spans = stored(spark, assemble(part, HALF_DAY), f"{root}/spans/{number}")
        T.write_events(spans, f"{root}/events", HALF_DAY)
        T.write_actions(spans, f"{root}/actions")
    return root


@query
def events_written_twice(spark, sf_dir):
    rows = spark.read.parquet(f"{_written_twice(spark, sf_dir)}/events")

    def attribute(name: str, column: str) -> str:
        return f"get_json_object(record_attributes, '$[\\'{T.NS}{name}\\']') as {column}"

    return rows.selectExpr(
        "event_id", "cast(event_date as string) as event_date", "record_type", "start_timestamp", "timestamp",
        "get_json_object(record, '$.name') as name", attribute("span_type", "span_type"), attribute("record_id", "record_id"),
        attribute("model", "model"), attribute("call.function", "call_function"),
        f"get_json_object(get_json_object(record_attributes, '$[\\'{T.NS}trace.input\\']'), '$.prompt') as prompt",
        *[f"get_json_object(trace, '$.{c}') as {c}" for c in ("trace_id", "span_id", "parent_id")],
    )


@query
def actions_written_twice(spark, sf_dir):
    rows = T.read_actions(spark, f"{_written_twice(spark, sf_dir)}/actions")
    return rows.withColumns(
        {
            "prompt": F.get_json_object("input_params", "$.prompt"),
            "q": F.get_json_object("input_params", "$.q"),
            "failure": F.get_json_object("output_result", "$.error"),
        }
    ).drop("input_params", "output_result", "event_date", *T.SLOTS)


@query
def stored_actions_by_session(spark, sf_dir):
    """Tool calls of one session up to a time, read from the stored table along its folders."""
    rows = T.read_actions(spark, f"{_written_twice(spark, sf_dir)}/actions")
    found = T.actions_by(rows, session="7", action_type="tool", until="2024-01-20 00:00:00")
    return found.select("event_id", "session_id", "action_name", "duration_ms", "created_at")


@query
def stored_sessions_by_start(spark, sf_dir):
    """Sessions that began in a span of time, read from the stored table."""
    found = T.sessions_by(sessions_written_twice(spark, sf_dir), since="2024-01-02 00:00:00", until="2024-01-04 00:00:00")
    return found.select("session_id", "start_time", "total_actions")


@query
def actions_append(spark, sf_dir):
    rows = actions(_spans(spark, sf_dir, HALF_DAY, V.hooks_diag))
    return rows.drop("input_params", "output_result")


@query
def session_merge(spark, sf_dir):
    """The rollup up to mid-month merged with the rollup of the later traces."""
    spans = _spans(spark, sf_dir)
    middle = 1_705_276_800_000_000
    earlier = rollup_sessions(spans.where(f"end_us < {middle}"))
    later = rollup_sessions(spans.where(f"end_us >= {middle}"))
    return T.merge_sessions(earlier, later)


@query
def sessions_written_twice(spark, sf_dir):
    """The stored session table after the traces of the month's first half and then the later ones."""
    path = f"{_scratch(spark, 'sessions')}/sessions"
    spans = _spans(spark, sf_dir)
    middle = 1_705_276_800_000_000
    for part in (spans.where(f"end_us < {middle}"), spans.where(f"end_us >= {middle}")):
        T.write_sessions(rollup_sessions(part), path)
    return T.read_sessions(spark, path)


@query
def union_hooks_counts(spark, sf_dir):
    rows = V.hooks_diag(spark, sf_dir)
    kinds = ["llm_input", "llm_output", "before_tool_call", "after_tool_call", "agent_end", "model.usage"]
    parts = [rows.where(F.col("event_name") == kind).dropna(how="all", subset=["event_seq"]) for kind in kinds]
    merged = union_hooks([p.drop("usage") if i % 2 else p for i, p in enumerate(parts)])
    return merged.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("events"), F.count("session_key").alias("with_session"), F.count("usage").alias("with_usage")
    )


@query
def quality(spark, sf_dir):
    rows = V.hooks_e(spark, sf_dir)
    broken = F.expr("if(event_seq % 50 = 1, '{\"q\":', params)")
    repeated = rows.where("event_seq % 100 = 0")
    return quality_report(rows.withColumn("params", broken).unionByName(repeated))


# --- payloads, text, media ---


@query
def trace_output(spark, sf_dir):
    text = P.trace_output_text("has_output", "output_texts", "run_messages")
    last = P.last_assistant("run_messages")
    return _traces(spark, sf_dir).where("finalized").selectExpr(
        "host_key as session_key", "trace_no", f"{text} as output_text", f"if(has_output, null, {last}.content) as last_text"
    )


@query
def assistant_text(spark, sf_dir):
    rows = V.hooks_c(spark, sf_dir).where("event_name = 'llm_output'").selectExpr(
        "event_seq", "concat(assistant_texts, array('second', null, '')) as texts"
    )
    return rows.selectExpr("event_seq", f"{S.assistant_text('texts')} as text")


@query
def trace_metadata(spark, sf_dir):
    spans = _spans(spark, sf_dir, HALF_DAY, V.hooks_diag).where("kind = 'root' and close_reason = 'agent_end'")
    keys = ["created_from", "costUsd", "contextUsed", "success", "durationMs", "model", "provider", "channel",
            "trigger", "error"]
    return spans.selectExpr(
        "session_id",
        "trace_no",
        *[f"get_json_object(metadata, '$.{key}') as m_{key.lower()}" for key in keys],
        "get_json_object(metadata, '$.usage.input') as m_usage_input",
    )


@query
def error_shapes(spark, sf_dir):
    spans = _spans(spark, sf_dir).where("error_info is not null or output is not null").where("kind <> 'llm'")
    return spans.selectExpr(
        "session_id", "kind", "start_seq", "close_reason",
        "get_json_object(error_info, '$.exceptionType') as exception_type",
        "get_json_object(error_info, '$.message') as message",
        "get_json_object(error_info, '$.traceback') as traceback",
        "if(kind = 'tool', output, null) as tool_output",
    )


@query
def payload_choice(spark, sf_dir):
    """Which texts of an event are searched for media."""
    rows = V.hooks_e(spark, sf_dir).withColumn("history", F.expr("concat('[', params, ',{\"z\":', event_seq, '}]')"))
    return rows.selectExpr(
        "event_seq",
        "if(event_name = 'llm_input', prompt, null) as prompt",
        f"{P.json_array_last('history')} as last_history",
        f"{P.last_item('messages')}.content as last_message",
        "if(event_name = 'agent_end', error, null) as run_error",
    )


@query
def redact_texts(spark, sf_dir):
    return V.conversations(spark, sf_dir).selectExpr("conv_id", "turn", f"{redact_text('text')} as text")


def _media_rows(spark, sf_dir) -> DataFrame:
    return M.extract_media(V.conversations(spark, sf_dir), ["conv_id", "turn"], ["text"], HOME)


@query
def media_refs(spark, sf_dir):
    rows = V.conversations(spark, sf_dir)
    return rows.select("conv_id", "turn", F.explode(M.media_refs(F.col("text"))).alias("ref"))


@query
def media_paths(spark, sf_dir):
    return _media_rows(spark, sf_dir)


@query
def media_json(spark, sf_dir):
    """The same references inside JSON, in values at any depth; those in keys do not count."""
    payload = "to_json(map('media:/tmp/key.png', struct(array(struct(concat(text, '\n', turn) as t)) as rows, turn as n)))"
    rows = V.conversations(spark, sf_dir).selectExpr("conv_id", "turn", f"{payload} as payload")
    return M.extract_media(rows, ["conv_id", "turn"], ["payload"], HOME)


@query
def mime_counts(spark, sf_dir):
    """MIME types of file names built from part sizes: known, unknown and missing extensions."""
    exts = [*M.MIME_TYPES, "txt", "PNG", ""]
    names = V.table(spark, sf_dir, "part").select(
        F.concat(
            F.lit("/d.x/p"),
            F.col("p_partkey").cast("string"),
            F.lit("."),
            F.element_at(F.array(*[F.lit(e) for e in exts]), (F.col("p_partkey") % len(exts) + 1).cast("int")),
        ).alias("path")
    )
    return M.with_mime(names).groupBy("mime").agg(F.count(F.lit(1)).alias("files"))


@query
def media_manifest(spark, sf_dir):
    found = _media_rows(spark, sf_dir)
    # A conversation's files grow with its number; files of every seventh one are empty.
    files = found.selectExpr(
        "path", "if(conv_id % 7 = 3, 0, (conv_id + 1) * 3000001) as size"
    ).dropDuplicates(["path"])
    references = found.selectExpr("'trace' as entity_type", "cast(conv_id as string) as entity_id", "path")
    return M.media_manifest(references, files)


# --- streams: run to the end of the data, then read back ---


def _scratch(spark, name: str) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _assembled(spark, sf_dir, options=NEVER_STALE) -> str:
    """All hook events as a stream, tool ends that lost their session included."""
    root = _scratch(spark, "traces")
    events = V.hooks_e(spark, sf_dir, streaming=True)
    assemble_traces(events, f"{root}/out", f"{root}/checkpoint", options, "0 seconds", available_now=True).awaitTermination()
    return f"{root}/out"


def _in_arrivals(spark, events: DataFrame, arrivals: int, options) -> str:
    """The events as so many arrivals, each at least one micro-batch; open traces go from batch to batch."""
    root = _scratch(spark, "batches")
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    number = F.floor((F.unix_micros("ts") - F.lit(low)) * arrivals / F.lit(high - low + 1))
    for arrival in range(arrivals):
        events.where(number == arrival).write.mode("append").parquet(f"{root}/in")
        stream = read_hook_events(spark, f"{root}/in", streaming=True, fmt="parquet")
        run = assemble_traces(stream, f"{root}/out", f"{root}/checkpoint", options, "0 seconds", available_now=True)
        run.awaitTermination()
    return f"{root}/out"


def _closed_events(spark, root: str) -> DataFrame:
    return T.read_batches(spark, root, "events").select("event_id", "record_type", "start_timestamp", "timestamp")


@query
def stream_assemble(spark, sf_dir):
    return _closed_events(spark, _assembled(spark, sf_dir))


@query
def stream_batches(spark, sf_dir):
    """All hook events in four arrivals; tool ends that lost their session are resolved across batches."""
    return _closed_events(spark, _in_arrivals(spark, V.hooks_e(spark, sf_dir), 4, NEVER_STALE))


@query
def stream_stale(spark, sf_dir):
    """Four arrivals with idle traces closing; every event has its session."""
    return _closed_events(spark, _in_arrivals(spark, V.hooks_known(spark, sf_dir), 4, HALF_DAY))


@query
def stream_routed(spark, sf_dir):
    """Child sessions routed to the root trace across four arrivals."""
    rows = T.read_batches(spark, _in_arrivals(spark, V.hooks_sub(spark, sf_dir), 4, NEVER_STALE), "events")
    return rows.select(
        "event_id", "start_timestamp", "timestamp",
        F.get_json_object("record", "$.name").alias("name"), F.get_json_object("trace", "$.parent_id").alias("parent_span_id"),
    )


@query
def stream_sink(spark, sf_dir):
    return T.read_sessions(spark, _assembled(spark, sf_dir), "sessions")


@query
def stream_quality(spark, sf_dir):
    """Counts observed while the batches of four arrivals were stored, added up."""
    rows = T.read_batches(spark, _in_arrivals(spark, V.hooks_e(spark, sf_dir), 4, NEVER_STALE), "quality")
    return rows.groupBy("metric").agg(F.sum("events").alias("events"))


@query
def stream_late(spark, sf_dir):
    """Two arrivals, the later times first: what then comes behind the watermark, with the reason."""
    root = _scratch(spark, "late")
    events = V.hooks_known(spark, sf_dir)
    for part in (events.where("ts >= '2024-01-15 12:00:00'"), events.where("ts < '2024-01-15 12:00:00'")):
        part.write.mode("append").parquet(f"{root}/in")
        stream = read_hook_events(spark, f"{root}/in", streaming=True, fmt="parquet")
        assemble_traces(stream, f"{root}/out", f"{root}/checkpoint", HALF_DAY, "1 day", available_now=True).awaitTermination()
    rows = T.read_batches(spark, f"{root}/out", "late")
    return rows.groupBy("event_name", "late_reason").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_time"))


def _media_stream(spark, sf_dir, found_in) -> DataFrame:
    root = _scratch(spark, "media")
    turns = V.conversations(spark, sf_dir, streaming=True).withColumn(
        "ts", F.expr("timestamp_micros(1704067200000000 + conv_id * 3600000000 + turn * 60000000)")
    )
    run = found_in(turns).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    run.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("conv_id", "path")


@query
def stream_media_dedup(spark, sf_dir):
    return _media_stream(spark, sf_dir, lambda turns: new_media(turns, ["conv_id"], ["text"], HOME, "1 day"))


@query
def stream_media_budget(spark, sf_dir):
    """References that are not among the last keys remembered, by number of keys."""
    return _media_stream(spark, sf_dir, lambda turns: new_media_by_count(turns, ["conv_id"], ["text"], HOME))


# --- redaction of JSON, decoding ---


@query
def redact_json_payloads(spark, sf_dir):
    nested = "to_json(named_struct('t', text, 'n', array(named_struct('t', concat('x', text))), 'k', turn))"
    rows = V.conversations(spark, sf_dir).selectExpr("conv_id", "turn", f"{nested} as payload")
    return rows.select("conv_id", "turn", redact_json("payload").alias("payload"))


@query
def tool_messages_redacted(spark, sf_dir):
    message = "to_json(named_struct('role', 'tool', 'content', text))"
    rows = V.conversations(spark, sf_dir).selectExpr("conv_id", "turn", f"{message} as message")
    return redact_tool_messages(rows, enabled=True)


@query
def percent_decoded(spark, sf_dir):
    urls = V.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "case page_id % 4 when 0 then url_encode(url) when 1 then concat(url, '%zz') "
        "when 2 then concat(url, '+a%20b%FF') else concat(url, '%C3%A9+') end as ref"
    )
    return urls.select("page_id", M.percent_decode(F.col("ref")).alias("decoded"))

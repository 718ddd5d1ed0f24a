"""Oracle SQL per query, for DuckDB over the same tables."""

from __future__ import annotations

from tracewright.functions.media import MIME_TYPES, OTHER_MIME
from tracewright.plans.oracle_parts import (
    FACTS,
    HOOKS_C,
    HOOKS_DIAG,
    HOOKS_E,
    HOOKS_KNOWN,
    HOOKS_SUB,
    HOUR_12,
    MINUTE_5,
    PAIRS,
    ROLLUP,
    SPANS,
    TURNS,
    bounds,
    numbered,
    provider,
    with_traces,
)

TRACES = with_traces(HOOKS_E, HOUR_12, FACTS)
TRACES_DIAG = with_traces(HOOKS_DIAG, HOUR_12, FACTS)
SPANNED = with_traces(HOOKS_E, HOUR_12, PAIRS, FACTS, SPANS)
SPANNED_DIAG = with_traces(HOOKS_DIAG, HOUR_12, PAIRS, FACTS, SPANS)
PAIRED = with_traces(HOOKS_E, None, PAIRS)

ACTIONS = """actions AS (SELECT session_key AS session_id, kind, CASE kind WHEN 'root' THEN 'trace' ELSE kind END AS action_type,
  coalesce(name, '') AS action_name, coalesce(model, '') AS model_name, prompt_tokens, completion_tokens, duration_ms,
  CASE kind WHEN 'root' THEN coalesce(channel, '') ELSE '' END AS channel_id, make_timestamp(end_us) AS created_at,
  event_id FROM ided)"""
ROLL = """count(*) AS actions, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms"""


def _closed(prefix: str, reason: str) -> str:
    return (
        f"{prefix} SELECT session_key, trace_no, start_seq, make_timestamp(close_us) AS close_time "
        f"FROM traces WHERE closed_by = '{reason}'"
    )


ACTION_ID = "CAST('0x' || substr(md5(event_id), 1, 15) AS BIGINT)"

# Usage diagnostics that reached a trace, and the last known value per trace.
_COST = """cost AS (SELECT *, us * 100000000000000::HUGEINT + event_seq % 100000000000000 AS pos FROM ann
  WHERE reached AND event_name = 'model.usage')"""


def _last(column: str, extra: str = "") -> str:
    return f"arg_max({column}, pos) FILTER (WHERE {column} IS NOT NULL {extra})"


# A sequential run over the events in order, one per step: which session a tool end without one goes to.
MISSING = f"""{HOOKS_E}, {numbered()},
starts AS (SELECT session_key, us AS open_us, event_seq AS open_seq,
  lead(us) OVER w AS next_us, lead(event_seq) OVER w AS next_seq, trace_no
  FROM num WHERE event_name = 'llm_input' WINDOW w AS (PARTITION BY session_key ORDER BY us, event_seq)),
ends AS (SELECT session_key, trace_no, min(us) AS end_us FROM num WHERE event_name = 'agent_end' GROUP BY ALL),
life AS (SELECT s.*, e.end_us FROM starts s LEFT JOIN ends e USING (session_key, trace_no)),
evs AS (SELECT event_seq, epoch_us(ts) AS us, event_name, session_key, agent_id,
  row_number() OVER (ORDER BY ts, event_seq) AS i FROM hooks),
lost AS (SELECT * FROM evs WHERE event_name = 'after_tool_call' AND session_key IS NULL),
opened AS (SELECT l.event_seq, count(t.open_seq) AS n, min(t.session_key) AS only_one FROM lost l LEFT JOIN life t
  ON (t.open_us, t.open_seq) < (l.us, l.event_seq) AND (t.next_us IS NULL OR (t.next_us, t.next_seq) > (l.us, l.event_seq))
  AND (t.end_us IS NULL OR t.end_us >= l.us) GROUP BY l.event_seq),
drops AS (SELECT session_key, CASE WHEN end_us < coalesce(next_us, 9e18) THEN end_us ELSE next_us END AS drop_us,
  CASE WHEN end_us < coalesce(next_us, 9e18) THEN 9223372036854775807 ELSE next_seq END AS drop_seq
  FROM life WHERE end_us IS NOT NULL OR next_us IS NOT NULL),
steps AS (SELECT l.*, row_number() OVER (ORDER BY l.us, l.event_seq) AS k, o.n, o.only_one,
  (SELECT arg_max({{'s': e.session_key, 'i': e.i}}, e.i) FROM evs e WHERE e.agent_id = l.agent_id AND e.i < l.i
    AND e.session_key IS NOT NULL) AS by_agent,
  (SELECT arg_max({{'s': e.session_key, 'i': e.i}}, e.i) FROM evs e WHERE e.i < l.i AND e.session_key IS NOT NULL) AS by_last
  FROM lost l JOIN opened o USING (event_seq))"""


def _valid(alias: str) -> str:
    """The candidate's trace is open at the step, and the session was not dropped since it was seen."""
    return f"""(EXISTS (SELECT 1 FROM life t WHERE t.session_key = {alias}.s AND (t.open_us, t.open_seq) < (x.us, x.event_seq)
      AND (t.next_us IS NULL OR (t.next_us, t.next_seq) > (x.us, x.event_seq)) AND (t.end_us IS NULL OR t.end_us >= x.us))
    AND NOT EXISTS (SELECT 1 FROM drops d, evs e WHERE d.session_key = {alias}.s AND e.i = {alias}.i
      AND (d.drop_us, d.drop_seq) >= (e.us, e.event_seq) AND (d.drop_us, d.drop_seq) < (x.us, x.event_seq)))"""


MISSING_STEPS = f"""WITH RECURSIVE {MISSING},
run AS (
  SELECT 0::BIGINT AS k, MAP {{}}::MAP(VARCHAR, STRUCT(s VARCHAR, i BIGINT)) AS agents,
    NULL::STRUCT(s VARCHAR, i BIGINT) AS latest, NULL::BIGINT AS event_seq, NULL::VARCHAR AS resolved, NULL::VARCHAR AS fallback
  UNION ALL
  SELECT k, CASE WHEN resolved IS NULL THEN agents
      ELSE map_concat(agents, MAP {{agent_id: {{'s': resolved, 'i': i}}}}) END,
    CASE WHEN resolved IS NULL THEN latest ELSE {{'s': resolved, 'i': i}} END, event_seq, resolved, fallback
  FROM (SELECT x.*, CASE WHEN ok_a THEN a.s WHEN n = 1 THEN only_one WHEN ok_c THEN c.s END AS resolved,
      CASE WHEN ok_a THEN 'agentId' WHEN n = 1 THEN 'single active trace' WHEN ok_c THEN 'last active session' END AS fallback
    FROM (SELECT x.*, {_valid("x.a")} AS ok_a, {_valid("x.c")} AS ok_c
      FROM (SELECT s.*, r.agents, r.latest,
        CASE WHEN coalesce(agents[s.agent_id].i, 0) > coalesce(s.by_agent.i, 0) THEN agents[s.agent_id] ELSE s.by_agent END AS a,
        CASE WHEN coalesce(r.latest.i, 0) > coalesce(s.by_last.i, 0) THEN r.latest ELSE s.by_last END AS c
        FROM run r JOIN steps s ON s.k = r.k + 1) x) x))
SELECT event_seq, resolved, fallback FROM run WHERE k > 0"""

# Sub-agent runs, also one event per step: a map from child session to its live link.
LINKS = f"""{HOOKS_SUB}, {numbered()},
starts AS (SELECT session_key, us AS open_us, event_seq AS open_seq, lead(us) OVER w AS next_us,
  lead(event_seq) OVER w AS next_seq, trace_no
  FROM num WHERE event_name = 'llm_input' WINDOW w AS (PARTITION BY session_key ORDER BY us, event_seq)),
ends AS (SELECT session_key, trace_no, min(us) AS end_us FROM num WHERE event_name = 'agent_end' GROUP BY ALL),
openings AS (SELECT s.*, e.end_us FROM starts s LEFT JOIN ends e USING (session_key, trace_no)),
sub AS (SELECT event_seq, epoch_us(ts) AS us, event_name, requester_session_key AS req, child_session_key AS child,
  target_session_key AS target, CASE event_name WHEN 'subagent_ended' THEN coalesce(target_session_key, child_session_key)
    ELSE child_session_key END AS life_key,
  row_number() OVER (ORDER BY ts, event_seq) AS k FROM hooks WHERE event_name LIKE 'subagent%'),
own AS (SELECT s.*, coalesce(r.open_seq, c.open_seq, t.open_seq) AS own_seq FROM sub s
  {{joins}}),
steps AS (SELECT o.*, l.session_key AS own_root, l.next_us, l.next_seq, l.end_us FROM own o
  LEFT JOIN openings l ON l.open_seq = o.own_seq)"""
LINKS = LINKS.replace(
    "{joins}",
    " ".join(
        f"""LEFT JOIN openings {a} ON {a}.session_key = s.{key} AND ({a}.open_us, {a}.open_seq) < (s.us, s.event_seq)
    AND ({a}.next_us IS NULL OR ({a}.next_us, {a}.next_seq) > (s.us, s.event_seq))
    AND ({a}.end_us IS NULL OR {a}.end_us >= s.us)"""
        for a, key in (("r", "req"), ("c", "child"), ("t", "life_key"))
    ),
)
_LINK = "STRUCT(root VARCHAR, root_seq BIGINT, next_us BIGINT, next_seq BIGINT, end_us BIGINT, link_seq BIGINT)"


def _alive(link: str) -> str:
    return (
        f"({link} IS NOT NULL AND ({link}.end_us IS NULL OR {link}.end_us >= x.us) AND "
        f"({link}.next_us IS NULL OR ({link}.next_us, {link}.next_seq) > (x.us, x.event_seq)))"
    )


RUNS = f"""{LINKS},
run AS (
  SELECT 0::BIGINT AS k, MAP {{}}::MAP(VARCHAR, {_LINK}) AS hosts, NULL::BIGINT AS event_seq, false AS creates,
    NULL::VARCHAR AS root_session, NULL::BIGINT AS root_trace, NULL::BIGINT AS link_seq, NULL::BIGINT AS parent_seq,
    NULL::BIGINT AS resets_link, NULL::{_LINK} AS after, NULL::VARCHAR AS life_key, NULL::VARCHAR AS event_name,
    NULL::BIGINT AS us
  UNION ALL
  SELECT k, CASE WHEN life_key IS NULL OR attached AND event_name <> 'subagent_ended' THEN hosts
      WHEN event_name = 'subagent_ended' OR home IS NULL THEN
        map_concat(hosts, MAP {{life_key: NULL::{_LINK}}})
      ELSE map_concat(hosts, MAP {{life_key: mine}}) END,
    event_seq, creates, CASE WHEN attached OR creates THEN home.root END, CASE WHEN attached OR creates THEN home.root_seq END,
    CASE WHEN attached THEN home.link_seq WHEN creates THEN event_seq END, CASE WHEN creates THEN parent_seq END,
    CASE WHEN event_name = 'subagent_spawning' AND live THEN cur.link_seq END,
    CASE WHEN life_key IS NOT NULL AND event_name <> 'subagent_ended' AND home IS NOT NULL THEN
      CASE WHEN attached THEN home ELSE mine END END, life_key, event_name, us
  FROM (SELECT *, NOT attached AND home IS NOT NULL AS creates, {{'root': home.root, 'root_seq': home.root_seq,
      'next_us': home.next_us, 'next_seq': home.next_seq, 'end_us': home.end_us, 'link_seq': event_seq}}::{_LINK} AS mine
    FROM (SELECT *, live AND event_name <> 'subagent_spawning' AS attached,
      CASE WHEN live AND event_name <> 'subagent_spawning' THEN cur WHEN nested THEN host
        WHEN own_seq IS NOT NULL THEN {{'root': own_root, 'root_seq': own_seq, 'next_us': next_us, 'next_seq': next_seq,
          'end_us': end_us, 'link_seq': NULL}}::{_LINK} END AS home,
      CASE WHEN nested AND NOT (live AND event_name <> 'subagent_spawning') THEN host.link_seq END AS parent_seq
      FROM (SELECT x.*, coalesce({_alive("x.cur")}, false) AS live, coalesce({_alive("x.host")}, false)
        AND NOT (event_name = 'subagent_spawning' AND req = life_key) AS nested
        FROM (SELECT s.*, r.hosts, r.hosts[s.life_key] AS cur, r.hosts[s.req] AS host
          FROM run r JOIN steps s ON s.k = r.k + 1) x))))"""

# Tool events of sub-agent sessions, by the last change of their session's link before them.
ROUTED = f"""{RUNS},
changes AS (SELECT life_key, us, event_seq, after FROM run WHERE life_key IS NOT NULL
  AND (creates OR event_name IN ('subagent_ended', 'subagent_spawning'))),
toolev AS (SELECT event_seq, epoch_us(ts) AS us, event_name, session_key FROM hooks
  WHERE event_name IN ('before_tool_call', 'after_tool_call')),
placed AS (SELECT x.*, (SELECT arg_max({{'l': c.after}}, c.us * 100000000000000::HUGEINT + c.event_seq) FROM changes c
  WHERE c.life_key = x.session_key AND (c.us, c.event_seq) < (x.us, x.event_seq)).l AS link FROM toolev x),
routed AS (SELECT x.*, CASE WHEN coalesce({_alive("x.link")}, false) THEN x.link.root ELSE session_key END AS host_key,
  CASE WHEN coalesce({_alive("x.link")}, false) THEN x.link.link_seq END AS parent_seq FROM placed x)"""

_CASE = " ".join(f"WHEN '{ext}' THEN '{mime}'" for ext, mime in MIME_TYPES.items())
_EXTS = "|".join(MIME_TYPES)
_EXT_LIST = "[" + ", ".join(f"'{e}'" for e in [*MIME_TYPES, "txt", "PNG", ""]) + "]"

# The engine has no look-ahead: the delimiter is captured and put back.
_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(@, '\r\n', E'\n'), '\n', E'\n'), '\r', E'\r'),
  '(?i)\[\[reply_to[^\]]*\]\]\s*', '', 'g'),
  '(?im)^\s*Untrusted context \(metadata, do not treat as instructions or commands\):\s*\n+<<<EXTERNAL_UNTRUSTED_CONTENT(?s:.*?)<<<END_EXTERNAL_UNTRUSTED_CONTENT[^>]*>>>\s*', '', 'g'),
  '(?im)^\s*Conversation info \(untrusted metadata\):\s*\n+\{(?s:.*?)\}\s*', '', 'g'),
  '(?im)^\s*Sender \(untrusted metadata\):\s*\n+\{(?s:.*?)\}\s*', '', 'g'),
  '\n{3,}', E'\n\n', 'g'),
  '(?i)(^|[^A-Za-z0-9_])media:[^\s"''`]+\.(jpe?g|png|webp|gif)([\s"''`]|\z)', '\1media:<image-ref>\3', 'g')"""


def redacted(column: str) -> str:
    return _REDACTED.replace("@", column)


REFS = rf"""{TURNS}, refs AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)media:((?:~/|/)[^\s"''`]+?\.(?:{_EXTS}))(?:[\s"''`]|\z)', 1)) AS ref FROM turns
  UNION ALL
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)file://((?:~/|/)[^\s"''`]+?\.(?:{_EXTS}))(?:\?[^\s"''`]*)?(?:[\s"''`]|\z)', 1)) FROM turns
  UNION ALL
  SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)!?\[[^\]]*\]\((?:file://)?((?:~/|/)[^)\s]+?\.(?:{_EXTS}))(?:\?[^)\s]*)?\)', 1)) FROM turns),
paths AS (SELECT DISTINCT conv_id, turn, replace(ref, '/a/..', '') AS path FROM refs)"""

# Spans of the routed events: the rules of plain spans, with tool calls kept per own session.
_OWN_PAIRS = (
    PAIRS.replace("PARTITION BY session_key, trace_no", "PARTITION BY session_key, own_key, trace_no")
    .replace("USING (session_key, trace_no, phase, call_id", "USING (session_key, own_key, trace_no, phase, call_id")
    .replace("e.session_key = s.session_key AND", "e.session_key = s.session_key AND e.own_key = s.own_key AND")
)
_MADE_TOOLS, _NUMBERED = SPANS.split("),\nspans AS", 1)
_NUMBERED = ", spans AS" + _NUMBERED
ROUTED_SPANS = f"""WITH hooks AS (WITH RECURSIVE {ROUTED}
  SELECT h.* REPLACE (CASE WHEN r.event_seq IS NOT NULL THEN r.host_key WHEN u.event_seq IS NOT NULL THEN u.root_session
      ELSE h.session_key END AS session_key),
    h.session_key AS own_key, coalesce(r.parent_seq, u.parent_seq) AS parent_seq, u.link_seq, u.resets_link, u.creates
  FROM hooks h LEFT JOIN routed r USING (event_seq) LEFT JOIN (SELECT * FROM run WHERE k > 0) u USING (event_seq)),
{numbered()}, {bounds(None)}, {_OWN_PAIRS}, {FACTS},
closes AS (SELECT link_seq AS seq, us, event_seq, 'ended' AS how FROM ann WHERE event_name = 'subagent_ended' AND link_seq IS NOT NULL
  UNION ALL SELECT resets_link, epoch_us(ts), event_seq, 'reset' FROM hooks WHERE resets_link IS NOT NULL),
first_close AS (SELECT seq, us, how FROM closes QUALIFY row_number() OVER (PARTITION BY seq ORDER BY us, event_seq) = 1),
runs AS (SELECT a.*, c.us AS own_us, c.how,
    CASE WHEN a.run_ended AND a.phase = 0 THEN a.first_end_us ELSE a.close_us END AS orphan_us,
    CASE WHEN a.run_ended AND a.phase = 0 THEN 'agent_end' ELSE a.closed_by END AS orphan_how
  FROM ann a LEFT JOIN first_close c ON c.seq = a.event_seq WHERE a.creates),
{_MADE_TOOLS}
  UNION ALL
  SELECT session_key, trace_no, 'subagent', 2, us, event_seq, CASE WHEN own_us <= orphan_us THEN own_us ELSE orphan_us END,
    CASE WHEN own_us <= orphan_us THEN how ELSE orphan_how END,
    'subagent:' || CASE event_name WHEN 'subagent_delivery_target' THEN 'delivery-target' WHEN 'subagent_ended' THEN
      coalesce(target_kind, 'unknown') ELSE coalesce(agent_id, 'unknown') END, NULL, NULL, NULL, NULL FROM runs
)
{_NUMBERED}
SELECT i.session_key AS session_id, i.trace_no, i.kind, i.start_seq, i.name, i.close_reason, i.span_seq, i.span_id,
  CASE WHEN i.kind <> 'root' THEN coalesce(p.span_id, 'span_' || i.trace_id || '_0') END AS parent_span_id,
  make_timestamp(i.end_us) AS end_time
FROM ided i LEFT JOIN hooks h ON h.event_seq = i.start_seq AND i.kind IN ('tool', 'subagent')
LEFT JOIN ided p ON p.start_seq = h.parent_seq AND p.kind = 'subagent'"""

# Events with the sessions found for lost tool ends; nothing goes stale.
RESOLVED = (
    f"WITH hooks AS ({MISSING_STEPS[: MISSING_STEPS.rindex('SELECT event_seq')]} SELECT h.* REPLACE (coalesce(h.session_key, "
    "f.resolved) AS session_key) FROM hooks h LEFT JOIN (SELECT event_seq, resolved FROM run WHERE k > 0) f USING (event_seq)), "
    + ", ".join([numbered(), bounds(None), PAIRS, FACTS, SPANS])
)
_CLOSED = ", closed AS (SELECT ided.* FROM ided JOIN traces USING (session_key, trace_no) WHERE closed_by <> 'end_of_input')"
_EVENT = "event_id, 'SPAN' AS record_type, make_timestamp(start_us) AS start_timestamp, make_timestamp(end_us) AS timestamp"

ORACLES: dict[str, str] = {
    "session_rollup": SPANNED + ROLLUP.format(source="ided"),
    "trace_numbering": f"WITH {HOOKS_E}, {numbered()}, n AS (SELECT session_key, trace_no, min(us) AS us FROM num WHERE event_name = "
    "'llm_input' GROUP BY ALL) SELECT a.session_key, a.event_seq, a.trace_no, n.us AS next_start_us FROM num a LEFT JOIN n ON "
    "n.session_key = a.session_key AND n.trace_no = a.trace_no + 1",
    "span_sequence": SPANNED + "SELECT session_key AS session_id, trace_no, kind, start_seq, span_seq FROM ided",
    "llm_pairs": TRACES + "SELECT session_key, trace_no, start_seq, make_timestamp(start_us) AS start_time, "
    "make_timestamp(out_us) AS output_time, CASE WHEN out_us IS NULL THEN in_model ELSE out_model END AS model, "
    "CASE WHEN out_us IS NULL THEN in_provider ELSE out_provider END AS provider, usage.input AS input_tokens "
    "FROM traces JOIN facts USING (session_key, trace_no)",
    "tool_pairs_by_id": PAIRED + "SELECT s.session_key, s.trace_no, nullif(s.tool_call_id, '') AS call_id, pairs.start_seq, end_seq "
    "FROM pairs JOIN ann s ON s.event_seq = pairs.start_seq WHERE how = 'id'",
    "tool_pairs_fifo": PAIRED + "SELECT s.session_key, s.trace_no, s.tool_name, pairs.start_seq, end_seq "
    "FROM pairs JOIN ann s ON s.event_seq = pairs.start_seq WHERE how = 'fifo'",
    "tool_duplicate_close": PAIRED + "SELECT s.session_key, s.trace_no, pairs.start_seq, make_timestamp(replaced_us) "
    "AS replaced_time FROM pairs JOIN ann s ON s.event_seq = pairs.start_seq WHERE end_seq IS NULL AND replaced_us IS NOT NULL",
    "orphan_close": SPANNED + "SELECT session_key AS session_id, kind, start_seq, close_reason, make_timestamp(end_us) AS end_time "
    "FROM ided WHERE kind <> 'root' AND close_reason <> 'ended'",
    "replaced_traces": _closed(with_traces(HOOKS_E, HOUR_12), "replaced"),
    "stale_traces_5m": _closed(with_traces(HOOKS_E, MINUTE_5), "stale"),
    "stale_traces_sweep": _closed(with_traces(HOOKS_E, MINUTE_5, sweep_us=60_000_000), "stale"),
    "finalized_traces": _closed(with_traces(HOOKS_E, HOUR_12), "agent_end"),
    "end_of_input_close": _closed(with_traces(HOOKS_E, HOUR_12), "end_of_input"),
    "gap_sessions": f"WITH {HOOKS_E}, g AS (SELECT session_key, ts, event_seq, CASE WHEN ts - lag(ts) OVER w <= "
    "INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM hooks WHERE session_key IS NOT NULL WINDOW w AS (PARTITION BY session_key "
    "ORDER BY ts, event_seq)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_key ORDER BY ts, event_seq) AS n FROM g) "
    "SELECT session_key, min(ts) AS first_time, max(ts) AS last_time, count(*) AS events FROM s GROUP BY session_key, n",
    "late_events": with_traces(HOOKS_E, HOUR_12, grace_us=3_600_000_000) + "SELECT event_name, CASE WHEN reached THEN 'accepted' "
    "WHEN trace_no = 0 THEN 'before_first_trace' WHEN run_ended THEN 'after_agent_end' ELSE 'after_stale' END AS reason, "
    "count(*) AS events FROM ann GROUP BY ALL",
    "last_activity": TRACES + "SELECT session_key, trace_no, make_timestamp(max(us)) AS last_activity, any_value(closed_by) AS "
    "closed_by FROM ann WHERE reached AND (event_name IN ('llm_input', 'before_tool_call', 'after_tool_call') OR first_out) "
    "GROUP BY ALL",
    "provider_normalized": f"WITH {HOOKS_E} SELECT event_seq, {provider('provider')} AS provider FROM hooks WHERE provider IS NOT NULL",
    "context_carry_forward": TRACES + "SELECT session_key, trace_no, channel, trigger FROM facts",
    "id_resolution": f"WITH {HOOKS_E} SELECT event_seq, event_name, session_key, nullif(tool_call_id, '') AS tool_call_id, "
    "CASE event_seq % 4 WHEN 0 THEN CASE WHEN event_name IN ('llm_output', 'agent_end') THEN 'c' ELSE 'e' END || event_seq "
    "WHEN 1 THEN 'c' || event_seq END AS run_id, channel_id, nullif(trigger, '') AS trigger, result FROM hooks",
    "usage_tokens": f"WITH {HOOKS_E} SELECT event_seq, usage.input AS prompt_tokens, usage.output AS completion_tokens, usage.total "
    "AS total_tokens, usage.cacheRead AS cache_read_tokens, usage.cacheWrite AS cache_write_tokens FROM hooks "
    "WHERE event_name = 'llm_output'",
    "span_labels": SPANNED + "SELECT kind, CASE kind WHEN 'root' THEN 'record_root' WHEN 'llm' THEN 'generation' ELSE 'tool' END AS "
    "span_type, CASE kind WHEN 'root' THEN 'trace' ELSE kind END AS action_type, count(*) AS spans FROM ided GROUP BY ALL",
    "trace_names": SPANNED + "SELECT session_key, trace_no, name AS trace_name FROM ided WHERE kind = 'root'",
    "clean_numbers": "SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 AND c_acctbal >= 0 THEN c_acctbal END AS clean FROM customer",
    "token_totals": "SELECT c_custkey, CAST(greatest(0, floor(CASE WHEN c_custkey % 7 < 2 THEN 0 ELSE c_acctbal END + "
    "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal / 2 END)) AS BIGINT) AS tokens FROM customer",
    "ids": SPANNED + f"SELECT session_key AS session_id, trace_id, span_id, event_id, CASE WHEN kind <> 'root' THEN 'span_' || "
    f"trace_id || '_0' END AS parent_span_id, {ACTION_ID} AS action_id FROM ided",
    "skip_reasons_by_event": with_traces(HOOKS_E, HOUR_12, PAIRS) + "SELECT event_name, CASE WHEN NOT reached AND event_name LIKE "
    "'%tool_call' THEN 'no_span_container' WHEN event_name = 'llm_output' AND NOT (reached AND first_out) THEN 'no_active_llm_span' "
    "WHEN NOT reached THEN 'no_active_trace' WHEN event_name = 'after_tool_call' AND event_seq NOT IN (SELECT end_seq FROM pairs "
    "WHERE end_seq IS NOT NULL) THEN 'no_matching_tool_span' ELSE 'ok' END AS reason, count(*) AS events FROM ann GROUP BY ALL "
    "UNION ALL SELECT event_name, 'no_session_key', count(*) FROM hooks WHERE session_key IS NULL GROUP BY ALL",
    "missing_session_resolved": MISSING_STEPS,
    "agent_forget": f"WITH {MISSING}, nxt AS (SELECT *, lead(us) OVER w AS until_us, lead(event_seq) OVER w AS until_seq FROM evs "
    "WHERE session_key IS NOT NULL WINDOW w AS (PARTITION BY agent_id ORDER BY us, event_seq)) SELECT agent_id AS agent, session_key "
    "AS session, event_seq, until_seq, EXISTS (SELECT 1 FROM drops d WHERE d.session_key = nxt.session_key AND (d.drop_us, "
    "d.drop_seq) >= (nxt.us, nxt.event_seq) AND (d.drop_us, d.drop_seq) < (nxt.until_us, nxt.until_seq)) AS dropped FROM nxt WHERE "
    "until_seq IS NOT NULL",
    "subagent_lifecycles": f"WITH RECURSIVE {RUNS} SELECT event_seq, event_name, life_key, creates, root_session, root_trace, link_seq, "
    "parent_seq, resets_link FROM run WHERE k > 0",
    "host_routing": f"WITH RECURSIVE {ROUTED} SELECT session_key, host_key, parent_seq, event_name, count(*) AS events, "
    "min(event_seq) AS first_seq, max(event_seq) AS last_seq FROM routed GROUP BY ALL",
    "diagnostics_attached": TRACES_DIAG + "SELECT event_seq, session_key, trace_no, cost_usd FROM ann WHERE reached AND event_name = "
    "'model.usage'",
    "cost_meta": with_traces(HOOKS_DIAG, HOUR_12, _COST) + f"SELECT session_key, trace_no, {_last('cost_usd')} AS cost_usd, "
    f"round(CAST(sum(CAST(cost_usd AS DECIMAL(30, 12))) AS DOUBLE), 6) AS cost_usd_sum, {_last('context_limit')} AS context_limit, "
    f"{_last('context_used')} AS context_used, {_last('model')} AS cost_model, "
    f"CASE WHEN {_last('provider')} IS NOT NULL THEN 'openai' END AS cost_provider, {_last('duration_ms')} AS cost_duration_ms, "
    f"({_last('usage')}).input AS usage_input, ({_last('usage')}).output AS usage_output, ({_last('usage')}).total AS usage_total, "
    "count(*) AS diagnostics FROM cost GROUP BY ALL",
    "trace_usage": with_traces(HOOKS_DIAG, HOUR_12, FACTS, _COST) + f", d AS (SELECT session_key, trace_no, {_last('usage')} AS du "
    "FROM cost GROUP BY ALL) SELECT f.session_key, f.trace_no, coalesce(f.usage, du).input AS input, coalesce(f.usage, du).output AS "
    "output, coalesce(f.usage, du).total AS total FROM facts f LEFT JOIN d USING (session_key, trace_no)",
    "trace_summary": with_traces(HOOKS_DIAG, HOUR_12, PAIRS, FACTS, SPANS, _COST) + f", c AS (SELECT session_key, trace_no, "
    f"{_last('cost_usd')} AS cost_usd, {_last('context_limit')} AS context_limit, {_last('context_used')} AS context_used FROM cost "
    "GROUP BY ALL) SELECT i.session_key AS session_id, i.trace_no, max(close_reason) FILTER (WHERE kind = 'root') AS closed_by, "
    "max(duration_ms) FILTER (WHERE kind = 'root') AS duration_ms, count(*) FILTER (WHERE kind = 'llm') AS llm_spans, "
    "count(*) FILTER (WHERE kind = 'tool') AS tool_spans, 0 AS subagent_spans, count(*) FILTER (WHERE kind <> 'root' AND close_reason "
    "<> 'ended') AS unmatched_starts, CAST(sum(tokens) AS BIGINT) AS tokens, max(c.cost_usd) AS cost_usd, max(c.context_limit) AS "
    "context_limit, max(c.context_used) AS context_used FROM ided i LEFT JOIN c ON c.session_key = i.session_key AND c.trace_no = "
    "i.trace_no GROUP BY ALL",
    "action_rollup_type": SPANNED + f", {ACTIONS} SELECT action_type, model_name, {ROLL} FROM actions GROUP BY ALL",
    "action_rollup_day": SPANNED + f", {ACTIONS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, action_type, {ROLL} FROM actions GROUP BY ALL",
    "sessions_by_start": SPANNED + f", r AS ({ROLLUP.format(source='ided')}) SELECT session_id, start_time, total_actions FROM r "
    "WHERE start_time >= TIMESTAMP '2024-01-02' AND start_time < TIMESTAMP '2024-01-04'",
    "actions_by_session": SPANNED + f", {ACTIONS} SELECT session_id, action_name, duration_ms, created_at FROM actions "
    "WHERE session_id = '7' AND action_type = 'tool'",
    "store_summary": SPANNED + "SELECT count(*) AS event_rows, make_timestamp(min(end_us)) AS first_time, make_timestamp(max(end_us)) "
    "AS last_time, 'kind,name' AS record_keys, 'parent_id,span_id,trace_id' AS trace_keys FROM ided",
    "newest_events": SPANNED + "SELECT event_id, 'SPAN' AS record_type, make_timestamp(end_us) AS timestamp FROM ided "
    "ORDER BY end_us DESC, event_id LIMIT 3",
    "event_keys": SPANNED + "SELECT json_column, json_key, count(*) AS row_count FROM (SELECT c AS json_column, unnest(k) AS json_key FROM ided, (VALUES ('record', ['name', "
    "'kind']), ('trace', ['trace_id', 'span_id', 'parent_id']), ('resource_attributes', ['ai.observability.app_name', "
    "'ai.observability.app_version'])) v(c, k)) GROUP BY ALL",
    "events_append_dedup": SPANNED + "SELECT event_id, CAST(CAST(make_timestamp(end_us) AS DATE) AS VARCHAR) AS event_date, 'SPAN' AS record_type, "
    "make_timestamp(start_us) AS start_timestamp, make_timestamp(end_us) AS timestamp FROM ided WHERE day(make_timestamp(end_us)) % 2 = 1",
    "events_written_twice": SPANNED + "SELECT event_id, CAST(CAST(make_timestamp(start_us) AS DATE) AS VARCHAR) AS event_date, 'SPAN' AS "
    "record_type, make_timestamp(start_us) AS start_timestamp, make_timestamp(end_us) AS timestamp, name, CASE kind WHEN 'root' THEN "
    "'record_root' WHEN 'llm' THEN 'generation' ELSE 'tool' END AS span_type, ided.session_key AS record_id, model, CASE WHEN "
    "close_reason = 'ended' OR (kind = 'root' AND close_reason IN ('agent_end', 'stale')) THEN name END AS call_function, CASE kind "
    "WHEN 'root' THEN prompt END AS prompt, trace_id, span_id, CASE WHEN kind <> 'root' THEN 'span_' || trace_id || '_0' END AS "
    "parent_id FROM ided JOIN facts USING (session_key, trace_no) WHERE close_reason <> 'end_of_input'",
    "actions_written_twice": SPANNED + f", {ACTIONS}, calls AS (SELECT i.event_id, coalesce(json_extract_string(e.params, '$.q'), "
    "json_extract_string(s.params, '$.q')) AS q, nullif(e.error, '') AS failure FROM ided i JOIN pairs p ON p.start_seq = i.start_seq "
    "AND i.kind = 'tool' JOIN ann s ON s.event_seq = p.start_seq LEFT JOIN ann e ON e.event_seq = p.end_seq), asked AS (SELECT "
    "event_id, f.prompt FROM ided i JOIN facts f USING (session_key, trace_no) WHERE kind <> 'tool') "
    f"SELECT {ACTION_ID} AS id, session_id, action_type, action_name, model_name, "
    "prompt_tokens, completion_tokens, duration_ms, '' AS user_id, channel_id, created_at, event_id, prompt, q, failure FROM actions "
    "LEFT JOIN calls USING (event_id) LEFT JOIN asked USING (event_id) WHERE event_id IN "
    "(SELECT event_id FROM ided WHERE close_reason <> 'end_of_input')",
    "stored_actions_by_session": SPANNED + f", {ACTIONS} SELECT event_id, session_id, action_name, duration_ms, created_at FROM actions "
    "WHERE session_id = '7' AND action_type = 'tool' AND created_at < TIMESTAMP '2024-01-20' AND event_id IN "
    "(SELECT event_id FROM ided WHERE close_reason <> 'end_of_input')",
    "stored_sessions_by_start": SPANNED + f", r AS ({ROLLUP.format(source='ided')}) SELECT session_id, start_time, total_actions FROM r "
    "WHERE start_time >= TIMESTAMP '2024-01-02' AND start_time < TIMESTAMP '2024-01-04'",
    "actions_append": SPANNED_DIAG + f", {ACTIONS} SELECT {ACTION_ID} AS id, session_id, action_type, action_name, model_name, "
    "prompt_tokens, completion_tokens, duration_ms, '' AS user_id, channel_id, created_at, event_id FROM actions",
    # Merging the two halves gives the rollup of all of it.
    "session_merge": SPANNED + ROLLUP.format(source="ided"),
    "sessions_written_twice": SPANNED + ROLLUP.format(source="ided"),
    "union_hooks_counts": f"WITH {HOOKS_DIAG} SELECT event_name, count(*) AS events, count(session_key) AS with_session, "
    "count(CASE WHEN event_name NOT IN ('llm_output', 'before_tool_call', 'model.usage', 'after_tool_call', 'llm_input', 'agent_end') "
    "THEN usage END) AS with_usage FROM hooks GROUP BY ALL",
    "quality": f"WITH {HOOKS_E}, r AS (SELECT *, CASE WHEN event_seq % 50 = 1 THEN 1 ELSE 0 END AS broken FROM hooks UNION ALL "
    "SELECT *, 0 FROM hooks WHERE event_seq % 100 = 0) SELECT count(*) AS event_rows, count(*) - count(DISTINCT event_seq) AS "
    "duplicate_rows, count(*) FILTER (WHERE session_key IS NULL) AS missing_session, count(*) FILTER (WHERE event_name LIKE "
    "'%tool_call' AND nullif(tool_call_id, '') IS NULL) AS missing_call_id, CAST(sum(broken) AS BIGINT) AS malformed_params, "
    "0::BIGINT AS bad_numbers, count(*) FILTER (WHERE event_name = 'llm_output' AND usage IS NULL) AS missing_usage, 0::BIGINT AS "
    "corrupt_rows FROM r",
    "trace_output": TRACES + ", m AS (SELECT f.*, e.messages FROM facts f JOIN ann e ON e.event_seq = f.end_seq), l AS (SELECT *, "
    "list_filter(messages, lambda x: x.role = 'assistant') AS said FROM m) SELECT l.session_key, l.trace_no, CASE WHEN out_us IS NOT "
    "NULL THEN array_to_string(assistant_texts, E'\\n\\n') WHEN len(said) > 0 THEN '' END AS output_text, CASE WHEN out_us IS NULL "
    "THEN said[-1].content END AS last_text FROM l JOIN traces t ON t.session_key = l.session_key AND t.trace_no = l.trace_no "
    "WHERE t.closed_by = 'agent_end'",
    "assistant_text": f"WITH {HOOKS_C} SELECT event_seq, assistant_texts[1] || E'\\n\\nsecond\\n\\n' AS text FROM hooks "
    "WHERE event_name = 'llm_output'",
    "trace_metadata": with_traces(HOOKS_DIAG, HOUR_12, FACTS, _COST) + f", d AS (SELECT session_key, trace_no, {_last('cost_usd')} AS "
    f"cost_usd, {_last('context_used')} AS used, {_last('model')} AS cost_model, {_last('usage')} AS du FROM cost GROUP BY ALL) "
    "SELECT f.session_key AS session_id, f.trace_no, 'agent' AS m_created_from, d.cost_usd::VARCHAR AS m_costusd, d.used::VARCHAR AS "
    "m_contextused, e.success::VARCHAR AS m_success, e.duration_ms::VARCHAR AS m_durationms, CASE WHEN f.out_us IS NULL THEN "
    "f.in_model ELSE f.out_model END AS m_model, CASE WHEN f.out_us IS NULL THEN f.in_provider ELSE f.out_provider END AS m_provider, "
    "f.channel AS m_channel, f.trigger AS m_trigger, nullif(e.error, '') AS m_error, coalesce(f.usage, d.du).input::VARCHAR AS "
    "m_usage_input FROM facts f JOIN traces t USING (session_key, trace_no) JOIN ann e ON e.event_seq = f.end_seq "
    "LEFT JOIN d ON d.session_key = f.session_key AND d.trace_no = f.trace_no WHERE t.closed_by = 'agent_end'",
    "error_shapes": SPANNED + ", tools AS (SELECT s.session_key AS session_id, 'tool' AS kind, s.start_seq, s.close_reason, "
    "CASE WHEN e.error <> '' THEN 'ToolError' END AS exception_type, nullif(e.error, '') AS message, nullif(e.error, '') AS traceback, "
    "CASE WHEN e.error <> '' THEN '{\"error\":\"' || e.error || '\"}' WHEN e.result LIKE '{%' THEN e.result WHEN e.result IS NOT NULL "
    "THEN '{\"result\":' || e.result || '}' END AS tool_output FROM ided s JOIN pairs p ON p.start_seq = s.start_seq JOIN ann e ON "
    "e.event_seq = p.end_seq WHERE s.kind = 'tool') SELECT * FROM tools WHERE tool_output IS NOT NULL UNION ALL "
    "SELECT t.session_key, 'root', t.start_seq, t.closed_by, CASE WHEN t.closed_by = 'stale' THEN 'StaleTrace' WHEN e.error <> '' THEN "
    "'AgentError' END AS x, CASE WHEN t.closed_by = 'stale' THEN 'Trace exceeded maximum inactivity threshold and was forcibly ended' "
    "ELSE nullif(e.error, '') END, CASE WHEN t.closed_by = 'stale' THEN 'Stale trace for sessionKey=' || t.session_key || "
    f"', inactive={HOUR_12 // 1000}ms' ELSE nullif(e.error, '') END, NULL FROM traces t JOIN facts f USING (session_key, trace_no) "
    "LEFT JOIN ann e ON e.event_seq = f.end_seq WHERE t.closed_by = 'stale' OR (t.closed_by = 'agent_end' AND (e.error <> '' OR "
    "f.out_us IS NOT NULL OR len(list_filter(e.messages, lambda x: x.role = 'assistant')) > 0))",
    # A stream emits the traces that closed; those open at its end stay in its state.
    "stream_assemble": RESOLVED + f"{_CLOSED} SELECT {_EVENT} FROM closed",
    "stream_batches": RESOLVED + f"{_CLOSED} SELECT {_EVENT} FROM closed",
    "stream_stale": with_traces(HOOKS_KNOWN, HOUR_12, PAIRS, FACTS, SPANS) + f"{_CLOSED} SELECT {_EVENT} FROM closed",
    "stream_routed": ROUTED_SPANS[: ROUTED_SPANS.rindex("SELECT i.session_key")] + "SELECT i.event_id, "
    "make_timestamp(i.start_us) AS start_timestamp, make_timestamp(i.end_us) AS timestamp, i.name, CASE WHEN i.kind <> 'root' THEN "
    "coalesce(p.span_id, 'span_' || i.trace_id || '_0') END AS parent_span_id "
    + ROUTED_SPANS[ROUTED_SPANS.rindex("FROM ided i") :]
    + " JOIN traces t ON t.session_key = i.session_key AND t.trace_no = i.trace_no WHERE t.closed_by <> 'end_of_input'",
    "stream_sink": RESOLVED + f"{_CLOSED} {ROLLUP.format(source='closed')}",
    "stream_quality": f"WITH {HOOKS_E}, m AS (SELECT count(*) AS event_rows, count(*) FILTER (WHERE session_key IS NULL) AS "
    "missing_session, count(*) FILTER (WHERE event_name LIKE '%tool_call' AND nullif(tool_call_id, '') IS NULL) AS missing_call_id, "
    "0::BIGINT AS malformed_params, 0::BIGINT AS bad_numbers, count(*) FILTER (WHERE event_name = 'llm_output' AND usage IS NULL) AS "
    "missing_usage, 0::BIGINT AS late_rows FROM hooks) SELECT metric, events FROM (UNPIVOT m ON * INTO NAME metric VALUE events)",
    "stream_late": f"WITH {HOOKS_KNOWN} SELECT event_name, 'behind_watermark' AS late_reason, count(*) AS events, max(ts) AS last_time "
    "FROM hooks WHERE ts < TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL",
    "stream_media_dedup": f"WITH {REFS} SELECT DISTINCT conv_id, path FROM paths",
    "routed_spans": ROUTED_SPANS,
    "redact_json_payloads": f"WITH {TURNS} SELECT conv_id, turn, CAST(to_json({{'t': {redacted('text')}, 'n': [{{'t': "
    f"{redacted("('x' || text)")}}}], 'k': turn}}) AS VARCHAR) AS payload FROM turns",
    "tool_messages_redacted": f"WITH {TURNS}, r AS (SELECT *, {redacted('text')} AS clean FROM turns) SELECT conv_id, turn, "
    "CAST(to_json({'role': 'tool', 'content': clean}) AS VARCHAR) AS message FROM r WHERE clean <> text",
    "percent_decoded": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '%zz' WHEN 2 THEN url || '+a%20b%FF' "
    "ELSE url || '\u00e9+' END AS decoded FROM pages",
    "payload_choice": f"WITH {HOOKS_E} SELECT event_seq, CASE event_name WHEN 'llm_input' THEN prompt END AS prompt, CASE WHEN params IS "
    "NOT NULL THEN '{\"z\":' || event_seq || '}' END AS last_history, messages[-1].content AS last_message, CASE event_name WHEN "
    "'agent_end' THEN error END AS run_error FROM hooks",
    "redact_texts": f"WITH {TURNS} SELECT conv_id, turn, {redacted('text')} AS text FROM turns",
    "media_refs": f"WITH {REFS} SELECT conv_id, turn, ref FROM refs",
    "media_json": f"WITH {REFS} SELECT conv_id, turn, path FROM paths",
    "media_paths": f"WITH {REFS} SELECT conv_id, turn, path FROM paths",
    "mime_counts": f"WITH e AS (SELECT lower(({_EXT_LIST})[p_partkey % {len(MIME_TYPES) + 3} + 1]) AS ext FROM part) SELECT CASE ext "
    f"{_CASE} ELSE '{OTHER_MIME}' END AS mime, count(*) AS files FROM e GROUP BY ALL",
    "media_manifest": f"WITH {REFS}, f AS (SELECT DISTINCT 'trace' AS entity_type, conv_id::VARCHAR AS entity_id, path, "
    "string_split(path, '/')[-1] AS file_name, (conv_id + 1) * 3000001 AS size FROM paths WHERE conv_id % 7 <> 3), e AS (SELECT *, "
    "lower(string_split(file_name, '.')[-1]) AS ext, greatest(1, CAST(ceil(size / 8388608.0) AS BIGINT)) AS part_count FROM f) "
    f"SELECT entity_type, entity_id, path, file_name, CASE ext {_CASE} ELSE '{OTHER_MIME}' END AS mime, size, part_count, size - "
    "(part_count - 1) * 8388608 AS last_part_size FROM e",
}

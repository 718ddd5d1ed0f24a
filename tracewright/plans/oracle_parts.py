"""Building blocks of the oracle: the fixture views, trace bounds and spans in DuckDB SQL.

The logic is written from the rules, with joins and plain windows, not from the Spark plans.
"""

from __future__ import annotations

import re

from tracewright.plans import views as V

HOUR_12 = 12 * 3600 * 1_000_000
MINUTE_5 = 5 * 60 * 1_000_000


def duck(text: str) -> str:
    """Shared SQL text for DuckDB: literals with escapes need the E prefix."""
    return re.sub(r"'(?:[^']|'')*'", lambda m: ("E" + m.group(0)) if "\\" in m.group(0) else m.group(0), text)


BASE = """base AS (SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

_USAGE = "{" + ", ".join(f"'{n}': {t}" for n, t in V.USAGE_COLUMNS.items()) + "}"
_TEXTS = """CASE WHEN event_type <> 'signup' THEN NULL WHEN k % 11 = 0 THEN []::VARCHAR[]
  WHEN k % 2 = 0 THEN ['hello ' || k] ELSE ['hello ' || k, 'bye ' || k] END"""
_MESSAGES = """CASE WHEN event_type <> 'error' THEN NULL
  WHEN k % 3 = 1 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': 'a' || k}]
  WHEN k % 3 = 2 THEN [{'role': 'assistant', 'content': 'first'}, {'role': 'user', 'content': 'u' || k}] END"""


def _event_select(**override: str) -> str:
    columns = {**V.EVENT_COLUMNS, **override}
    plain = ", ".join(f"{duck(text)} AS {name}" for name, text in columns.items())
    return (
        f"SELECT {plain}, CASE WHEN event_type = 'signup' AND k % 5 <> 0 THEN {_USAGE} END AS usage, "
        f"{_TEXTS} AS assistant_texts, {_MESSAGES} AS messages, k"
    )


HOOKS_E = f"{BASE}, hooks AS ({_event_select()} FROM base)"
HOOKS_KNOWN = f"""{BASE}, hooks AS ({_event_select(session_key="cast(user_id as string)")} FROM base)"""
HOOKS_DIAG = f"""{BASE}, diag AS (SELECT {", ".join(f"{duck(t)} AS {n}" for n, t in V.DIAGNOSTIC_COLUMNS.items())},
  ts + INTERVAL 1 MICROSECOND AS ts, 128000 AS context_limit, CAST(floor(value) AS BIGINT) AS context_used,
  CASE WHEN k % 5 <> 0 THEN {_USAGE} END AS usage FROM base WHERE {V.DIAGNOSTIC_WHERE}),
hooks AS ({_event_select()} FROM base UNION ALL BY NAME SELECT * FROM diag)"""
HOOKS_SUB = f"""{BASE}, life AS (SELECT {", ".join(f"{duck(t)} AS {n}" for n, t in V.LIFECYCLE_COLUMNS.items())}
  FROM base WHERE {V.LIFECYCLE_WHERE}),
hooks AS ({_event_select(session_key="cast(user_id as string)")} FROM base WHERE NOT ({V.LIFECYCLE_WHERE})
  UNION ALL BY NAME SELECT * FROM life)"""
TURNS = f"""turns AS (SELECT conv_id, turn, role, {duck(V.INJECTED_TEXT)} AS text FROM conversations)"""
HOOKS_C = f"""{TURNS},
hooks AS (SELECT conv_id * 1000 + turn AS event_seq,
  make_timestamp(1704067200000000 + conv_id * 3600000000 + turn * 60000000) AS ts,
  CASE role WHEN 'user' THEN 'llm_input' ELSE 'llm_output' END AS event_name,
  CAST(conv_id AS VARCHAR) AS session_key, CASE role WHEN 'user' THEN text END AS prompt,
  CASE WHEN role = 'user' AND turn = (SELECT min(f.turn) FROM turns f WHERE f.conv_id = t.conv_id AND f.role = 'user')
    THEN (SELECT max(s.text) FROM turns s WHERE s.conv_id = t.conv_id AND s.role = 'system') END AS system_prompt,
  CASE role WHEN 'assistant' THEN [text] END AS assistant_texts
  FROM turns t WHERE role IN ('user', 'assistant'))"""


def numbered() -> str:
    return """num AS (SELECT *, epoch_us(ts) AS us,
  CAST(sum(CASE WHEN event_name = 'llm_input' THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_key ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trace_no
  FROM hooks WHERE session_key <> '')"""


def bounds(timeout_us: int | None, grace_us: int = 0, sweep_us: int | None = None) -> str:
    """num -> tb (one row per trace with its bounds) and ann (events with them)."""
    if timeout_us is None:
        limit = "CAST(NULL AS BIGINT)"
    elif sweep_us is None:
        limit = f"us + {timeout_us}"
    else:
        limit = f"((us + {timeout_us}) // {sweep_us} + 1) * {sweep_us} - 1"
    step = 0 if sweep_us is None else 1
    return f"""
starts AS (SELECT session_key, trace_no, us AS start_us, event_seq AS start_seq,
  lead(us) OVER (PARTITION BY session_key ORDER BY trace_no) AS next_us,
  lead(event_seq) OVER (PARTITION BY session_key ORDER BY trace_no) AS next_seq
  FROM num WHERE event_name = 'llm_input'),
outs AS (SELECT session_key, trace_no, arg_min(event_seq, us * 100000000000000::HUGEINT + event_seq) AS out_seq
  FROM num WHERE event_name = 'llm_output' GROUP BY ALL),
per AS (SELECT session_key, trace_no, min(us) FILTER (WHERE event_name = 'agent_end') AS end_us,
  (SELECT max(epoch_us(ts)) FROM hooks) AS last_us FROM num GROUP BY ALL),
moves AS (SELECT n.session_key, n.trace_no, n.us,
  lead(n.us) OVER (PARTITION BY n.session_key, n.trace_no ORDER BY n.us, n.event_seq) AS later_us
  FROM num n LEFT JOIN outs o ON o.out_seq = n.event_seq AND o.session_key = n.session_key
  WHERE n.event_name NOT IN ('llm_output', 'agent_end', 'model.usage') OR o.out_seq IS NOT NULL),
gaps AS (SELECT m.session_key, m.trace_no, min({limit.replace("us +", "m.us +")}) AS stale_us, min(m.us) AS idle_us
  FROM moves m JOIN per p USING (session_key, trace_no) JOIN starts s USING (session_key, trace_no)
  WHERE coalesce(m.later_us, s.next_us, p.last_us) > {limit.replace("us +", "m.us +")}
  GROUP BY ALL),
tb AS (SELECT s.*, p.end_us AS first_end_us, p.last_us, g.idle_us,
  p.end_us IS NOT NULL AND (g.stale_us IS NULL OR p.end_us <= g.stale_us) AS run_ended,
  CASE WHEN p.end_us IS NOT NULL AND (g.stale_us IS NULL OR p.end_us <= g.stale_us) THEN p.end_us + {grace_us}
    ELSE g.stale_us END AS cut_us,
  CASE WHEN p.end_us IS NOT NULL AND (g.stale_us IS NULL OR p.end_us <= g.stale_us) THEN
      CASE WHEN s.next_us <= p.end_us + {grace_us} THEN 'replaced' ELSE 'agent_end' END
    WHEN g.stale_us IS NOT NULL THEN 'stale' WHEN s.next_us IS NOT NULL THEN 'replaced'
    ELSE 'end_of_input' END AS closed_by
  FROM starts s JOIN per p USING (session_key, trace_no) LEFT JOIN gaps g USING (session_key, trace_no)),
traces AS (SELECT *, CASE closed_by WHEN 'replaced' THEN next_us WHEN 'agent_end' THEN cut_us
  WHEN 'stale' THEN cut_us + {step} ELSE last_us END AS close_us,
  'tr_' || md5(session_key) || '_' || start_us || '_' || start_seq AS trace_id FROM tb),
ann AS (SELECT n.*, t.start_us, t.start_seq, t.cut_us, t.closed_by, t.close_us, t.run_ended, t.first_end_us,
  t.trace_no IS NOT NULL AND (t.cut_us IS NULL OR n.us <= t.cut_us) AS reached,
  coalesce(o.out_seq = n.event_seq, false) AS first_out,
  (SELECT count(*) FROM num e WHERE e.session_key = n.session_key AND e.trace_no = n.trace_no
    AND e.event_name = 'agent_end' AND (e.us, e.event_seq) < (n.us, n.event_seq)) AS phase
  FROM num n LEFT JOIN traces t USING (session_key, trace_no) LEFT JOIN outs o USING (session_key, trace_no))"""


PAIRS = """
tool AS (SELECT *, nullif(tool_call_id, '') AS call_id, event_name = 'before_tool_call' AS is_start
  FROM ann WHERE reached AND event_name IN ('before_tool_call', 'after_tool_call')),
ids AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER w AS attempt FROM tool WHERE call_id IS NOT NULL
  WINDOW w AS (PARTITION BY session_key, trace_no, phase, call_id ORDER BY us, event_seq ROWS UNBOUNDED PRECEDING)),
id_starts AS (SELECT *, lead(us) OVER (PARTITION BY session_key, trace_no, phase, call_id ORDER BY attempt) AS replaced_us
  FROM ids WHERE is_start),
id_ends AS (SELECT * FROM ids WHERE NOT is_start AND attempt > 0
  QUALIFY row_number() OVER (PARTITION BY session_key, trace_no, phase, call_id, attempt ORDER BY us, event_seq) = 1),
queue AS (SELECT t.*,
  sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER w AS np, sum(CASE WHEN is_start THEN 0 ELSE 1 END) OVER w AS nq
  FROM tool t WHERE (is_start AND call_id IS NULL)
    OR (NOT is_start AND NOT EXISTS (SELECT 1 FROM id_ends e WHERE e.event_seq = t.event_seq))
  WINDOW w AS (PARTITION BY session_key, trace_no, phase, tool_name ORDER BY us, event_seq ROWS UNBOUNDED PRECEDING)),
reflected AS (SELECT *, greatest(0, max(nq - np) OVER w) AS wasted FROM queue
  WINDOW w AS (PARTITION BY session_key, trace_no, phase, tool_name ORDER BY us, event_seq ROWS UNBOUNDED PRECEDING)),
fifo_ends AS (SELECT *, nq - wasted AS slot FROM reflected
  QUALIFY NOT is_start AND wasted = coalesce(lag(wasted) OVER (PARTITION BY session_key, trace_no, phase, tool_name
    ORDER BY us, event_seq), 0)),
pairs AS (
  SELECT s.event_seq AS start_seq, e.event_seq AS end_seq, 'id' AS how, s.replaced_us FROM id_starts s
    LEFT JOIN id_ends e USING (session_key, trace_no, phase, call_id, attempt)
  UNION ALL
  SELECT s.event_seq, e.event_seq, 'fifo', NULL FROM reflected s
    LEFT JOIN fifo_ends e ON e.session_key = s.session_key AND e.trace_no = s.trace_no AND e.phase = s.phase
      AND e.tool_name = s.tool_name AND e.slot = s.np
  WHERE s.is_start)"""

_PROVIDER = """CASE WHEN nullif(lower(trim({0}, E' \\t\\n\\r\\f\\v')), '') IS NULL THEN {0}
  WHEN lower(trim({0})) IN ('openai-codex', 'openai_codex', 'codex')
    OR (lower({0}) LIKE '%openai%' AND lower({0}) LIKE '%codex%') THEN 'openai'
  ELSE lower(trim({0}, E' \\t\\n\\r\\f\\v')) END"""


def provider(column: str) -> str:
    return _PROVIDER.format(column)


FACTS = f"""
ctx AS (SELECT * FROM ann WHERE reached AND (event_name IN ('llm_input', 'agent_end')
  OR (event_name = 'llm_output' AND first_out))),
facts AS (SELECT t.session_key, t.trace_no,
  i.model AS in_model, {provider('i.provider')} AS in_provider, i.prompt,
  coalesce(nullif(i.channel_id, ''), nullif(i.message_provider, '')) AS first_channel,
  o.event_seq AS out_seq, o.us AS out_us, o.model AS out_model, {provider('o.provider')} AS out_provider, o.usage AS usage,
  o.assistant_texts,
  coalesce(
    (SELECT arg_max(c.channel_id, c.us * 100000000000000::HUGEINT + c.event_seq) FROM ctx c
      WHERE c.session_key = t.session_key AND c.trace_no = t.trace_no AND c.channel_id <> ''),
    (SELECT arg_min(c.message_provider, c.us * 100000000000000::HUGEINT + c.event_seq) FROM ctx c
      WHERE c.session_key = t.session_key AND c.trace_no = t.trace_no AND c.message_provider <> '')) AS channel,
  (SELECT arg_max(c.trigger, c.us * 100000000000000::HUGEINT + c.event_seq) FROM ctx c
    WHERE c.session_key = t.session_key AND c.trace_no = t.trace_no AND c.trigger <> '') AS trigger,
  (SELECT arg_max(c.event_seq, c.us * 100000000000000::HUGEINT + c.event_seq) FROM ctx c
    WHERE c.session_key = t.session_key AND c.trace_no = t.trace_no AND c.event_name = 'agent_end') AS end_seq
  FROM traces t JOIN ctx i ON i.event_seq = t.start_seq AND i.session_key = t.session_key
  LEFT JOIN ctx o ON o.session_key = t.session_key AND o.trace_no = t.trace_no AND o.event_name = 'llm_output')"""

SPANS = """
made AS (
  SELECT session_key, trace_no, 'root' AS kind, 0 AS rank, start_us, start_seq, close_us AS end_us,
    closed_by AS close_reason, coalesce(in_model, 'undefined') || ' · ' || coalesce(first_channel, 'unknown') AS name,
    NULL AS model, channel, NULL::BIGINT AS prompt_tokens, NULL::BIGINT AS completion_tokens
  FROM traces JOIN facts USING (session_key, trace_no)
  UNION ALL
  SELECT session_key, trace_no, 'llm', 1, start_us, start_seq, coalesce(out_us, close_us),
    CASE WHEN out_us IS NULL THEN closed_by ELSE 'ended' END, in_model,
    CASE WHEN out_us IS NULL THEN in_model ELSE out_model END, channel, usage.input, usage.output
  FROM traces JOIN facts USING (session_key, trace_no)
  UNION ALL
  SELECT s.session_key, s.trace_no, 'tool', 2, s.us, s.event_seq,
    coalesce(e.us, p.replaced_us, CASE WHEN s.run_ended AND s.phase = 0 THEN s.first_end_us ELSE s.close_us END),
    CASE WHEN e.us IS NOT NULL THEN 'ended' WHEN p.replaced_us IS NOT NULL THEN 'duplicate_id'
      WHEN s.run_ended AND s.phase = 0 THEN 'agent_end' ELSE s.closed_by END,
    s.tool_name, NULL, NULL, NULL, NULL
  FROM pairs p JOIN ann s ON s.event_seq = p.start_seq LEFT JOIN ann e ON e.event_seq = p.end_seq),
spans AS (SELECT made.*, traces.trace_id,
  row_number() OVER (PARTITION BY made.session_key, made.trace_no ORDER BY made.start_us, made.start_seq, rank) - 1 AS span_seq,
  CAST(floor((end_us - made.start_us) / 1000) AS BIGINT) AS duration_ms,
  greatest(0, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS tokens
  FROM made JOIN traces ON made.session_key = traces.session_key AND made.trace_no = traces.trace_no),
ided AS (SELECT *, 'evt_' || trace_id || '_' || CASE span_seq WHEN 0 THEN 'root' ELSE span_seq::VARCHAR END AS event_id,
  'span_' || trace_id || '_' || span_seq AS span_id FROM spans)"""

ROLLUP = """SELECT session_key AS session_id, '' AS user_id,
  coalesce(arg_max(model, w) FILTER (WHERE model <> ''), '') AS model_name,
  coalesce(arg_max(channel, w) FILTER (WHERE kind = 'root' AND channel <> ''), '') AS channel_id,
  make_timestamp(min(start_us)) AS start_time,
  make_timestamp(arg_max(end_us, w) FILTER (WHERE kind = 'root')) AS end_time,
  count(*) AS total_actions, CAST(sum(tokens) AS BIGINT) AS total_tokens
FROM (SELECT *, row_number() OVER (ORDER BY end_us, trace_no, kind = 'root', span_seq) AS w FROM {source})
GROUP BY session_key"""


def with_traces(hooks: str, timeout_us: int | None, *more: str, grace_us: int = 0, sweep_us: int | None = None) -> str:
    return "WITH " + ", ".join([hooks, numbered(), bounds(timeout_us, grace_us, sweep_us), *more]) + " "

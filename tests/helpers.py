from __future__ import annotations

from tracewright.plans.views import conform
from tracewright.schemas import HOOK_EVENTS

NAMES = {
    "seq": "event_seq", "name": "event_name", "session": "session_key", "agent": "agent_id", "tool": "tool_name",
    "call": "tool_call_id", "requester": "requester_session_key", "child": "child_session_key",
    "target": "target_session_key", "kind": "target_kind",
}


def frame(spark, events: list[dict]):
    """Canonical events out of dictionaries; ``us`` is the time in microseconds."""
    rows = [{NAMES.get(k, k): v for k, v in e.items()} for e in events]
    known = {f.name: f for f in HOOK_EVENTS.fields}
    used = sorted({k for r in rows for k in r if k in known and k != "ts"})
    schema = ", ".join(f"{c} {known[c].dataType.simpleString()}" for c in used) + ", us bigint"
    data = [tuple(r.get(c) for c in used) + (r["us"],) for r in rows]
    df = spark.createDataFrame(data, schema)
    return conform(df.selectExpr(*used, "timestamp_micros(us) as ts"))

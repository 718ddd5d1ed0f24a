r"""SQL expressions for names, labels, numbers and ids.

Every function takes SQL expression text and returns SQL expression text, to be used with ``F.expr`` or
``selectExpr``. Text composes without a driver round trip per operator, which is what building the large
span plans out of ``Column`` objects would cost.
"""

from __future__ import annotations

# Fixed: the characters the source runtime counts as white space, as a regex class body.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Fixed: span kind -> (span type, action type).
LABELS = {
    "root": ("record_root", "trace"),
    "llm": ("generation", "llm"),
    "tool": ("tool", "tool"),
    "subagent": ("agent", "subagent"),
}

# Fixed: usage count -> token name.
TOKEN_NAMES = {
    "input": "prompt_tokens",
    "output": "completion_tokens",
    "total": "total_tokens",
    "cacheRead": "cache_read_tokens",
    "cacheWrite": "cache_write_tokens",
}

# Fixed: separator in trace names.
DOT = " \u00b7 "


def literal(text: str) -> str:
    """A SQL string literal for any text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, {literal(f'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '')"


def present(value: str) -> str:
    """The text, with the empty string read as missing."""
    return f"nullif({value}, '')"


def resolve_id(event_value: str, context_value: str) -> str:
    return f"coalesce({present(event_value)}, {present(context_value)})"


def normalize_provider(value: str) -> str:
    """Trimmed lower-case provider; every spelling of the code model provider becomes ``openai``; blank is null."""
    name = present(f"lower({trimmed(value)})")
    return (
        f"regexp_replace({name}, "
        # Fixed spellings; then any name that holds both words.
        f"'^(?s:openai-codex|openai_codex|codex|.*openai.*codex.*|.*codex.*openai.*)\\\\z', 'openai')"
    )


def provider_or_raw(value: str) -> str:
    return f"coalesce({normalize_provider(value)}, {value})"


def has_usage(usage: str) -> str:
    return "coalesce(" + ", ".join(f"{usage}.{name}" for name in TOKEN_NAMES) + ") is not null"


def map_usage(usage: str) -> str:
    """Usage counts under their token names; null when no count is known."""
    fields = ", ".join(f"'{new}', {usage}.{old}" for old, new in TOKEN_NAMES.items())
    return f"if({has_usage(usage)}, named_struct({fields}), null)"


def _label(kind: str, position: int, other: str) -> str:
    cases = " ".join(f"when '{name}' then '{labels[position]}'" for name, labels in LABELS.items())
    return f"case {kind} {cases} else '{other}' end"


def span_type(kind: str) -> str:
    return _label(kind, 0, "unknown")


def action_type(kind: str) -> str:
    return _label(kind, 1, "action")


def trace_name(model: str, channel: str) -> str:
    return f"concat(coalesce({model}, 'undefined'), '{DOT}', coalesce({present(channel)}, 'unknown'))"


def subagent_name(event_name: str, agent_id: str, target_kind: str) -> str:
    """The name depends on which event created the span."""
    return (
        f"concat('subagent:', case {event_name} when 'subagent_delivery_target' then 'delivery-target' "
        f"when 'subagent_ended' then coalesce({present(target_kind)}, 'unknown') "
        f"else coalesce({present(agent_id)}, 'unknown') end)"
    )


def clean_number(value: str) -> str:
    """The number when finite and not negative, else null."""
    number = f"cast({value} as double)"
    return f"if(not isnan({number}) and {number} >= 0 and {number} < double('infinity'), {value}, null)"


def token_total(prompt: str, completion: str) -> str:
    """Whole tokens of a span, never negative; unknown and non-finite parts count as zero."""

    def finite(value: str) -> str:
        number = f"cast({value} as double)"
        return f"coalesce(if(not isnan({number}) and abs({number}) < double('infinity'), {value}, null), 0)"

    return f"greatest(0L, cast(floor({finite(prompt)} + {finite(completion)}) as bigint))"


def assistant_text(texts: str) -> str:
    """The texts joined by a blank line; no texts give the empty string."""
    return f"coalesce(array_join({texts}, '\\n\\n'), '')"


def trace_id(session: str, start_us: str, start_seq: str) -> str:
    """Stable under retries, parallel writers and replays: the session's digest and the event that opened it."""
    return f"concat('tr_', md5(cast({session} as binary)), '_', {start_us}, '_', {start_seq})"


def event_id(trace: str, seq: str) -> str:
    return f"concat('evt_', {trace}, '_', if({seq} = 0, 'root', cast({seq} as string)))"


def span_id(trace: str, seq: str) -> str:
    return f"concat('span_', {trace}, '_', {seq})"


def action_id(event: str) -> str:
    """A 60-bit number from the event id's digest."""
    return f"cast(conv(substring(md5(cast({event} as binary)), 1, 15), 16, 10) as bigint)"

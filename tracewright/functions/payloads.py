"""SQL expressions for the JSON payloads of spans and traces."""

from __future__ import annotations

from tracewright.functions.scalars import assistant_text, has_usage, literal, present
from tracewright.functions.text import redact_text


def json_object(fields: dict[str, str], raw: dict[str, str] | None = None) -> str:
    """A JSON object of plain values and of values that already are JSON; null members are left out."""
    plain = "to_json(named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + "))"
    if not raw:
        return plain
    members = [f"concat('\"{name}\":', {value})" for name, value in raw.items()]
    if fields:
        members.insert(0, present(f"regexp_extract({plain}, '(?s)^.(.*).$', 1)"))
    return "concat('{', concat_ws(',', " + ", ".join(members) + "), '}')"


def last_item(array: str) -> str:
    """The last element, null for an empty or missing array."""
    return f"try_element_at({array}, -1)"


def last_assistant(messages: str) -> str:
    """The last message the assistant wrote."""
    return last_item(f"filter({messages}, m -> m.role = 'assistant')")


def json_array_last(raw: str) -> str:
    """The last element of a JSON array, as JSON text."""
    return f"to_json({last_item(f'''try_variant_get(try_parse_json({raw}), '$', 'array<variant>')''')})"


def tool_output(error: str, clean_result: str) -> str:
    """``{"error"}`` for a failed call, an object result as it is, anything else under ``result``."""
    shaped = (
        f"if(left(ltrim({clean_result}), 1) in ('{{', '['), {clean_result}, "
        f"concat('{{\"result\":', {clean_result}, '}}'))"
    )
    return f"if({present(error)} is not null, {json_object({'error': redact_text(error)})}, {shaped})"


def error_info(kind: str, message: str) -> str:
    """The error record; null without a message. An empty message is no error."""
    clean = redact_text(message)
    record = json_object({"exceptionType": f"'{kind}'", "message": clean, "traceback": clean})
    return f"if({present(message)} is not null, {record}, null)"


def stale_error(session: str, idle_us: str) -> str:
    """The error record of a trace closed for inactivity."""
    return json_object(
        {
            "exceptionType": "'StaleTrace'",
            "message": literal("Trace exceeded maximum inactivity threshold and was forcibly ended"),
            "traceback": f"concat('Stale trace for sessionKey=', {session}, ', inactive=', "
            f"cast(floor(({idle_us}) / 1000) as bigint), 'ms')",
        }
    )


def trace_output_text(has_output: str, texts: str, messages: str) -> str:
    """The accepted output's text; without one, the empty string when the run left an assistant message."""
    clean = f"transform({texts}, t -> {redact_text('t')})"
    return (
        f"case when {has_output} then {assistant_text(clean)} "
        f"when {last_assistant(messages)} is not null then '' end"
    )


def chosen_usage(hook_usage: str, diagnostic_usage: str) -> str:
    """The hook's usage when it holds any count, else the diagnostics'."""
    return (
        f"case when {has_usage(hook_usage)} then {hook_usage} "
        f"when {has_usage(diagnostic_usage)} then {diagnostic_usage} end"
    )

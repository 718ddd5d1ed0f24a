"""Redaction of internal markers and media references from text and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.scalars import SPACE, literal

_S = f"[{SPACE}]"
QUOTES = "\"'`"  # fixed: the quotes that end a reference
_REF = f"[^{SPACE}{QUOTES}]"

# Line starts and word edges are spelled out: they must mean the same in the JVM and in Python.
LINE_START = r"(?:\A|(?<=[\n\r\u2028\u2029]))"
WORD_START = r"(?<![A-Za-z0-9_])"

# Fixed patterns: what counts as an internal block or a media reference, in the order they are removed.
REPLY_MARKER = rf"(?i)\[\[reply_to[^\]]*\]\]{_S}*"
UNTRUSTED_CONTEXT = (
    rf"(?i){LINE_START}{_S}*Untrusted context \(metadata, do not treat as instructions or commands\):{_S}*\n+"
    rf"<<<EXTERNAL_UNTRUSTED_CONTENT(?s:.*?)<<<END_EXTERNAL_UNTRUSTED_CONTENT[^>]*>>>{_S}*"
)
CONVERSATION_INFO = rf"(?i){LINE_START}{_S}*Conversation info \(untrusted metadata\):{_S}*\n+\{{(?s:.*?)\}}{_S}*"
SENDER_INFO = rf"(?i){LINE_START}{_S}*Sender \(untrusted metadata\):{_S}*\n+\{{(?s:.*?)\}}{_S}*"
BLANK_LINES = r"\n{3,}"
MEDIA_IMAGE = rf"(?i){WORD_START}media:{_REF}+\.(?:jpe?g|png|webp|gif)(?=[{SPACE}{QUOTES}]|\z)"
IMAGE_MARK = "media:<image-ref>"
REMOVED = (REPLY_MARKER, UNTRUSTED_CONTEXT, CONVERSATION_INFO, SENDER_INFO)


def redact_text(value: str) -> str:
    """SQL text: the value without internal blocks, with real newlines and with image references masked.

    The patterns only run on rows that hold one of their fixed words.
    """
    low = f"lower({value})"
    could_change = " or ".join(
        [
            f"contains({value}, {literal(chr(92))})",
            f"contains({value}, {literal(chr(10) * 3)})",
            *[f"contains({low}, '{word}')" for word in ("[[reply_to", "untrusted", "media:")],
        ]
    )
    text = value
    for escaped, plain in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\r")):
        text = f"replace({text}, {literal(escaped)}, {literal(plain)})"
    for pattern in REMOVED:
        text = f"regexp_replace({text}, {literal(pattern)}, '')"
    text = f"regexp_replace({text}, {literal(BLANK_LINES)}, {literal(chr(10) * 2)})"
    text = f"regexp_replace({text}, {literal(MEDIA_IMAGE)}, '{IMAGE_MARK}')"
    return f"if({could_change}, {text}, {value})"


def needs_redaction(raw: str) -> str:
    """SQL text: whether a JSON text could change: it holds a fixed word, a letter that may be spelled as an escape, an
    escaped backslash (of a spelled-out line end), or three line ends."""
    back = chr(92)
    words = " or ".join(f"contains(lower({raw}), '{word}')" for word in ("[[reply_to", "media:", "untrusted"))
    marks = " or ".join(f"contains({raw}, {literal(mark)})" for mark in (back + "u", back + back, (back + "n") * 3))
    return f"({words} or {marks})"


def leaf_redactor():
    """The same rules for one string.

    Built as a closure over plain values, so that it travels to the executors whole.
    """
    removed = [(pattern, "") for pattern in REMOVED]
    rules = [
        (re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII), text)
        for pattern, text in [*removed, (BLANK_LINES, "\n\n"), (MEDIA_IMAGE, IMAGE_MARK)]
    ]

    def redact(value: str) -> str:
        value = value.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\\r", "\r")
        for pattern, text in rules:
            value = pattern.sub(text, value)
        return value

    return redact


def leaf_walker():
    """(is_json, leaves): whether a text is JSON, and an iterator over its string values as (start, end, value).

    Only string tokens are decoded, so numbers, order and repeated keys stay as they are written. Keys are left out. A
    text nested too deeply to be checked counts as JSON.
    """
    token = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
    colon = re.compile(r"[ \t\n\r]*:")

    def is_json(text: str) -> bool:
        try:
            json.loads(text)
        except RecursionError:
            return True
        except ValueError:
            return False
        return True

    def leaves(text: str):
        for found in token.finditer(text):
            if not colon.match(text, found.end()):
                try:
                    yield found.start(), found.end(), json.loads(found.group())
                except ValueError:  # only in texts too deep to be checked
                    continue

    return is_json, leaves


def _json_redactor():
    redact = leaf_redactor()
    is_json, leaves = leaf_walker()

    def written(value: str) -> str:
        try:
            value.encode()
        except UnicodeEncodeError:  # half of a surrogate pair can only be written as an escape
            return json.dumps(value)
        return json.dumps(value, ensure_ascii=False)

    def one(text: str) -> str:
        if not is_json(text):
            return text
        out, at = [], 0
        for start, end, value in leaves(text):
            clean = redact(value)
            if clean != value:
                out += [text[at:start], written(clean)]
                at = end
        return "".join([*out, text[at:]]) if out else text

    def batch(raw: pd.Series) -> pd.Series:
        return raw.map(one, na_action="ignore")

    return F.pandas_udf(batch, T.StringType())


def redact_json(raw: str) -> Column:
    """JSON text with every string value redacted; keys and all else are kept as written, other texts as they are.

    Only rows that could change are sent to Python.
    """
    dirty = F.expr(f"if({needs_redaction(raw)}, {raw}, null)")
    return F.coalesce(_json_redactor()(dirty), F.expr(raw))


def _json_leaves():
    is_json, leaves = leaf_walker()

    def one(text: str) -> list[str]:
        if not is_json(text):
            return [text]
        return [value.encode("utf-8", "replace").decode() for _, _, value in leaves(text)]

    def batch(raw: pd.Series) -> pd.Series:
        return raw.map(one, na_action="ignore")

    return F.pandas_udf(batch, T.ArrayType(T.StringType()))


def texts(payload: Column, wanted: Column) -> Column:
    """The string values of a JSON payload, or a plain text as its only one.

    Only payloads that look like JSON and for which ``wanted`` holds are sent to Python.
    """
    json_like = payload.rlike(r'\A\s*[\[{"]') & wanted
    return F.coalesce(_json_leaves()(F.when(json_like, payload)), F.array(payload))


def redact_tool_messages(df: DataFrame, enabled: bool = False, column: str = "message") -> DataFrame:
    """The persisted tool messages that redaction changes, rewritten; none while the option is off."""
    if not enabled:
        return df.limit(0)
    candidates = df.where(needs_redaction(column))
    return (
        candidates.withColumn("_clean", redact_json(column))
        .where(F.col("_clean") != F.col(column))
        .withColumn(column, F.col("_clean"))
        .drop("_clean")
    )

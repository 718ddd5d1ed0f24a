"""The three output tables and how they are written, merged and read along their access paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.payloads import json_object
from tracewright.functions.scalars import literal
from tracewright.operators.rollups import actions
from tracewright.options import Options
from tracewright.schemas import SESSIONS_TABLE
from tracewright.sources.store import Commit, blooms, commit, exists, last_commit, read_buckets, upsert

# The stored actions lie in folders by day, type and session. A folder is named by a hash, so that any text may be a type or
# session; a table keeps the numbers it was begun with.
SLOTS = {"type_slot": ("action_type", 8), "session_slot": ("session_id", 4)}
# Fixed prefix of the attribute names.
NS = "ai.observability."


def event_rows(spans: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per ended span, with its record, attributes and place in the trace as JSON."""
    root = "kind = 'root'"
    tags = "to_json(array(" + ", ".join(literal(t) for t in options.tags) + "))"
    payload = json_object({}, {"output": "output", "metadata": "metadata", "errorInfo": "error_info"})
    updated = f"({root} and close_reason in ('agent_end', 'stale')) or close_reason = 'ended'"
    attributes = json_object(
        {
            NS + "span_type": "span_type",
            NS + "record_id": "session_id",
            NS + "model": "model",
            NS + "provider": "provider",
            NS + "call.function": f"if({updated}, name, null)",
            NS + "usage": "usage",
        },
        {
            NS + "trace.input": f"if({root}, input, null)",
            NS + "trace.tags": f"if({root}, {tags}, null)",
            NS + "call.input": f"if({root}, null, input)",
            NS + "call.return": "output",
            NS + "payload": f"if({updated}, {payload}, null)",
        },
    )
    return spans.where("end_us is not null").selectExpr(
        "event_id",
        json_object({"name": "name", "kind": literal(options.record_kind)}) + " as record",
        f"{attributes} as record_attributes",
        "'SPAN' as record_type",
        json_object({NS + "app_name": literal(options.app_name), NS + "app_version": literal(options.app_version)})
        + " as resource_attributes",
        "timestamp_micros(start_us) as start_timestamp",
        "timestamp_micros(end_us) as timestamp",
        # The root's parent is an explicit null.
        "to_json(named_struct('trace_id', trace_id, 'span_id', span_id, 'parent_id', parent_span_id), "
        "map('ignoreNullFields', 'false')) as trace",
    )


def without_known(rows: DataFrame, known: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose key is new: duplicates within the batch and rows already stored are dropped.

    The day must follow from the key, so that the stored side is read only for the days of the batch.
    """
    return not_stored(rows.dropDuplicates([key]), known, key, day)


def not_stored(rows: DataFrame, known: DataFrame, key: str, day: str) -> DataFrame:
    return rows.join(known.select(key, day), [key, day], "left_anti")


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, of stored rows. Repeats are looked for by the key alone: without any, whole rows are neither moved
    nor grouped."""
    repeated = rows.groupBy(key).count().where("count > 1").limit(1).count()
    return rows.dropDuplicates([key]) if repeated else rows


def slot(name: str, value: Column) -> Column:
    """The folder of a type or session."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(SLOTS[name][1])).cast("int")


def append(dated: DataFrame, path: str, key: str, time: str, slots: tuple[str, ...] = (), looked_up: tuple[str, ...] = ()) -> None:
    """Append rows idempotently, in folders by ``event_date`` and ``slots``, sorted within files so that file statistics prune;
    ``looked_up`` columns get Bloom filters. Rows of a folder are gathered first, large folders in several tasks and files.
    ``dated`` is read twice and should be stored."""
    spark, schema = dated.sparkSession, dated.schema
    dated = once(dated, key)
    if exists(spark, path):
        dated = not_stored(dated, spark.read.schema(schema).parquet(path), key, "event_date")
    order = "session_id" if "session_id" in dated.columns else key
    folders = ["event_date", *slots]
    if slots:
        dated = dated.withColumns({name: slot(name, F.col(SLOTS[name][0])) for name in slots}).hint("rebalance", *folders)
    sorted_rows = dated.sortWithinPartitions(*folders, order, time)
    sorted_rows.write.options(**blooms(looked_up)).mode("append").partitionBy(*folders).parquet(path)


def final(spans: DataFrame) -> DataFrame:
    """Spans whose end later input cannot move: those still open where the input ends are left for the next write."""
    return spans.where("end_us is not null and close_reason <> 'end_of_input'")


def write_events(spans: DataFrame, path: str, options: Options = Options()) -> None:
    """Add the final spans that are not stored yet. An event id fixes its start, and so its day."""
    rows = event_rows(final(spans), options)
    append(rows.withColumn("event_date", F.to_date("start_timestamp")), path, "event_id", "timestamp")


def write_actions(spans: DataFrame, path: str) -> None:
    # The key is the span's event id; the numeric id is a digest and could collide.
    rows = actions(final(spans), "to_date(timestamp_micros(start_us)) as event_date")
    append(rows, path, "event_id", "created_at", tuple(SLOTS), ("session_id", "user_id"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The stored actions, with the columns that name their folders, for ``actions_by``."""
    return spark.read.parquet(path)


def merge_sessions(target: DataFrame, delta: DataFrame) -> DataFrame:
    """The session rows after a later batch: set values overwrite, the earliest start stays, totals add up."""

    def newer(name: str) -> str:
        return f"coalesce(nullif(d.{name}, ''), t.{name}, '') as {name}"

    return (
        target.alias("t")
        .join(delta.alias("d"), F.col("t.session_id") == F.col("d.session_id"), "full_outer")
        .selectExpr(
            "coalesce(t.session_id, d.session_id) as session_id",
            newer("user_id"),
            newer("model_name"),
            newer("channel_id"),
            "least(t.start_time, d.start_time) as start_time",
            "coalesce(d.end_time, t.end_time) as end_time",
            "coalesce(t.total_actions, 0) + coalesce(d.total_actions, 0) as total_actions",
            "coalesce(t.total_tokens, 0) + coalesce(d.total_tokens, 0) as total_tokens",
        )
    )


# Stored sessions are sorted by these within their files.
SESSIONS_NEAR = ("user_id", "start_time")


def write_sessions(delta: DataFrame, path: str) -> None:
    """Merge session rows into the stored table: only the buckets of the sessions in ``delta`` are written again."""
    spark = delta.sparkSession
    state = (last_commit(spark, path) or Commit()).next()
    upsert(delta, state, path, "rows", "session_id", merge_sessions, near=SESSIONS_NEAR)
    commit(spark, path, state)


def read_sessions(spark: SparkSession, path: str, table: str = "rows") -> DataFrame:
    """The stored session rows as of the newest commit."""
    return read_buckets(spark, last_commit(spark, path) or Commit(), table, SESSIONS_TABLE)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's rows into its own partition; a repeated batch replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of the batches that are committed; a batch that is being written is not seen in any table."""
    last = last_commit(spark, root)
    return spark.read.parquet(f"{root}/{table}").where(F.col("batch_id") <= (-1 if last is None else last.number))


def actions_by(
    action_rows: DataFrame,
    session: str | None = None,
    action_type: str | None = None,
    user: str | None = None,
    since=None,
    until=None,
) -> DataFrame:
    """Actions along any access path; every condition is a plain comparison that reaches the scan.

    Of a stored table, type and session choose folders, ``until`` leaves out later days, and the rest is left to the
    statistics and Bloom filters of the files.
    """
    known = {"session_id": session, "action_type": action_type, "user_id": user}
    out = action_rows
    for column, value in known.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    out = _between(out, "created_at", since, until)
    for name, (of, _) in SLOTS.items():
        if known[of] is not None and name in action_rows.columns:
            out = out.where(F.col(name) == slot(name, F.lit(known[of])))
    return out


def sessions_by(session_rows: DataFrame, user: str | None = None, since=None, until=None) -> DataFrame:
    out = session_rows if user is None else session_rows.where(F.col("user_id") == F.lit(user))
    return _between(out, "start_time", since, until)


def events_by(rows: DataFrame, since=None, until=None) -> DataFrame:
    return _between(rows, "timestamp", since, until)


def _between(rows: DataFrame, column: str, since, until) -> DataFrame:
    """Half-open in time. A table is partitioned by the day of the start, which no end precedes, so ``until`` prunes
    partitions; ``since`` prunes files by their statistics."""
    if since is not None:
        rows = rows.where(F.col(column) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(column) < F.lit(until))
        rows = rows.where(F.col("event_date") <= F.to_date(F.lit(until))) if "event_date" in rows.columns else rows
    return rows


def newest(rows: DataFrame, n: int = 3) -> DataFrame:
    """The newest rows, ties by event id."""
    return rows.select("event_id", "record_type", "timestamp").orderBy(F.desc("timestamp"), "event_id").limit(n)


def json_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct top-level keys of JSON columns and how many rows hold them."""
    pairs = ", ".join(f"'{c}', json_object_keys({c})" for c in columns)
    keys = rows.selectExpr(f"stack({len(columns)}, {pairs}) as (json_column, keys)")
    return (
        keys.select("json_column", F.explode("keys").alias("json_key"))
        .groupBy("json_column", "json_key")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def store_summary(rows: DataFrame) -> DataFrame:
    """One row: how many events are stored, over what time, and the keys their JSON columns use."""
    # A set of key lists: as many entries as there are shapes, not rows.
    keys = "array_join(array_sort(array_distinct(flatten(collect_set(json_object_keys({0}))))), ',') as {0}_keys"
    return rows.agg(
        F.expr("count(1) as event_rows"),
        F.expr("min(timestamp) as first_time"),
        F.expr("max(timestamp) as last_time"),
        *[F.expr(keys.format(c)) for c in ("record", "trace")],
    )

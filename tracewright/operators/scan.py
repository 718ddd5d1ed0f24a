"""Ordered scans over groups of any size.

A window partitioned by session puts a whole session into one task. That is the best plan while every
session is small, and no plan at all when one session holds a third of the data. The scans here take
both: with ``PLAIN`` they are ordinary windows; with a split they run in two levels. The rows are dealt
by ranges of group and order into even chunks, however close in time they lie; the scan runs inside
(group, chunk), then over one total row per chunk. Totals of more than ``FAN`` chunks are scanned as a tree: inside groups
of ``FAN`` chunks, then over the totals of these, so that no task reads more than ``FAN`` of them. Both give the same values.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
PACK = "packed_row"
FAN = 1024  # chunk totals that one task scans
# Hot keys are broadcast up to this many, else joined like any other table.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Scan:
    """One running value.

    kind: ``sum``, ``min``, ``max`` or ``last`` (the nearest non-null value in scan order).
    scope: ``upto`` (rows up to and with this one), ``before``, ``after`` (rows behind this one, nearest
    first), or ``all`` (the whole group).
    """

    name: str
    kind: str
    value: Column
    scope: str = "upto"


@dataclass(frozen=True)
class Split:
    """Into how many chunks rows are dealt along groups and order; None means not at all."""

    chunks: int | None = None

    @property
    def active(self) -> bool:
        return self.chunks is not None


PLAIN = Split()


def _descending(order: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def _reduce(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _over(scan: Scan, value: Column, keys: list, order: list[str]) -> Column:
    group = Window.partitionBy(*keys)
    if scan.scope == "all":
        return _reduce(scan.kind, value).over(group)
    ordered = group.orderBy(*(_descending(order) if scan.scope == "after" else _ascending(order)))
    last_row = Window.currentRow if scan.scope == "upto" else -1
    return _reduce(scan.kind, value).over(ordered.rowsBetween(Window.unboundedPreceding, last_row))


def _total(scan: Scan, order: list[str]) -> Column:
    if scan.kind != "last":
        return _reduce(scan.kind, scan.value)
    position = F.when(scan.value.isNotNull(), F.struct(*order))
    return F.min_by(scan.value, position) if scan.scope == "after" else F.max_by(scan.value, position)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNotNull() | carry.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if kind == "last":
        return F.coalesce(local, carry)
    return (F.least if kind == "min" else F.greatest)(local, carry)


def _filled(scan: Scan, column: Column) -> Column:
    """Sums over no rows count as zero."""
    return F.coalesce(column, F.lit(0)) if scan.kind == "sum" else column


def _carry(totals: DataFrame, keys: list[str], scans: list[Scan], chunks: int) -> DataFrame:
    """For each key and chunk (``_k_`` columns) what the chunks before it, behind it or all of them come to (``_c_`` columns)."""
    inner = [*keys, CHUNK]
    over = [Scan(s.name, s.kind, F.col(f"_t_{s.name}"), "before" if s.scope == "upto" else s.scope) for s in scans]
    named = [F.col(k).alias(f"_k_{k}") for k in inner]
    if chunks <= FAN:
        return totals.select(*named, *[_over(s, s.value, keys, [CHUNK]).alias(f"_c_{s.name}") for s in over])
    dealt = totals.withColumn("_above", F.floor(F.col(CHUNK) / FAN).cast("int"))
    near = [*keys, "_above"]
    local = dealt.select(*near, *named, *[_over(s, s.value, near, [CHUNK]).alias(f"_n_{s.name}") for s in over if s.scope != "all"])
    above = dealt.groupBy(*near).agg(*[_total(s, [CHUNK]).alias(f"_t_{s.name}") for s in over])
    far = _carry(above.withColumnRenamed("_above", CHUNK), keys, scans, -(-chunks // FAN))
    far = far.select(*[F.col(f"_k_{k}").alias(f"_f_{k}") for k in inner], *[F.col(f"_c_{s.name}").alias(f"_f_c_{s.name}") for s in over])
    same = F.col("_above") == F.col(f"_f_{CHUNK}")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_f_{key}"))
    values = [
        F.col(f"_f_c_{s.name}") if s.scope == "all" else _combine(s.kind, F.col(f"_n_{s.name}"), F.col(f"_f_c_{s.name}"))
        for s in over
    ]
    named = [F.col(f"_k_{k}") for k in inner]
    return local.join(far, same, "left").select(*named, *[v.alias(f"_c_{s.name}") for s, v in zip(over, values, strict=True)])


def running(df: DataFrame, keys: list[str], order: list[str], scans: list[Scan], split: Split = PLAIN) -> DataFrame:
    """Add one column per scan, computed over the rows with equal ``keys`` in the given order."""
    if not split.active:
        return df.select("*", *[_filled(s, _over(s, s.value, keys, order)).alias(s.name) for s in scans])

    spark = df.sparkSession
    # Ranges are numbered in order, and rows equal in keys and order share one. Both branches below read the same rows:
    # they are stored once instead of being computed twice.
    dealt = df.repartitionByRange(split.chunks, *keys, *order)
    df = cut(spark, dealt.withColumn(CHUNK, F.spark_partition_id()))
    inner = [*keys, CHUNK]
    local = df.select(
        "*", *[_over(s, s.value, inner, order).alias(f"_l_{s.name}") for s in scans if s.scope != "all"]
    )
    totals = df.groupBy(*inner).agg(*[_total(s, order).alias(f"_t_{s.name}") for s in scans])
    carry = _carry(totals, keys, scans, split.chunks)
    same = F.lit(True)
    for key in inner:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = local.join(carry, same, "left")
    values = [
        _filled(
            s,
            F.col(f"_c_{s.name}")
            if s.scope == "all"
            else _combine(s.kind, F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")),
        ).alias(s.name)
        for s in scans
    ]
    return joined.select(*[c for c in df.columns if c != CHUNK], *values)


def beside(df: DataFrame, row: list[str], read: list[str], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns ``plan`` adds to it, found on the columns it reads alone.

    Split scans store their rows; this keeps payloads out of what is stored. ``row`` names one row.
    """
    slim = df.select(*dict.fromkeys([*row, *read]))
    found = plan(slim)
    added = [c for c in found.columns if c not in slim.columns]
    named = found.select(*[F.col(c).alias(f"_r_{c}") for c in row], *added)
    same = F.lit(True)
    for column in row:
        same = same & F.col(column).eqNullSafe(F.col(f"_r_{column}"))
    return df.join(named, same).select(*df.columns, *added)


def packed(df: DataFrame, read: list[str], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns ``plan`` adds to it; the columns it does not read pass through it as one struct.

    Every sort and window writes each column of a row anew; a struct is copied as one run of bytes. For rows that are wanted
    whole: where few columns are, their pruning saves more.
    """
    carried = [c for c in df.columns if c not in read]
    if len(carried) < 2:
        return plan(df)
    slim = df.select(*dict.fromkeys(read), F.struct(*carried).alias(PACK))
    found = plan(slim)
    added = [c for c in found.columns if c not in slim.columns]
    return found.select(*[F.col(f"{PACK}.{c}") if c in carried else F.col(c) for c in df.columns], *added)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session must name in spark.checkpoint.dir. Only a plain local session,
    where driver and executor are one process, may go without; it gets a new temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Store the rows reliably and start a new lineage from them."""
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Store rows by column in ``path``, a new folder that all executors share, and start a new lineage from them. For wide
    rows that are read several times: ``cut`` gives every reader whole rows, this only the columns it asks for."""
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks_for(rows: int, max_group_rows: int) -> Split:
    """Chunks of at most about half the rows that one task should take."""
    return Split(max(2, -(-2 * rows // max_group_rows)))


def split_for(df: DataFrame, keys: list[str], max_group_rows: int) -> Split:
    """The split under which no group of any of the keys is too large for one task; usually none is needed."""
    roles = F.explode(F.array(*[F.struct(F.lit(i).alias("role"), F.col(k).alias("key")) for i, k in enumerate(keys)]))
    counts = df.select(roles.alias("_key")).where("_key.key is not null").groupBy("_key").count()
    largest, rows = counts.agg(F.max("count"), F.sum("count")).first()
    return PLAIN if (largest or 0) <= max_group_rows else chunks_for(rows, max_group_rows)


def global_split(df: DataFrame, max_group_rows: int) -> Split:
    """A split for scans over all rows, where these are more than one task should take."""
    rows = df.count()
    return PLAIN if rows <= max_group_rows else chunks_for(rows, max_group_rows)


def measure(df: DataFrame, key: str, time_us: str, row: list[str]) -> tuple[int, int | None, bool]:
    """Rows of the largest group, the last time in the data, and whether some row, which the columns ``row`` name, occurs
    more than once; in one aggregation over these columns."""
    rows = df.groupBy(*row).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias(key), F.max(time_us).alias("last"))
    counted = F.when(F.col(key).isNotNull(), F.col("copies"))
    groups = rows.groupBy(key).agg(F.sum(counted).alias("n"), F.max("last").alias("last"), F.max("copies").alias("copies"))
    largest, last, copies = groups.agg(F.max("n"), F.max("last"), F.max("copies")).first()
    return largest or 0, last, (copies or 0) > 1


def by_heat(
    df: DataFrame, key: str, largest: int, limit: int, plan: Callable[[DataFrame, Split], DataFrame]
) -> DataFrame:
    """Run ``plan`` with plain windows on ordinary keys and with split scans on hot ones."""
    if largest <= limit:
        return plan(df, PLAIN)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # At most (all rows / limit) keys are hot; broadcast them only while they are few.
    hot = cut(df.sparkSession, counts.where(F.col("n") > limit))
    keys, rows = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = hot.select(key)
    if keys <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = plan(df.join(hot, key, "left_anti"), PLAIN)
    return cold.unionByName(plan(df.join(hot, key, "left_semi"), chunks_for(rows, limit)))


def as_of(
    probes: DataFrame, facts: DataFrame, key: str, order: list[str], value: str, found: str, split: Split = PLAIN
) -> DataFrame:
    """For each probe the ``value`` of the last fact of the same key before it in order.

    Facts and probes are merged by key and time and scanned once: no range join, no pairs. A probe stands before the facts
    of its own position, in whatever order a shuffle brings the rows: an event may be both.
    """
    value_type = facts.schema[value].dataType
    merged = (
        probes.withColumn(value, F.lit(None).cast(value_type))
        .withColumn("_fact", F.lit(False))
        .unionByName(facts.select(key, *order, value).withColumn("_fact", F.lit(True)), allowMissingColumns=True)
    )
    return (
        running(merged, [key], [*order, "_fact"], [Scan(found, "last", F.col(value), "before")], split)
        .where("not _fact")
        .drop("_fact", value)
    )

"""State that grows by batches: a commit log, parts that merge in tiers, and tables upserted by bucket.

A batch writes its files first and then one commit, a small JSON file that appears at once under its final name.
Readers go by the newest commit, so they see all tables of a batch or none of them. What a batch wrote before it failed
is in no commit; the batch writes it again when it is repeated, and what nobody refers to any more is removed.

Parts. A table of parts gets one new part from a batch. When ``FAN_IN`` parts of a level have gathered, they are merged into
one of the next level and what is dead by then is left out, so a row is written again a logarithmic number of times.

Buckets. An upserted table is kept in buckets by the hash of its key. A batch reads and writes only the buckets that hold
keys of the batch; the others keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 8
BUCKETS = 64


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    folder, target = _at(spark, path)
    return folder.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine's own state, if it is there."""
    folder, target = _at(spark, path)
    folder.delete(target, True)


@dataclass
class Commit:
    """What is valid after a batch: parts by table, bucket folders by table, and plain values."""

    number: int = -1
    parts: dict[str, list[list]] = field(default_factory=dict)  # table -> [path, level], oldest first
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)  # table -> bucket -> path
    values: dict = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)  # folders that this commit no longer refers to

    def next(self) -> Commit:
        """A draft of the commit after this one."""
        copied = json.loads(json.dumps([self.parts, self.buckets, self.values]))
        return Commit(self.number + 1, *copied, [])


def last_commit(spark: SparkSession, root: str) -> Commit | None:
    folder, target = _at(spark, f"{root}/_commits")
    if not folder.exists(target):
        return None
    names = [s.getPath().getName() for s in folder.listStatus(target)]
    names = sorted(n for n in names if n.endswith(".json"))
    if not names:
        return None
    folder, target = _at(spark, f"{root}/_commits/{names[-1]}")
    stream = folder.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Commit(**json.loads(text))


def commit(spark: SparkSession, root: str, draft: Commit) -> None:
    """Make a batch visible. Folders that the commit before dropped are removed: no reader of now refers to them."""
    before = last_commit(spark, root)
    name = f"{draft.number:020d}"
    folder, written = _at(spark, f"{root}/_commits/.{name}-{uuid.uuid4().hex}")
    stream = folder.create(written, True)
    try:
        stream.write(bytearray(json.dumps(draft.__dict__).encode()))
    finally:
        stream.close()
    if not folder.rename(written, _at(spark, f"{root}/_commits/{name}.json")[1]):
        raise FileExistsError(f"{root}: batch {draft.number} is committed already")
    for path in before.dropped if before is not None else ():
        remove(spark, path)
    remove(spark, f"{root}/_commits/{draft.number - 2:020d}.json")


def tidy(spark: SparkSession, root: str, tables: tuple[str, ...]) -> None:
    """Remove what batches wrote that never came to a commit. For the one writer of ``root``, between batches."""
    state = last_commit(spark, root) or Commit()
    known = [p for parts in state.parts.values() for p, _ in parts] + state.dropped
    known += [p for held in state.buckets.values() for p in held.values()] + [p for p, _ in state.values.get("arrived", [])]
    for table in tables:
        folder, target = _at(spark, f"{root}/{table}")
        for found in folder.listStatus(target) if folder.exists(target) else ():
            path = f"{root}/{table}/{found.getPath().getName()}"
            if not any(k == path or k.startswith(f"{path}/") for k in known):
                remove(spark, path)


def new_folder(root: str, table: str) -> str:
    return f"{root}/{table}/{uuid.uuid4().hex}"


def read_parts(spark: SparkSession, state: Commit, table: str, schema: T.StructType) -> DataFrame:
    """All rows of a table of parts, dead ones included."""
    paths = [path for path, _ in state.parts.get(table, [])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def add_part(
    rows: DataFrame, state: Commit, root: str, table: str, live: Callable[[DataFrame, bool], DataFrame], near: str
) -> None:
    """Write a batch's rows as a new part and merge tiers that are full.

    ``live(rows, oldest)`` leaves out what is dead; ``oldest`` tells whether nothing older remains behind the merged parts.
    Rows are gathered by the column ``near``, with large gatherings split, so that file statistics prune.
    """
    spark, schema = rows.sparkSession, rows.schema

    def write(df: DataFrame) -> str:
        path = new_folder(root, table)
        df.hint("rebalance", near).sortWithinPartitions(near).write.option("compression", "zstd").parquet(path)
        return path

    parts = state.parts.setdefault(table, [])
    parts.append([write(rows), 0])
    level = 0
    while len(same := [p for p in parts if p[1] == level]) >= FAN_IN:
        merged = spark.read.schema(schema).parquet(*[p[0] for p in same])
        path = write(live(merged, parts[0] is same[0]))
        at = parts.index(same[0])
        state.dropped.extend(p[0] for p in same)
        parts[at : at + len(same)] = [[path, level + 1]]
        level += 1


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, state: Commit, table: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    held = state.buckets.get(table, {})
    paths = [path for bucket, path in held.items() if only is None or int(bucket) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def blooms(columns: tuple[str, ...]) -> dict[str, str]:
    """Options of a Parquet writer: Bloom filters, as large as what they hold, for columns that are looked up by value."""
    enabled = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return {**enabled, "parquet.bloom.filter.adaptive.enabled": "true"} if columns else {}


def upsert(
    delta: DataFrame, state: Commit, root: str, table: str, key: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS, near: tuple[str, ...] = (),
) -> None:
    """Merge rows into a bucketed table. ``delta`` is read twice and should be stored. The rows of a bucket are sorted by
    ``near``, so that statistics prune row groups; the key and the first of ``near`` get Bloom filters."""
    spark, schema = delta.sparkSession, delta.schema
    dealt = delta.withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r[0] for r in dealt.select("bucket").distinct().collect())
    if not touched:
        return
    merged = merge(read_buckets(spark, state, table, schema, touched), delta).select(*delta.columns)
    path = new_folder(root, table)
    merged = merged.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", *near)
    merged.write.options(**blooms((key, *near[:1])), compression="zstd").partitionBy("bucket").parquet(path)
    held = state.buckets.setdefault(table, {})
    for bucket in map(str, touched):
        if bucket in held:
            state.dropped.append(held[bucket])
        held[bucket] = f"{path}/bucket={bucket}"

"""Media references out of a stream, each (entity, path) once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.media import extract_media

REMEMBERED = 2048  # fixed default value: keys that are remembered
SHARDS = 16


def new_media(stream: DataFrame, entity: list[str], payloads: list[str], home: str, memory: str) -> DataFrame:
    """References not seen before within the watermark; ``memory`` bounds how long a key is remembered."""
    marked = stream.withWatermark("ts", memory)
    found = extract_media(marked, [*entity, "ts"], payloads, home, distinct=False)
    return found.dropDuplicatesWithinWatermark([*entity, "path"])


def new_media_by_count(
    stream: DataFrame, entity: list[str], payloads: list[str], home: str, budget: int = REMEMBERED, shards: int = SHARDS
) -> DataFrame:
    """References that are not among the ``budget`` keys remembered, whatever their age; the oldest key goes first."""
    found = extract_media(stream, [*entity, "ts"], payloads, home, distinct=False)
    return first_seen(found, [*entity, "path"], "ts", budget, shards)


def first_seen(rows: DataFrame, key: list[str], order: str, budget: int, shards: int = SHARDS) -> DataFrame:
    """Rows whose key is not remembered, in order of ``order`` within a micro-batch.

    Keys are dealt by hash into shards; each remembers its share of the budget in the order of first sight and forgets its
    oldest key beyond that, so no task sees all keys and the state is bounded by ``budget``. A remembered key that comes
    again does not become younger.
    """
    most = max(1, budget // shards)
    state = T.StructType([T.StructField("keys", T.ArrayType(T.StringType()))])

    def step(_: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(group.get[0] if group.exists else ())
        for part in [pd.concat(list(parts)).sort_values([order, *key], kind="stable")]:
            fresh = []
            for name in part["_key"]:
                fresh.append(name not in known)
                if fresh[-1]:
                    known[name] = None
                    if len(known) > most:
                        del known[next(iter(known))]
            yield part[fresh].drop(columns=["_key", "_shard"])
        group.update((list(known),))

    named = rows.withColumn("_key", F.to_json(F.struct(*key))).withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)))
    return named.groupBy("_shard").applyInPandasWithState(step, rows.schema, state, "append", GroupStateTimeout.NoTimeout)

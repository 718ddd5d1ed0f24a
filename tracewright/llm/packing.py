"""Sharding by vector bin packing.

Groups of equal texts are placed whole, so that bytes, tokens and rows of the shards come out near equal together. A
group goes where the dot product of its size vector with a shard's residual capacity is highest (ties: smaller shard);
sizes are measured as shares of all bytes, tokens and rows, larger groups first.

Placing has two levels, so that no task sees all groups. Groups are dealt by hash into a fixed number of packs; a task
reads the groups of a pack in order of size and places them into as many bins as there are shards, keeping only the
loads. Then the bins of all packs (packs x shards of them, whatever the input) are placed into the shards by the same
rule. A group that holds more than 1 / (4 x shards) of all bytes, tokens or rows (there are at most 12 x shards such
groups) cannot go whole without tilting a shard; it is dealt by id into pieces of at most that size, which are placed
as groups of their own.

Size is the UTF-8 length plus 1; a null text has length 0 and is a group of its own kind. Tokens are words between
blanks. Repeated rows are rows of their own, with slots of their own; rows without an id are placed too. An empty table
gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, stored

PACKS = 256
SLACK = 4  # pieces of hot groups are at most this part of a shard


def place(loads: np.ndarray, item: np.ndarray) -> int:
    """The bin for an item, whose residual capacity is what its load leaves of the common capacity."""
    at = int(np.argmin(loads @ item))  # capacity . item is the same for all bins
    loads[at] += item
    return at


def pack(docs: DataFrame, shards: int = 16, packs: int = PACKS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slots count from 0 in every shard, without gaps."""
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    rows = stored(
        docs.select(
            docs["doc_id"].alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            # two texts that share both hashes would only be placed together
            F.xxhash64(text, text.isNull()).alias("__group"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    whole = [max(1, x or 0) for x in total]
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    limits = [x / (SLACK * shards) for x in whole]
    need = [F.ceil(F.col(c) / F.lit(limit)) for c, limit in zip(("size", "tokens", "rows"), limits, strict=True)]
    hot = rows.groupBy("__group").agg(*sums).withColumn("__pieces", F.greatest(*need))
    hot = hot.where((F.col("__pieces") > 1) & (F.col("rows") > 1)).select("__group", "__pieces")
    piece = F.pmod(F.xxhash64("doc_id", "__row"), F.coalesce("__pieces", F.lit(1)))
    rows = rows.join(F.broadcast(hot), "__group", "left").withColumn("__piece", piece)  # at most 3 * SLACK * shards groups
    items = rows.groupBy("__group", "__piece").agg(*sums)
    items = items.withColumn("__pack", F.pmod(F.xxhash64("__group", "__piece"), F.lit(packs)).cast("int"))
    items = items.withColumn("__weight", F.greatest(*[F.col(c) / F.lit(w) for c, w in zip(("size", "tokens", "rows"), whole, strict=True)]))
    dealt = items.repartition("__pack").sortWithinPartitions("__pack", F.desc("__weight"), "__group", "__piece")

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, loads = -1, np.zeros((shards, 3))
        for batch in batches:
            sizes = batch[["size", "tokens", "rows"]].to_numpy(float) / whole
            out = np.empty(len(batch), np.int32)
            for k, own in enumerate(batch["__pack"].to_numpy()):
                if own != now:
                    now, loads = own, np.zeros((shards, 3))
                out[k] = place(loads, sizes[k])
            yield batch[["__group", "__piece", "__pack", "size", "tokens", "rows"]].assign(__bin=out)

    placed = stored(
        dealt.mapInPandas(bins, "__group long, __piece long, __pack int, size long, tokens long, rows long, __bin int"), "bins"
    )
    found = placed.groupBy("__pack", "__bin").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    of_bin = [(*r, s, o) for r, s, o in _shards([tuple(r) for r in found.collect()], np.array(whole, float), shards)]
    # packs x shards rows
    lookup = F.broadcast(spark.createDataFrame(of_bin, "__pack int, __bin int, shard int, __offset long"))
    own = placed.select("__group", "__piece", "__pack", "__bin").join(lookup, ["__pack", "__bin"])
    joined = rows.join(own, ["__group", "__piece"])
    rank = F.expr("row_number() over (partition by __pack, __bin order by doc_id, __row)")
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__offset") + rank - 1).cast("long").alias("slot"), "tokens"
    )


def _shards(bins: list[tuple], whole: np.ndarray, shards: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((pack, bin), shard, rows of the shard before it) for each bin, given (pack, bin, size, tokens, rows)."""
    loads, filled = np.zeros((shards, 3)), [0] * shards
    for pack_, bin_, *sizes in sorted(bins, key=lambda b: (-max(np.array(b[2:], float) / whole), b[0], b[1])):
        shard = place(loads, np.array(sizes, float) / whole)
        yield (pack_, bin_), shard, filled[shard]
        filled[shard] += sizes[2]

"""Source divergence audit: which terms a source uses more than its language does, and how far sources lie apart.

Terms are counted in tasks over the bytes of many texts at once. Short terms are packed: up to 8 bytes into one uint64
word, up to 16 into two, high byte first and filled with zeros (no term holds a zero byte). Words are sorted by radix, 16
bits at a time, and runs of equal words of a group are counted. Longer terms go to a bucket for each length and are
sorted as bytes. A text larger than a portion is counted in portions that end between terms, and counts as one document.

A task returns one row for each (lang, source, term) of a portion; Spark adds them up, keeps the terms that enough documents
of the language hold, and gives every group the smoothed share p = 1 + floor(scale * (count + alpha) / (N + alpha * V)).
Differences of sources are summed over chunks of terms: the tasks of a language share its terms, each task holds a bounded
table of sources by terms, and Spark adds up the sums. No task sees all terms of a language, and no group all its rows.

Null text, lang and source count as empty; repeated rows are documents of their own; groups without a kept term have the
share of an absent term everywhere, and where no term is kept all differences are 0. Empty tables give empty tables; extra
columns are not looked at. Counts are integers throughout, shares are divided as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import partitions, sized, stored

PORTION = 1 << 22  # bytes of text that are counted at once; counting takes about 20 times as much memory
CELLS = 1 << 22  # sources x terms of a chunk at most
ROWS = 200_000  # counts of a chunk, about
PARTIAL = "lang string, source string, term string, count long, docs long"

# Letters and all that is not ASCII, and A-Z as a-z: fixed by the contract.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
KEEP = np.array([0, *[(~0 << (64 - 8 * n)) & (2**64 - 1) for n in range(1, 9)]], np.uint64)  # the first n bytes of a word


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by words, the least significant one first. 16-bit keys are sorted by radix."""
    order = np.arange(len(words[0]))
    for word in words:
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The up to eight bytes from ``begin`` as one word. ``data`` must go on for eight bytes behind the last term."""
    bytes_ = np.lib.stride_tricks.sliding_window_view(data, 8)[begin]
    return np.ascontiguousarray(bytes_).view(">u8").ravel().astype(np.uint64) & KEEP[np.minimum(length, 8)]


def runs(terms: list[np.ndarray], doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and documents of each run of equal terms and group, given rows in that order."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.ones(len(doc), bool)
    fresh[1:] = group[1:] != group[:-1]
    for term in terms:
        fresh[1:] |= term[1:] != term[:-1]
    first = np.flatnonzero(fresh)
    new_doc = fresh.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(first, append=len(doc)), np.add.reduceat(new_doc.astype(np.int64), first)


def count_terms(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, groups, counts, documents) of texts that lie one behind the other in ``data``, ordered by group."""
    data = LOWER[data]
    inside = TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    first[bounds[:-1][filled]] = inside[bounds[:-1][filled]]
    last[bounds[1:][filled] - 1] = inside[bounds[1:][filled] - 1]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin
    del inside, first, last
    doc = np.searchsorted(bounds, begin, side="right") - 1
    data = np.concatenate([data, np.zeros(16, np.uint8)])

    def found(rows: np.ndarray, keys: list[np.ndarray], order: np.ndarray):
        rows, keys = rows[order], [k[order] for k in keys]
        at, count, docs = runs(keys, doc[rows], group[doc[rows]])
        return [k[at] for k in keys], group[doc[rows[at]]], count, docs

    one = np.flatnonzero(length <= 8)
    keys = [packed(data, begin[one], length[one])]
    keys, *rest = found(one, keys, radix_order(keys))
    yield keys[0].astype(">u8").view("S8").tolist(), *rest
    del one, keys, rest
    two = np.flatnonzero((length > 8) & (length <= 16))
    keys = [packed(data, begin[two] + 8, length[two] - 8), packed(data, begin[two], length[two])]
    keys, *rest = found(two, keys, radix_order(keys))
    yield np.stack(keys[::-1], axis=1).astype(">u8").view("S16").ravel().tolist(), *rest
    del two, keys, rest
    long = np.flatnonzero(length > 16)
    long = long[np.argsort(length[long], kind="stable")]
    for same in np.split(long, np.flatnonzero(np.diff(length[long])) + 1) if len(long) else ():
        size = int(length[same[0]])
        bytes_ = np.lib.stride_tricks.sliding_window_view(data, size)[begin[same]]
        keys = [np.ascontiguousarray(bytes_).view(f"S{size}").ravel()]
        keys, *rest = found(same, keys, np.argsort(keys[0], kind="stable"))
        yield keys[0].tolist(), *rest


def large_text(data: np.ndarray, portion: int) -> dict[bytes, int]:
    """Counts of the terms of one text, portion by portion; a portion ends between terms."""
    total: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        end = min(at + portion, len(data))
        while end < len(data) and TERM[data[end]]:
            ahead = np.flatnonzero(~TERM[data[end : end + portion]])
            end = end + int(ahead[0]) if len(ahead) else min(end + portion, len(data))
        for terms, _, counts, _ in count_terms(data[at:end], np.array([0, end - at]), np.zeros(1, np.int64)):
            for term, count in zip(terms, counts.tolist(), strict=True):
                total[term] = total.get(term, 0) + count
        at = end
    return total


def partial_counts(docs: DataFrame, portion: int = PORTION) -> DataFrame:
    """Rows (lang, source, term, count, docs) to be added up."""

    def rows_of(names: list[tuple[str, str]], parts: Iterator) -> Iterator[pa.RecordBatch]:
        for terms, groups, counts, docs_ in parts:
            if len(terms):
                lang, source = (pa.array([n[k] for n in names], pa.string()).take(pa.array(groups)) for k in (0, 1))
                text = pa.array(terms, pa.binary()).cast(pa.string())
                columns = [lang, source, text, pa.array(counts, pa.int64()), pa.array(docs_, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            names = sorted(set(pairs))
            code = {pair: i for i, pair in enumerate(names)}
            group = np.fromiter((code[p] for p in pairs), np.int64, len(pairs))
            order = np.argsort(group, kind="stable")
            group = group[order]
            text = batch.column(2).cast(pa.large_binary()).take(pa.array(order))
            _, offsets, buffer = text.buffers()
            ends = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
            data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + portion, side="right")) - 1)
                part, bounds = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
                if len(part) <= portion:
                    yield from rows_of(names, count_terms(part, bounds, group[at:to]))
                else:
                    total = large_text(part, portion)
                    size = len(total)
                    counts = np.fromiter(total.values(), np.int64, size)
                    yield from rows_of(names, iter([(list(total), np.full(size, group[at]), counts, np.ones(size, np.int64))]))
                at = to

    texts = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*texts).mapInArrow(run, PARTIAL)


def share(count: Column, total: Column, kept: Column, alpha: int, scale: int) -> Column:
    """1 + floor(scale * (count + alpha) / (total + alpha * kept)), in decimals."""
    above = (count + alpha).cast("decimal(28,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", above, (total + kept * alpha).cast("decimal(28,0)")).cast("long") + 1


def audit(docs: DataFrame, least_docs: int = 30, alpha: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance (``pair``), the ``top`` terms by excess (``term``)."""
    spark = docs.sparkSession
    sums = [F.sum("count").alias("count"), F.sum("docs").alias("docs")]
    counts = stored(partial_counts(docs).groupBy("lang", "source", "term").agg(*sums), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("whole"), F.sum("docs").alias("docs"))
    kept = sized(kept.where(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    mine = stored(counts.join(kept, ["lang", "term"]), "kept")

    names = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = mine.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    absent = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"), alpha, scale))
    groups = sized(groups.withColumn("absent", absent))

    shares = mine.join(groups, ["lang", "source"]).select(
        "lang", "source", "term",
        share(F.col("count"), F.col("total"), F.col("kept"), alpha, scale).alias("p"),
        share(F.col("whole"), F.col("lang_total"), F.col("kept"), alpha, scale).alias("q"),
    )
    excess = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.expr("cast(row_number() over (partition by lang, source, part order by value desc, item) as int)")
    terms = excess.withColumn("rank", ranked).where(F.col("rank") <= top)

    size = mine.agg(F.count(F.lit(1))).first()[0]
    table = groups.groupBy("lang").agg((F.count(F.lit(1)) * F.max("kept")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    chunks = max(partitions(spark), -(-size // ROWS), -(-table // CELLS))
    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    sides = groups.where("kept > 0").select("lang", "source", "absent", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sums_ = shares.select("lang", "source", "term", "p", chunk.alias("chunk")).groupBy("lang", "chunk")
    apart = sums_.cogroup(sides.groupBy("lang", "chunk")).applyInPandas(distances, "lang string, source string, item string, value long")
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = groups.where("kept = 0")
    others = none.select("lang", F.col("source").alias("item"))
    zero = none.join(others, "lang").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    half = apart.unionByName(zero)
    other = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = half.unionByName(other).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return pairs.unionByName(terms)


def distances(shares: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """Sum of |p - p'| over the terms of a chunk, for each two sources of the language, the lesser one first."""
    sides = sides.sort_values("source", ignore_index=True)
    names = sides["source"].to_numpy(object)
    if shares.empty or len(names) < 2:
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})
    terms, column = np.unique(shares["term"].to_numpy(object), return_inverse=True)
    table = np.repeat(sides["absent"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    row = pd.Index(names).get_indexer(shares["source"])
    table[row, column] = shares["p"].to_numpy(np.int64)
    sums = [np.abs(table[k + 1 :] - table[k]).sum(axis=1) for k in range(len(names) - 1)]
    left = np.repeat(np.arange(len(names) - 1), [len(s) for s in sums])
    right = np.concatenate([np.arange(k + 1, len(names)) for k in range(len(names) - 1)])
    return pd.DataFrame({"lang": shares["lang"].iloc[0], "source": names[left], "item": names[right], "value": np.concatenate(sums)})

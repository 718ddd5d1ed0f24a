"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, each set if it is set in over half the hashes of a text's word shingles. Fingerprints link at
``RADIUS`` = 4 or fewer differing bits; components of links are the groups.

The bits are cut into three segments. If two fingerprints differ in at most four bits, then either
 - one segment is equal, and of five blocks of the other bits one is equal too, or
 - every segment differs, so two of them differ in exactly one bit each: leaving out that bit of the first (one-wildcard
   variant of the segment) makes it equal, and one half of the second is equal.
So each fingerprint is indexed under 15 pairs of segment and block and 130 pairs of segment variant and half, every key
about 30 bits wide, and linked fingerprints meet under at least one equal key. There they are verified. A key with many
fingerprints is cut into blocks; blocks are verified in themselves and then pair by pair, in tasks of their own. Only
links that join what is not yet joined within the same key leave a task, so dense groups give few links, yet the
components are those of all links.

Equal fingerprints are one row before anything is compared. A text without words has fingerprint zero and links like
any other. Null texts count as empty. Repeated rows share a fingerprint. Rows without an id get the component of their
fingerprint, null if nothing in it has an id. Empty tables give empty ones. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import partitions, stored, unused
from tracewright.llm.components import components

RADIUS = 4
SEED = 42  # fixed by the contract
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
SMALL = 6  # rows of a key that are compared all at once
BLOCK = 8192


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A to Z only, and exactly the blanks of the contract
    if not words:
        return 0
    joined, count = b" ".join(words), max(1, len(words) - width + 1)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    last = min(width, len(words)) - 1
    for at in range(0, count, 1 << 16):  # bounded memory for very long texts
        upto = min(count, at + (1 << 16))
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:upto], ends[at + last : upto + last], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int, keep: tuple[str, ...] = ("doc_id",), name: str = "__fp") -> DataFrame:
    """The columns ``keep`` with ``name``, the fingerprint as a signed long."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.select(range(len(keep))).columns, pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(*[docs[c] for c in keep], docs["text"].alias(unused(docs, "__text"))).mapInArrow(run, schema)


def bits(fps: np.ndarray, first: int, length: int) -> np.ndarray:
    return (fps >> np.uint64(first)) & np.uint64((1 << length) - 1)


def keys(fps: np.ndarray) -> Iterator[np.ndarray]:
    """Each key of every fingerprint: number of the key above 40 bits, its value below."""
    number = 0

    def key(high: np.ndarray, low: np.ndarray, low_bits: int) -> np.ndarray:
        nonlocal number
        number += 1
        return (np.uint64(number << 40) | (high << np.uint64(low_bits)) | low).view(np.int64)

    for i, (first, length) in enumerate(SEGMENTS):
        rest = [s for k, s in enumerate(SEGMENTS) if k != i]
        other = bits(fps, *rest[0]) << np.uint64(rest[1][1]) | bits(fps, *rest[1])
        size = rest[0][1] + rest[1][1]
        cuts = [round(size * b / (RADIUS + 1)) for b in range(RADIUS + 2)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield key(bits(fps, first, length), bits(other, start, end - start), end - start)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (first, length), (other, size) = SEGMENTS[i], SEGMENTS[j]
        segment, half = bits(fps, first, length), size // 2
        for left_out in range(length):
            variant = bits(segment, left_out + 1, length) << np.uint64(left_out) | bits(segment, 0, left_out)
            yield key(variant, bits(fps, other, half), half)
            yield key(variant, bits(fps, other + half, size - half), size - half)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is linked within ``fps``, as a forest."""
    left, heads, tails = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(fps[left], fps[at], radius)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                heads.append(np.full(len(found), at))
                tails.append(found)
    none = np.zeros(0, int)
    return (fps[np.concatenate(heads)], fps[np.concatenate(tails)]) if heads else (fps[none], fps[none])


def between(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from ``a`` to ``b`` that join what all of them join: a forest again."""
    both = np.concatenate([a, b])
    side = np.arange(len(both)) < len(a)
    left, heads, tails = np.arange(len(both)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(both[left], both[at], radius) & (side[left] != side[at])
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                heads.append(np.full(len(found), at))
                tails.append(found)
    none = np.zeros(0, int)
    return (both[np.concatenate(heads)], both[np.concatenate(tails)]) if heads else (both[none], both[none])


OUT = "a long, b long, key long, no int, part binary"


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints __fp that join all that lies within ``radius`` bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the index finds fingerprints up to {RADIUS} differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                own = batch.column(0).slice(start, 1024).to_numpy(zero_copy_only=False)
                for values in _grouped(keys(own.view(np.uint64)), 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(values)), pa.array(np.tile(own, len(values)))], names=["key", "fp"]
                    )

    def pair(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return _rows(a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key."""
        kept_key, kept_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut_key, cut_no = None, 0  # the key of which blocks went out, and how many

        def solve(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs of equal keys."""
            nonlocal cut_key, cut_no
            if cut_key is not None and len(key) and key[0] == cut_key:
                size = int(np.searchsorted(key, cut_key, side="right"))
                yield from block(cut_key, fps[:size])
                key, fps = key[size:], fps[size:]
            cut_key, cut_no = None, 0
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(key)])
            few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            heads, tails = [], []
            for step in range(1, SMALL):
                at = np.flatnonzero(few[:-step] & (key[step:] == key[:-step]))
                at = at[near(fps[at], fps[at + step], radius)]
                heads.append(fps[at])
                tails.append(fps[at + step])
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                a, b = spanning(fps[s : s + n], radius)
                heads.append(a)
                tails.append(b)
            if sum(map(len, heads)):
                found = np.unique(np.stack([np.concatenate(heads), np.concatenate(tails)]), axis=1)
                yield pair(found[0], found[1])

        def block(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal cut_no
            a, b = spanning(fps, radius)
            if len(a):
                yield pair(a, b)
            yield _rows(key=pa.array([int(key)]), no=pa.array([cut_no], pa.int32()), part=pa.array([fps.tobytes()], pa.binary()))
            cut_no += 1

        for batch in batches:
            kept_key = np.concatenate([kept_key, batch.column(0).to_numpy(zero_copy_only=False)])
            kept_fps = np.concatenate([kept_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(kept_key, kept_key[-1])) if len(kept_key) else 0
            if last:
                yield from solve(kept_key[:last], kept_fps[:last])
                kept_key, kept_fps = kept_key[last:], kept_fps[last:]
            while len(kept_key) > BLOCK:
                if cut_key != kept_key[0]:
                    cut_key, cut_no = kept_key[0], 0
                yield from block(cut_key, kept_fps[:BLOCK])
                kept_key, kept_fps = kept_key[BLOCK:], kept_fps[BLOCK:]
        yield from solve(kept_key, kept_fps)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = between(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    indexed = classes.select("__fp").mapInArrow(spread, "key long, fp long")
    met = stored(indexed.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(meet, OUT), "met")
    found = met.where("a is not null").select("a", "b")
    blocks = met.where("part is not null").select("key", "no", "part")
    if blocks.limit(1).count():
        other = blocks.select("key", F.col("no").alias("no2"), F.col("part").alias("part2"))
        pairs = blocks.join(other, "key").where("no < no2").repartition("key", "no", "no2").select("part", "part2")
        found = found.unionByName(pairs.mapInArrow(cross, "a long, b long"))
    return found


def _grouped(arrays: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    out: list[np.ndarray] = []
    for x in arrays:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def _rows(**given: pa.Array) -> pa.RecordBatch:
    size = len(next(iter(given.values())))
    kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "no": pa.int32(), "part": pa.binary()}
    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds))


def rooted(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """doc_id, __fp, __root (a number of the group) and component_id, the smallest id of the group."""
    own = stored(fingerprints(docs, width), "fingerprints")
    classes = stored(own.groupBy("__fp").agg(F.min("doc_id").alias("__least")), "classes")
    roots = stored(components(links(classes, radius)), "roots")
    reached = classes.join(roots, classes["__fp"] == roots["node"], "left").withColumn("__root", F.coalesce("root", "__fp"))
    least = reached.groupBy("__root").agg(F.min("__least").alias("component_id"))
    named = reached.select("__fp", "__root").join(least, "__root").select("__fp", "__root", "component_id")
    return own.join(named, "__fp").select("doc_id", "__fp", "__root", "component_id")


def groups(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return rooted(docs, width, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")


def distinct(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """docs, all columns, with one row of each group: one with the smallest id (of rows that share it, one with the least
    fingerprint). Documents without an id stay only where no document of their group has one."""
    found = rooted(docs, width, radius)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__stay")).distinct().hint("shuffle_hash")
    named = docs.join(stay, docs["doc_id"] == stay["__stay"], "left_semi")
    # Ids that several rows share, and rows without one, are told apart by their fingerprints.
    shared = found.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("__shared"))
    if shared.limit(1).count():
        chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("__root", "doc_id").agg(F.min("__fp").alias("__chosen"))
        unclear = docs.join(shared, docs["doc_id"].eqNullSafe(shared["__shared"]), "left_semi")
        columns, own = unclear.columns, unused(docs, "__fp")
        marked = fingerprints(unclear, width, tuple(columns), own)
        same = marked["doc_id"].eqNullSafe(chosen["doc_id"]) & (marked[own] == chosen["__chosen"])
        marked = marked.join(chosen, same, "left_semi").dropDuplicates(["doc_id", own])
        named = named.join(shared, named["doc_id"] == shared["__shared"], "left_anti").unionByName(marked.select(*columns))
    return named

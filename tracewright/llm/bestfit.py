"""Best-fit packing of documents into training sequences.

A document is its token ids and an end id. One longer than a sequence is cut into whole sequences, the rest in front;
nothing else is cut. Packing is online best-fit in bounded space: a fixed number of bins is open, kept by their free space
in a bitset. An item goes where least space stays free, the lowest set bit from its size on; where none fits a new bin
opens, and if too many are open the fullest, the lowest set bit of all, closes. Items come in windows, the longest of a
window first, which leaves the short ones to fill gaps.

Documents are dealt by hash into packs that are packed on their own; their number grows with the number of documents. Only
lengths and checksums go through the shuffle; ids stay where they were stored.

Tokens come from the tokenizers library. A text is cut after runs of letters and before white space, where the published
pre-tokenizing pattern always cuts (it looks ahead at white space only); the ids of the parts together are those of the
text. Parts recur, so a worker remembers a bounded number of them. Strings of special tokens are ordinary text.

Null texts count as empty and are the end id alone. Repeated rows and rows without an id are packed each for
themselves. Extra columns are not looked at. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import crc32, stored

LIMIT = 2048
OPEN = 8192  # bins that are open at once
WINDOW = 8192  # items that come in order of length
PACKS, PACK_ROWS = 16, 131_072  # at least so many packs, of about so many documents at most
REMEMBERED = 300_000  # parts, and words, in each of two generations
ROWS = 256  # documents that are turned into one Arrow batch

# Latin letters; what follows them within ASCII is none, so the pattern cuts there. The other cut is before a blank.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
CUT = re.compile(rf"(?<=[{LETTERS}])(?=[\x00-@\[-`{{-\x7f])|(?<=[!-~])(?=[ \t\n\r])")
WORD = re.compile(rf" ?[{LETTERS}]+")
LATIN = re.compile(rf"[{LETTERS}]+").fullmatch
STOPS = frozenset(".,;:!?")
BLANKS = re.compile(r"\s ")
# The published alphabet of byte-level pieces: printable bytes stand for themselves, the others are numbered from 256.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        before = given["pre_tokenizer"]
        if given["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level tokenizer; texts could not be encoded in parts")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        # Ids of parts, and of what stands between two blanks with the blank in front; the latest and those before.
        self.parts: list[dict[str, bytes]] = [{}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]

    def whole_part(self, part: str) -> bytes:
        """A word is one piece for the model; other parts need the whole tokenizer."""
        if len(part) < 64 and WORD.fullmatch(part):
            ids = [p.id for p in self.model.tokenize(part.encode().decode("latin-1").translate(ALPHABET))]
        else:
            ids = self.whole.encode(part, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def cut(self, text: str) -> bytes:
        parts = CUT.split(text)
        if len(parts) == 1:
            return self.whole_part(text)
        get, known = self.words[0].get, self.parts[0].get
        return b"".join(
            [(get(p[1:]) or self.word(p[1:])) if p[0] == " " and len(p) > 1 else (known(p) or self.part(p)) for p in parts]
        )

    def part(self, part: str) -> bytes:
        return remember(self.parts, part, self.parts[1].get(part) or self.whole_part(part))

    def word(self, word: str) -> bytes:
        found = self.words[1].get(word)
        if found is None:
            stem, last = word[:-1], word[-1:]
            if last in STOPS and LATIN(stem):
                # the pattern cuts between a letter and a stop
                return (self.words[0].get(stem) or self.word(stem)) + (self.parts[0].get(last) or self.part(last))
            if len(word) < 64 and word.isascii() and word.isalpha():
                found = array("I", [p.id for p in self.model.tokenize(ALPHABET[0x20] + word)]).tobytes()
            elif LATIN(word):
                found = self.whole_part(" " + word)
            else:
                found = self.cut(" " + word)
        return remember(self.words, word, found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if BLANKS.search(text):
            return self.cut(text)
        # No white space in front of a blank: the pattern cuts before every blank.
        first, *words = text.split(" ")
        get, slow = self.words[0].get, self.word
        return b"".join([self.cut(first) if first else b"", *[get(w) or slow(w) for w in words]])


def remember(generations: list[dict[str, bytes]], key: str, value: bytes) -> bytes:
    if len(key) < 64:
        if len(generations[0]) >= REMEMBERED:
            generations[:] = [{}, generations[0]]
        generations[0][key] = value
    return value


def tokens(docs: DataFrame, path: str, end: int = 0, limit: int = LIMIT, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, row (unique), length, the checksum of each piece, and the ids, which ``sequences`` needs; stored."""
    schema = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("crcs", T.ArrayType(T.LongType())),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        ]
    )
    tail = np.array([end], "<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value  # a worker keeps it from task to task, and with it the tokenizer and the latest parts
        encoder = box.get("encoder") or box.setdefault("encoder", Encoder(path))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                flat, ends, crcs, pieces = array("i"), [0], [], [0]
                for value in rows.column(2).to_pylist():
                    ids = encoder.encode(value or "") + tail
                    ends.append(ends[-1] + len(ids) // 4)
                    if keep_ids:
                        flat.frombytes(ids)
                    first = len(ids) % (4 * limit)
                    cuts = [0, *range(first or 4 * limit, len(ids) + 1, 4 * limit)]
                    crcs.extend(crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:]))
                    pieces.append(len(crcs))
                sums = pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), pa.array(crcs, pa.int64()))
                columns = [rows.column(0), rows.column(1), pa.array(np.diff(ends), pa.int64()), sums]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row"), docs[text].cast("string").alias("text"))
    return stored(rows.mapInArrow(run, schema), "tokens")


class Bins:
    """Open bins by free space: a bit for each space that some bin has, and the bins that have it."""

    def __init__(self, limit: int, most: int) -> None:
        self.limit, self.most, self.open = limit, most, 0
        self.bits = 0
        self.of: list[list[int]] = [[] for _ in range(limit + 1)]
        self.count = 0  # bins opened so far

    def take(self, free: int) -> int:
        bins = self.of[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item of at most ``limit``."""
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            at = self.take(free)
        else:
            if self.open >= self.most and size < self.limit:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, at = self.limit, self.count
            self.count += 1
        if free > size:
            left = free - size
            self.of[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.limit - free

    def whole(self, bins: int) -> int:
        """The first of so many new bins that are full at once."""
        first = self.count
        self.count += bins
        return first


def pack(rows: DataFrame, limit: int = LIMIT, most: int = OPEN, window: int = WINDOW) -> DataFrame:
    """Rows of ``tokens`` with their place: ``bin`` and ``offset`` of the first piece if it is shorter than a sequence, and
    ``whole``, the first of the consecutive sequences of the other pieces. Sequence numbers are unique over all packs."""
    packs = max(PACKS, -(-rows.agg(F.count(F.lit(1))).first()[0] // PACK_ROWS))
    light = rows.select("doc_id", "row", "length", "crcs", F.pmod(F.xxhash64("row"), F.lit(packs)).alias("pack"))
    dealt = light.repartition(packs, "pack").sortWithinPartitions("pack", F.xxhash64(F.lit(1), "row"), "row")
    schema = T.StructType([*light.schema.fields, *[T.StructField(c, T.LongType()) for c in ("bin", "offset", "whole")]])

    def placed(part: pa.Table, bins: Bins, number: int) -> pa.RecordBatch:
        length = part.column("length").to_numpy()
        bin_, offset, whole = (np.zeros(len(length), np.int64) for _ in range(3))
        rest = length % limit
        for k in np.argsort(-rest, kind="stable").tolist():
            if rest[k]:
                bin_[k], offset[k] = bins.place(int(rest[k]))
            whole[k] = bins.whole(int(length[k] // limit))
        base = number << 40
        columns = [*part.combine_chunks().columns, pa.array(bin_ + base), pa.array(offset), pa.array(whole + base)]
        return pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, bins, size = None, Bins(limit, most), 0
        for batch in batches:
            packs_ = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(packs_)) + 1).tolist(), len(packs_)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if packs_[a] != now:
                    if held:
                        yield placed(pa.Table.from_batches(held), bins, now)
                    held, size, now, bins = [], 0, int(packs_[a]), Bins(limit, most)
                while a < b:
                    part = batch.slice(a, min(b - a, window - size))
                    held.append(part)
                    a, size = a + part.num_rows, size + part.num_rows
                    if size == window:
                        yield placed(pa.Table.from_batches(held), bins, now)
                        held, size = [], 0
        if held:
            yield placed(pa.Table.from_batches(held), bins, now)

    return dealt.mapInArrow(run, schema)


def pieces(placed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of ``pack``."""
    first = F.col("length") % limit
    rows = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32")).withColumn("first", first)
    rest = (F.col("piece") == 0) & (F.col("first") > 0)
    before = F.when(F.col("first") > 0, F.col("piece") - 1).otherwise(F.col("piece"))  # whole pieces in front
    return rows.select(
        "doc_id",
        "row",
        "piece",
        F.when(rest, 0).otherwise(F.col("first") + before * limit).cast("long").alias("start"),
        F.when(rest, F.col("first")).otherwise(limit).cast("long").alias("length"),
        "ids_crc32",
        F.when(rest, F.col("bin")).otherwise(F.col("whole") + before).alias("sequence_id"),
        F.when(rest, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )


def sequences(tokens_: DataFrame, placed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, each of at most ``limit`` ids."""
    cut = pieces(placed, limit).join(tokens_.select("row", "ids"), "row")
    cut = cut.select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))

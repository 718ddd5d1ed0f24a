"""Language-model scoring by prediction by partial matching.

A byte-context trie of order ``ORDER`` is trained on a corpus: for every context of up to four bytes, which bytes
followed and how often. A byte is predicted in the longest context the trie knows; if it did not follow there, the model
escapes to the next shorter context, where bytes already ruled out are excluded, and so on down to a uniform choice
among the bytes never seen. Escape estimation is by the number of different bytes that followed, and by how often none
did. The code length of a document, pretrained, is the sum over its bytes and its end.

All texts are counted, in tasks that each add up the n-grams and words they read before anything is shuffled. No count is
dropped. The value of a position depends on its five bytes alone. Grams of five bytes that occur at least once in 2^22
positions (so at most 2^22) go to every task with their values; what else a document holds is looked up by its code: the
trie is dealt out by the last three bytes of the context, and each task builds the part of it that its codes need. Grams
of up to three bytes, of which an alphabet bounds the number, whatever the size of the corpus, are in every part.

The baseline is the unigram score of words with add-0.1 smoothing. Words that occur at least once in 2^20 tokens (so at
most 2^20 words) go to every task; the counts of all others are joined by word.

Texts are lower-cased (A to Z). Null texts count as empty: one token, the end. Repeated rows and rows without an id are
scored each on its own. Without training texts all bytes are equally likely. Empty tables give empty ones. Extra columns
are not looked at. Very long texts are counted and scored in stretches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stored

ORDER = 4
RAREST = 1 << 22  # positions among which a gram must occur once to go to every task
LOW = 3  # bytes of the grams that are in every part of the trie
PART = 1 << 20  # rows of a part of the trie, about
COMMON = 1 << 20  # tokens among which a word must occur once to go to every task
ADD = 0.1  # fixed by the contract
STRETCH = 1 << 20  # positions worked on at once
WORDS_HELD = 400_000
GRAMS_HELD = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    return (text or "").encode().lower()


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Codes of ORDER + 1 bytes (the last one predicted, zeros in front of a text and as its end), and which stretch of
    them belongs to which text: (text, from, to)."""
    parts: list[np.ndarray] = []
    spans: list[tuple[int, int, int]] = []
    held = 0
    for number, text in enumerate(texts):
        padded = np.frombuffer(bytes(ORDER) + text + b"\0", np.uint8)
        for start in range(0, len(text) + 1, STRETCH):
            piece = padded[start : min(len(padded), start + STRETCH + ORDER)].astype(np.uint64)
            size = len(piece) - ORDER
            codes = np.zeros(size, np.uint64)
            for k in range(ORDER + 1):
                codes = codes << np.uint64(8) | piece[k : k + size]
            parts.append(codes)
            spans.append((number, held, held + size))
            held += size
            if held >= STRETCH:
                yield np.concatenate(parts), spans
                parts, spans, held = [], [], 0
    if parts:
        yield np.concatenate(parts), spans


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def counted(texts: DataFrame) -> DataFrame:
    """(word, gram, n): counts of words (gram null) and of byte n-grams (word null) in the column ``text``, with one
    row (null, null, n) for the number of texts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes, counts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        held = 0

        def said() -> pa.RecordBatch:
            names, numbers = list(words), list(words.values())
            words.clear()
            return _rows(len(names), word=pa.array(names, pa.binary()), n=pa.array(numbers, pa.int64()))

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                texts = [plain(t) for t in batch.column(0).slice(start, 512).to_pylist()]
                ends += len(texts)
                for text in texts:
                    words.update(text.split())
                    if len(words) > WORDS_HELD:
                        yield said()
                for found, _ in stretches(texts):
                    found.sort()
                    at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    codes.append(found[at])
                    counts.append(np.diff(np.r_[at, len(found)]))
                    held += len(at)
                    if held > GRAMS_HELD:
                        own, n = summed(np.concatenate(codes), np.concatenate(counts))
                        if len(own) > GRAMS_HELD // 2:
                            yield _rows(len(own), gram=pa.array(own.view(np.int64)), n=pa.array(n))
                            own, n = own[:0], n[:0]
                        codes, counts, held = [own], [n], len(own)
        own, n = summed(np.concatenate(codes), np.concatenate(counts))
        yield _rows(len(own), gram=pa.array(own.view(np.int64)), n=pa.array(n))
        yield said()
        yield _rows(1, n=pa.array([ends], pa.int64()))

    return texts.mapInArrow(run, "word binary, gram long, n long")


def _rows(size: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"word": pa.binary(), "gram": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds))


class Hashed:
    """Positions of 64-bit codes, by open addressing."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(codes)).bit_length())
        size = 1 << self.bits
        self.codes, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo = np.arange(len(codes), dtype=np.int32)
        self.probes = 0
        slots = self.slot(codes)
        while len(todo):
            free = self.at[slots] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            take = free & first
            self.at[slots[take]], self.codes[slots[take]] = todo[take], codes[todo[take]]
            todo, slots = todo[~take], (slots[~take] + 1) & (size - 1)
            self.probes += 1

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position of each code, -1 where there is none."""
        slots = self.slot(codes)
        out = self.at[slots]
        wrong = np.flatnonzero((out >= 0) & (self.codes[slots] != codes))
        while len(wrong):
            again = (slots[wrong] + 1) & (len(self.at) - 1)
            slots[wrong] = again
            out[wrong] = self.at[again]
            wrong = wrong[(out[wrong] >= 0) & (self.codes[again] != codes[wrong])]
        return out


class Trie:
    """log10 probabilities in tables: for each order the grams (context and byte) and the contexts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """(codes in order, counts) of the grams of 1 to ORDER + 1 bytes."""
        self.codes, self.counts, self.contexts = [], [], []
        self.whole, self.escape, self.left, self.onward = [], [], [], []
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        lower: dict[str, np.ndarray] = {}
        for k, (codes, counts) in enumerate(grams):
            context = codes >> np.uint64(8)
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(codes) else np.zeros(0, int)
            names = context[starts]
            total = np.add.reduceat(counts, starts).astype(float) if len(starts) else np.zeros(0)
            kinds = np.diff(np.r_[starts, len(codes)]).astype(float)
            pruned = np.zeros(len(names))
            left, onward = np.ones(len(names)), np.ones(len(names))
            if k:
                at = _look(grams[k - 1][0], names)
                pruned = np.where(at >= 0, np.maximum(grams[k - 1][1][at] - total, 0.0), 0.0) if len(names) else pruned
                suffix_of = np.uint64((1 << 8 * (k - 1)) - 1)
                up = np.searchsorted(lower["names"], names & suffix_of) if len(names) else np.zeros(0, int)
                # what the shorter context has beside the bytes that followed here
                shorter = (codes & np.uint64((1 << 8 * k) - 1)) if len(codes) else codes
                seen = grams[k - 1][1][np.searchsorted(grams[k - 1][0], shorter)] if len(codes) else counts
                rest = lower["total"][up] - (np.add.reduceat(seen, starts) if len(starts) else 0)
                escapes = lower["kinds"][up] - kinds + lower["pruned"][up]
                if k == 1:
                    escapes = np.where(lower["kinds"][up] == 256, 0.0, np.maximum(escapes, 1.0))
                left, onward = rest + escapes, escapes / np.maximum(rest + escapes, 1e-300)
                onward = np.where(rest + escapes > 0, onward, 1.0)
            escapes = kinds + pruned if k else np.where(kinds == 256, 0.0, kinds)
            whole = total + escapes
            self.codes.append(codes)
            self.counts.append(log(counts.astype(float)))
            self.contexts.append(names)
            self.whole.append(log(whole))
            self.escape.append(log(escapes / np.maximum(whole, 1e-300)))
            self.left.append(log(left))
            self.onward.append(log(onward))
            lower = {"names": names, "total": total, "kinds": kinds, "pruned": pruned}
        unseen = 256 - len(grams[0][0])
        self.uniform = -np.log10(unseen) if unseen else 0.0
        top = self.codes[-1]
        own = np.searchsorted(self.contexts[-1], top >> np.uint64(8))
        self.value = self.counts[-1] - self.whole[-1][own] if len(top) else np.zeros(0)
        self.hashed = Hashed(top)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code, given the others."""
        found = self.hashed.find(codes)
        out = self.value[found] if len(self.value) else np.zeros(len(codes))
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            return out
        code, total = codes[rest], np.zeros(len(rest))
        came = np.full(len(rest), -1)  # the longer context from which a position escaped
        live = np.arange(len(rest))
        for k in range(ORDER, -1, -1):
            if not len(live):
                break
            gram = code[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            own = _look(self.contexts[k], gram >> np.uint64(8))
            at = _look(self.codes[k], gram)
            prior = came[live]
            if k < ORDER:
                hit = at >= 0
                where = live[hit]
                below = np.where(prior[hit] < 0, self.whole[k][own[hit]], _take(self.left[k + 1], prior[hit]))
                total[where] += self.counts[k][at[hit]] - below
            else:
                hit = np.zeros(len(live), bool)
            miss = ~hit
            live, own, prior = live[miss], own[miss], prior[miss]
            known = own >= 0
            cost = np.where(prior < 0, _take(self.escape[k], own), _take(self.onward[k + 1], prior) if k < ORDER else 0.0)
            total[live] += np.where(known, cost, 0.0)
            came[live] = np.where(known, own, -1)
        total[live] += self.uniform if len(self.codes[0]) else -np.log10(256)
        out[rest] = total
        return out


def _look(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[np.maximum(at, 0)] if len(values) else np.zeros(len(at))


def train(counts: DataFrame) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]], int]:
    """The grams of all sizes (size, code, n), those of up to LOW bytes as (codes in order, counts), and the positions."""
    grams = counts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))
    short = grams.withColumn("size", sizes).withColumn("code", F.expr("gram & (shiftleft(1L, 8 * size) - 1)"))
    short = stored(short.groupBy("size", "code").agg(F.sum("n").alias("n")), "grams")
    positions = short.where("size = 1").agg(F.sum("n")).first()[0] or 0
    kept = short.where(F.col("size") <= LOW).toPandas()
    low = []
    for size in range(1, LOW + 1):
        own = kept[kept["size"] == size].sort_values("code")
        low.append((own["code"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)))
    return short, low, positions


def valued(grams: DataFrame, low: Broadcast, wanted: DataFrame) -> DataFrame:
    """(code, value): log10 probability of the last byte of each code of ``wanted``, given the others. Rows of the trie and
    codes meet by the last LOW bytes of the context."""
    mask = (1 << 8 * LOW) - 1
    own = F.shiftright("code", 8).bitwiseAND(F.lit(mask))
    long = grams.where(F.col("size") > LOW).select("size", "code", "n")
    rows = long.withColumn("key", own)
    # a gram that may end texts is also read as a context, for how often nothing followed
    ends = long.where((F.col("size") <= ORDER) & (F.col("code").bitwiseAND(F.lit(255)) == 0)).withColumn("key", F.col("code").bitwiseAND(F.lit(mask)))
    asked = wanted.select(F.lit(0).alias("size"), "code", F.lit(0).cast("long").alias("n")).withColumn("key", own)
    rows = rows.unionByName(ends).unionByName(asked)

    def part(size: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        asked = code[size == 0]
        values = np.zeros(0)
        if len(asked):
            tables = list(low.value)
            for k in range(LOW + 1, ORDER + 2):
                codes, first = np.unique(code[size == k], return_index=True)
                tables.append((codes, n[size == k][first]))
            values = Trie(tables).scores(asked)
        return pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(values, pa.float64())], names=["code", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, last = 0, None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("size", "code", "n", "key")]
            columns[1] = columns[1].astype(np.int64).view(np.uint64)
            if not len(columns[3]):
                continue
            if rows >= PART and columns[3][-1] != last:
                cut = int(np.searchsorted(columns[3], columns[3][-1]))  # keys come in order: what is before the last one is whole
                held.append([c[:cut] for c in columns])
                yield part(*[np.concatenate([h[i] for h in held]) for i in range(3)])
                held, rows, columns = [], 0, [c[cut:] for c in columns]
            held.append(columns)
            rows, last = rows + len(columns[3]), columns[3][-1]
        if held:
            yield part(*[np.concatenate([h[i] for h in held]) for i in range(3)])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "code long, value double")


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    sc = docs.sparkSession.sparkContext
    counts = stored(counted(docs.where(trains).select("text")), "counts")
    words = stored(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = counts.where("word is null and gram is null").agg(F.sum("n")).first()[0] or 0
    total = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, kinds = (total[0] or 0) + ends, total[1] + (ends > 0)
    below = tokens + ADD * (kinds + 1)
    common = words.where(F.col("c") * COMMON >= tokens).toPandas()  # at most COMMON rows
    grams, low, positions = train(counts)
    low = sc.broadcast(low)
    often = grams.where((F.col("size") == ORDER + 1) & (F.col("n") * RAREST >= positions))  # at most RAREST rows
    often = valued(grams, low, often.select("code")).toPandas()
    box = {
        "codes": often["code"].to_numpy(np.int64).view(np.uint64), "values": often["value"].to_numpy(float),
        "words": dict(zip(map(bytes, common["word"]), common["c"].tolist(), strict=True)),
    }
    shared = sc.broadcast(box)
    pair = pa.struct([("code", pa.int64()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box: dict[str, Any] = shared.value  # a worker keeps it from task to task, and with it the tables
        hashed = box.get("hashed") or box.setdefault("hashed", Hashed(box["codes"]))
        known, log = box["words"], np.log10
        log_end = log((ends + ADD) / below)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [plain(t) for t in part.column(2).to_pylist()]
                scores = np.zeros(len(texts))
                others: list[list[np.ndarray]] = [[] for _ in texts]
                for codes, spans in stretches(texts):
                    at = hashed.find(codes)
                    values = np.where(at >= 0, _take(box["values"], at), 0.0) if len(box["values"]) else np.zeros(len(codes))
                    for number, first, last in spans:
                        scores[number] += values[first:last].sum()
                        others[number].append(codes[first:last][at[first:last] < 0])
                found = [np.unique(np.concatenate(o), return_counts=True) for o in others]
                offsets = np.cumsum([0, *(len(c) for c, _ in found)])
                both = [np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1)]
                pairs = pa.StructArray.from_arrays([pa.array(b) for b in both], fields=list(pair))
                n_tokens, n_known, base, rare = [], [], [], []
                for text in texts:
                    found = Counter(text.split())
                    hits = [(known[w], n) for w, n in found.items() if w in known]
                    rare.append([{"word": w, "tf": n} for w, n in found.items() if w not in known])
                    n_tokens.append(found.total() + 1)
                    n_known.append(sum(n for _, n in hits) + (ends > 0))
                    value = np.array(hits, float).reshape(-1, 2)
                    base.append(float((log((value[:, 0] + ADD) / below) * value[:, 1]).sum() + log_end))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                        pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "others"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", docs["text"].cast("string").alias("text"))
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, tf: long>>, others array<struct<code: long, tf: long>>"
    first = stored(rows.mapInArrow(run, schema), "scored")
    rare = first.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tf")
    counted_ = words.where(F.col("c") * COMMON < tokens)
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(ADD)) / F.lit(float(below) if below else 1.0))
    later = rare.join(counted_, "word", "left").select(
        "row", F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (log * F.col("tf")).alias("base"), F.lit(0.0).alias("score")
    )
    others = first.select("row", F.explode("others").alias("x")).select("row", "x.code", "x.tf")
    values = stored(valued(grams, low, others.select("code").distinct()), "values")
    scored = others.join(values, "code").select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), (F.col("value") * F.col("tf")).alias("score"))
    later = later.unionByName(scored).groupBy("row")
    later = later.agg(F.sum("n_known").alias("__known"), F.sum("base").alias("__base"), F.sum("score").alias("__score"))
    joined = first.drop("rare", "others").join(later, "row", "left")
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("__base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("__score", F.lit(0.0))).alias("score"),
    )

"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (fewer where an item has fewer). For every
size of a benchmark item, windows of that many words slide over each document. A window is compared through its 64-bit
SimHash: the fingerprint is cut into four blocks, and items are indexed under every value of a block that differs in at
most four bits, so every fingerprint within 19 bits is found (20 differing bits would be needed to put five into each
block). What is found within the radius is verified exactly: the similarity of two bags of shingles is the sum of the
smaller counts over the sum of the larger ones, and 0.8 or more counts.

A similarity of 0.8 needs 0.8 of the item's shingles in the window. So only windows are fingerprinted in which that many
positions hold shingles of items of the same size; they start at such a position, since moving the start of a window to
the next one never lowers the similarity. At the end of a document a window may be shorter. Nothing else is left out:
all positions of all texts are looked up.

Null and empty texts, items without words, and empty tables match nothing. A document is its id and text: rows that
repeat both give one result. Items that repeat an id count as separate texts; the best is reported. Extra columns are not
looked at. Shingles and document keys are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import sized, stored

WIDTH = 5
SIMILAR = 0.8
BLOCKS, FLIPS = 4, 4
RADIUS = BLOCKS * (FLIPS + 1) - 1
NOT_WORD = r"[^\p{L}\p{N}]+"
MOST_SHARED = 1_000_000  # rows that may be sent to all tasks; more are joined through a shuffle

SUMS = "aggregate(grams, array_repeat(0L, 32), (s, x) -> transform(s, (v, k) -> v + (shiftrightunsigned(x, k) & 4294967297L)))"
FINGERPRINT = """aggregate(sequence(0, 31), 0L, (f, k) -> f
  | if(2 * (sums[k] & 4294967295L) > size(grams), shiftleft(1L, k), 0L)
  | if(2 * shiftrightunsigned(sums[k], 32) > size(grams), shiftleft(1L, k + 32), 0L))"""
# the sum of the smaller counts; counting each shingle is needed only where both sides repeat some
SHARED = """if(size(array_distinct(grams)) = size(grams) or size(array_distinct(item_grams)) = size(item_grams),
  size(array_intersect(grams, item_grams)),
  aggregate(array_intersect(grams, item_grams), 0, (s, g) -> s + least(size(filter(grams, y -> y = g)), size(filter(item_grams, y -> y = g)))))"""


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(hashes: Column, width: int) -> Column:
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(hashes, i + k) for k in range(1, width)]))


def of_width(hashes: Column, width: Column, widths: list[int]) -> Column:
    return F.coalesce(*[F.when(width == w, grams(hashes, w)) for w in widths])


def fingerprinted(df: DataFrame) -> DataFrame:
    """df with fp, the SimHash of its bag ``grams``."""
    return df.withColumn("sums", F.expr(SUMS)).withColumn("fp", F.expr(FINGERPRINT)).drop("sums")


def block_key(size: Column, block: Column, value: Column) -> Column:
    """One long for the size of an item, the number of a block, and the block's value."""
    return F.shiftleft(size.cast("long"), 20) + F.shiftleft(block.cast("long"), 16) + value


def block_value(fp: str, block: str) -> Column:
    return F.expr(f"shiftrightunsigned({fp}, {block} * {64 // BLOCKS}) & 65535L")


def keyed(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"], docs["text"].isNull())


def matches(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best window for each document and item that match, with
    __key, the key of the document."""
    bench = items.select(items["item_id"].alias("item_id"), words(items["text"]).alias("w"))
    bench = bench.withColumn("n", F.size("w")).where("n > 0").withColumn("width", F.least("n", F.lit(WIDTH)))
    widths = [w for w in range(1, WIDTH + 1) if bench.where(F.col("width") == w).limit(1).count()]
    empty = "doc_id bigint, item_id bigint, similarity double, first_word int, n_words int, __key bigint"
    if not widths:
        return docs.sparkSession.createDataFrame([], empty)
    bench = stored(fingerprinted(bench.select("item_id", "n", "width", of_width(F.col("w"), F.col("width"), widths).alias("grams"))), "items")
    known = sized(bench.select(F.explode("grams").alias("gram"), "n", "width").distinct(), most=MOST_SHARED)

    texts = docs.select(docs["doc_id"].alias("doc_id"), keyed(docs).alias("__key"), docs["text"].alias("__text"))
    hashed = texts.select("doc_id", "__key", words(F.col("__text")).alias("w"))
    hits = None
    for width in widths:
        placed = hashed.select("doc_id", "__key", F.posexplode(grams(F.col("w"), width)).alias("pos", "gram"))
        found = placed.join(known.where(F.col("width") == width).drop("width"), "gram").select("doc_id", "__key", "n", "pos")
        hits = found if hits is None else hits.unionByName(found)
    size, need = F.col("n") - F.least("n", F.lit(WIDTH)) + 1, F.ceil(F.lit(similar) * (F.col("n") - F.least("n", F.lit(WIDTH)) + 1)).cast("int")
    runs = hits.groupBy("doc_id", "__key", "n").agg(F.array_sort(F.collect_set("pos")).alias("at")).where(F.size("at") >= need)
    dense = F.filter(F.transform("at", lambda p, i: F.when(F.get(F.col("at"), i + need - 1) <= p + size - 1, p)), lambda p: p.isNotNull())
    runs = runs.withColumn("starts", dense).where(F.size("starts") > 0)
    of_doc = runs.groupBy("__key").agg(F.collect_list(F.struct("n", "starts")).alias("wanted"))
    of_doc = sized(of_doc, F.expr("aggregate(wanted, 0, (s, x) -> s + size(x.starts))"), MOST_SHARED)

    again = texts.join(of_doc, "__key").select("doc_id", "__key", "wanted", words(F.col("__text")).alias("w"))
    again = again.select("doc_id", "__key", "w", F.explode("wanted").alias("x")).select("doc_id", "__key", "w", "x.n", "x.starts")
    width = F.least("n", F.lit(WIDTH))
    again = again.select("doc_id", "__key", "n", "starts", of_width(F.col("w"), width, widths).alias("all"))
    windows = again.select("doc_id", "__key", "n", "all", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "__key", "n", "start", F.slice("all", F.col("start") + 1, size).alias("grams"))
    windows = stored(fingerprinted(windows), "windows")

    masks = [m for m in range(1 << 64 // BLOCKS) if m.bit_count() <= FLIPS]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    index = bench.select("n", "fp").distinct().withColumn("block", blocks).withColumn("mask", F.explode(F.lit(masks)))
    index = index.select(block_key(F.col("n"), F.col("block"), block_value("fp", "block").bitwiseXOR(F.col("mask").cast("long"))).alias("key"), F.col("fp").alias("item_fp"))
    probes = windows.select("n", "fp").distinct().withColumn("block", blocks)
    probes = probes.withColumn("key", block_key(F.col("n"), F.col("block"), block_value("fp", "block")))
    near_fps = probes.join(sized(index, most=MOST_SHARED), "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near_fps = near_fps.select("n", "fp", "item_fp").distinct()

    rows = bench.select("item_id", "n", F.col("fp").alias("item_fp"), F.col("grams").alias("item_grams"))
    candidates = sized(near_fps.join(rows, ["n", "item_fp"]), F.size("item_grams"), MOST_SHARED)
    pairs = windows.join(candidates, ["n", "fp"]).withColumn("shared", F.expr(SHARED))
    pairs = pairs.withColumn("similarity", F.col("shared") / (F.size("grams") + F.size("item_grams") - F.col("shared")))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("start"))).alias("best")
    kept = pairs.where(F.col("similarity") >= similar).groupBy("doc_id", "__key", "item_id", "n").agg(best)
    kept = kept.groupBy("doc_id", "__key", "item_id").agg(F.max(F.struct("best", "n")).alias("top"))
    return kept.select(
        "doc_id", "item_id", F.col("top.best.similarity").alias("similarity"), (-F.col("top.best.start")).alias("first_word"),
        F.col("top.n").alias("n_words"), "__key",
    )


def clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs, all columns, without the documents that hold a window similar to an item."""
    found = sized(matches(docs, items, similar).select("__key").distinct(), most=MOST_SHARED)
    return docs.join(found, keyed(docs) == found["__key"], "left_anti")

"""Language identification by compression.

Each language has a zstandard raw-content dictionary, made of texts of that language. A text is compressed whole with
every dictionary; the smallest result names the language. A text whose second-best result is hardly larger (less than
``margin`` of the best) is marked as rejected; the best language stays visible.

Before that, texts are lower-cased and runs of anything but letters become one blank, in dictionaries too, so that
capitals, digits and signs speak for no language.

A dictionary is a bounded sample: whole training texts, least hash first, until ``size`` bytes are full (the last one is
cut). Classification reads every text whole.

Equal sizes go to the language with more training documents, then to the smaller name. Null texts and texts without any
letter are ``und`` with score 0, rejected. Null languages and texts without letters teach nothing; without any training
row every text is ``und``. Repeated rows and rows without an id are classified each on its own; other columns are not
looked at. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import unused

UNKNOWN = "und"
DICTIONARY_BYTES = 1 << 17
DICTIONARY_TEXTS = 400  # per language, at most
SHARES = 64  # of a language, whose texts are ranked apart first
MOST_BYTES = 1 << 28  # of all dictionaries together
MARGIN = 0.02
LEVEL = 5
NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def plain(text: str) -> bytes:
    """What is compressed: the letters of the whole text."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def learn(docs: DataFrame, trains: Column, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more training documents first."""
    rows = docs.where(trains & F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.select(F.col("lang").cast("string").alias("__lang"), F.col("text").alias("__text"))
    counts = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) * size > MOST_BYTES:
        raise ValueError(f"{len(counts)} languages need smaller dictionaries than {size} bytes")
    first = Window.partitionBy("__lang").orderBy("__h", "__n")
    slim = rows.select("__lang", F.xxhash64("__text").alias("__h"), F.octet_length("__text").alias("__n")).distinct()
    # The first of each share of a language, then of the shares: how many there are does not depend on the input.
    share = Window.partitionBy("__lang", "__share").orderBy("__h", "__n")
    slim = slim.withColumn("__share", F.pmod("__h", F.lit(SHARES)))
    slim = slim.withColumn("__k", F.row_number().over(share)).where(F.col("__k") <= DICTIONARY_TEXTS).select("__lang", "__h", "__n")
    ranked = slim.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= DICTIONARY_TEXTS)
    filled = F.sum("__n").over(first.rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("__full", F.coalesce(filled, F.lit(0))).where(F.col("__full") < size)
    texts = (
        rows.withColumn("__h", F.xxhash64("__text"))
        .join(F.broadcast(chosen.select("__lang", "__h", "__k")), ["__lang", "__h"])  # DICTIONARY_TEXTS per language
        .groupBy("__lang", "__k")
        .agg(F.min(F.expr(f"substring(encode(__text, 'UTF-8'), 1, {size})")).alias("part"))
        .collect()
    )
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts:
        parts.setdefault(r["__lang"], []).append((r["__k"], plain(bytes(r["part"]).decode(errors="ignore"))))
    order = sorted(counts, key=lambda name: (-counts[name], name))
    return [(name, b"\n".join(p for _, p in sorted(parts[name]))[:size]) for name in order]


def classify(
    docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN
) -> DataFrame:
    """The columns ``keep`` with lang_pred, score (how much larger the second-best is, 0 to 1) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionaries))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*[docs.schema[c] for c in keep], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, packers = [], []
        for name, data in shared.value:
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            names.append(name)
            packers.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
            )

        def judge(text: str) -> tuple[str, float, bool]:
            data = plain(text)
            sizes = [pack(data) for pack in packers]
            order = sorted((len(s), k) for k, s in enumerate(sizes))
            if len(order) < 2:
                return names[0], 1.0, False
            best, second = order[0], order[1]
            gap = (second[0] - best[0]) / second[0]
            return names[best[1]], gap, gap < margin

        for batch in batches:
            texts, letters = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            found = [judge(t) if ok and names else (UNKNOWN, 0.0, True) for t, ok in zip(texts, letters, strict=True)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.select(range(len(keep))).columns, *columns], names=schema.names)

    text = docs["text"]
    return docs.select(*[docs[c] for c in keep], text.alias(unused(docs, "__text")), has_letter(text).alias(unused(docs, "__letter"))).mapInArrow(run, schema)

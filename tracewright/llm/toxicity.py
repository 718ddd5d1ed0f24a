"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Only bags are labelled: one is toxic if any of its sentences is. A sentence scores
p = 1 / (1 + exp(-(b + sum of the weights of its distinct words' features))), a document 1 - prod(1 - p), the noisy-or.
Weights come from maximum likelihood on the documents' labels alone. They are zero or more, with a penalty that leaves
most at zero; what a sentence without any scores, 1 / (1 + exp(-b)), is taken off when documents are scored,
q = (p - p0) / (1 - p0), so that a clean document is not toxic by its length. Only features that
are more common in toxic documents take part; the fitted sentence scores then say which sentences make a document toxic.

Features of a word: itself, its first 3 to 6 and its last 3 to 5 letters, so that inflected forms share evidence.

The classifier is fitted on a bounded sample: at most ``Bounds.per_label`` different texts of each label, least hash
first, none longer than ``Bounds.longest`` characters. Scoring reads every text whole.

Null and empty texts have one empty sentence. Repeated rows score alike, each on its own; a text counts once for each
label it has (null: not used). Without training rows, or with one label only, every score is 0, or 1 if all
labels are 1. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import crc32, unused

SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"\w+")
REMEMBERED = 1 << 17
SPAN = T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()))])


@dataclass(frozen=True)
class Bounds:
    per_label: int = 4000  # different documents of each label that the fit may see
    longest: int = 60_000  # characters of such a document
    least: int = 6  # toxic documents of the sample that must hold a feature
    lift: float = 2.0  # times as common among toxic documents as among others, at least
    rounds: int = 200
    step: float = 0.15
    penalty: float = 1e-4
    toxic_share: float = 0.2  # weight of the toxic documents together, however many were drawn


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    size = len(word)
    return [
        word,
        *("^" + word[:n] for n in range(3, min(7, size))),
        *(word[-n:] + "$" for n in range(3, min(6, size))),
    ]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, len(text))]


def sample(docs: DataFrame, labels: DataFrame, trains: Column, bounds: Bounds) -> list[tuple[str, int]]:
    """Texts and labels the fit sees, the same ones whatever the partitions."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).where("__y in (0, 1)")
    bags = docs.where(trains).select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    bags = bags.where(F.length("__text") <= bounds.longest)
    ranked = marked.join(bags.select("__id", F.xxhash64("__text").alias("__h")), "__id").groupBy("__y", "__h").agg(F.min("__id").alias("__id"))
    chosen = [
        ranked.where(F.col("__y") == y).orderBy("__h").limit(bounds.per_label) for y in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_label rows
    hashed = bags.withColumn("__h", F.xxhash64("__text"))
    rows = hashed.join(ids, ["__id", "__h"]).groupBy("__y", "__h").agg(F.min("__text").alias("__text")).collect()
    return sorted((r["__text"], r["__y"]) for r in rows)


def telling(bags: list[tuple[str, int]], bounds: Bounds) -> list[str]:
    """Features in at least ``least`` toxic documents that are ``lift`` times as common there as in others."""
    toxic = [t for t, y in bags if y]
    # first by hash, so that rare features, which are most, never take memory
    rough = np.zeros(1 << 22, np.int32)
    for text in toxic:
        rough[[crc32(f.encode()) & (1 << 22) - 1 for f in all_features(text)]] += 1
    found: Counter[str] = Counter()
    for text in toxic:
        found.update(f for f in all_features(text) if rough[crc32(f.encode()) & (1 << 22) - 1] >= bounds.least)
    found = Counter({f: n for f, n in found.items() if n >= bounds.least})
    others: Counter[str] = Counter()
    for text, y in bags:
        if not y:
            others.update(f for f in all_features(text) if f in found)
    odds = bounds.lift * len(toxic) / (len(bags) - len(toxic))
    return sorted(f for f, n in found.items() if n >= odds * others[f])


def all_features(text: str) -> set[str]:
    return {f for word in set(WORDS.findall(text.lower())) for f in features(word)}


def fit(bags: list[tuple[str, int]], bounds: Bounds) -> Model:
    labels = {y for _, y in bags}
    if len(labels) < 2:
        return Model(math.inf if labels == {1} else -math.inf, {})
    names = telling(bags, bounds)
    number = {f: i for i, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    at, sentence, document = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(bags):
        for part in SENTENCE.findall(text.lower()) or [""]:
            for word in set(WORDS.findall(part)):
                ids = known.get(word)
                if ids is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = known[word] = [number[f] for f in features(word) if f in number]
                at.extend(ids)
                sentence.extend([len(document)] * len(ids))
            document.append(d)
    feature, sentence, bag = np.frombuffer(at, np.int32), np.frombuffer(sentence, np.int32), np.frombuffer(document, np.int32)
    y = np.array([y for _, y in bags], float)
    share = np.where(y == 1, bounds.toxic_share / y.sum(), (1 - bounds.toxic_share) / (len(y) - y.sum()))
    weights, bias = np.zeros(len(names)), -6.0
    seen_w, seen_b = np.full(len(names), 1e-10), 1e-10
    for _ in range(bounds.rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, weights[feature], len(bag)), -30, 30)))
        clean = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0) * share
        slope = pull[bag] * p
        grad, grad_b = np.bincount(feature, slope[sentence], len(names)), slope.sum()
        seen_w += grad * grad
        seen_b += grad_b * grad_b
        rate = bounds.step / np.sqrt(seen_w)
        weights -= rate * grad
        weights = np.maximum(weights - rate * bounds.penalty, 0)
        bias -= bounds.step / math.sqrt(seen_b) * grad_b
    return Model(float(bias), {n: float(w) for n, w in zip(names, weights, strict=True) if w})


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), cut: float = 0.5) -> DataFrame:
    """The columns ``keep`` with score and offending, the spans (code points) of sentences that score ``cut`` or more."""
    return _run(docs, model, keep, cut, drop=False)


def reject(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose score is below ``cut``."""
    return _run(docs, model, tuple(docs.columns), cut, drop=True)


def _run(docs: DataFrame, model: Model, keep: tuple[str, ...], cut: float, drop: bool) -> DataFrame:
    bias, weights = model.bias, model.weights
    fields = [docs.schema[c] for c in keep]
    more = [] if drop else [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(SPAN))]
    schema = T.StructType([*fields, *more])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weigh(word: str) -> float:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = total = sum(weights.get(f, 0.0) for f in features(word))
            return total

        base = 1 / (1 + math.exp(-min(max(bias, -30.0), 30.0))) if math.isfinite(bias) else float(bias > 0)

        def judge(text: str) -> tuple[float, list[dict]]:
            if not math.isfinite(bias):
                return base, []
            clean, marked = 1.0, []
            for start, end in sentences(text):
                total = bias
                for word in set(WORDS.findall(text[start:end].lower())):
                    value = known.get(word)
                    total += weigh(word) if value is None else value
                p = 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))
                p = (p - base) / (1 - base)
                clean *= 1 - p
                if p >= cut:
                    marked.append({"start": start, "end": end, "score": p})
            return 1 - clean, marked

        for batch in batches:
            judged = [judge(t or "") for t in batch.column(len(keep)).to_pylist()]
            own = batch.select(range(len(keep)))
            if drop:
                yield pa.RecordBatch.from_arrays(own.columns, names=schema.names).filter(pa.array([s < cut for s, _ in judged], pa.bool_()))
            else:
                columns = [pa.array([s for s, _ in judged], pa.float64()), pa.array([m for _, m in judged], pa.list_(span))]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=schema.names)

    return docs.select(*[docs[c] for c in keep], docs["text"].alias(unused(docs, "__text"))).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, trains: Column, bounds: Bounds | None = None) -> Model:
    """The classifier of the documents for which ``trains`` holds."""
    bounds = bounds or Bounds()
    return fit(sample(docs, labels, trains, bounds), bounds)

"""A corpus pipeline of five stages, each one operator over all that the stage before kept.

toxicity          documents that score 0.5 or more go
simhash_dedup     one document of each near-duplicate group stays, the one with the smallest id
decontaminate     documents that hold a benchmark passage go
secrets           findings are blanked out; n_chars follows
pieces            the documents as piece ids

Null and empty texts pass: they are clean, count as near-duplicates of each other, and have no pieces. Extra columns are
carried along up to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, pieces, secrets, simhash, toxicity
from tracewright.llm.common import stored, table
from tracewright.llm.queries import PIECES, fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~fold(0, 5)))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct(docs, width=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blanked = secrets.redact(docs, secrets.empty_ledger(spark))
    kind = docs.schema["n_chars"].dataType
    return blanked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.read_model(PIECES), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", blank_secrets),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None  # no stage but the secrets is within reach of SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

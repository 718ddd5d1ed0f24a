"""Helpers of this subpackage: stored tables, dealing rows out, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed by the contracts: a word is what lies between blanks
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without; it gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, so that it is worked out once and its lineage ends."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def sized(df: DataFrame, weight: Column | None = None, most: int = 200_000) -> DataFrame:
    """df, stored; marked for broadcast only if the sum of ``weight`` over its rows (or their count) is at most ``most``."""
    kept = stored(df, "sized")
    total = kept.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(kept) if total <= most else kept


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table that store() wrote and no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, *A_TO_Z)


def id_hash(column: Column) -> Column:
    """crc32 of the id as text, which splits documents into training and held-out ones."""
    return F.crc32(column.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

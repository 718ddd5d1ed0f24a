"""Secret scans with an incremental ledger of blobs.

A blob is a text, named by its SHA-256. The ledger holds one row for each blob and rule version that was scanned, with
its findings (possibly none). A scan of any set of versions (paths and texts) looks up which pairs of blob and rule
version the ledger lacks, reads one text of each such blob, adds the findings, and joins them back to every path that
ever held the blob. Scanning again, with more versions or one changed rule, reads only what is new.

Positions are code points, ends exclusive. Matches of a rule are leftmost and do not overlap; those that are too short
are dropped afterwards and do not open the way for others.

A null text counts as empty and has no findings. Repeated rows share a blob and get its findings each; rows without an
id are scanned too. Texts of any length are read whole. Extra columns are not looked at. Empty tables give empty ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import new_path, sized, stored

FINDINGS = "array<struct<kind: string, start: bigint, end: bigint>>"
FEW = 200_000  # blobs that are sent to all tasks, at most
LEDGER = f"blob string, rule string, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int
    version: int = 1
    hints: tuple[str, ...] = ()  # lower case; a text without any of them has no match

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, hints=("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


NOTHING = re.compile(r"(?!)")


def compiled(rule: Rule) -> re.Pattern:
    """Runs of one class are sought at their least length at once, which finds the same matches sooner."""
    whole_run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(f"{whole_run[1]}{{{rule.least},}}" if whole_run and rule.group == 0 else rule.pattern)


def find(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> str:
    """The path of a new ledger."""
    path = new_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob) of every version with its findings in order of start, then rule; adds to the ledger what it lacked."""
    spark = versions.sparkSession
    paths = stored(
        versions.select(
            versions[path], blob_name(versions[text]).alias("__blob"), F.monotonically_increasing_id().alias("__row")
        ),
        "versions",
    )
    names = spark.createDataFrame([(r.name,) for r in rules], "rule string")
    wanted = paths.select("__blob").distinct()
    done = spark.read.schema(LEDGER).parquet(ledger).join(F.broadcast(names), "rule", "left_semi")  # one row per rule
    seen = done.groupBy("blob").agg(F.collect_set("rule").alias("done"))
    lacking = wanted.join(seen, wanted["__blob"] == seen["blob"], "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
    todo = F.filter(F.lit([r.name for r in rules]), lambda r: ~F.array_contains(F.coalesce("done", F.array().cast("array<string>")), r))
    lacking = stored(lacking.select(F.col("__blob").alias("__need"), todo.alias("__todo")), "lacking")
    texts = versions.select(blob_name(versions[text]).alias("__of"), F.coalesce(versions[text], F.lit("")).alias("__text"))
    if lacking.limit(FEW + 1).count() <= FEW:  # most blobs are known: their texts stay where they are
        texts = texts.join(F.broadcast(lacking.select("__need")), F.col("__of") == F.col("__need"), "left_semi")
    # One text of each blob, found before the shuffle: copies and versions of one path never meet.
    texts = texts.groupBy("__of").agg(F.first("__text").alias("__text"))
    reads = lacking.hint("shuffle_hash").join(texts, F.col("__need") == F.col("__of")).select("__need", "__todo", "__text")
    _read(reads, rules).write.mode("append").parquet(ledger)

    of_blob = findings(spark, ledger, rules)
    joined = paths.join(of_blob, paths["__blob"] == of_blob["__of"], "left")
    return joined.select(path, F.col("__blob").alias("blob"), F.coalesce("__found", F.array().cast(FINDINGS)).alias("findings"))


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """__of, a blob with any finding of these rules, and __found, its findings in order of start, then rule."""
    names = spark.createDataFrame([(r.name,) for r in rules], "rule string")
    rows = spark.read.schema(LEDGER).parquet(ledger).join(F.broadcast(names), "rule", "left_semi").where(F.size("findings") > 0)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform(
        F.flatten(F.collect_set("findings")),
        lambda f: F.struct(f["start"].alias("start"), rank[f["kind"]].alias("rank"), f["end"].alias("end"), f["kind"].alias("kind")),
    )
    plain = F.transform(
        F.array_sort(ranked), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))
    )
    return rows.groupBy(F.col("blob").alias("__of")).agg(plain.cast(FINDINGS).alias("__found"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs, all columns, with every finding in ``text`` replaced by ``mark`` (overlapping ones by a single one)."""
    scan(docs, ledger, rules)
    of_blob = findings(docs.sparkSession, ledger, rules)
    of_blob = sized(of_blob.join(docs.select(blob_name(docs["text"]).alias("__of")), "__of", "left_semi"), F.size("__found"))
    text, hits = docs["text"], of_blob["__found"]
    clean = F.aggregate(
        hits,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, f: F.when(f["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(f["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (f["start"] - acc["at"]).cast("int")), F.lit(mark)))
                .alias("out"),
                f["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    joined = docs.join(of_blob, blob_name(text) == of_blob["__of"], "left")
    return joined.select(
        *[F.when(hits.isNull(), text).otherwise(clean).alias(c) if c == "text" else docs[c] for c in docs.columns]
    )


def _read(reads: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blobs and the rules each lacks. Texts that come twice give equal rows, which count once."""
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {r.name: (r, compiled(r)) for r in rules}
        for batch in batches:
            blobs, names, lists = [], [], []
            for blob, todo, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = text.lower()
                for name in todo:
                    rule, pattern = patterns[name]
                    if rule.hints and not any(h in low for h in rule.hints):
                        pattern = NOTHING
                    blobs.append(blob)
                    names.append(name)
                    lists.append([{"kind": rule.kind, "start": a, "end": b} for a, b in find(text, rule, pattern)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(lists, entry)], names=["blob", "rule", "findings"]
            )

    return reads.mapInArrow(run, LEDGER)

"""Scans in chunks, and trees of chunk totals, give what plain windows give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import scan
from tracewright.operators.scan import PLAIN, Scan, Split, as_of, running


@pytest.mark.parametrize("keys", [[], ["k"]], ids=["no key", "key"])
@pytest.mark.parametrize("fan", [3, 1024])
def test_trees_of_totals(spark, monkeypatch, keys, fan):
    """A hot key, a null key, null values, all kinds and scopes; 40 chunks are three levels of three above the rows."""
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([None, None, rng.randrange(100)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at int, v long")
    scans = [
        Scan(f"{kind}_{scope}", kind, F.col("v"), scope)
        for kind in ("sum", "min", "max", "last") for scope in ("upto", "before", "after", "all")
        if (kind, scope) != ("last", "all")  # the last of a whole group has no order in a plain window
    ]
    want = running(df, keys, ["at"], scans, PLAIN).orderBy("at").collect()
    got = running(df, keys, ["at"], scans, Split(40)).select(*want[0].__fields__).orderBy("at").collect()
    assert got == want


def test_no_task_scans_more_totals_than_the_fan(spark, monkeypatch):
    """Without a key the top of the tree is one task; it reads as many rows as there are groups of chunks."""
    monkeypatch.setattr(scan, "FAN", 8)
    totals = spark.range(60).selectExpr("cast(id as int) as _chunk", "id as _t_s")
    scans = [Scan("s", "sum", F.col("v"))]
    plan = scan._carry(totals, [], scans, 60)
    got = {r["_k__chunk"]: r["_c_s"] or 0 for r in plan.collect()}
    assert got == {i: i * (i - 1) // 2 for i in range(60)}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    single = [line for line in text.splitlines() if "Window [" in line and "_above" not in line]
    assert len(single) == 1 and "windowspecdefinition(_chunk" in single[0]  # over the totals of the groups alone
    assert text.index(single[0]) < text.index("Aggregate [")


@pytest.mark.parametrize("split", [PLAIN, Split(3)], ids=["plain", "split"])
def test_a_probe_does_not_see_the_fact_of_its_own_position(spark, monkeypatch, split):
    """The shuffle of a cluster may bring the facts first; then the rounds of routing never came to an end."""
    facts_first = lambda df, *rest: running(df.coalesce(1).sortWithinPartitions(F.col("v").isNull()), *rest)
    monkeypatch.setattr(scan, "running", facts_first)
    rows = spark.range(20).selectExpr("'a' as k", "id as at")
    found = as_of(rows, rows.withColumn("v", F.col("at")), "k", ["at"], "v", "before", split)
    assert {r["at"]: r["before"] for r in found.collect()} == {i: i - 1 if i else None for i in range(20)}

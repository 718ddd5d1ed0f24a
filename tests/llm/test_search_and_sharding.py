import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.llm import packing, topk

VECTORS = "vec_id long, embedding array<float>, label int, score long, g int"


def brute(rows, k):
    def clean(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and clean(v)]
    out = []
    for n, (q, u) in enumerate(ints):
        if q % 5 == 0:
            exact = [(sum(a * b for a, b in zip(u, v, strict=False)), i) for m, (i, v) in enumerate(ints) if m != n]
            scores = sorted((-max(min(s, 2**63 - 1), 1 - 2**63), i) for s, i in exact)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def search(spark, rows, **more):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows], VECTORS)
    return [tuple(r) for r in topk.search(df, F.col("vec_id") % 5 == 0, k=3, **more).select("query_id", "rank", "vec_id", "score").collect()]


def test_top_k_is_exact_with_ties_hot_vectors_and_bad_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.125, 0.5]) if i % 3 else 0.25 for _ in range(4)]) for i in range(300)]
    rows += [(None, [1.0] * 4), (301, None), (305, [math.nan, 0, 0, 0]), (310, [math.inf, 0, 0, 0]), (315, [None, 0.5, 0, 0])]
    rows += [(7, rows[7][1]), (10, [0.5, 0.5, 0.5, 0.5]), (320, [0.5]), (321, []), (325, [1.5, 1.5])]
    got = search(spark, rows, pivots=6, block=8, chunk=40)
    assert sorted(got) == brute(rows, 3)
    large = [(i, [rng.choice([1.0, -3.0, 3e5, 4e5, 2.5e8, 2.0**43])] * rng.randint(1, 3)) for i in range(60)]
    assert sorted(search(spark, large, pivots=6, block=8, chunk=40)) == brute(large, 3)
    assert set(search(spark, [(0, [1.0]), (1, [300000.0]), (2, [400000.0])])) == {(0, 1, 2, 26_214_400_000), (0, 2, 1, 19_660_800_000)}


def test_top_k_of_few_or_no_vectors(spark):
    assert search(spark, []) == []
    assert search(spark, [(5, [1.0])]) == []
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert set(search(spark, [(0, [1.0]), (2, [-1.0])])) == {(0, 1, 2, -65536)}
    assert set(search(spark, [(0, [3e38]), (2, [3e38])])) == {(0, 1, 2, (1 << 63) - 1)}


DOCS = "doc_id long, text string, size string, shard string, __group int"


@pytest.mark.parametrize("rows", [0, 1, 400])
def test_packing_keeps_every_row_and_balances(spark, rows):
    rng = random.Random(rows)
    texts = [" ".join(rng.choice(["a", "bb", "ccc"]) * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))) for _ in range(rows)]
    data = [(i, t, "x", "y", 0) for i, t in enumerate(texts)]
    if rows > 1:
        data += [(1000 + i, "the same text", "x", "y", 0) for i in range(200)]  # a third of all rows
        data += [(None, None, None, None, None), (2000, "", "", "", 0), (2001, None, "", "", 0), (1, texts[1], "x", "y", 0)]
    got = packing.pack(spark.createDataFrame(data, DOCS), shards=4, packs=64).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 1) for d in data)
    assert Counter((r.doc_id, r["size"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows > 1:
        for column in ("size", "tokens"):
            sums = Counter()
            for r in got:
                sums[r.shard] += r[column]
            assert max(sums.values()) < 1.1 * min(sums.values())
        counts = [len(s) for s in slots.values()]
        assert max(counts) < 1.15 * min(counts)
        places = {}
        for r in got:
            if (r.text_crc32, r["size"]) in {(g.text_crc32, g["size"]) for g in got if g.doc_id == 1}:
                places.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(len(p) == 1 for p in places.values())  # a small group stays together

"""Exact top-k search by inner product: a Voronoi kNN join.

Components are floor(256 x). Pivots, a fixed number of data vectors, cut the space into cells; every vector belongs to
the cell of its nearest pivot. A cell's summary is the number of its vectors and its smallest distances to the pivot.
For a query q and a vector x of a cell with pivot p, q.x lies within |q| |x - p| of q.p. So the summaries alone give each
query a score that its k best surely reach, and each group of queries (those of one cell) a distance at which a vector
of a cell may matter to it. Only vectors within that distance are copied to the group, and groups are solved apart:
split into blocks of queries, their vectors dealt by hash into even chunks, the best k of all chunks merged.

Everything that is collected or sent to all tasks depends on the numbers of pivots and dimensions alone.

Every row is a candidate for every query but itself, rows that repeat an id included; a repeated query is asked for each
of its rows. Rows without an id, null vectors, and vectors that hold a null or a non-finite component take no part. Shorter
vectors count as filled up with zeros. Scores are exact; one that a long cannot hold counts as the nearest long. Ties go to
the smaller id. Fewer than k other vectors give fewer results; an empty table gives none. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stored

SCALE = 256.0
LONGEST = (1 << 63) - 1
PIVOTS = 32
BLOCK = 512  # queries of a task
CHUNK = 8192  # vectors of a task, about
EXACT = float(1 << 53)
USUAL = float(1 << 26)


def quantised(vectors: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    lengths = vectors.map(len).to_numpy()
    if len(vectors) and (lengths == size).all() and size:
        out[:] = np.stack(vectors.to_numpy())
    else:
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
    return np.floor(SCALE * out)


def unpack(blobs: pd.Series, size: int, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), size).astype(float)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of vectors of whole numbers, exact: in doubles where all sums fit, else in integers, of any length
    for the vectors that need it."""
    high_a, high_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    bound = high_a.max(initial=0) * high_b.max(initial=0) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    if bound < float(1 << 62):
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.empty((len(a), len(b)), np.int64)
    for rows in (high_a < USUAL, high_a >= USUAL):
        for columns in (high_b < USUAL, high_b >= USUAL):
            if rows.any() and columns.any():
                part = a[rows], b[columns]
                out[np.ix_(rows, columns)] = _long_products(*part) if rows.all() and columns.all() else products(*part)
    return out


def _long_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    left, right = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))
    exact = left @ right.T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -LONGEST, LONGEST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, given columns in order of id; -1 in front of fewer."""
    width = scores.shape[1]
    if width > k and np.abs(scores).max(initial=0) < 2.0**62 / (width + 1):
        joined = scores * width + np.arange(width - 1, -1, -1)
        top = np.argpartition(joined, width - k, axis=1)[:, width - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(joined, top, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for the k best other vectors of each vector for which ``is_query`` holds."""
    spark = vectors.sparkSession
    v = vectors[vector].cast("array<double>")
    valid = vectors[vec_id].isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    data = vectors.where(F.coalesce(valid, F.lit(False))).select(
        vectors[vec_id].cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"),
        F.monotonically_increasing_id().alias("row"),
    )
    data = stored(data, "vectors")
    sizes, largest = data.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if sizes is None:
        return spark.createDataFrame([], result)
    size = int(sizes)
    kind = np.int32 if SCALE * (largest or 0) < 2**31 - 1 else np.float64
    spread = data.groupBy(F.xxhash64("v").alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(pivots).toPandas()
    centres = quantised(spread["v"], size)
    norms = (centres * centres).sum(1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = quantised(batch["v"], size)
            cells = np.argmin(norms - 2 * (x @ centres.T), axis=1).astype(np.int32)
            far = np.sqrt(((x - centres[cells]) ** 2).sum(1))
            packed = [r.tobytes() for r in x.astype(kind)]
            yield pd.DataFrame({"id": batch["id"], "row": batch["row"], "q": batch["q"], "cell": cells, "far": far, "x": packed})

    cells = stored(data.mapInPandas(assign, "id long, row long, q boolean, cell int, far double, x binary"), "cells")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    # in two steps: a few distances of each (cell, salt), then of each cell
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    ranked = salted.select("cell", "salt", "far", F.expr("row_number() over (partition by cell, salt order by far)").alias("n"))
    few = ranked.where(F.col("n") <= k + 1).groupBy("cell", "salt").agg(F.collect_list("far").alias("near"))
    summary = few.groupBy("cell").agg(nearest.alias("near")).collect()  # pivots x (k + 1) numbers
    bounds = sorted((d, r["cell"]) for r in summary for d in r["near"])
    at, radius = np.array([c for _, c in bounds], int), np.array([d for d, _ in bounds])

    def demand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each query cell: queries, and for each data cell the most that q.p may exceed what q surely reaches."""
        most, norm, count = np.full((pivots, pivots), -np.inf), np.zeros(pivots), np.zeros(pivots, np.int64)
        for batch in batches:
            q = unpack(batch["x"], size, kind)
            own, near, length = batch["cell"].to_numpy(), q @ centres.T, np.sqrt((q * q).sum(1))
            sure = near[:, at] - length[:, None] * radius
            # the query itself may be one of the k + 1
            reach = -np.partition(-sure, k, axis=1)[:, k] if sure.shape[1] > k else np.full(len(q), -np.inf)
            # scores beyond a long are equal
            reach = np.where(reach <= -LONGEST, -np.inf, np.minimum(reach, LONGEST))
            # what rounding may take away, of the sums and of their terms
            slack = 1e-6 * (np.where(np.isfinite(reach), np.abs(reach), 0) + 1) + 1e-12 * size * length * (np.sqrt(norms.max()) + radius.max())
            gap = near - (reach - slack)[:, None]
            for c in np.unique(own):
                mine = own == c
                most[c, : len(centres)] = np.maximum(most[c, : len(centres)], gap[mine].max(0))
                norm[c] = max(norm[c], length[mine].max())
                count[c] += mine.sum()
        rows = [(int(c), int(count[c]), float(norm[c]), most[c].tolist()) for c in np.flatnonzero(count)]
        yield pd.DataFrame(rows, columns=["cell", "n", "norm", "most"])

    queries = cells.where("q")
    parts = queries.select("cell", "x").mapInPandas(demand, "cell int, n long, norm double, most array<double>")
    merged = parts.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("norm").alias("norm"), *[F.max(F.col("most")[j]).alias(f"m{j}") for j in range(len(centres))]
    )
    groups = {r["cell"]: (r["n"], r["norm"], [r[f"m{j}"] for j in range(len(centres))]) for r in merged.collect()}
    if not groups:
        return spark.createDataFrame([], result)
    blocks = {c: -(-n // block) for c, (n, _, _) in groups.items()}

    def needs(cell: Column, far: Column) -> Column:
        """The groups to which a vector at this distance from this cell's pivot may matter."""
        tests = [
            F.when(F.element_at(F.lit([float(m) for m in most]), cell + 1) + F.lit(float(norm) * (1 + 1e-6)) * far >= 0, F.lit(c))
            for c, (_, norm, most) in sorted(groups.items())
        ]
        return F.array_compact(F.array(*tests))

    needed = cells.select("id", "row", "cell", "far", "x", F.explode(needs(F.col("cell"), F.col("far"))).alias("g"))
    counts = {r["g"]: r["n"] for r in needed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = {c: max(1, -(-n // chunk)) for c, n in counts.items()}

    def per_group(numbers: dict[int, int], column: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(numbers.items()) for x in pair]), F.col(column))

    copied = needed.withColumn("s", F.pmod(F.xxhash64("row"), per_group(chunks, "g")).cast("int"))
    copied = copied.withColumn("b", F.explode(F.sequence(F.lit(0), per_group(blocks, "g") - 1))).select("g", "b", "s", "id", "row", "x")
    asked = queries.withColumn("g", F.col("cell")).where(F.col("g").isin(*chunks))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), per_group(blocks, "g")).cast("int"))
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), per_group(chunks, "g") - 1))).select("g", "b", "s", "id", "row", "x")

    def solve(asked: pd.DataFrame, copied: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(copied):
            copied = copied.sort_values(["id", "row"])
            ids, rows, x = copied["id"].to_numpy(), copied["row"].to_numpy(), unpack(copied["x"], size, kind)
            for start in range(0, len(asked), 128):
                part = asked.iloc[start : start + 128]
                scores = products(unpack(part["x"], size, kind), x)
                top = best(scores, ids, k + 1)  # one more, for the query itself
                own = np.repeat(part["row"].to_numpy(), top.shape[1])
                frame = pd.DataFrame(
                    {
                        "row": own,
                        "query_id": np.repeat(part["id"].to_numpy(), top.shape[1]),
                        "vec_id": ids[top].ravel(),
                        "score": np.take_along_axis(scores, top, 1).ravel(),
                    }
                )
                out.append(frame[own != rows[top].ravel()])
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = "row long, query_id long, vec_id long, score long"
    solved = asked.groupBy("g", "b", "s").cogroup(copied.groupBy("g", "b", "s")).applyInPandas(solve, found)
    rank = F.expr("row_number() over (partition by row order by score desc, vec_id)")
    return solved.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot. From each group's summary (count and
radius) a query gets an upper bound on what the group can score: q.x = q.p + q.(x - p)
<= q.p + |q| * radius. A query goes only to groups whose bound reaches its k-th best
score among a bounded set of witnesses, which its true k-th best can't be below. Groups
are cut into chunks of a fixed number of rows. Queries are grouped by their pivots too:
a block holds those of neighbouring pivots, which ask for much the same groups. A row
goes to the blocks with a query that asks for its group and to no other; each chunk and
block is solved locally, and the best of all chunks are ranked.

Scores are exact: products are taken in floats only while every sum fits in 53 bits,
otherwise in Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import settle

SCALE = 1024
MAX_PIVOTS, WITNESSES = 1024, 4096
CHUNK_ROWS = 4096  # of a group that go into one task together, about
QUERY_BLOCK = 4096  # queries of a block, at most about
BOUND_TOGETHER = 64  # queries whose bounds one task works out, about
SLACK = 1e-9  # bounds are in floats; relative
LONG = 1 << 63


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return rows.filter(vector.isNotNull() & ~bad & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"),
    )


def matrix(vectors, dim: int, exact: bool) -> np.ndarray:
    """Rows filled up with zeros to ``dim``; Python integers where floats aren't exact."""
    if exact and len(vectors) and all(len(v) == dim for v in vectors):
        return np.array(list(vectors), dtype=float)
    out = np.zeros((len(vectors), dim), dtype=float if exact else object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v if exact else [int(x) for x in v]
    return out


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    m, pivots = m.astype(float), pivots.astype(float)
    cell = ((pivots**2).sum(axis=1) - 2 * (m @ pivots.T)).argmin(axis=1)
    return cell, np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1))


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= limit)
    else:
        keep = np.arange(len(scores))
    order = sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else None
    if order is None:
        order = keep[np.lexsort((ids[keep], -scores[keep]))]
    return np.asarray(order[:k], dtype=np.int64)


def blocks_of(counts: np.ndarray, pivots: np.ndarray) -> tuple[list[int], list[int]]:
    """For each pivot the first block of its queries and the number of its blocks.

    Pivots are taken from one to the nearest not yet taken, and share a block until it
    has ``QUERY_BLOCK`` queries. One that has more alone is spread over several.
    """
    points, left = pivots.astype(float), np.ones(len(pivots), dtype=bool)
    first, number, at = [0] * len(pivots), [1] * len(pivots), 0
    block = held = 0
    for _ in range(len(pivots)):
        left[at] = False
        count = int(counts[at])
        if held and held + count > QUERY_BLOCK:
            block, held = block + 1, 0
        first[at], number[at] = block, max(1, -(-count // QUERY_BLOCK))
        if number[at] > 1:
            block, held = block + number[at], 0
        else:
            held += count
        far = ((points - points[at]) ** 2).sum(axis=1)
        at = int(np.where(left, far, math.inf).argmin())
    return first, number


def chunked(grouped: DataFrame, chunks: list[int]) -> DataFrame:
    """Rows with a chunk of their group; repeated rows are told apart by their number."""
    return grouped.select(
        "vec_id", "v", "cell", F.pmod(F.xxhash64("row"), per_cell(chunks, F.col("cell"))).cast("int").alias("chunk")
    )


def per_cell(values: list[int], cell: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), cell + 1)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` highest scores of each query against every row but its own.

    Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. ``is_query`` is a
    condition on the id, named ``vec_id``. Ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and rows with a null id, take no part.
    Shorter vectors count as filled up with zeros; an empty one scores 0. Rows with the
    query's id are its own; rows of one other id each stand for themselves; queries of
    one id share the ``k`` places, each row with its best score. Scores beyond 64 bits
    are ranked as they are and shown as the nearest 64-bit number. An empty table gives
    an empty result, and so does one without queries. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_column, vector_column)
    facts = vectors.agg(
        F.count("*").alias("n"),
        F.max(F.size("v")).alias("dim"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"),
    ).first()
    n, dim = facts.n, max(facts.dim or 0, 1)
    exact = (facts.most or 0.0) ** 2 * dim < 2**52
    witnesses = vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(WITNESSES).collect()
    witness_ids = np.array([r.vec_id for r in witnesses], dtype=np.int64)
    witness = matrix([r.v for r in witnesses], dim, exact)
    pivots = witness[: min(MAX_PIVOTS, max(1, math.isqrt(n)))]
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # Both are bounded: at most WITNESSES vectors.
    shared = spark.sparkContext.broadcast((pivots, witness, witness_ids))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, distance = nearest(matrix(batch["v"], dim, exact), shared.value[0])
            yield batch.assign(cell=cell.astype(np.int32), distance=distance)

    grouped = settle(
        vectors.mapInPandas(assign, "vec_id bigint, v array<bigint>, cell int, distance double").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "voronoi",
    )
    summary = grouped.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    radius, sizes = np.full(len(pivots), -1.0), [0] * len(pivots)
    for r in summary:
        radius[r.cell], sizes[r.cell] = r.radius, r.n
    chunks = [max(1, -(-size // CHUNK_ROWS)) for size in sizes]
    queries = settle(grouped.filter(is_query).select("vec_id", "v", "cell").distinct(), "queries")
    counts = np.zeros(len(pivots), dtype=np.int64)
    for r in queries.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    first_block, own_blocks = blocks_of(counts, pivots)
    block = per_cell(first_block, F.col("cell")) + F.pmod(F.xxhash64("vec_id", F.lit(3)), per_cell(own_blocks, F.col("cell")))
    queries = queries.select("vec_id", "v", block.cast("int").alias("block"))
    queries = queries.repartition(max(1, -(-int(counts.sum()) // BOUND_TOGETHER)), "vec_id")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, known, known_ids = shared.value
        for batch in batches:
            q = matrix(batch["v"], dim, exact)
            ids = batch["vec_id"].to_numpy()
            scores = (q @ known.T).astype(float)
            scores[ids[:, None] == known_ids[None, :]] = -math.inf
            at_least = np.full(len(q), -math.inf)
            if scores.shape[1] >= k:
                at_least = np.partition(scores, -k, axis=1)[:, -k]
            lower = at_least - SLACK * np.abs(np.where(np.isfinite(at_least), at_least, 0.0)) - 1.0
            length = norms(q)
            center = (q @ points.T).astype(float)
            reach = center + length[:, None] * radius[None, :]
            reach += SLACK * (np.abs(center) + length[:, None] * np.abs(radius)[None, :]) + 1.0
            wanted = (reach >= lower[:, None]) & (radius >= 0)[None, :]
            at, cell = np.nonzero(wanted)
            yield pd.DataFrame(
                {
                    "query_id": ids[at],
                    "block": batch["block"].to_numpy()[at],
                    "q": [batch["v"].iloc[i] for i in at],
                    "lower": lower[at],
                    "cell": cell.astype(np.int32),
                }
            )

    sent = queries.mapInPandas(bound, "query_id bigint, block int, q array<bigint>, lower double, cell int")
    sent = settle(
        sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), per_cell(chunks, F.col("cell")) - 1))), "sent"
    )
    keys = ["cell", "chunk", "block"]
    # Columns of their own, as both sides of the join below come from the same table.
    asked = sent.select(*(F.col(key).alias(key) for key in keys)).distinct()
    data = chunked(grouped, chunks).join(asked, ["cell", "chunk"])

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, m = left["vec_id"].to_numpy(), matrix(left["v"], dim, exact)
            for start in range(0, len(right), 256):
                some = right.iloc[start : start + 256]
                scores = matrix(some["q"], dim, exact) @ m.T
                for i, (query, lower) in enumerate(zip(some["query_id"], some["lower"], strict=True)):
                    keep = np.flatnonzero((scores[i] >= lower) & (ids != query))
                    best = keep[best_rows(scores[i][keep], ids[keep], k)]
                    found += [(query, ids[j], *exactly(scores[i][j])) for j in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "high", "score"])

    local = (
        data.groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInPandas(solve, "query_id bigint, vec_id bigint, high double, score bigint")
    )
    ranks = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(ranks))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def exactly(score) -> tuple[float, int]:
    """The score to order by where it is beyond 64 bits (0 otherwise), and the score."""
    whole = int(score)
    inside = min(max(whole, -LONG), LONG - 1)
    return (0.0 if inside == whole else float(whole)), inside

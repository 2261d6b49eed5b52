"""Packing by optimal length buckets.

A histogram of all lengths goes through a dynamic programme that picks the bucket
boundaries with the least padding. Inside each bucket documents are put into batches
that hold a fixed budget of padded tokens.

A document's length is its number of token ids with the end id, as the token store would
write them. It is worked out once and written down; texts are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import in_small_batches, in_turns, settle
from tarnwell.llm.token_store import COUNTED_AT_ONCE, counter_at

BUCKETS = 16
CONTEXT = 4096  # longer documents are cut into pieces of this many tokens
TOKEN_BUDGET = 65_536  # padded tokens in a batch
SHARD_ROWS = 20_000  # pieces numbered together, about


def word_count(text: Column) -> Column:
    """Words between ASCII white space plus an end token; 1 for null or empty text."""
    gaps = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.length(gaps) - F.length(F.replace(gaps, F.lit(" "))) + F.when(gaps == "", 1).otherwise(2)


@dataclass(frozen=True)
class Buckets:
    limits: list[int]  # padded length of each bucket, ascending
    padding: int  # tokens of padding over the whole histogram


def optimal_buckets(histogram: dict[int, int], most: int) -> Buckets:
    """Boundaries of at most ``most`` buckets with the least padding in total.

    A bucket ends at a length that occurs. ``cost[j]`` is the least padding of the
    lengths up to the j-th with one bucket more in each round; the best last boundary
    never moves back as j grows, so each round is solved by halving.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return Buckets([], 0)
    counts = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * sizes)])

    def waste(i: np.ndarray, j: int) -> np.ndarray:  # lengths i up to, not including, j
        return sizes[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    n = len(sizes)
    cost = np.array([0, *(int(waste(np.array(0), j)) for j in range(1, n + 1))], dtype=np.int64)
    choices = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(most, n)):
        new, chosen = cost.copy(), np.zeros(n + 1, dtype=np.int64)
        spans = [(1, n, 0, n - 1)]
        while spans:
            low, high, first, last = spans.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + waste(i, j)
            best = int(total.argmin())
            new[j], chosen[j] = total[best], i[best]
            spans += [(low, j - 1, first, int(i[best])), (j + 1, high, int(i[best]), last)]
        cost, choices = new, [*choices, chosen]
    limits, j = [], n
    for chosen in reversed(choices):
        if j > 0:
            limits.append(int(sizes[j - 1]))
            j = int(chosen[j])
    return Buckets(sorted(limits), int(cost[n]))


def lengths_of(docs: DataFrame, tokenizer_path: str | None, id_column: str, text_column: str) -> DataFrame:
    """``doc_id``, ``salt`` (a hash of the text, apart even where ids are alike) and ``total``, its length."""
    texts = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(F.col(text_column)).alias("salt"),
        F.col(text_column).cast("string").alias("text"),
    )
    if tokenizer_path is None:
        return texts.select("doc_id", "salt", word_count(F.col("text")).cast("bigint").alias("total"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_at(tokenizer_path)
        for batch in batches:
            texts, found = batch["text"].tolist(), []
            for turn in in_turns(texts, COUNTED_AT_ONCE):
                found += counter.lengths(texts[turn])
            yield batch[["row", "salt"]].assign(total=found)

    # The id goes along as text that only Spark reads, so it may be of any type.
    id_type = texts.schema["doc_id"].dataType
    counted = in_small_batches(texts).withColumnRenamed("doc_id", "id").select(
        F.col("id").cast("string").alias("row"), "salt", "text"
    ).mapInPandas(count, "row string, salt bigint, total bigint")
    return counted.select(F.col("row").cast(id_type).alias("doc_id"), "salt", "total")


def pieces_of(lengths: DataFrame, context: int) -> DataFrame:
    """One row per piece: a document's tokens are cut every ``context`` tokens."""
    cut = F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / context).cast("int"))).alias("piece")
    return lengths.select("doc_id", "total", "salt", cut).select(
        "doc_id",
        "piece",
        "salt",
        F.least(F.lit(context), F.col("total") - F.col("piece") * context).cast("int").alias("n_tokens"),
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    context: int = CONTEXT,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per piece of a document: its bucket, the batch in it and its place there.

    Columns: ``doc_id``, ``piece`` (from 0), ``n_tokens``, ``bucket`` (from 0),
    ``padded`` (the bucket's length), ``shard``, ``batch`` (number in bucket and shard)
    and ``place`` in the batch. A batch holds at most ``budget // padded`` pieces, one
    at least. Lengths are at most ``context``, so the histogram is bounded too. A bucket
    is numbered in as many shards as its count asks for, so that no task numbers more
    than about ``SHARD_ROWS`` pieces; each shard's last batch may be part full.

    Tokens are those of the tokenizer, with an end; without a path, words between white
    space and an end. Null and empty texts have one token, the end; a very long text is
    cut into pieces. A null id is kept; repeated rows are packed each, and ties between
    pieces are settled by id, piece, length and text; columns with names used here are
    ignored as any others are; an empty table gives an empty result.
    """
    pieces = pieces_of(settle(lengths_of(docs, tokenizer_path, id_column, text_column), "lengths"), context)
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    limits = optimal_buckets(histogram, buckets).limits
    shards = [0] * len(limits)
    for size, count in histogram.items():
        shards[int(np.searchsorted(limits, size))] += count
    shards = [-(-count // SHARD_ROWS) for count in shards]
    known = [F.lit(x) for x in limits] or [F.lit(0)]
    number = sum((F.col("n_tokens") > x).cast("int") for x in known)
    of_bucket = lambda values: F.element_at(F.array(*map(F.lit, values or [1])), F.col("bucket") + 1)
    placed = (
        pieces.withColumn("bucket", number)
        .withColumn("padded", of_bucket(limits))
        .withColumn(
            "shard",
            F.pmod(F.xxhash64("doc_id", "piece", "salt"), of_bucket(shards).cast("bigint")).cast("int"),
        )
    )
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens", "salt")
    capacity = F.greatest(F.lit(1), (F.lit(budget) / F.col("padded")).cast("int"))
    rank = F.row_number().over(order) - 1
    return placed.withColumn("rank", rank).select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket",
        "padded",
        "shard",
        (F.col("rank") / capacity).cast("int").alias("batch"),
        (F.col("rank") % capacity).alias("place"),
    )

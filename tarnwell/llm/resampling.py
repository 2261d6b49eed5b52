"""Importance resampling towards a target distribution.

A document's words, or runs of them, fall into hash buckets. Each bucket's gain says how
much more frequent it is in the target than in the documents; the gains are one array of
fixed size, and a document's weight is the mean of what its features pick from it. A
Gumbel key per document turns the weights into a draw without replacement: the highest
scores win.

The winners are found by a distributed quickselect. Random pivot keys split what is left
of the keys; exact counts of those before, at and after each pivot say between which two
the last winner lies, until a pivot is that one. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import in_small_batches, settle
from tarnwell.llm.license_scan import words_of

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PIVOTS = 31  # random keys of a round
RANKED_TOGETHER = 100_000  # winners that one task ranks, about
CACHED = 500_000  # features whose buckets a worker remembers

#: Of a key, in its order: the higher score first, then the smaller id, null ids last.
KEY = ("neg", "no_id", "doc_id", "row")


class Bucketer:
    """Hash buckets of a text's features, all runs of 1 to ``longest`` words."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.known: dict[bytes, int] = {}

    def bucket(self, feature: bytes) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.bucket, words))
        for size in range(2, self.longest + 1):
            found += [self.bucket(b" ".join(words[i : i + size])) for i in range(len(words) - size + 1)]
        return np.array(found, dtype=np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket is in all texts; the driver gets one number for each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucketer, total = Bucketer(longest, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(bucketer.of(words_of(text)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, dtype=np.int64)
    total[[r.bucket for r in rows]] = [r.n for r in rows]
    return total


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floored thousandfold log ratio of smoothed shares, target over source."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def gumbel(id_column: str, seed: int) -> Column:
    """Thousandfold Gumbel variate of the id, floored; a null id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def key(values=None) -> Column:
    """A row's composite key, or the literal of one."""
    kinds = ("bigint", "boolean", "bigint", "bigint")
    parts = map(F.col, KEY) if values is None else (F.lit(v).cast(k) for v, k in zip(values, kinds, strict=True))
    return F.struct(*(part.alias(name) for name, part in zip(KEY, parts, strict=True)))


def kth_key(keys: DataFrame, k: int, seed: int = SEED) -> tuple:
    """The k-th key from 1 of at least ``k`` different ones, by distributed quickselect."""
    for turn in range(1, 1 << 16):
        pivots = keys.orderBy(F.xxhash64("row", F.lit(seed), F.lit(turn)), "row").limit(PIVOTS).collect()
        pivots = ordered(pivots)
        counts = keys.agg(
            *(F.count(F.when(key() < key(p), 1)).alias(f"before_{i}") for i, p in enumerate(pivots)),
            *(F.count(F.when(key() == key(p), 1)).alias(f"at_{i}") for i, p in enumerate(pivots)),
        ).first()
        low = 0
        for i, pivot in enumerate(pivots):
            before, at = counts[f"before_{i}"], counts[f"at_{i}"]
            if before < k <= before + at:
                return pivot
            if k <= before:
                break
            low = i + 1
        else:
            i = len(pivots)
        left = keys
        if low:
            k -= counts[f"before_{low - 1}"] + counts[f"at_{low - 1}"]
            left = left.filter(key() > key(pivots[low - 1]))
        if i < len(pivots):
            left = left.filter(key() < key(pivots[i]))
        keys = settle(left, "keys-left")
    raise AssertionError("each turn takes its pivots out")


def ordered(rows) -> list[tuple]:
    """Keys as tuples in the order that Spark gives their structs, null ids by ``no_id``."""
    return sorted((tuple(r[c] for c in KEY) for r in rows), key=lambda v: (v[0], v[1], v[2] or 0, v[3]))


def draw(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text_column: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with its weight and score, and the rank of those drawn.

    Columns: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null for
    rows that aren't drawn). Of the rows with at least ``least_words`` words the
    ``percent`` hundredths with the highest scores are drawn, rounded down; ties go to the
    smaller id, and null ids come last.

    Null and empty texts have no features and weight 0. Repeated rows have the same score
    and each take a place of their own; a null id draws as empty text would. Very long
    texts are read whole, one at a time. An empty target leaves the smoothing alone in
    it, an empty table gives an empty result, and other columns are ignored. What the
    driver holds is two numbers for each bucket and ``PIVOTS`` keys.
    """
    text = F.col(text_column).cast("string").alias("text")
    docs = in_small_batches(docs)
    gains = gains_of(
        bucket_counts(docs.select(text), longest, buckets),
        bucket_counts(target.select(F.col(target_text_column).cast("string").alias("text")), longest, buckets),
    )
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # ``buckets`` numbers

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucketer = Bucketer(longest, buckets)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                picked = shared.value[bucketer.of(words)]
                rows.append((len(picked), int(picked.sum()) // max(len(picked), 1), len(words) >= least_words))
            out = pd.DataFrame(rows, columns=["n_features", "weight", "takes_part"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    scored = settle(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text)
        .mapInPandas(weigh, "doc_id bigint, n_features bigint, weight bigint, takes_part boolean")
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        .withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    result = ["doc_id", "n_features", "weight", "score"]
    keyed = scored.withColumns({"neg": -F.col("score"), "no_id": F.col("doc_id").isNull()})
    partakers = keyed.filter("takes_part")
    wanted = partakers.count() * percent // 100
    if not wanted:
        return scored.select(*result, F.lit(None).cast("bigint").alias("rank"))
    last = key(kth_key(partakers.select(*KEY), wanted, seed))
    drawn = F.col("takes_part") & (key() <= last)
    return (
        keyed.filter(~drawn)
        .select(*result, F.lit(None).cast("bigint").alias("rank"))
        .union(ranked(keyed.filter(drawn), wanted).select(*result, "rank"))
    )


def ranked(winners: DataFrame, count: int) -> DataFrame:
    """``rank`` of the winners in the order of their keys: sorted by ranges, numbered in each, the counts added up."""
    dealt = settle(
        winners.repartitionByRange(-(-count // RANKED_TOGETHER), *KEY).withColumn("part", F.spark_partition_id()),
        "winners",
    )
    sizes = sorted(dealt.groupBy("part").count().collect())
    before = np.cumsum([0, *(size for _, size in sizes)]).tolist()
    starts = winners.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, before, strict=False)], "part int, start bigint"
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    # One row for each range.
    return dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + place)

"""Connected components: forests within parts, then large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import settle

PART = 500_000  # edges that one task reduces to a forest


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (columns ``a`` and ``b``); root is the smallest node.

    First each part of at most about ``PART`` edges is reduced to links from its nodes to
    the smallest they reach within it. Where that is one part, all is done. Otherwise
    each step replaces a node's neighbours by links to the smallest of them, first for
    the larger neighbours, then for the smaller ones, until nothing changes. A step is a
    grouped minimum and a join, so a node with very many neighbours needs no task of its
    own. Steps are written to the shared folder.
    """
    links = settle(tidy(edges), "links")
    parts = -(-links.count() // PART)
    if parts:
        links = settle(links.repartition(parts).mapInPandas(to_smallest, "a bigint, b bigint"), "links")
    return pairs_of(links if parts < 2 else starred(links))


def to_smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from each node of a part, but the smallest, to the smallest it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            p, q = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(p, q)] = min(p, q)
    found = [(r, x) for x in parent if (r := root(x)) != x]
    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def starred(links: DataFrame) -> DataFrame:
    seen = state_of(links)
    while True:
        larger = star(links, "b > a")
        links = settle(tidy(star(larger, "b < a")), "links")
        state = state_of(links)
        if state == seen:
            break
        seen = state
    return links


def pairs_of(links: DataFrame) -> DataFrame:
    every = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return every.union(links.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller node first, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star(edges: DataFrame, of: str) -> DataFrame:
    """Join the neighbours that ``of`` picks, and the node itself if they are smaller, to the least of all."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    picked = both.filter(of)
    least = (both if of == "b > a" else picked).groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = picked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def state_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

"""N-gram Jaccard join, size-aware: small sets by subsets, large sets by inverted lists.

Two sets of sizes a and b reach the threshold only if they share ``overlap(a, b)``
elements. Sets up to a boundary enumerate their subsets of just that size, so two small
sets that link share a subset. Larger sets put the first elements of a common order
into inverted lists, as many as make sure that linked sets meet, and meet often: what
meets too seldom is dropped before it is compared. The boundary is where a small set's
subsets would cost more than its lists.

Equal sets are one class from the start. The common order puts frequent elements last, by
a sketch of fixed size over all documents, which may take a rare element for a frequent
one but never the other way round. It changes costs, not results.

Lists longer than ``LONG_LIST`` hold large groups of near copies, or a phrase that many
unrelated sets have. Prefixes are longer than one shared element would ask for, so
linked sets share several, and a set with few long lists meets its links in short ones.
Only sets made of common elements for the most part go by long lists, and by the
shortest of these that linked sets can't all miss. Sets that those join are compared
block by block, inside tasks, so no list of pairs is made of them; blocks hold sets of
like sizes, and blocks whose sizes can't link aren't compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import bitmap, in_small_batches, is_set, let_go, settle
from tarnwell.llm.components import connected_components

WIDTH = 4  # words in a shingle
PERCENT = 85
MOST_SMALL = 24  # the boundary between small and large sets is looked for up to here
SCAN = 8  # cost of one inverted list against one subset
LONG_LIST = 64
BLOCK = 256
FURTHER = 10  # hundredths of a set by which its prefix is longer than needed to meet once
CELLS = 1 << 19  # of each of the two rows of the sketch
CELLS_IN_ROW = 1 << 13
CHUNK = 1_000_000  # sets that a task remembers
BITS = 1 << 24  # of the bitmaps that thin out joins
COLUMNS = 8192  # elements compared at once within a block

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row's elements in their order."""
    total = np.full(rows.shape[0], rows.shape[1], dtype=np.uint64)
    for i in range(rows.shape[1]):
        total = mixed(total * MULTIPLIER + rows[:, i])
    return total


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, min(width, len(words)))
    return np.unique(sequence_hash(windows))


def overlap(a: int, b: int, percent: int) -> int:
    """Elements that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(a: int, percent: int) -> int:
    """Elements of a large set that go into lists."""
    return min(a, a - -(-percent * a // 100) + 1 + a * FURTHER // 100)


def subset_sizes(a: int, percent: int, most: int) -> list[tuple[int, int]]:
    """(size of the partner, elements to share) for all partners up to ``most``."""
    low, high = -(-percent * a // 100), 100 * a // percent
    sizes = [(b, overlap(a, b, percent)) for b in range(max(low, 1), min(high, most) + 1)]
    return [(b, o) for b, o in sizes if o <= min(a, b)]


def subset_cost(a: int, percent: int) -> int:
    return sum(math.comb(a, o) for _, o in subset_sizes(a, percent, 2 * a))


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Size up to which sets enumerate subsets, with the least cost over the histogram."""
    best, at, saved = 0, 0, 0
    for size in range(1, MOST_SMALL + 1):
        lists = SCAN * prefix_size(size, percent)
        saved += histogram.get(size, 0) * (lists - subset_cost(size, percent))
        if saved > best:
            best, at = saved, size
    return at


def subset_keys(elements: np.ndarray, percent: int, most: int) -> list[int]:
    a, keys = len(elements), []
    for b, share in subset_sizes(a, percent, most):
        picked = np.array(list(combinations(range(a), share)), dtype=np.int64)
        salt = np.uint64((min(a, b) * 1000 + max(a, b)) * 1000 + share)
        keys += mixed(sequence_hash(elements[picked]) + salt).tolist()
    return keys


def signed(values) -> list[int]:
    return np.asarray(values, dtype=np.uint64).view(np.int64).tolist()


def digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def cells_of(elements: np.ndarray, count: int) -> list[np.ndarray]:
    """An element's cell in each row of the sketch, from different bits of its hash."""
    return [((elements >> np.uint64(shift)) % np.uint64(count)).astype(np.int64) for shift in (0, 32)]


def sketch_counter(width: int, count_of_cells: int, in_row: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets of a task that have an element of each cell (kind 0), and how many are small (kind 1)."""
        let_go()
        sketch, seen = np.zeros((2, count_of_cells), dtype=np.int64), set()
        small = np.zeros(MOST_SMALL + 1, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text, width)
                if not len(found) or (name := digest(found)) in seen:
                    continue
                if len(seen) < CHUNK:
                    seen.add(name)
                if len(found) <= MOST_SMALL:
                    small[len(found)] += 1
                for row, cells in zip(sketch, cells_of(found, count_of_cells), strict=True):
                    np.add.at(row, cells, 1)
        sizes = np.flatnonzero(small)
        yield pd.DataFrame({"kind": 1, "at": sizes, "n": small[sizes], "cells": None})
        flat = sketch.reshape(-1, in_row)
        some = np.flatnonzero(flat.any(axis=1))
        yield pd.DataFrame({"kind": 0, "at": some, "n": 0, "cells": [squeezed(flat[i]) for i in some]})

    return count


def squeezed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * count, codec="zstd", asbytes=True), "<i8")


def adder(in_row: int):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts of sketches added up, one row for each place that a task meets."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch["at"], batch["cells"], strict=True):
                total[at] = total.get(at, 0) + unsqueezed(cells, in_row)
        yield pd.DataFrame({"at": list(total), "cells": [squeezed(x) for x in total.values()]})

    return add


def counted(texts: DataFrame, width: int) -> tuple[np.ndarray, dict[int, int]]:
    """The sketch over all texts, and how many small sets there are of each size.

    A part of the sketch is added up by one task; the driver gets ``2 * CELLS`` numbers.
    """
    counter = sketch_counter(width, CELLS, CELLS_IN_ROW)
    counts = settle(texts.select("text").mapInPandas(counter, "kind int, at int, n bigint, cells binary"), "sketch")
    small = counts.filter("kind = 1").groupBy("at").agg(F.sum("n").alias("n")).collect()
    parts = counts.filter("kind = 0").select("at", "cells").repartition("at")
    parts = parts.mapInPandas(adder(CELLS_IN_ROW), "at int, cells binary")
    sketch = np.zeros((2 * CELLS // CELLS_IN_ROW, CELLS_IN_ROW), dtype=np.int64)
    for r in parts.collect():
        sketch[r["at"]] = unsqueezed(r["cells"], CELLS_IN_ROW)
    return sketch.reshape(2, CELLS), {r["at"]: r["n"] for r in small}


def keys_of(elements: np.ndarray, sketch: np.ndarray, small: int, percent: int) -> list[int]:
    """A set's subset keys if it is small, its list keys if a large set can link to it."""
    size, keys = len(elements), []
    if size <= small:
        keys += subset_keys(elements, percent, small)
    if size and 100 * size >= percent * (small + 1):
        weight = np.minimum(*(row[cells] for row, cells in zip(sketch, cells_of(elements, sketch.shape[1]), strict=True)))
        order = np.lexsort((elements, weight))
        keys += elements[order[: prefix_size(size, percent)]].tolist()
    return signed(keys)


def list_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least number of lists in which two linked large sets meet.

    Of the elements they share, each set's prefix holds all but those it may lack, and
    both hold the first of them in the common order.
    """
    share = F.ceil(F.lit(percent) * (a + b) / (100 + percent))
    return F.greatest(F.lit(1), F.least(*(share - x + listed(x, percent) for x in (a, b))))


def listed(size: Column, percent: int) -> Column:
    """``prefix_size`` of a column."""
    needed = size - F.ceil(F.lit(percent) * size / 100) + 1
    return F.least(size.cast("bigint"), needed + F.floor(size * FURTHER / 100))


def linked_in_block(percent: int):
    """Compares two blocks of sets; gives links for a forest and what they add up to."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        let_go()
        left, right = rows[rows["on_left"]], rows[rows["on_right"]]
        shared = shared_counts(left["tokens"].tolist(), right["tokens"].tolist())
        a, b = left["size"].to_numpy(), right["size"].to_numpy()
        linked = (100 + percent) * shared >= percent * (a[:, None] + b[None, :])
        a_id, b_id = left["cid"].to_numpy(), right["cid"].to_numpy()
        linked &= a_id[:, None] != b_id[None, :]
        out = [
            pd.DataFrame({"a": a_id, "b": None, "links": linked @ right["weight"].to_numpy()})
        ]
        if not (rows["on_left"] & rows["on_right"]).any():  # two blocks
            out.append(pd.DataFrame({"a": b_id, "b": None, "links": linked.T @ left["weight"].to_numpy()}))
        parent = {int(x): int(x) for x in np.concatenate([a_id, b_id])}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            p, q = root(int(a_id[x])), root(int(b_id[y]))
            if p != q:
                parent[p] = q
                edges.append((int(a_id[x]), int(b_id[y])))
        out.append(pd.DataFrame(edges, columns=["a", "b"]).assign(links=0))
        return pd.concat([x for x in out if len(x)]).astype({"a": "Int64", "b": "Int64", "links": "int64"})

    return solve


def shared_counts(left: list, right: list) -> np.ndarray:
    """Size of the intersection of each set on the left with each on the right."""
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    if not left or not right:
        return total.astype(np.int64)
    names = np.unique(np.concatenate([*left, *right]))
    rows = [[np.searchsorted(names, np.sort(s)) for s in side] for side in (left, right)]
    for start in range(0, len(names), COLUMNS):
        tables = []
        for side in rows:
            table = np.zeros((len(side), min(COLUMNS, len(names) - start)), dtype=np.float32)
            for k, at in enumerate(side):
                lo, hi = np.searchsorted(at, (start, start + COLUMNS))
                table[k, at[lo:hi] - start] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return np.rint(total).astype(np.int64)


def link(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
) -> DataFrame:
    """One row per input row with its set's size, component and number of links.

    A set holds the text's shingles of ``width`` words; sets whose Jaccard similarity is
    ``percent`` hundredths or more link.

    Columns: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``links``
    (other rows linked to this one), ``first_of_component`` (true for one row of each
    component, that of the smallest id) and ``text_key`` (hash of the text).

    A null text and one without words have an empty set, link to nothing and are their
    own component. Repeated rows are equal sets and link; a null id stands for no
    number and is the smallest only where there is no other. Ties between rows of the
    same id go to the one read first. A very long text is shingled whole, by itself; its
    set goes into a task as a whole. Other columns are ignored; an empty table gives an
    empty result.
    """
    texts = in_small_batches(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text_column)).alias("text_key"),
        F.col(text_column).cast("string").alias("text"),
    )
    session = docs.sparkSession
    sketch, histogram = counted(texts, width)
    small = boundary(histogram, percent)
    shared = session.sparkContext.broadcast(sketch)  # of a fixed size

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        row, seen = TaskContext.get().partitionId() << 36, set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                elements = shingles(text, width)
                name = digest(elements) if len(elements) else b""
                fresh = len(elements) and name not in seen
                if fresh and len(seen) < CHUNK:
                    seen.add(name)
                rows.append((len(elements), name, keys_of(elements, shared.value, small, percent) if fresh else None))
            out = pd.DataFrame(rows, columns=["size", "name", "keys"])
            out.insert(0, "row", np.arange(row, row + len(out)))
            out.insert(1, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out.insert(2, "text_key", batch["text_key"].to_numpy())
            row += len(out)
            yield out

    rows = settle(
        texts.mapInPandas(
            describe,
            "row bigint, doc_id bigint, text_key bigint, size int, name binary, keys array<bigint>",
        ),
        "sets",
    )
    # A class is all rows of one set; its id is its first row, which always has the keys.
    classes = settle(
        rows.filter("size > 0")
        .groupBy("name")
        .agg(
            F.min("row").alias("cid"),
            F.min("doc_id").alias("least"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
            F.min_by(F.struct("doc_id", "text_key"), "row").alias("at"),
            F.first("size").alias("size"),
            F.count("*").alias("weight"),
        ),
        "classes",
    )
    # Tasks give keys to the first set of each kind they meet; of those, all but the class's first go.
    again = settle(
        rows.filter("keys IS NOT NULL")
        .select("row", "name")
        .join(classes.filter("weight > 1").select("name", "cid"), "name")
        .filter("row <> cid")
        .select("row"),
        "again",
    )
    lists = rows.select("row", "size", "keys").filter("keys IS NOT NULL").join(unbounded(again), "row", "left_anti")
    entries = lists.select(F.col("row").alias("cid"), "size", F.explode("keys").alias("key"))
    lengths = settle(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    kept = entries.filter(is_set(bitmap(lengths, "key", BITS).scalar(), F.col("key"), BITS))
    entries = settle(kept.join(lengths, "key"), "entries")

    clusters = long_list_clusters(entries, small, percent)
    pairs = settle(meeting_often(entries, clusters, small, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))
    if clusters is not None:
        clusters = clusters.filter("cluster IS NOT NULL").select("cid", "cluster")
        wanted = wanted.union(clusters.select("cid"))
    sets = sets_of(texts, classes.join(wanted.distinct(), "cid"), width)
    links = compared(pairs, sets, percent)
    if clusters is not None:
        links = links.union(compared_in_blocks(clusters, sets, percent))
    links = settle(links, "links")
    components = connected_components(links.filter("b IS NOT NULL").select("a", "b"))
    per_class = links.filter("links > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("linked"))
    return with_components(rows, classes, settle(components, "components"), per_class)


def long_list_clusters(entries: DataFrame, small: int, percent: int) -> DataFrame | None:
    """``(cid, longs, cluster)`` of the sets in long lists; None if there are none.

    ``longs`` is their number, ``cluster`` is null where short lists are enough. Linked sets
    of sizes a and b meet in ``list_overlap(a, b)`` lists at least, so a set with fewer
    long lists than any partner leaves meets its links in short ones too. Of the others'
    long lists all but that number less one are enough, and the shortest are taken.
    Subset keys ask for one meeting.
    """
    long = entries.filter(F.col("n") > LONG_LIST)
    if not long.head(1):
        return None
    least = F.when(F.col("size") <= small, 1).otherwise(least_overlap(F.col("size"), percent))
    own = Window.partitionBy("cid")
    lists = settle(
        long.withColumn("longs", F.count("*").over(own)).withColumn("turn", F.row_number().over(own.orderBy("n", "key"))),
        "long-lists",
    )
    taken = lists.filter(F.col("turn") <= F.col("longs") - least + 1).select("key", "cid")
    heads = taken.groupBy("key").agg(F.min("cid").alias("a"))
    joined = connected_components(taken.join(heads, "key").select("a", F.col("cid").alias("b")))
    joined = joined.select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    every = lists.filter("turn = 1").select("cid", "longs")
    return settle(every.join(unbounded(joined), "cid", "left"), "clusters")


def least_overlap(size: Column, percent: int) -> Column:
    """The smallest ``list_overlap`` of a set of ``size`` with any that it can link to.

    Of two linked sets the smaller holds ``percent`` hundredths of the larger, which its
    prefix without the further part would meet once; the further part adds its own.
    """
    return 1 + F.floor(F.ceil(F.lit(percent) * size / 100) * FURTHER / 100)


def meeting_often(entries: DataFrame, clusters: DataFrame | None, small: int, percent: int) -> DataFrame:
    """Pairs that share a subset, or enough lists; not those that are compared in blocks."""
    short = entries.filter(F.col("n") <= LONG_LIST).select("key", "cid", "size")
    if clusters is None:
        short = short.withColumns({"cluster": F.lit(None).cast("bigint"), "longs": F.lit(0)})
    else:
        short = short.join(clusters, "cid", "left").withColumn("longs", F.coalesce("longs", F.lit(0)))
    columns = ("cid", "size", "cluster", "longs")
    left, right = (short.select("key", *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "lr")
    a, b = F.col("l_size"), F.col("r_size")
    together = F.coalesce(F.col("l_cluster") == F.col("r_cluster"), F.lit(False))
    met = left.join(
        right,
        (left["key"] == right["key"])
        & (F.col("l_cid") < F.col("r_cid"))
        & (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
        & ~together,
    )
    # Of the lists in which they must meet, long ones aren't counted here.
    often = list_overlap(a, b, percent) - F.least("l_longs", "r_longs")
    often = F.when(F.greatest("l_size", "r_size") <= small, 1).otherwise(often)
    return (
        met.groupBy(F.col("l_cid").alias("a"), F.col("r_cid").alias("b"), "l_size", "r_size", "l_longs", "r_longs")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= often)
        .select("a", "b")
    )


def sets_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of the classes in ``wanted``, made again from one text of each.

    Where rows repeat an id and its text, one of them is taken.
    """
    wanted = settle(
        wanted.select(
            "cid", "size", "weight", F.xxhash64("at.doc_id", "at.text_key").alias("row_key"), F.col("at.text_key").alias("text_key")
        ),
        "wanted",
    )
    row_key = F.xxhash64("doc_id", "text_key")
    likely = texts.withColumn("row_key", row_key).filter(is_set(bitmap(wanted, "row_key", BITS).scalar(), F.col("row_key"), BITS))
    once = likely.groupBy("row_key", "text_key").agg(F.first("text").alias("text"))
    found = once.join(unbounded(wanted), ["row_key", "text_key"]).select("cid", "size", "weight", "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            tokens = [shingles(text, width).view(np.int64) for text in batch["text"]]
            yield batch.drop(columns="text").assign(tokens=tokens)

    made = found.mapInPandas(make, "cid bigint, size int, weight bigint, tokens array<bigint>")
    return settle(made, "tokens")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs: the link itself, and what it adds to the links of either side."""
    left = sets.select(F.col("cid").alias("a"), F.col("size").alias("a_size"), F.col("weight").alias("a_weight"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("cid").alias("b"), F.col("size").alias("b_size"), F.col("weight").alias("b_weight"), F.col("tokens").alias("b_tokens"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    linked = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(shared * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent)
        .select("a", "b", "a_weight", "b_weight")
    )
    both = F.array(
        F.struct(F.col("a"), F.col("b"), F.col("b_weight").alias("links")),
        F.struct(F.col("b").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("a_weight").alias("links")),
    )
    return linked.select(F.explode(both).alias("s")).select("s.a", "s.b", "s.links")


def compared_in_blocks(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within each cluster, from comparing its blocks of about ``BLOCK`` sets two by two.

    Blocks hold sets of one size class. A class spans a ratio of sizes that linked sets
    keep within, so a block is compared with those of its class and of the next.
    """
    steps = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) * (1 - 1e-9))
    members = sets.join(clusters, "cid").withColumn("class", steps.cast("int"))
    sizes = settle(
        members.groupBy("cluster", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks"
    )
    after = sizes.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("blocks_after"))
    before = sizes.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("blocks_before"))

    def blocks_of(step: int, column: str) -> Column:
        count = F.coalesce(F.col(column), F.lit(0))
        numbers = F.slice(F.sequence(F.lit(0), count), 1, count)  # none, if there are none
        return F.transform(numbers, lambda k: block_name(F.col("class") + step, k))

    met = F.concat(blocks_of(0, "blocks"), blocks_of(1, "blocks_after"), blocks_of(-1, "blocks_before"))
    dealt = (
        members.join(sizes, ["cluster", "class"])
        .join(after, ["cluster", "class"], "left")
        .join(before, ["cluster", "class"], "left")
        .withColumn("block", block_name(F.col("class"), F.pmod(F.xxhash64("cid"), F.col("blocks"))))
        .withColumn("other", F.explode(met))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .withColumn("on_left", F.col("block") == F.col("i"))
        .withColumn("on_right", F.col("block") == F.col("j"))
        .select("cluster", "i", "j", "on_left", "on_right", "cid", "size", "weight", "tokens")
    )
    return dealt.groupBy("cluster", "i", "j").applyInPandas(
        linked_in_block(percent), "a bigint, b bigint, links bigint"
    )


def block_name(size_class: Column, number: Column) -> Column:
    return F.shiftleft(size_class.cast("bigint"), 32) + number


def with_components(rows: DataFrame, classes: DataFrame, components: DataFrame, per_class: DataFrame) -> DataFrame:
    placed = (
        classes.join(components.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
        .join(per_class, "cid", "left")
    )
    joined = components.select("node", "root").join(
        classes.select(F.col("cid").alias("node"), "least", "first"), "node"
    )
    heads = joined.groupBy("root").agg(F.min("least").alias("head_id"), F.min("first").alias("head"))
    by_class = settle(
        placed.join(heads, "root", "left").select(
            "name",
            F.coalesce("head_id", "least").alias("component_id"),
            F.coalesce("head", "first")["row"].alias("head_row"),
            (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
        ),
        "by-class",
    )
    return rows.drop("keys").join(by_class, "name", "left").select(
        "doc_id",
        F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("row") == F.coalesce("head_row", "row")).alias("first_of_component"),
        "text_key",
    )


def keep_first(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
) -> DataFrame:
    """Rows of ``docs`` that are the first of their component, columns unchanged.

    The keys of rows to leave out are written first; a bitmap of them lets most documents
    through where they lie, and only the others are joined. Of rows with the same id
    and text all or none are left out by their key, so one of each such group is put
    back. Null and empty texts all stay, an empty table stays empty; see ``link`` for the
    rest.
    """
    found = link(docs, id_column, text_column, percent, width)
    out = settle(
        found.groupBy(F.col("doc_id").alias("__out_id"), F.col("text_key").alias("__out_key"))
        .agg(F.max("first_of_component").alias("__kept"), F.count("*").alias("__times"))
        .filter("NOT __kept OR __times > 1"),
        "left-out",
    )
    key = F.xxhash64(F.col(text_column))
    likely = is_set(bitmap(out, "__out_key", BITS).scalar(), key, BITS)
    same = F.col(id_column).cast("bigint").eqNullSafe(F.col("__out_id")) & (key == F.col("__out_key"))
    some = docs.filter(likely)
    kept = docs.filter(~likely).unionByName(some.join(unbounded(out), same, "left_anti"))
    once = out.filter("__kept")
    if once.head(1):
        again = some.join(unbounded(once), same, "left_semi")
        kept = kept.unionByName(again.dropDuplicates([id_column, text_column]))
    return kept


def unbounded(df: DataFrame) -> DataFrame:
    """For a side that grows with the input: joined by a shuffle at every size."""
    return df.hint("merge")

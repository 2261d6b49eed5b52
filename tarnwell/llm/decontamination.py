"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Two fixed masks pick six of the eight or nine words at a position and ignore the rest,
so a substituted word spoils few seeds. Seeds of documents meet seeds of benchmark
items, and around each meeting windows of ``WINDOW`` words are compared word for word: a
window with at least ``SAME`` equal words is contaminated. Any such window holds a hit
of one of the masks wherever its unequal words stand (``tests/llm`` tries them all), so
none is missed. An item shorter than a window is its own window and may differ in the
same share of its words. Its masks leave out what may differ: it is cut into two parts
more than that, and each two parts together are a mask, so one of them is whole.

A bitmap of the benchmark's seeds, of a fixed size, keeps most positions of a document
from becoming rows. It only saves work: what passes is joined on the whole hash.
"""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import bitmap, is_set, settle

MASKS = [(0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8)]
WINDOW, SAME = 13, 11  # 0.8 of the window, rounded up
PERCENT = 80  # of a shorter item's words
BITS = 1 << 22  # of the bitmap
WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``size`` words: all pairs of its parts, of which no more differ than may."""
    changed = size - -(-size * PERCENT // 100)
    if not changed:
        return [tuple(range(size))]
    edges = [size * i // (changed + 2) for i in range(changed + 3)]
    parts = [tuple(range(*edge)) for edge in pairwise(edges)]
    return [one + other for one, other in combinations(parts, 2)]


def seed(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """Hash of the words a mask picks from position ``at``; null where it doesn't fit."""
    picked = [F.get(hashes, at + offset) for offset in mask]
    return F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(number), *picked))


def benchmark_seeds(items: DataFrame, masks: list[tuple[int | None, tuple[int, ...]]]) -> DataFrame:
    """Seeds of the items: of all places in those of a window or more, of the beginning of shorter ones.

    Masks go with the size of the short items they are for, None for the others. A seed
    has its item's words from ``WINDOW`` before to ``WINDOW`` after it.
    """
    at = F.col("place")
    seeds = []
    for number, (size, mask) in enumerate(masks):
        fits = (F.col("size") == size) & (at == 0) if size else F.col("size") >= WINDOW
        value = F.when(fits, seed(F.col("item_hashes"), at, mask, number))
        seeds.append(F.struct(F.lit(number).alias("mask"), value.alias("seed")))
    first = F.greatest(at - WINDOW, F.lit(0))
    around = F.slice("item_hashes", first + 1, at + 2 * WINDOW - first)
    rows = items.select("item_id", "item_hashes", "size", F.posexplode("item_hashes").alias("place", "_"))
    return rows.select(
        "item_id", "size", "place", around.alias("item_around"), (at - first).alias("item_at"), F.explode(F.array(*seeds)).alias("s")
    ).select("item_id", "size", "place", "item_around", "item_at", "s.mask", "s.seed").filter("seed IS NOT NULL")


def equal_words_of_short() -> Column:
    """Equal words of a short item and the words from the hit on; 0 where the document ends before."""
    same = F.zip_with(
        F.slice("doc_around", F.col("doc_at") + 1, F.col("size")),
        F.slice("item_around", F.lit(1), F.col("size")),
        lambda doc, item: (doc == item).cast("int"),
    )
    whole = F.get("doc_around", F.col("doc_at") + F.col("size") - 1).isNotNull()
    return F.when(whole, F.aggregate(same, F.lit(0), lambda a, b: a + b)).otherwise(0)


def equal_words() -> Column:
    """Most equal words of a window that holds the hit, over all ways to lay the window."""
    reach = WINDOW - F.col("span")
    shift = F.sequence(-reach, F.lit(0))

    def same(begin: Column) -> Column:
        def one(k: Column) -> Column:
            doc = F.get("doc_around", F.col("doc_at") + begin + k)
            item = F.get("item_around", F.col("item_at") + begin + k)
            outside = (F.col("doc_at") + begin + k < 0) | (F.col("item_at") + begin + k < 0)
            return F.when(outside, 0).otherwise(F.coalesce((doc == item).cast("int"), F.lit(0)))

        return F.aggregate(
            F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), one), F.lit(0), lambda a, b: a + b
        )

    return F.array_max(F.transform(shift, same))


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that share a contaminated window.

    Columns: ``doc_id``, ``text_key`` (hash of the text, telling rows of a repeated id
    apart), ``item_id``, ``first_word`` and ``last_word`` (places of the first and last
    verified seed in the document), ``seeds`` (verified seeds, in repeated rows each) and ``best`` (largest
    share of equal words in a window). Words are runs of letters and digits in lower
    case. A window has ``WINDOW`` words, or all words of an item that has fewer, and at
    least ``PERCENT`` hundredths of them must be equal.

    Null and empty texts and items have no words and match nothing; a null id is kept;
    a very long text is read whole, its words are rows before any join; repeated rows of
    a document or an item give one row; other columns are ignored; empty tables give an
    empty result.
    """
    hashed = (
        items.select(F.col(item_column).alias("item_id"), word_hashes(F.col(item_text_column)).alias("item_hashes"))
        .withColumn("size", F.size("item_hashes"))
        .filter("size > 0")
        .distinct()
    )
    short = sorted(r["size"] for r in hashed.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    masks = [(None, mask) for mask in MASKS] + [(size, mask) for size in short for mask in short_masks(size)]
    seeds = settle(benchmark_seeds(hashed, masks), "benchmark-seeds")
    bits = bitmap(seeds, "seed", BITS).scalar()
    at = F.col("at")
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(F.col(text_column)).alias("text_key"),
        word_hashes(F.col(text_column)).alias("doc_hashes"),
    ).select("doc_id", "text_key", "doc_hashes", F.posexplode("doc_hashes").alias("at", "_"))
    values = [seed(F.col("doc_hashes"), at, mask, number) for number, (_, mask) in enumerate(masks)]
    likely = rows.filter(any_of([is_set(bits, value, BITS) for value in values]))
    first = F.greatest(at - WINDOW, F.lit(0))
    around = F.slice("doc_hashes", first + 1, at + 2 * WINDOW - first)
    found = likely.select(
        "doc_id",
        "text_key",
        "at",
        around.alias("doc_around"),
        (at - first).alias("doc_at"),
        F.explode(F.array(*values)).alias("seed"),
    ).filter("seed IS NOT NULL")
    # The hash covers the mask's number, so seeds of different masks don't meet.
    spans = F.element_at(F.array(*[F.lit(mask[-1] + 1) for _, mask in masks]), F.col("mask") + 1)
    hits = found.join(seeds, "seed").withColumn("span", spans)
    short_item = F.col("size") < WINDOW
    window = F.when(short_item, F.col("size")).otherwise(WINDOW)
    return (
        hits.withColumn("same", F.when(short_item, equal_words_of_short()).otherwise(equal_words()))
        .filter(F.col("same") * 100 >= window * PERCENT)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(
            F.min("at").alias("first_word"),
            F.max("at").alias("last_word"),
            F.count("*").alias("seeds"),
            F.max(F.col("same") / window).alias("best"),
        )
    )


def any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows of ``docs`` without an overlap, columns unchanged.

    The contaminated keys are written first, so the join knows how many there are and
    moves the documents only if the keys are too many to broadcast. Null and empty texts
    and empty tables stay as they are, a null id is no different from others, repeated
    rows stay or go alike, and very long texts are read whole.
    """
    found = find_overlaps(docs, items, id_column, text_column).select(
        F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")
    )
    bad = settle(found.distinct(), "contaminated")
    same = F.col(id_column).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col(text_column)) == F.col("__bad_key"))
    return docs.join(bad, same, "left_anti")

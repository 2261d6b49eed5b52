"""Removal of repeated strings by distributed prefix doubling.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. The
strings that start at two places are alike if their ranks are: Spark sorts the places by
what begins there, equal ones get one rank, and places whose rank nobody shares drop out.
The rank of a place for twice the length comes from sorting the pairs of its own rank and
that of the place a length further on, until the length is ``width``.

Exact steps ahead of that keep it from sorting every byte of the corpus:

* Of the short grams in a string of ``width`` bytes one is the least by hash, and equal
  strings have equal ones. Neighbouring strings share theirs, so a text has few. They
  lie in one stretch of text, and have the gram as a common core.
* Stretches are sorted by core and content. Where no other has the core, no string is
  repeated; in equal stretches all are, and of those one goes on if another stretch has
  its core. Long copies end here.
* What is left is cut into parts of neighbouring strings, whose common cores are longer,
  and these are sorted in the same way; then into smaller parts.

The places that the last parts leave are sorted by doubling: the ends of copied passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import Tables, bitmap, in_small_batches, is_set, settle
from tarnwell.llm.jaccard_join import mixed, unbounded

WIDTH = 200
GRAM = 50  # bytes by whose hash strings are sampled
START = 100  # bytes that the first sort of places compares
ROWS_AT_ONCE = 50_000  # that a task hands on together
PARTS = (32, 8)  # strings in the parts of a stretch, powers of two
PIECE = 1 << 20  # bytes of a text that are looked at together
JOINED = 1 << 16  # bytes of short texts that are
BITS = 1 << 24  # of the bitmaps that thin out rows, at least
GROWN = 4  # times as many at most
KEY_BITS = 8  # that a key has in them, as far as that goes

#: Each text is known by its id and a hash of it; a place adds an offset in bytes.
TEXT = ("doc", "text_key")
PLACE = (*TEXT, "at")

BASE = np.uint64(0x9E3779B97F4A7C13)
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Sampler:
    """Least grams of all strings of ``width`` bytes of a text, by a rolling hash."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.windows = width, gram, width - gram + 1
        count = PIECE + width
        self.up = powers(int(BASE), count)
        self.down = powers(pow(int(BASE), -1, 1 << 64), count)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram at each place."""
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(LETTERS[data] * self.up[: len(data)], out=total[1:])
        return mixed((total[self.gram :] - total[: -self.gram]) * self.down[: len(data) - self.gram + 1])

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """Place of the least gram in each string; the first of equal ones."""
        place = np.arange(len(hashes), dtype=np.uint64)
        bits = np.uint64(PIECE.bit_length())
        low = (hashes >> bits << bits) | place
        count, reach = len(hashes) - self.windows + 1, 1
        while 2 * reach <= self.windows:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = self.windows - reach
        low = np.minimum(low[:count], low[rest : rest + count])
        return (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)

    def stretches(self, joined: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """First strings of neighbours with one least gram, how many they are, how far on the gram is, its hash.

        ``joined`` is several pieces in a row, each of ``width`` bytes or more; no string is of two.
        """
        hashes = self.hashes(np.frombuffer(joined, np.uint8))
        places = self.least(hashes)
        whole = np.ones(len(places), dtype=bool)
        for end in ends[:-1].tolist():
            whole[end - self.width + 1 : end] = False
        strings = np.flatnonzero(whole)
        places = places[strings]
        first = np.flatnonzero(np.diff(places, prepend=-1))
        count, begins, grams = np.diff(first, append=len(places)), strings[first], places[first]
        return begins, count, grams - begins, hashes[grams].view(np.int64)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def fingerprints(text: bytes, begins, ends) -> np.ndarray:
    """128-bit hashes of stretches of a text, as two columns of 64 bits."""
    view, digest = memoryview(text), xxhash.xxh3_128_digest
    whole = b"".join([digest(view[begin:end]) for begin, end in zip(begins, ends, strict=True)])
    return np.frombuffer(whole, dtype=np.int64).reshape(-1, 2)


def hashed(text: bytes, begins: list[int], ends: list[int]) -> np.ndarray:
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    found = (digest(view[begin:end]) for begin, end in zip(begins, ends, strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(begins)).view(np.int64)


def grouped_frames(columns: tuple[str, ...], find: Callable[[Iterator[pd.DataFrame]], Iterator[tuple]]):
    """A frame of many rows at a time from a function that gives columns of a few rows each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def framed() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held, strict=True)), strict=True)))

        for found in find(batches):
            held.append(found)
            rows += len(found[0])
            if rows >= ROWS_AT_ONCE:
                yield framed()
                held, rows = [], 0
        if held:
            yield framed()

    return run


def pieces_of(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Texts' pieces with where they begin; the strings that begin in a piece are in it."""
    for batch in batches:
        for doc, text_key, text in zip(batch["doc"], batch["text_key"], batch["text"], strict=True):
            data = utf8(text)
            for begin in range(0, len(data) - width + 1, PIECE):
                yield doc, text_key, begin, data[begin : begin + PIECE + width - 1]


def together(pieces: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Pieces in a row of at most so many bytes together, one at least."""
    held, size = [], 0
    for piece in pieces:
        if held and size + len(piece[-1]) > most:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[-1])
    if held:
        yield held


def stretches_of(width: int, gram: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        sampler = Sampler(width, gram)
        for some in together(pieces_of(batches, width), min(JOINED, PIECE)):
            docs, text_keys, offsets, data = zip(*some, strict=True)
            joined, ends = b"".join(data), np.cumsum(list(map(len, data)))
            begins, count, reach, grams = sampler.stretches(joined, ends)
            content = hashed(joined, begins.tolist(), (begins + count - 1 + width).tolist())
            piece = np.searchsorted(ends, begins, side="right")
            at = begins + (np.array(offsets) - ends + list(map(len, data)))[piece]
            doc, text_key = np.array(docs, np.int64)[piece], np.array(text_keys, np.int64)[piece]
            yield doc, text_key, at, count, reach, np.zeros(len(at), dtype=bool), grams, content

    return grouped_frames((*PLACE, "count", "reach", "known", "core", "k2"), find)


def with_content(width: int):
    """The bytes of the stretches that are asked of a text, a row for each."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            columns = (*TEXT, "text", "at", "count", "reach", "known")
            for doc, text_key, text, at, count, reach, known in zip(*(batch[c] for c in columns), strict=True):
                data, content = utf8(text), np.empty(len(at), dtype=object)
                content[:] = [data[b:e] for b, e in zip(at.tolist(), (at + count - 1 + width).tolist(), strict=True)]
                yield np.full(len(at), doc), np.full(len(at), text_key), at, count, reach, known, content

    return grouped_frames((*PLACE, "count", "reach", "known", "content"), find)


def parts_of(width: int, size: int):
    """Stretches cut where the distance to their gram is a multiple of ``size``.

    All strings of a part have the bytes between the beginning of the one nearest to the
    gram and the end of the farthest that the part could have. That is the core; it
    doesn't depend on where the stretch begins or ends.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = (*PLACE, "count", "reach", "known", "content")
            for doc, text_key, at, count, reach, known, content in zip(*(batch[c] for c in columns), strict=True):
                for number in range((reach - count + 1) // size, reach // size + 1):
                    near, far = number * size, (number + 1) * size - 1
                    core = content[reach - near : reach - far + width]
                    near, far = max(near, reach - count + 1), min(far, reach)
                    own = content[reach - far : reach - near + width]
                    core_key = xxhash.xxh3_64_intdigest(core, number) - (1 << 63)
                    rows.append((doc, text_key, at + reach - far, far - near + 1, far, known, own, core_key, xxhash.xxh3_64_intdigest(own) - (1 << 63)))
            yield pd.DataFrame(rows, columns=[*columns, "core", "k2"])

    return cut_up


def roomy(count: int) -> int:
    """Bits of a bitmap for ``count`` keys; one that is full would let everything through."""
    bits = BITS
    while bits < KEY_BITS * count and bits < GROWN * BITS:
        bits *= 2
    return bits


def winnowed(rows: DataFrame, width: int, name: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What repeated strings cover in the stretches, and the stretches that must be looked at closer.

    Stretches are sorted by core and content. Those whose core no other has go; the sieve
    for that only saves work. Equal ones are repeated, all their strings are. What is
    left are stretches that are alone with their content, and for each other content, if
    some of those have its core, one that has it (``known``: nothing is asked about it).

    ``rows`` is the table ``name``. It is dropped, and both results are settled.
    """
    often = tables.settle(rows.groupBy("core").count().filter("count > 1").select("core"), f"{name}-often")
    bits = roomy(often.count())
    sieve = tables.settle(bitmap(often, "core", bits), f"{name}-cores").scalar()
    likely = rows.filter(is_set(sieve, F.col("core"), bits))
    found = ranked(likely.withColumn("k1", F.col("core")), f"{name}-ranked", tables.settle)
    tables.drop(name, f"{name}-often", f"{name}-cores")
    alike = found.filter("NOT alone AND NOT known").select(
        *TEXT, F.col("at").alias("begin"), (F.col("at") + F.col("count") - 1 + width).alias("end")
    )
    open_ = F.col("alone") & ~F.col("known")
    bits = roomy(found.filter(open_).count())
    asking = tables.settle(bitmap(found.filter(open_), "core", bits), f"{name}-open").scalar()
    left = found.filter(open_ | F.col("head") & is_set(asking, F.col("core"), bits)).withColumn("known", ~open_)
    settled = tables.settle(alike, f"{name}-alike"), tables.settle(left.drop("core", "rank", "head", "alone"), f"{name}-left")
    tables.drop(f"{name}-ranked", f"{name}-open")
    return settled


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted part with where their group of equal keys starts in it.

    Keys stay on the first and the last row alone, as those may have equals in other parts.
    """
    part, held, before, at, start = TaskContext.get().partitionId(), None, None, 0, 0

    def told(rows: pd.DataFrame, after: tuple | None) -> pd.DataFrame:
        nonlocal before, at, start
        keys = rows[["k1", "k2"]].to_numpy()
        new = np.ones(len(rows) + 1, dtype=bool)
        new[1:-1] = (keys[1:] != keys[:-1]).any(axis=1)
        new[0] = before is None or tuple(keys[0]) != before
        new[-1] = after is None or tuple(keys[-1]) != after
        place = np.arange(at, at + len(rows))
        starts = np.maximum.accumulate(np.where(new[:-1], place, start))
        edge = np.zeros(len(rows), dtype=bool)
        edge[0], edge[-1] = at == 0, after is None
        before, at, start = tuple(keys[-1]), at + len(rows), int(starts[-1])
        out = rows.drop(columns=["k1", "k2"]).assign(
            part=part, start=starts, head=new[:-1], alone=new[:-1] & new[1:], place=place
        )
        for i, name in enumerate(("k1", "k2")):
            out[name] = pd.array(keys[:, i], dtype="Int64")
            out.loc[~edge, name] = pd.NA
        return out

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(rows) > 1:
            after = (rows["k1"].iloc[-1], rows["k2"].iloc[-1])
            yield told(rows.iloc[:-1].reset_index(drop=True), after)
        held = rows.iloc[-1:]
    if held is not None and len(held):
        yield told(held.reset_index(drop=True), None)


def ranked(rows: DataFrame, name: str, settle: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """Rows with the rank of their keys ``k1`` and ``k2``: how many have smaller ones.

    ``head`` is true for one row of each rank, ``alone`` where no other has it. Rows are
    sorted over all parts by keys and place, so equal keys may fill many parts; the
    first and last row of each tell the driver which groups go on.
    """
    others = [f for f in rows.schema.fields if f.name not in ("k1", "k2")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    schema += ", part int, start bigint, head boolean, alone boolean, place bigint, k1 bigint, k2 bigint"
    order = ["k1", "k2", *PLACE]
    parts = settle(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(numbered, schema), name
    )
    edges = parts.filter("k1 IS NOT NULL").select("part", "place", "start", "k1", "k2").collect()  # two of a part
    fixes = rows.sparkSession.createDataFrame(
        joints(sorted(map(tuple, edges))), "part int, offset bigint, first_rank bigint, goes_on boolean, last_start bigint, kept_on boolean"
    )
    first = (F.col("start") == 0) & F.col("goes_on")
    last = (F.col("start") == F.col("last_start")) & F.col("kept_on")
    return (
        parts.join(F.broadcast(fixes), "part")  # a row for each part
        .withColumn("rank", F.when(first, F.col("first_rank")).otherwise(F.col("offset") + F.col("start")))
        .withColumn("head", F.col("head") & ~first)
        .withColumn("alone", F.col("alone") & ~first & ~last)
        .select(*(f.name for f in others), "rank", "head", "alone")
    )


def joints(edges: list[tuple]) -> list[tuple]:
    """For each part its offset, the rank of its first group, and whether that and its last go beyond it."""
    parts: dict[int, list[tuple]] = {}
    for part, place, start, *keys in edges:
        parts.setdefault(part, []).append((place, start, tuple(keys)))
    found, offset, last_key, last_rank = [], 0, None, 0
    for part, rows in sorted(parts.items()):
        (_, _, first_key), (place, start, key) = rows[0], rows[-1]
        goes_on = first_key == last_key
        if goes_on:
            found[-1][-1] = True
        first_rank = last_rank if goes_on else offset
        found.append([part, offset, first_rank, goes_on, start, False])
        last_key, last_rank = key, first_rank if start == 0 else offset + start
        offset += place + 1
    return list(map(tuple, found))


def lengths(width: int, start: int) -> tuple[int, ...]:
    """Lengths whose ranks are made in turn, doubled up to ``width``."""
    found = [min(start, width)]
    while found[-1] < width:
        found.append(min(2 * found[-1], width))
    return tuple(found)


@cache
def needed(count: int, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places for ``count`` strings in a row, and the step up to which each is needed."""
    places, last = np.arange(count), np.full(count, len(steps) - 1)
    for step in range(len(steps) - 1, 0, -1):
        further = places[last >= step] + (steps[step] - steps[step - 1])
        grown = np.union1d(places, further)
        until = np.full(len(grown), step - 1)
        until[np.searchsorted(grown, places)] = last
        places, last = grown, until
    return places, last


def places_of(steps: tuple[int, ...]):
    """Places whose first bytes must be ranked, so that all strings asked for can be."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for doc, text_key, *parts in zip(*(batch[c] for c in (*TEXT, "at", "count", "known", "content")), strict=True):
                found, prints = [], []
                for begin, count, known, content in zip(*(x.tolist() for x in parts), strict=True):
                    places, last = needed(count, steps)
                    prints.append(fingerprints(content, places.tolist(), (places + steps[0]).tolist()))
                    found.append((places + begin, last, (places < count) & (not known)))
                every, last, wanted = map(np.concatenate, zip(*found, strict=True))
                # Parts overlap, and a place is one row.
                at, first, number = np.unique(every, return_index=True, return_inverse=True)
                until, asked = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                np.maximum.at(until, number, last)
                np.logical_or.at(asked, number, wanted)
                keys = np.concatenate(prints)[first]
                yield np.full(len(at), doc), np.full(len(at), text_key), at, until, asked, keys[:, 0], keys[:, 1]

    return grouped_frames((*PLACE, "last", "wanted", "k1", "k2"), find)


def find_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    start: int = START,
    tables: Tables | None = None,
) -> DataFrame:
    """``(doc, text_key, begin, end)``: stretches of bytes that repeated strings cover.

    Together they are all such bytes; they may overlap. See ``dedup`` for odd rows.
    ``tables`` then has those that the result is read from.
    """
    if not 0 < gram <= width or not 0 < start:
        raise ValueError("grams are no longer than the strings, and nothing is shorter than a byte")
    texts = named(in_small_batches(docs), id_column, text_column).filter(F.octet_length("text") >= width)
    kept = "doc bigint, text_key bigint, at bigint, count bigint, reach bigint, known boolean"
    tables = Tables() if tables is None else tables
    stretches = texts.mapInPandas(stretches_of(width, gram), f"{kept}, core bigint, k2 bigint")
    covered, left = winnowed(tables.settle(stretches, "stretches"), width, "stretches", tables)

    asked = tables.settle(
        left.groupBy(*TEXT).agg(F.collect_list(F.struct("at", "count", "reach", "known")).alias("asked")), "asked"
    )
    tables.drop("stretches-left")
    bits = roomy(asked.count())
    near = texts.filter(is_set(bitmap(asked, "text_key", bits).scalar(), F.col("text_key"), bits))
    once = near.groupBy(*TEXT).agg(F.first("text").alias("text")).join(unbounded(asked), list(TEXT))
    once = once.select(*TEXT, "text", "asked.at", "asked.count", "asked.reach", "asked.known")
    left, name = once.mapInPandas(with_content(width), f"{kept}, content binary"), "content"
    left = tables.settle(left, name)
    tables.drop("asked")
    for size in PARTS:
        if size < width:
            parts = left.mapInPandas(parts_of(width, size), f"{kept}, content binary, core bigint, k2 bigint")
            parts = tables.settle(parts, f"parts-{size}")
            tables.drop(name)
            alike, left = winnowed(parts, width, f"parts-{size}", tables)
            covered, name = covered.union(alike), f"parts-{size}-left"
    return covered.union(doubled(left, width, start, name, tables))


def doubled(left: DataFrame, width: int, start: int, name: str, tables: Tables) -> DataFrame:
    """Repeated strings of the parts left, by prefix doubling; ``name`` is their table and goes."""
    steps = lengths(width, start)
    parts = left.groupBy(*TEXT).agg(F.collect_list(F.struct("at", "count", "known", "content")).alias("parts"))
    places = tables.settle(
        parts.select(*TEXT, "parts.at", "parts.count", "parts.known", "parts.content").mapInPandas(
            places_of(steps),
            "doc bigint, text_key bigint, at bigint, last int, wanted boolean, k1 bigint, k2 bigint",
        ),
        "places",
    )
    tables.drop(name)
    name = "places"
    for step, length in enumerate(steps):
        shared = ranked(places, f"ranked-{length}", tables.settle).filter("NOT alone")
        tables.drop(name)
        if length == width:
            break
        further = steps[step + 1] - length
        after = Window.partitionBy(*TEXT).orderBy("at").rangeBetween(further, further)
        name = f"places-{length}"
        places = tables.settle(
            shared.withColumn("k2", F.max("rank").over(after))
            .filter((F.col("last") > step) & F.col("k2").isNotNull())
            .select(*PLACE, "last", "wanted", F.col("rank").alias("k1"), "k2"),
            name,
        )
        tables.drop(f"ranked-{length}")
    return shared.filter("wanted").select(*TEXT, F.col("at").alias("begin"), (F.col("at") + width).alias("end"))


def named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts with their names; a null id is replaced by a hash of the text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    own = F.col(id_column).cast("bigint")
    return docs.select(
        own.alias("doc_id"),
        F.coalesce(own, F.xxhash64(text, F.lit("no id"))).alias("doc"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[dict], bytes]:
    """Maximal runs that the spans cover, and the bytes outside them."""
    runs: list[list[int]] = []
    for begin, end in sorted(spans):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    edges = [0, *(edge for run in runs for edge in run), len(text)]
    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
    return [{"begin": begin, "end": end} for begin, end in runs], kept


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        columns = ("doc_id", "text", "begins", "ends")
        for doc_id, text, begins, ends in zip(*(batch[c] for c in columns), strict=True):
            data = utf8(text)
            spans = list(zip(begins.tolist(), ends.tolist(), strict=True)) if begins is not None else []
            rows.append((doc_id, len(data), *removed(data, spans)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "removed", "kept"]).astype({"doc_id": "Int64"})


def dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    start: int = START,
) -> DataFrame:
    """One row per input row with what is left when repeated strings go.

    Columns: ``doc_id``, ``n_bytes`` (of the text in UTF-8), ``removed`` (maximal runs of
    removed bytes, ``begin`` and ``end`` from 0, the end left out) and ``kept`` (the other
    bytes in a row; binary, since a cut may part a character). Every byte goes that is in
    a string of ``width`` bytes which also starts at another place, in the same document
    or another; strings are those of the input and may overlap. ``gram`` and ``start`` change
    costs, not results.

    Null texts count as empty; texts shorter than ``width`` are kept whole. Repeated rows
    are documents of their own and so repeat each other; rows with a null id are told
    apart by their text. Very long texts are looked at in pieces and held whole by one
    task. An empty table gives an empty result, other columns are ignored. Texts move
    only where something is removed or still to be compared.
    """
    tables = Tables()
    spans = tables.settle(
        find_repeats(docs, id_column, text_column, width, gram, start, tables)
        .groupBy(*TEXT)
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans")),
        "spans",
    )
    tables.drop_others("spans")
    bits = roomy(spans.count())
    texts = named(docs, id_column, text_column)
    likely: Column = is_set(bitmap(spans, "text_key", bits).scalar(), F.col("text_key"), bits)
    run = "array<struct<begin: bigint, end: bigint>>"
    whole = texts.filter(~likely).select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.array().cast(run).alias("removed"),
        F.col("text").cast("binary").alias("kept"),
    )
    parted = texts.filter(likely).join(unbounded(spans), list(TEXT), "left").select(
        "doc_id", "text", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends")
    )
    return whole.union(parted.mapInPandas(cut, f"doc_id bigint, n_bytes bigint, removed {run}, kept binary"))

"""Alignment of two tokenizers' ids over the same bytes.

Each text is encoded twice, and every token stands for bytes. Byte offsets at which a
token of both ends cut the two lists of ids into groups: the cumulative ends go into a
dictionary each, end to place, and the ends in both, in order, slice the lists. Within a
group every id of one side is linked with every id of the other.

How many documents hold a pair of ids linked is counted over all documents. Texts are
read in blocks; a block counts its own pairs first, so a pair is one row for each block
and not one for each document, and asks for the corpus's counts of its own pairs only.
Until they are there a document's pairs wait as places in its block's list.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwell.llm.common import in_small_batches, in_turns, settle

#: Fixed value: how byte-level tokenizers split a text before merging, by default.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 4 << 20  # of text, about
ENCODED_CHARACTERS = 1 << 18  # encoded together
LINKS_AT_ONCE = 2_000_000
PAIRS_IN_ROW = 50_000

RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string, groups string"
)
WAITING = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, groups string, n_pairs int, places binary, times binary, "
    "first int, pairs array<bigint>, docs array<int>"
)
NO_PAIRS = {"first": None, "pairs": None, "docs": None}


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, to the byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelTokens:
    """Ids and bytes of a byte-level BPE file of the tokenizers library.

    Where the file is a plain one, whose merges come in the order of their ids, the same
    ids are made by the faster ``tiktoken``; else by the library itself. Special tokens'
    strings are plain text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        special = {token["content"] for token in parts["added_tokens"] if token["special"]}
        letters = byte_letters()
        vocabulary = parts["model"]["vocab"]
        spelled = {
            i: token.encode() if token in special else bytes(letters[c] for c in token)
            for token, i in vocabulary.items()
        }
        self.bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.fast = None
        if plain(parts):
            ranks = {spelled[i]: i for token, i in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(" " + text) for text in texts]
        return [self.tokenizer.encode(" " + text, add_special_tokens=False).ids for text in texts]


def plain(parts: dict) -> bool:
    """Whether splitting by ``SPLIT`` and merging by ascending id is all that the file asks for."""
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    return (
        parts["normalizer"] is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(a < b for a, b in zip(made, made[1:], strict=False))
    )


class PieceTokens:
    """Ids and bytes of a sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self.spelled(i) for i in range(self.model.get_piece_size())]

    def spelled(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Aligned:
    """A text's ids on both sides and, for each group, where it ends in either."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_ends, prepend=0), np.diff(self.b_ends, prepend=0)

    def n_links(self) -> int:
        in_a, in_b = self.sizes()
        return int((in_a * in_b).sum())

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of ids, that of A in the upper half, and how often each is linked.

        Links are expanded group by group, some millions at once.
        """
        in_a, in_b = self.sizes()
        repeats = np.repeat(in_b, in_a)  # links of each token of A
        first = np.repeat(self.b_ends - in_b, in_a)
        total = np.concatenate([[0], np.cumsum(repeats)])
        found, begin = [], 0
        while begin < len(self.a):
            end = int(np.searchsorted(total, total[begin] + LINKS_AT_ONCE, side="right")) - 1
            end = min(max(end, begin + 1), len(self.a))
            times = repeats[begin:end]
            at = np.arange(times.sum()) - np.repeat(total[begin:end] - total[begin], times)
            pair = np.repeat(self.a[begin:end] << 32, times) | self.b[at + np.repeat(first[begin:end], times)]
            found.append(np.unique(pair, return_counts=True))
            begin = end
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        names, inverse = np.unique(np.concatenate([names for names, _ in found]), return_inverse=True)
        return names, np.bincount(inverse, np.concatenate([times for _, times in found])).astype(np.int64)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelTokens(a_path), PieceTokens(b_path)
        self.a_sizes = [len(x) for x in self.a.bytes]
        self.b_sizes = [len(x) for x in self.b.bytes]
        sides = [(len(self.a.bytes), "|"), (len(self.b.bytes), ";")]
        # Each id with the mark that follows it inside a group and with the one at a group's end.
        self.marked = [f"{i}{mark}" for size, last in sides for mark in (",", last) for i in range(size)]

    def align(self, texts: list[str | None]) -> list[Aligned | None]:
        """None for texts without tokens: null, empty, or not what the tokens spell."""
        some = [text for text in texts if text]
        encoded = iter(zip(some, self.a.encode(some), self.b.encode(some), strict=True))
        return [self.grouped(*next(encoded)) if text else None for text in texts]

    def grouped(self, text: str, a: list[int], b: list[int]) -> Aligned | None:
        whole = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole:
            return None
        if b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        a_places = dict(zip(accumulate(map(self.a_sizes.__getitem__, a)), range(1, len(a) + 1), strict=True))
        b_places = dict(zip(accumulate(map(self.b_sizes.__getitem__, b)), range(1, len(b) + 1), strict=True))
        common = sorted(a_places.keys() & b_places.keys())
        return Aligned(
            np.array(a, dtype=np.int64),
            np.array(b, dtype=np.int64),
            np.array([a_places[end] for end in common], dtype=np.int64),
            np.array([b_places[end] for end in common], dtype=np.int64),
        )

    def written(self, found: Aligned) -> str:
        """Groups in order, as ``a1,a2|b1;a3|b2,b3``."""
        in_a, in_b = found.sizes()
        last_a, last_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
        last_a[found.a_ends - 1] = last_b[found.b_ends - 1] = True
        codes = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        codes[np.arange(len(found.a)) + np.repeat(found.b_ends - in_b, in_a)] = found.a + size_a * last_a
        codes[np.arange(len(found.b)) + np.repeat(found.a_ends, in_b)] = 2 * size_a + found.b + size_b * last_b
        return "".join(map(self.marked.__getitem__, codes.tolist()))[:-1]


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), "<u4").astype(np.int64)


class Block:
    """Documents read so far and their pairs, which are numbered when the block is full."""

    def __init__(self):
        self.rows, self.names, self.times, self.bytes = [], [], [], 0

    def add(self, row: tuple, found: Aligned | None, size: int) -> None:
        names, times = found.pairs() if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.rows.append(row)
        self.names.append(names)
        self.times.append(times)
        self.bytes += size

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        """A row for each document, then rows of the block's pairs with how many documents hold each."""
        names, inverse, docs = np.unique(np.concatenate(self.names), return_inverse=True, return_counts=True)
        out, at = [], 0
        for row, own, times in zip(self.rows, self.names, self.times, strict=True):
            places = np.diff(inverse[at : at + len(own)], prepend=0)  # ascending, as the pairs are
            out.append((block, *row, len(own), squeezed(places), squeezed(times)))
            at += len(own)
        columns = [x.split()[0] for x in WAITING.split(", ")]
        yield pd.DataFrame(out, columns=columns[:-3]).assign(**NO_PAIRS).astype({"doc_id": "Int64", "first": "Int32"})
        for first in range(0, len(names), PAIRS_IN_ROW):
            some = slice(first, first + PAIRS_IN_ROW)
            row = (block, *[None] * (len(columns) - 4), first, names[some], docs[some])
            yield pd.DataFrame([row], columns=columns, dtype=object).astype(
                dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs"], "Int64")
            )


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_groups: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: how the ids of two tokenizers cover the same bytes.

    A is a byte-level BPE file of the tokenizers library, given a space and the text; B a
    sentencepiece model, which adds the space itself. Columns: ``doc_id``, ``n_a`` and
    ``n_b`` (ids), ``n_groups``, ``n_links``, ``n_best`` (links whose pair no other pair of
    its id of A surpasses in documents that hold it), ``count_sum`` (those numbers of
    documents, added over the links), ``groups_sha256`` and, if asked for, ``groups``: the
    groups themselves, as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose tokens don't spell them, have no tokens: zeros,
    an empty digest and null groups. Repeated rows are documents of their own and a null
    id is kept. A very long text is encoded whole and is a block by itself; its links are
    expanded some millions at once. Ties for the highest count all count. An empty table
    gives an empty result, other columns are ignored. Nothing is collected.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, block, number = Aligner(a_path, b_path), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for some in in_turns(texts, ENCODED_CHARACTERS):
                for doc_id, text, found in zip(ids[some], texts[some], aligner.align(texts[some]), strict=True):
                    row = (doc_id, 0, 0, 0, 0, "", None)
                    if found:
                        groups = aligner.written(found)
                        row = (
                            doc_id, len(found.a), len(found.b), len(found.a_ends), found.n_links(),
                            hashlib.sha256(groups.encode()).hexdigest(), groups if with_groups else None,
                        )
                    block.add(row, found, len(text or ""))
                    if block.bytes >= block_bytes:
                        yield from block.frames(number)
                        block, number = Block(), number + 1
        if block.rows:
            yield from block.frames(number)

    texts = in_small_batches(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    waiting = settle(texts.mapInPandas(encode, WAITING), "aligned")
    lists = waiting.filter("pairs IS NOT NULL").select(
        "block", "first", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "pair")
    )
    asked = lists.select(F.col("block").alias("asker"), (F.col("first") + F.col("at")).alias("place"), F.col("pair.pairs").alias("pair"))
    counts = lists.groupBy(F.col("pair.pairs").alias("pair")).agg(F.sum("pair.docs").alias("n"))
    counts = settle(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.join(counts, "pair").select("asker", "place", "n", "best")

    def summed(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("place")
        n, best = answers["n"].to_numpy(), answers["best"].to_numpy(dtype=bool)
        n_best, count_sum = [], []
        for size, places, times in zip(rows["n_pairs"], rows["places"], rows["times"], strict=True):
            at, times = np.cumsum(unsqueezed(places, size)), unsqueezed(times, size)
            n_best.append(int(times[best[at]].sum()) if size else 0)
            count_sum.append(int((times * n[at]).sum()) if size else 0)
        out = rows.assign(n_best=n_best, count_sum=count_sum)
        return out[[x.split()[0] for x in RESULT.split(", ")]]

    rows = waiting.filter("pairs IS NULL").drop(*NO_PAIRS)
    result = rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(summed, RESULT)
    return result if with_groups else result.drop("groups")

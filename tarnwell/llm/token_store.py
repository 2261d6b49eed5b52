"""Token-id store: Arrow files of equal-length sequences with masks.

Documents are encoded in ascending id order and their ids run on, one document after
another, through rows of a fixed length. A file holds record batches of two
fixed-size-list columns: ``ids`` and ``mask`` (false where the last row is filled up).
Fixed-size lists have no offsets, so position ``p`` of a file is element ``p`` of one
flat buffer per batch and is read from a memory map without copying or decoding.

Which file, from where and how long is kept per document in an index table beside the
files; the index is written by Spark, so only files of successful tasks are listed.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tarnwell.llm.common import in_small_batches, in_turns, kept, scratch

END_ID = 1
BEYOND_LATIN = re.compile("[^\0-\u02ff]")
MARKS = string.punctuation.encode()
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [byte for byte in range(0x100) if byte not in PRINTED]
#: For each byte the character that stands for it in a byte-level vocabulary.
BYTE_LEVEL = "".join(chr(b) if b in PRINTED else chr(0x100 + HIDDEN.index(b)) for b in range(0x100))
SEQUENCE = 2048  # ids in a row
ROWS = 256  # rows in a record batch
CACHED_WORDS = 900_000  # words' ids that a worker remembers, and as many older ones
COUNTED_WORDS = 300_000  # words' lengths that a worker remembers, and as many older ones
CHARACTERS_AT_ONCE = 200_000
COUNTED_AT_ONCE = 1_000_000  # characters
WORDS_AT_ONCE = 1000

INDEX_SCHEMA = "doc_id bigint, part int, file string, file_start bigint, n_tokens bigint"
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


#: Settings under which a text's ids are those of its words in turn.
BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def splits_at_words(path: str) -> bool:
    """Whether a tokenizer's file has the settings of ``BY_WORDS``, and special tokens that ``<|`` begins."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    return (
        all(parts.get(name) == value for name, value in BY_WORDS.items())
        and parts["model"].get("type") == "BPE"
        and not parts["model"].get("dropout")
        and all(token["content"].startswith("<|") and not token["normalized"] for token in parts["added_tokens"])
    )


class WordEncoder:
    """Encodes texts word by word, where the tokenizer's settings allow it, else whole.

    Under such settings the tokenizer drops white space and never joins what stands on
    both sides of it, so a text's ids are those of its words in turn; words repeat, so
    most are looked up. Words are split at ASCII white space only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy already
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = splits_at_words(path)
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.width = np.dtype("<u2" if small else "<u4")
        self.pack = "H" if small else "I"
        self.end = struct.pack(f"<{self.pack}", END_ID)
        self.known: dict[bytes, bytes] = {b"": b""}  # a word's ids; white space at an end gives an empty one
        self.older: dict[bytes, bytes] = {}  # what was known before ``known`` was begun
        # The model alone, for words as the vocabulary has them, between bytes that stand for spaces.
        self.spaced = Tokenizer(self.tokenizer.model)
        self.spaced.pre_tokenizer = CharDelimiterSplit(BYTE_LEVEL[0x20])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id, and the number of each text."""
        if not self.by_words:
            return self.encode_whole(texts)
        distinct, places, ends = words_at(texts)
        runs = list(map(self.known.get, distinct))
        fresh = [place for place, run in enumerate(runs) if run is None]
        self.learn([distinct[place] for place in fresh])
        for place in fresh:
            runs[place] = self.known[distinct[place]]
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {b"": b""}, self.known
        with_ends = np.insert(places, ends[1:], len(runs))  # the end id is one word more
        found = pa.array([*runs, self.end], pa.large_binary()).take(pa.array(with_ends))
        _, offsets, ids = found.buffers()
        starts = np.frombuffer(offsets, dtype=np.int64) // self.width.itemsize  # of each word in the ids
        sizes = np.diff(starts[ends + np.arange(len(ends))])
        return np.frombuffer(ids or b"", dtype=self.width, count=int(sizes.sum())), sizes

    def encode_whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([text or "" for text in texts], add_special_tokens=False)
        runs = [[*e.ids, END_ID] for e in encoded]
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        return np.fromiter(chain.from_iterable(runs), dtype=self.width, count=int(sizes.sum())), sizes

    def learn(self, words: list[bytes]) -> None:
        known, others, pairs = self.known, set(), []
        together: dict[bytes, bytes] = {}  # runs of Latin letters, and these in lower case
        for word in words:
            run = self.older.get(word)
            if run is not None:
                known[word] = run
                continue
            parts = parted(word)
            for part in parts:
                if part in known or part in together:
                    continue
                lower = latin_letters(part)
                if lower:
                    together[part] = lower
                else:
                    others.add(part)
            if len(parts) > 1:
                pairs.append((word, *parts))
        self.learn_together(together)
        self.learn_each(list(others))
        known.update((word, known[body] + known[marks]) for word, body, marks in pairs)

    def learn_each(self, words: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)
        for word, e in zip(words, encoded, strict=True):
            self.known[word] = struct.pack(f"<{len(e)}{self.pack}", *e.ids)

    def learn_together(self, words: dict[bytes, bytes]) -> None:
        """Runs of Latin letters are encoded as one text, which is faster, and told apart by their place."""
        size, every = self.width.itemsize, list(words)
        for first in range(0, len(every), WORDS_AT_ONCE):
            some = every[first : first + WORDS_AT_ONCE]
            encoded = self.spaced.encode(in_byte_level(b" ".join(map(words.get, some))), add_special_tokens=False)
            place = np.array(encoded.word_ids)
            ends = ((np.flatnonzero(np.diff(place, append=-1)) + 1) * size).tolist()
            if len(ends) != len(some):  # a vocabulary without some letters
                self.learn_each(some)
                continue
            ids = np.array(encoded.ids, dtype=self.width).tobytes()
            self.known.update((word, ids[start:end]) for word, start, end in zip(some, [0, *ends], ends, strict=False))


class LengthCounter:
    """Numbers of ids, the end id included, for where the ids themselves aren't needed."""

    def __init__(self, path: str):
        self.encoder = WordEncoder(path)
        self.known: dict[bytes, int] = {b"": 0}  # a word's number of ids; white space at an end gives an empty one
        self.older: dict[bytes, int] = {}  # what was known before ``known`` was begun

    def lengths(self, texts: list[str | None]) -> list[int]:
        if not self.encoder.by_words:
            return self.encoder.encode_whole(texts)[1].tolist()
        distinct, places, word_ends = words_at(texts)
        sizes = list(map(self.known.get, distinct))
        fresh = [place for place, size in enumerate(sizes) if size is None]
        self.learn([distinct[place] for place in fresh])
        for place in fresh:
            sizes[place] = self.known[distinct[place]]
        each = np.array(sizes, dtype=np.int64)[places]
        ends = np.concatenate([[0], np.cumsum(each)])[word_ends]
        if len(self.known) > COUNTED_WORDS:
            self.known, self.older = {b"": 0}, self.known
        return (np.diff(ends) + 1).tolist()

    def learn(self, words: list[bytes]) -> None:
        known, tokenize = self.known, self.encoder.tokenizer.model.tokenize
        others, pairs = set(), []
        for word in words:
            size = self.older.get(word)
            if size is not None:
                known[word] = size
                continue
            parts = parted(word)
            for part in parts:
                if part in known:
                    continue
                letters = latin_letters(part)
                if letters:
                    known[part] = len(tokenize(in_byte_level(letters)))
                else:
                    others.add(part)
            if len(parts) > 1:
                pairs.append((word, *parts))
        self.learn_others(others)
        known.update((word, known[body] + known[marks]) for word, body, marks in pairs)

    def learn_others(self, words: set[bytes]) -> None:
        size, self.encoder.known = self.encoder.width.itemsize, {}
        self.encoder.learn(list(words))
        self.known.update((word, len(self.encoder.known[word]) // size) for word in words)


def words_at(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, which of them stand in all texts in turn, and 0 and where each text's words end there.

    Words are in lower case where the tokenizer would put the same.
    """
    lowered = pa.array([lowered_latin(t or "") for t in texts], pa.large_binary())
    words = pc.ascii_split_whitespace(lowered.view(pa.large_string()))
    places = words.flatten().dictionary_encode()
    distinct = places.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return distinct, places.indices.to_numpy(), words.offsets.to_numpy()


def lowered_latin(text: str) -> bytes:
    """A text, in lower case if it has Latin letters without combining characters and no special tokens."""
    if (text.isascii() or not BEYOND_LATIN.search(text)) and "<|" not in text:
        text = text.lower()
    return text.encode("utf-8", "replace")


def latin_letters(word: bytes) -> bytes | None:
    """A word of Latin letters in lower case; nothing for other words."""
    if word.isalpha():
        return word.lower()
    text = word.decode().lower()
    return text.encode() if text.isalpha() and not BEYOND_LATIN.search(text) else None


def in_byte_level(word: bytes) -> str:
    """As the vocabulary has it."""
    return codecs.charmap_decode(word, "strict", BYTE_LEVEL)[0]


def parted(word: bytes) -> tuple[bytes, ...]:
    """The word, or its body and the marks at its end if the body ends with a letter.

    A run of marks after a letter is never joined to it, and isn't cut here.
    """
    body = word.rstrip(MARKS)
    if len(body) in (0, len(word)) or b"<|" in word:
        return (word,)
    # In lower case, since one capital letter ends with a combining character then.
    letter = body[-1:].isalpha() or body[-1] >= 128 and body.decode().lower()[-1].isalpha()
    return (body, word[len(body) :]) if letter else (word,)


def encoder_at(path: str) -> WordEncoder:
    return kept(WordEncoder, path)


def counter_at(path: str) -> LengthCounter:
    return kept(LengthCounter, path)


class SequenceFile:
    """Writes a run of ids as equal-length rows; holds one record batch at most."""

    def __init__(self, uri: str, length: int, width: np.dtype, notes: dict):
        self.length = length
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))],
            metadata={"token_store": json.dumps(notes)},
        )
        files, path = pa.fs.FileSystem.from_uri(uri)
        self.sink = files.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        full = ROWS * self.length
        if self.held >= full:
            flat = np.concatenate(self.waiting)
            for start in range(0, len(flat) - full + 1, full):
                self._write(flat[start : start + full], full)
            rest = flat[len(flat) // full * full :]
            self.waiting, self.held = [rest], len(rest)

    def _write(self, flat: np.ndarray, valid: int) -> None:
        ids = pa.array(flat)
        mask = pa.array(np.arange(len(flat)) < valid)
        self.writer.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(ids, self.length),
                    pa.FixedSizeListArray.from_arrays(mask, self.length),
                ],
                schema=pa.schema(self.schema),
            )
        )

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=flat.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to the ids of one file, by position; local files are memory-mapped."""

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(files, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else files.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray] | None = None

    def flat(self, number: int) -> np.ndarray:
        """All ids of a batch, as they lie in the file."""
        if self.last is None or self.last[0] != number:
            self.last = number, self.batch(number).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.last[1]

    def batch(self, number: int) -> pa.RecordBatch:
        return self.file.get_batch(number)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``; a view where they lie in one batch."""
        full, parts = ROWS * self.length, []
        while count > 0:
            number, offset = divmod(start, full)
            parts.append(self.flat(number)[offset : offset + count])
            if not len(parts[-1]):
                raise EOFError(f"no ids at {start}")
            start, count = start + len(parts[-1]), count - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])

    def close(self) -> None:
        self.source.close()


def write_store(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = SEQUENCE,
) -> DataFrame:
    """Write the files and the index under ``folder``, a URI; returns the index.

    Documents are range-partitioned and sorted by id, so file ``part`` holds ids before
    those of ``part + 1``; equal ids are ordered by a hash of the text. Null ids come
    first. Ids are stored in two bytes where the vocabulary allows it, in four otherwise.
    Any tokenizer of the ``tokenizers`` library will do; those that split at words as
    ``BY_WORDS`` says are faster.

    A null text is an empty one and has the end id alone. A very long text is encoded
    whole and may go through many record batches. Repeated rows are stored each, ties
    between them don't matter; an empty table gives an empty index; other columns are
    ignored.
    """
    folder = folder.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, store, at = encoder_at(tokenizer_path), None, 0
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for turn in in_turns(batch["text"].tolist(), CHARACTERS_AT_ONCE):
                some = batch.iloc[turn]
                ids, sizes = encoder.encode(some["text"].tolist())
                if store is None:
                    store = SequenceFile(uri, length, encoder.width, {"end_id": END_ID, "length": length})
                store.append(ids)
                starts = at + np.cumsum(sizes) - sizes
                at += len(ids)
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64"),
                        "part": part,
                        "file": uri,
                        "file_start": starts,
                        "n_tokens": sizes,
                    }
                )
        if store is not None:
            store.close()

    texts = in_small_batches(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    index = (
        texts.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInPandas(write, INDEX_SCHEMA)
    )
    make_folder(docs.sparkSession, folder)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def make_folder(spark: SparkSession, uri: str) -> None:
    files, path = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)


def read_store(index: DataFrame) -> DataFrame:
    """Per document, from the files: global start, number of ids and their checksum.

    Only the size of each file is brought to the driver, one row a file. Rows are those of
    the index, with null ids, repeated rows and texts without ids as they were written; a
    very long document's ids are read whole. An empty index gives an empty result.
    """
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = dict(
        zip(
            [r.part for r in sizes],
            np.cumsum([0, *(r.n for r in sizes)])[:-1].tolist(),
            strict=True,
        )
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("file", sort=False):
                reader, sums, counts = SequenceReader(file), [], []
                for start, count in zip(rows["file_start"], rows["n_tokens"], strict=True):
                    ids = reader.ids(int(start), int(count))
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    del ids
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].astype("Int64"),
                        "start": rows["file_start"] + rows["part"].map(before),
                        "n_tokens": counts,
                        "ids_crc32": sums,
                    }
                )

    return index.mapInPandas(read, READ_SCHEMA)


def new_store_folder(spark: SparkSession) -> str:
    shared = scratch(spark).rstrip("/")
    return f"{shared if ':' in shared else 'file://' + shared}/token-store-{uuid.uuid4().hex}"

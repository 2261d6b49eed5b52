"""Language-model scoring by prediction by partial matching over bytes.

Training documents give a trie of byte contexts up to ``ORDER`` long. A text's code
length adds up over its bytes and one end symbol. A symbol is looked for at the longest
context that training has seen; where it wasn't seen there, an escape is paid and the
next shorter context is asked, without the symbols that the longer one already offered
(symbol exclusion). The escape estimate is the number of different symbols of a context
(method C). Below the empty context all symbols left are alike.

Nothing that grows with the corpus is broadcast. Documents are dealt into blocks; a
block asks for the statistics of just the words and contexts that occur in it, once
each, by a join, and is scored where they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import fold, settle

ORDER = 4  # bytes of the longest context
END = 0xFF  # never in UTF-8: ends a text, and stands before it
BLOCK_BYTES = 16 << 20
PART_BYTES = 1 << 20  # worked on at once within a block
MERGED = 8  # parts whose keys are merged at once
HELD = 2_000_000  # distinct entries a task gathers before it hands them on

WORD, ENTRY, CONTEXT = 0, 1, 16  # kinds of keys; + length of the context
END_WORD = 0  # key of the end token
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIXERS = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LONG = 64  # bytes; longer words are hashed one by one
BYTES_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, each text's end token last; and their numbers.

    Words are known by their hash: among 10^8 different words the chance that any two
    fall together is about 3 in 10,000.
    """
    raw = b"".join(t + b" " for t in texts).lower()
    flat = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    space = SPACES[flat[: len(raw)]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    before = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    sizes = np.diff(before, prepend=0) + 1
    keys = np.full(len(starts) + len(texts), END_WORD, dtype=np.int64)
    is_word = np.ones(len(keys), dtype=bool)
    is_word[np.cumsum(sizes) - 1] = False
    keys[is_word] = hashes(raw, flat, starts, ends - starts)
    return keys, sizes


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Each 64-bit number to another one; every bit depends on all bits."""
    for factor in MIXERS:
        numbers = (numbers ^ (numbers >> np.uint64(33))) * factor
    return numbers ^ (numbers >> np.uint64(33))


def hashes(raw: bytes, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of ``raw``, by eight bytes at a time; ``flat`` is ``raw`` and eight bytes more."""
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=flat, strides=(1,))
    found = sizes.astype(np.uint64) * SPREAD
    left = np.arange(len(starts))
    for at in range(0, LONG, 8):
        rest = sizes[left] - at
        eight = eights[starts[left] + at] & BYTES_KEPT[np.minimum(rest, 8)]
        found[left] = mixed(found[left] ^ eight)
        left = left[rest > 8]
    for i in left.tolist():
        found[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return found.view(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Every key once, ascending; by a sort, which keeps to the processor's caches."""
    keys = np.sort(keys)
    return keys[first_of_runs(keys)]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(first_of_runs(keys))
    return keys[first], np.diff(first, append=len(keys))


def first_of_runs(keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def windows(texts: list[bytes]) -> np.ndarray:
    """For each byte and the end of each text, it and the ``ORDER`` bytes before as one number."""
    edge = bytes([END]) * ORDER
    padded = b"".join(edge + t + edge[:1] for t in texts) + bytes(8)
    n = max(len(padded) - 8 - ORDER, 0)
    eights = np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,))
    codes = eights.astype(np.uint64).byteswap(inplace=True)  # the first byte is the highest
    codes >>= np.uint64(8 * (7 - ORDER))
    inside = np.ones(n, dtype=bool)
    ends = np.cumsum([len(t) + 1 + ORDER for t in texts[:-1]], dtype=np.int64)
    for j in range(1, ORDER + 1):
        inside[ends - j] = False  # over the end of a text
    return codes[inside].view(np.int64)


def parts(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about ``PART_BYTES`` together, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + ORDER
        if size >= PART_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in counts])
    numbers = np.concatenate([n for _, n in counts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(first_of_runs(keys))
    return keys[first], np.add.reduceat(numbers[order], first) if len(first) else numbers


def count_training(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and of windows, one row each for as much as a task holds at once."""
    held: dict[int, list] = {WORD: [], ENTRY: []}

    def handed_on() -> Iterator[pd.DataFrame]:
        for kind, counts in held.items():
            if counts:
                keys, numbers = merged(counts)
                yield pd.DataFrame({"kind": kind, "key": keys, "n": numbers})
                counts.clear()

    for batch in batches:
        for _, raw in parts(batch["text"].tolist()):
            held[WORD].append(counted(word_keys(raw)[0]))
            held[ENTRY].append(counted(windows(raw)))
            for counts in held.values():
                if len(counts) > MERGED:
                    counts[:] = [merged(counts)]
            if sum(len(k) for counts in held.values() for k, _ in counts) > HELD:
                yield from handed_on()
    yield from handed_on()


def low_bytes(code: Column, count: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 8 * count) - 1))


def statistics(counts: DataFrame) -> DataFrame:
    """What blocks ask for: ``(kind, key, x, y, z)``.

    Words and entries (a context and a symbol): their count x. Contexts: number of
    symbols seen x, of different ones y, and z, the count that those have together at
    the context one shorter, which is what exclusion takes away there.
    """
    entries = [
        counts.filter(F.col("kind") == ENTRY)
        .groupBy(low_bytes(F.col("key"), k + 1).alias("code"))
        .agg(F.sum("n").alias("n"))
        for k in range(ORDER + 1)
    ]
    zero = F.lit(0).cast("bigint")
    rows = counts.filter(F.col("kind") == WORD).select(
        F.lit(WORD).alias("kind"), "key", F.col("n").alias("x"), zero.alias("y"), zero.alias("z")
    )
    for k, entry in enumerate(entries):
        rows = rows.union(entry.select(F.lit(ENTRY + k), "code", "n", zero, zero))
        below = entry.withColumn("m", zero)
        if k:
            shorter = entries[k - 1].select(F.col("code").alias("short"), F.col("n").alias("m"))
            below = entry.withColumn("short", low_bytes(F.col("code"), k)).join(shorter, "short")
        contexts = below.groupBy(F.shiftright("code", 8).alias("context")).agg(
            F.sum("n").alias("x"), F.count("*").alias("y"), F.sum("m").alias("z")
        )
        rows = rows.union(contexts.select(F.lit(CONTEXT + k), "context", "x", "y", "z"))
    return rows


def keys_of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Every word, entry and context of a block, once each."""
    words, codes = [], []
    for _, raw in parts(rows["text"].tolist()):
        words.append(distinct(word_keys(raw)[0]))
        codes.append(distinct(windows(raw)))
        if len(codes) > MERGED:
            words, codes = [distinct(np.concatenate(words))], [distinct(np.concatenate(codes))]
    full = distinct(np.concatenate(codes))
    found = [(WORD, distinct(np.concatenate(words)))]
    for k in range(ORDER + 1):
        code = distinct(full & ((1 << 8 * (k + 1)) - 1))
        found += [(ENTRY + k, code), (CONTEXT + k, distinct(code >> 8))]
    return pd.concat(
        [pd.DataFrame({"kind": np.int32(kind), "key": key}) for kind, key in found]
    ).assign(block=rows["block"].iloc[0])[["block", "kind", "key"]]


class Slots:
    """Places of distinct keys, found through a table of slots; -1 for other keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self.slot_of(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            behind = self.table[slot] != left
            left, slot = left[behind], (slot[behind] + 1) & self.mask

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        slot = self.slot_of(keys)
        at = self.table[slot]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            at[left] = self.table[slot]
            wrong = (at[left] >= 0) & (self.keys[at[left]] != keys[left])
            left, slot = left[wrong], slot[wrong]
        return at


class Lookup:
    """Numbers by key; zero for keys that training hasn't seen."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.slots = Slots(np.ascontiguousarray(keys))
        self.values = [np.append(v.astype(np.float64), 0.0) for v in values]  # place -1: zero

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        at = self.slots(keys)
        return [v[at] for v in self.values]


def log_probabilities(codes: np.ndarray, stats: dict[int, Lookup]) -> np.ndarray:
    """log10 probability of the last byte of each code after the bytes before it."""
    total = np.zeros(len(codes))
    open_ = np.ones(len(codes), dtype=bool)  # symbols not coded yet
    mass, kinds = np.zeros(len(codes)), np.zeros(len(codes))  # excluded
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(ORDER, -1, -1):
            entry = codes & ((1 << 8 * (k + 1)) - 1)
            (count,) = stats[ENTRY + k](entry)
            seen, different, below = stats[CONTEXT + k](entry >> 8)
            escape = different - kinds
            whole = seen - mass + escape
            here = open_ & (count > 0)
            total[here] += np.log10(count[here] / whole[here])
            pays = open_ & ~here & (seen > 0) & (whole > 0)
            total[pays] += np.log10(escape[pays] / whole[pays])
            open_ &= ~here
            mass, kinds = np.where(seen > 0, below, 0.0), np.where(seen > 0, different, 0.0)
        total[open_] -= np.log10(256 - kinds[open_])
    return total


def score_block(rows: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    kinds, keys = stats["kind"].to_numpy(), stats["key"].to_numpy()
    numbers = [stats[name].to_numpy() for name in "xyz"]
    tables = {}
    for kind in (WORD, *range(ENTRY, ENTRY + ORDER + 1), *range(CONTEXT, CONTEXT + ORDER + 1)):
        of = kinds == kind
        tables[kind] = Lookup(keys[of], *(n[of] for n in numbers[: 3 if kind >= CONTEXT else 1]))
    texts, out = rows["text"].tolist(), []
    found = []
    for _, raw in parts(texts):
        found.append(distinct(windows(raw)))
        if len(found) > MERGED:
            found = [distinct(np.concatenate(found))]
    codes = distinct(np.concatenate(found or [np.zeros(0, np.int64)]))
    logs, places = log_probabilities(codes, tables), Slots(codes)
    for _, raw in parts(texts):
        each = logs[places(windows(raw))]
        starts = np.cumsum([0, *(len(t) + 1 for t in raw[:-1])])
        scores = np.add.reduceat(each, starts)
        words, sizes = word_keys(raw)
        (counts,) = tables[WORD](words)
        word_starts = np.cumsum(sizes) - sizes
        out.append(
            pd.DataFrame(
                {
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), word_starts),
                    "logs": np.add.reduceat(np.log10(counts + 0.5), word_starts),
                    "score": scores,
                }
            )
        )
    result = pd.concat(out, ignore_index=True)
    result.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
    result.insert(1, "held_out", rows["held_out"].to_numpy())
    return result


def score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row, scored by what the documents outside fold 1 teach.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (smoothed word frequencies) and ``score`` (log10 probability of the
    text's bytes and its end). A null text is an empty one, whose end is scored. With
    nothing to learn from, bytes are equally likely. A very long text is scored whole, in
    one block and in parts of some megabytes. Repeated rows give repeated rows, a
    null id is kept and counts as empty text for the fold, other columns are ignored, an
    empty table gives an empty result.
    """
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (fold(id_column) == 1).alias("held_out"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    counts = settle(
        texts.filter("NOT held_out")
        .select("text")
        .mapInPandas(count_training, "kind int, key bigint, n bigint")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n")),
        "ppm-counts",
    )
    stats = settle(statistics(counts), "ppm-statistics")
    words = counts.filter(F.col("kind") == WORD).agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = words.n or 0, words.v
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = texts.withColumn("block", block).repartition(3 * blocks, "block")  # few partitions get several
    asked = blocked.groupBy("block").applyInPandas(keys_of_block, "block int, kind int, key bigint")
    told = asked.join(stats, ["kind", "key"])
    scored = (
        blocked.groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInPandas(
            score_block,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double",
        )
    )
    floor = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )

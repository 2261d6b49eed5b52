"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts words and character n-grams per language. A text's words are looked up
by their log frequency in each language; a word never seen falls back to its longest
n-grams that were seen, from ``LONGEST`` characters down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import fold, hash_sample, in_small_batches, in_turns, let_go, settle

RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 4
WORD_PRIOR = 0.5  # added to each count
GRAM_WEIGHT = 0.5  # an unseen word's n-grams say less than a known word
MAX_TRAIN_DOCS = 20_000
CHARACTERS_AT_ONCE = 500_000
HASH_SEED = 42  # Spark's
MAX_WORDS, MAX_GRAMS = 100_000, 50_000  # kept of each language, n-grams of each size
ALL_WORDS, ALL_GRAMS = 2_000_000, 1_000_000  # in even shares, of all languages together
LEAST_WORD, LEAST_GRAM = 2, 5  # times that a language must have what is kept for it
LEAST_EVIDENCE = 0.5  # share of a kept text's letters
TIES = 1 << 30  # parts in which a hash deals equally common ones

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; some digits of other scripts look like letters to ``re``."""
    if not text:
        return []
    return [w for w in RUNS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, size: int) -> list[str]:
    padded = f"<{word}>" if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per language of words (size 0) and n-grams, one row each for some texts."""
    let_go()
    for batch in batches:
        for some in in_turns(batch["text"].tolist(), CHARACTERS_AT_ONCE):
            counts: Counter = Counter()
            for lang, texts in batch.iloc[some].groupby("lang")["text"]:
                words = Counter(chain.from_iterable(map(words_of, texts)))
                for word, times in words.items():
                    counts[lang, 0, word] += times
                    for size in range(1, LONGEST + 1):
                        for gram in grams_of(word, size):
                            counts[lang, size, gram] += times
            yield pd.DataFrame(
                [(*key, times) for key, times in counts.items()],
                columns=["lang", "size", "gram", "n"],
            )


def keys_of(grams: Sequence[str]) -> np.ndarray:
    """64-bit hashes, the same that Spark's ``xxhash64`` gives."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g.encode("utf-8", "surrogatepass"), HASH_SEED) for g in grams), np.uint64, len(grams))


class LanguageModel:
    """Log frequencies of words and n-grams in each language, in sorted arrays.

    Only the languages that have a word or n-gram take space for it, so the model grows
    with what the languages have and not with the number of languages times that.
    """

    def __init__(self, counts: pa.Table, docs_per_lang: dict[str, int]):
        """``counts`` has a row for each word or n-gram: ``size``, ``key`` and ``found``, a list of ``lang`` and ``n``."""
        self.langs = sorted(docs_per_lang)
        self.keys: list[np.ndarray] = []  # by size, hashes in ascending order
        self.starts: list[np.ndarray] = []  # by row, where its languages begin
        self.columns: list[np.ndarray] = []  # languages that have it
        self.gains: list[np.ndarray] = []  # log frequency there, over that of what was never seen
        self.unseen: list[np.ndarray] = []
        for size in range(LONGEST + 1):
            own = counts.filter(pc.equal(counts["size"], size)).combine_chunks()
            keys = own["key"].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            own = own.take(order)
            ends = np.cumsum(pc.list_value_length(own["found"]).to_numpy())
            found = pc.list_flatten(own["found"]).combine_chunks()
            columns = pc.index_in(found.field("lang"), pa.array(self.langs, pa.string())).to_numpy()
            numbers = found.field("n").to_numpy()
            totals = np.bincount(columns, numbers, len(self.langs)) + WORD_PRIOR * len(keys)
            self.keys.append(keys[order])
            self.starts.append(np.concatenate([[0], ends]).astype(np.int64))
            self.columns.append(columns.astype(np.int32))
            self.gains.append(np.log(numbers / WORD_PRIOR + 1).astype(np.float32))
            self.unseen.append(np.log(WORD_PRIOR / totals) if len(keys) else totals)
        docs = np.array([docs_per_lang[lang] for lang in self.langs], dtype=float)
        self.prior = np.log(docs / docs.sum()) if len(docs) else docs

    def rows(self, size: int, grams: Sequence[str]) -> np.ndarray:
        """The row of each word or n-gram, -1 where it isn't known."""
        known, keys = self.keys[size], keys_of(grams)
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def sums(self, size: int, owner: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
        """For each of ``count`` owners, the log frequencies of its rows added up."""
        starts = self.starts[size][row]
        lengths = self.starts[size][row + 1] - starts
        flat = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        cells = np.repeat(owner, lengths) * len(self.langs) + self.columns[size][flat]
        gains = np.bincount(cells, self.gains[size][flat], count * len(self.langs))
        times = np.bincount(owner, minlength=count)[:, None]
        return gains.reshape(count, len(self.langs)) + times * self.unseen[size]

    def words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score in each language, and whether more than single letters speak for it."""
        known = self.rows(0, words)
        owners = np.flatnonzero(known >= 0)
        scores = self.sums(0, owners, known[owners], len(words))
        left = np.flatnonzero(known < 0)
        for size in range(LONGEST, 0, -1):
            grams = [grams_of(words[i], size) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            rows = self.rows(size, list(chain.from_iterable(grams)))
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            backed, owner = np.unique(owner, return_inverse=True)
            if len(backed):
                found = GRAM_WEIGHT * self.sums(size, owner, rows, len(backed))
                scores[left[backed]] = found - found.max(axis=1, keepdims=True)
            left = np.delete(left, backed)
            if size == 2:
                spoken_for = np.ones(len(words), dtype=bool)
                spoken_for[left] = False
        return scores, spoken_for

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.with_evidence(texts)]

    def with_evidence(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, its share of the likelihood, and the share of letters that speaks for any.

        Such letters are in words that are known or have a known n-gram of two characters
        or more. Letters are counted and not words, since a text without spaces is one word.
        """
        words = [words_of(text) for text in texts]
        sizes = np.array([len(w) for w in words])
        if not self.langs or not sizes.sum():
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
        scores, spoken_for = self.words(distinct)
        totals = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), sizes)
        for i in range(len(self.langs)):
            totals[:, i] = np.bincount(owner, scores[codes, i], minlength=len(texts))
        letters = np.array([len(w) for w in distinct])
        known = np.bincount(owner, (letters * spoken_for)[codes], minlength=len(texts))
        evidence = known / np.maximum(np.bincount(owner, letters[codes], minlength=len(texts)), 1)
        totals += self.prior
        shares = np.exp(totals - totals.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return [
            (self.langs[b], float(shares[i, b]), float(evidence[i])) if sizes[i] else (UNKNOWN, 0.0, 0.0)
            for i, b in enumerate(best)
        ]


def limits(steps: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(language, size, least count, parts of ``TIES`` of those with just that count).

    Steps are (language, size, count, entries with that count).
    """
    langs = len({lang for lang, *_ in steps})
    per_table: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for lang, size, n, entries in steps:
        per_table.setdefault((lang, size), []).append((n, entries))
    found = []
    for (lang, size), counts in per_table.items():
        room = min(MAX_GRAMS, ALL_GRAMS // langs) if size else min(MAX_WORDS, ALL_WORDS // langs)
        for n, entries in sorted(counts, reverse=True):
            least, parts = n, TIES * min(room, entries) // entries
            room -= entries
            if room <= 0:
                break
        found.append((lang, size, least, parts))
    return found


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_docs: int = MAX_TRAIN_DOCS,
) -> LanguageModel:
    """Learn from labelled documents outside the held-out fold.

    The classifier is fitted on a hash sample of about ``max_docs`` of them. Each language
    keeps its own commonest ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams of each size, or an
    even share of ``ALL_WORDS`` and ``ALL_GRAMS`` where there are more than 20 languages. What
    is kept for one language is counted in all. So the model has at most ``ALL_WORDS`` and
    ``LONGEST`` times ``ALL_GRAMS`` entries, and the driver gathers no more.

    Rows without an id are a fold of their own; null texts and languages are left out,
    repeated rows count each, and an empty table gives a model that knows no language.
    """
    labelled = in_small_batches(docs).filter(
        (fold(id_column) != 0) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()
    ).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    counted = settle(
        hash_sample(labelled, "id", max_docs, seed=2)
        .select("lang", "text")
        .mapInPandas(count_batches, "lang string, size int, gram string, n bigint")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n")),
        "language-counts",
    )
    often = F.col("n") >= F.when(F.col("size") == 0, LEAST_WORD).otherwise(LEAST_GRAM)
    # How many entries have each count is little, and enough to rank all of them.
    steps = counted.filter(often).groupBy("lang", "size", "n").count().collect()
    least = docs.sparkSession.createDataFrame(
        limits([tuple(row) for row in steps]), "lang string, size int, least bigint, parts bigint"
    )
    dealt = F.pmod(F.xxhash64("gram"), F.lit(TIES))
    kept = (F.col("n") > F.col("least")) | (F.col("n") == F.col("least")) & (dealt < F.col("parts"))
    top = (
        counted.join(F.broadcast(least), ["lang", "size"], "left")
        .groupBy("size", "gram")
        .agg(F.collect_list(F.struct("lang", "n")).alias("found"), F.max(kept).alias("kept"))
        .filter("kept")
        .select("size", F.xxhash64("gram").alias("key"), "found")
    )
    per_lang = labelled.groupBy("lang").count().collect()
    return LanguageModel(top.toArrow(), {r.lang: r["count"] for r in per_lang})


def identify(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: the language and its share of the likelihood.

    A null text or one without a letter is ``und`` with score 0, and so is everything
    if nothing was learned. Between equal languages the first by name wins. A very long
    text is read whole, by itself. Repeated rows give repeated rows, a null id is kept and counts as empty text for the fold,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        known = shared.value
        for batch in batches:
            for some in in_turns(batch["text"].tolist(), CHARACTERS_AT_ONCE):
                part = batch.iloc[some]
                lang, score = zip(*known.texts(part["text"].tolist()), strict=True)
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": lang, "score": score}
                ).astype({"doc_id": "Int64"})

    return in_small_batches(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (fold(id_column) == 0).alias("held_out"),
        F.col(text_column).cast("string").alias("text"),
    ).mapInPandas(predict, SCHEMA)


def keep_identified(
    docs: DataFrame,
    model: LanguageModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: float = 0.5,
    least_evidence: float = LEAST_EVIDENCE,
) -> DataFrame:
    """Rows of ``docs`` with a language whose score is at least ``least``, columns unchanged.

    The score only compares the languages learned, so a text in a script or language of
    which next to nothing was learned could have any. At least ``least_evidence`` of its
    letters must be in words that are known or have a known n-gram of two characters.

    Null and empty texts and those without a letter go. Repeated rows stay or go alike, a
    null id doesn't matter, very long texts are read whole, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        let_go()
        found = []
        for some in in_turns(texts.tolist(), CHARACTERS_AT_ONCE):
            found += shared.value.with_evidence(texts.iloc[some].tolist())
        return pd.Series(
            [
                lang != UNKNOWN and score >= least and evidence >= least_evidence
                for lang, score, evidence in found
            ],
            dtype=bool,
        )

    return in_small_batches(docs).filter(identified(F.col(text_column).cast("string")))

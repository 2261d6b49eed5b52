"""Toxicity: gradient-boosted trees over dense text features, calibrated isotonically.

A lexicon is learned from labelled documents (words far commoner in toxic ones). Each
text becomes a short dense vector: how dense the lexicon is, how near its words stand
to second-person words, capitals, punctuation, and obfuscated spellings. Boosted trees
score the vector and isotonic regression turns their margin into a probability.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import fold, hash_sample, in_small_batches, settle

MAX_TRAIN_DOCS = 20_000  # labelled documents the classifier is fitted on
MAX_LEXICON = 20_000
LEAST_TOXIC_DOCS, LEAST_LOG_ODDS = 4, 1.5  # of a lexicon word
LEAST_RATIO = 15.1  # twice the log likelihood ratio; chance alone gives so much to one word in 10,000
NEAR = 6  # words around a lexicon word in which a second person counts as near

TOKENS = re.compile(r"[^\s.,;:?\"()|<>\[\]{}…«»]+")
#: Second-person words of the languages with the most web text.
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous "
    "votre vos usted ustedes tú tus vosotros".split()
)
#: Characters commonly written in place of letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MARKS = b"!?*#%&$@"

FEATURES = [
    "lexicon_density",
    "lexicon_weight",
    "lexicon_hits",
    "lexicon_distinct",
    "lexicon_most",
    "second_person",
    "second_person_near",
    "capitals",
    "punctuation",
    "exclamation_runs",
    "obfuscated",
    "obfuscated_lexicon",
    "log_words",
]


def tokens_of(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def plain(word: str) -> str:
    """The word with look-alikes undone and separators inside it left out."""
    return "".join(filter(str.isalpha, word.strip("!*#%&$").translate(LOOKALIKES)))


def is_obfuscated(word: str) -> bool:
    core = word.strip("!*#%&$'-")
    return len(core) > 2 and not core.isalpha() and core[:1].isalpha() and core[-1:].isalpha()


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """All zero for a null or empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    words = tokens_of(text)
    count = max(len(words), 1)
    hits: Counter = Counter()
    at, disguised, obfuscated = [], 0, 0
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    for i, word in enumerate(words):
        if word in lexicon:
            hits[word] += 1
            at.append(i)
        elif not word.isalpha():
            bare = word.strip("!*#%&$'-")
            if bare in lexicon:
                hits[bare] += 1
                at.append(i)
            elif is_obfuscated(word):
                obfuscated += 1
                if (undone := plain(word)) in lexicon:
                    disguised += 1
                    hits[undone] += 1
                    at.append(i)
    near = 0
    for i in at:
        k = bisect_left(second, i - NEAR)
        near += k < len(second) and second[k] <= i + NEAR
    raw = text.encode("utf-8", "surrogatepass")
    letters = max(len(raw) - len(raw.translate(None, LETTERS)), 1)
    total = sum(hits.values())
    return [
        total / count,
        sum(lexicon[w] * n for w, n in hits.items()) / count,
        math.log1p(total),
        math.log1p(len(hits)),
        max((lexicon[w] for w in hits), default=0.0),
        len(second) / count,
        near / max(total, 1),
        (len(raw) - len(raw.translate(None, UPPER))) / letters,
        (len(raw) - len(raw.translate(None, MARKS))) / len(raw),
        raw.count(b"!!") / count,
        obfuscated / count,
        math.log1p(disguised),
        math.log1p(len(words)),
    ]


def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and clean documents have each word, one row per word and batch."""
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen[int(toxic)].update({w for t in tokens_of(text or "") if (w := t.strip("!*#%&$'-"))})
        words = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame(
            {"word": words, "clean": [seen[0][w] for w in words], "toxic": [seen[1][w] for w in words]}
        )


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    bounds: list[float]  # of the isotonic fit: margins and their probabilities
    values: list[float]
    base_rate: float


def likelihood_ratio(share: float) -> Column:
    """Twice the log likelihood ratio of a word's toxic and clean documents against a ``share`` of toxic ones.

    It grows with the documents that have the word and asks no more of it in a larger
    sample.
    """
    both = F.col("toxic") + F.col("clean")

    def part(times: Column, of: float) -> Column:
        return F.when(times > 0, times * F.log(times / (both * max(of, 1e-9)))).otherwise(0.0)

    return 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """Columns named in ``keep`` (a schema) and the features of column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [part.split()[0] for part in keep.split(", ")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features_of(text, shared.value) for text in batch["text"]]
            values = np.array(rows, dtype=float).reshape(len(batch), len(FEATURES))
            out = pd.DataFrame(values, columns=FEATURES)
            for name in reversed(kept):
                kind = "Int64" if name == "doc_id" else batch[name].dtype
                out.insert(0, name, batch[name].astype(kind).to_numpy())
            yield out

    return docs.mapInPandas(measure, keep + "".join(f", {name} double" for name in FEATURES))


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def with_margin(df: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    raw = trees.transform(assembled(df))
    return raw.withColumn("margin", vector_to_array("rawPrediction")[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_docs: int = MAX_TRAIN_DOCS,
) -> ToxicityModel:
    """Fit on a hash sample of about ``max_docs`` labelled documents outside the held-out fold.

    Several labels of one document count as toxic if any is; null labels and labels of
    unknown documents are left out. Two folds of the sample give the lexicon and the
    trees, a third the calibration. Without labels of both kinds the model gives every
    text the share of toxic labels there is, 0 without any.
    """
    ids = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (fold(id_column) != 0))
        .groupBy(F.col(id_column).cast("bigint").alias("id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    )
    texts = in_small_batches(docs).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    # The sample's size is bounded by max_docs, so its ids and labels can be broadcast.
    sample = settle(
        texts.join(F.broadcast(hash_sample(ids, "id", max_docs, seed=1)), "id").withColumn(
            "part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)).cast("int")
        ),
        "toxicity-sample",
    )
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    total = sum(kinds.values())
    base_rate = kinds.get(1, 0) / total if total else 0.0
    if len(kinds) < 2:
        return ToxicityModel({}, None, [], [], base_rate)
    fit_docs = sample.filter("part < 2")
    sizes = {r.toxic: r["count"] for r in fit_docs.groupBy("toxic").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1.0)) - F.log(
        (F.col("clean") + 0.5) / (sizes.get(0, 0) + 1.0)
    )
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    words = (
        fit_docs.select("text", "toxic")
        .mapInPandas(word_counts, "word string, clean bigint, toxic bigint")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= LEAST_TOXIC_DOCS) & (likelihood_ratio(share) >= LEAST_RATIO))
        .select("word", odds.alias("weight"), F.col("toxic").alias("n"))
        .filter(F.col("weight") >= LEAST_LOG_ODDS)
        .orderBy((F.col("weight") * F.sqrt("n")).desc(), "word")
        .limit(MAX_LEXICON)
    )
    lexicon = {r.word: r.weight for r in words.collect()}
    measured = settle(
        with_features(sample.select("part", "toxic", "text"), lexicon, "part int, toxic int"),
        "toxicity-features",
    )
    fit_rows = assembled(measured.filter("part < 2")).select("features", F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=1, maxMemoryInMB=128).fit(
        fit_rows.coalesce(4)
    )
    held = with_margin(measured.filter("part = 2"), trees).select(
        F.col("toxic").cast("double").alias("label"), "margin"
    )
    if not held.head(1):
        held = with_margin(measured, trees).select(F.col("toxic").cast("double").alias("label"), "margin")
    curve = IsotonicRegression(featuresCol="margin").fit(held)
    return ToxicityModel(
        lexicon, trees, curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist(), base_rate
    )


def score(
    docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: the calibrated probability that the text is toxic.

    The score is the isotonic curve at the trees' margin, straight between its corners;
    texts whose margins lie in a flat stretch of it tie. A null or empty text is scored
    from features that are all zero, a very long one is read whole, by itself. Repeated
    rows give repeated rows, a null id is kept and counts as empty text for the fold,
    other columns are ignored, an empty table gives an empty result.
    """
    rows = in_small_batches(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (fold(id_column) == 0).alias("held_out"),
        F.col(text_column).cast("string").alias("text"),
    )
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(float(model.base_rate)))
    else:
        margins = with_margin(
            with_features(rows, model.lexicon, "doc_id bigint, held_out boolean"), model.trees
        )
        bounds, values = model.bounds, model.values

        @F.pandas_udf("double")
        def calibrated(margin: pd.Series) -> pd.Series:
            return pd.Series(np.interp(margin, bounds, values))

        scored = margins.withColumn("score", calibrated("margin"))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

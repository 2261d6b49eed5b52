"""Importance resampling against brute force; ``test_queries`` has the query against SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tarnwell.llm import resampling

DOCS = "doc_id bigint, text string, weight string, `row` int, part string, rank int"


def table(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "w", 1, "p", 2) for i, t in rows], DOCS)


def features(text, longest, buckets):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run) % buckets for run in runs]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    found = [(d, *features(t, longest, buckets)) for d, t in rows]
    s = Counter(b for _, _, own in found for b in own)
    t = Counter(b for _, text in target for b in features(text, longest, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, words, own in found:
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own
        ]
        name = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def rows_of(seed, count=200):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["w", "Word", "über", "x1", "é"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(count)]
    rows += [(count, None), (count + 1, ""), (count + 2, "word " * 30_000), (None, text(40)), (None, None)]
    return rows + [rows[-4]] * 3 + [(7, text(50))] * 2, [(i, text(80)) for i in range(5)] + [(9, None), (10, "")]


@pytest.mark.parametrize(
    ("longest", "buckets", "percent", "pivots"),
    [(1, 10_000, 10, 31), (1, 10_000, 100, 1), (2, 97, 37, 2), (3, 1, 50, 5)],
)
def test_rows_equal_brute_force(spark, monkeypatch, longest, buckets, percent, pivots):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    monkeypatch.setattr(resampling, "RANKED_TOGETHER", 9)
    monkeypatch.setattr(resampling, "CACHED", 50)
    rows, target = rows_of(percent)
    found = resampling.draw(table(spark, rows), table(spark, target), longest=longest, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = brute(rows, target, longest, buckets, percent=percent)
    assert Counter(map(tuple, found.collect())) == expected
    assert any(r[4] for r in expected)


def test_every_kth_key_is_found(spark):
    rng = random.Random(13)
    rows = [(-rng.randrange(4), i % 3 == 0, None if i % 3 == 0 else rng.randrange(3), i) for i in range(60)]
    keys = spark.createDataFrame(rows, "neg bigint, no_id boolean, doc_id bigint, `row` bigint")
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
    for k in (1, 2, 30, 59, 60):
        assert resampling.kth_key(keys, k) == order[k - 1]


def test_nothing_to_draw(spark):
    rows, target = rows_of(1, 10)
    empty = table(spark, []).limit(0)
    assert resampling.draw(empty, table(spark, target)).collect() == []
    short = [r for r in rows if len((r[1] or "").split()) < 15]
    for against in (target, []):
        found = resampling.draw(table(spark, short), table(spark, against) if against else empty).collect()
        assert Counter(map(tuple, found)) == brute(short, against)
        assert all(r["rank"] is None for r in found)

"""Removal of repeated strings against a table of all strings."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tarnwell.llm import common, suffix_dedup

DOCS = "doc_id bigint, text string, doc string, `at` int, gram string, k1 string, spans int"


def table(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "d", 1, "g", "k", 2) for i, t in rows], DOCS)


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(x[i : i + width] for x in texts for i in range(len(x) - width + 1))
    out = Counter()
    for (doc_id, _), x in zip(rows, texts, strict=True):
        gone = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - width + 1):
            if times[x[i : i + width]] > 1:
                gone[i : i + width] = True
        begins = np.flatnonzero(np.diff(gone.astype(int), prepend=0) == 1)
        ends = np.flatnonzero(np.diff(gone.astype(int), prepend=0) == -1)
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out[doc_id, len(x), tuple(zip(begins.tolist(), ends.tolist(), strict=True)), kept] += 1
    return out


def rows_of(seed, width):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choices("abcde é", k=n))
    shared = [fresh(n) for n in (width - 1, width, width + 1, 2 * width, 5 * width)]
    rows = [(i, fresh(rng.randrange(3)) * 1 + fresh(rng.randrange(6 * width))) for i in range(25)]
    for i in range(25, 70):
        parts = [fresh(rng.randrange(width)) for _ in range(3)]
        passage = rng.choice(shared)
        if rng.random() < 0.4:  # a near copy: a letter changed somewhere
            at = rng.randrange(len(passage))
            passage = passage[:at] + "Z" + passage[at + 1 :]
        parts.insert(rng.randrange(4), passage)
        if rng.random() < 0.2:
            parts.append(rng.choice(shared))  # twice in one text
        rows.append((i, "".join(parts)))
    rows += [(70, "a" * 3 * width), (71, "ab" * 2 * width), (72, "a" * width), (73, None), (74, ""), (75, "short")]
    rows += [rows[30], rows[30], (None, rows[31][1]), (None, fresh(3 * width)), (5, shared[3])]
    return rows


@pytest.mark.parametrize(
    ("seed", "width", "gram", "start", "bits", "parts"),
    [
        (0, 24, 6, 6, 1 << 24, (4,)),
        (1, 24, 6, 5, 1 << 10, (32, 8)),
        (2, 40, 40, 10, 64, (8, 2)),
        (3, 17, 1, 17, 1 << 24, ()),
        (4, 24, 10, 40, 1 << 24, (16, 4, 1)),
    ],
)
def test_rows_equal_brute_force(spark, monkeypatch, seed, width, gram, start, bits, parts):
    monkeypatch.setattr(suffix_dedup, "BITS", bits)
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    if seed % 2:
        monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rows = rows_of(seed, width)
    found = suffix_dedup.dedup(table(spark, rows), width=width, gram=gram, start=start).collect()
    got = Counter((r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.removed), bytes(r.kept)) for r in found)
    expected = brute(rows, width)
    assert got == expected
    assert sum(len(r[2]) for r in expected) > 20


def test_equal_keys_over_many_parts_are_one_group(spark, settings):
    settings("spark.sql.shuffle.partitions", "7")
    settings("spark.sql.adaptive.enabled", "false")
    rng = random.Random(5)
    keys = [rng.choice([(1, 1), (1, 2), (5, 0), (9, rng.randrange(50))]) for _ in range(300)]
    rows = spark.createDataFrame([(i, 0, i, *k) for i, k in enumerate(keys)], "doc bigint, text_key bigint, `at` bigint, k1 bigint, k2 bigint")
    found = suffix_dedup.ranked(rows, "test").collect()
    times, order = Counter(keys), sorted(keys)
    assert len(found) == len(keys)
    for r in found:
        assert r["rank"] == order.index(keys[r.doc])
        assert r.alone == (times[keys[r.doc]] == 1)
    assert Counter(r["rank"] for r in found if r["head"]) == Counter({order.index(k): 1 for k in times})


@pytest.mark.parametrize(("width", "start"), [(200, 50), (200, 200), (200, 30), (7, 1), (5, 9)])
def test_lengths_double_up_to_the_width(width, start):
    steps = suffix_dedup.lengths(width, start)
    assert steps[-1] == width and all(a < b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_the_least_gram_is_that_of_each_string():
    rng = np.random.default_rng(1)
    for width, gram in ((9, 3), (20, 20), (30, 1)):
        sampler = suffix_dedup.Sampler(width, gram)
        data = rng.integers(0, 3, 500).astype(np.uint8)
        hashes = sampler.hashes(data)
        texts = [data[i : i + gram].tobytes() for i in range(len(data) - gram + 1)]
        assert len(set(zip(texts, hashes.tolist(), strict=True))) == len(set(texts)) == len(set(hashes.tolist()))
        short = hashes >> np.uint64(suffix_dedup.PIECE.bit_length())
        windows = np.lib.stride_tricks.sliding_window_view(short, width - gram + 1)
        assert (sampler.least(hashes) == windows.argmin(axis=1) + np.arange(len(windows))).all()


def test_short_texts_are_looked_at_together_and_keep_their_own_stretches(monkeypatch):
    rng, width, gram, calls = random.Random(8), 12, 4, []
    least = suffix_dedup.Sampler.least
    monkeypatch.setattr(suffix_dedup.Sampler, "least", lambda self, hashes: calls.append(len(hashes)) or least(self, hashes))
    texts = ["".join(rng.choices("abé", k=rng.randrange(width, 6 * width))) for _ in range(60)] + ["a" * width, "b" * 900]
    batch = pd.DataFrame({"doc": range(62), "text_key": range(100, 162), "text": texts})
    (found,) = suffix_dedup.stretches_of(width, gram)(iter([batch]))
    assert len(calls) == 1
    alone = [frame for i in range(62) for frame in suffix_dedup.stretches_of(width, gram)(iter([batch[i : i + 1]]))]
    pd.testing.assert_frame_equal(found, pd.concat(alone, ignore_index=True))
    for doc, rows in found.groupby("doc"):
        places = [p for at, n in zip(rows["at"], rows["count"], strict=True) for p in range(at, at + n)]
        assert places == list(range(len(texts[doc].encode()) - width + 1))
    asked = found.groupby(["doc", "text_key"])[["at", "count", "reach", "known"]].agg(list).map(np.array).reset_index()
    (content,) = suffix_dedup.with_content(width)(iter([asked.assign(text=texts)]))
    for r in content.itertuples():
        assert r.content == texts[r.doc].encode()[r.at : r.at + r.count - 1 + width]
    pd.testing.assert_frame_equal(content.drop(columns="content"), found.drop(columns=["core", "k2"]))


def test_parts_have_every_string_once_and_a_core_that_all_share():
    rng = random.Random(6)
    for _ in range(300):
        width, size = rng.randrange(9, 60), rng.choice([1, 2, 4, 8])
        count, reach = rng.randrange(1, width), 0
        reach = rng.randrange(count - 1, width)
        content = bytes(rng.randrange(256) for _ in range(count - 1 + width))
        row = pd.DataFrame([(1, 2, 100, count, reach, False, content)], columns=["doc", "text_key", "at", "count", "reach", "known", "content"])
        (parts,) = suffix_dedup.parts_of(width, size)(iter([row]))
        places = [p for at, n in zip(parts["at"], parts["count"], strict=True) for p in range(at, at + n)]
        assert sorted(places) == list(range(100, 100 + count))
        for r in parts.itertuples():
            assert r.content == content[r.at - 100 : r.at - 100 + r.count - 1 + width]
            assert 100 + reach - r.at == r.reach and r.count <= size


def test_nothing_to_remove(spark):
    empty = table(spark, []).limit(0)
    assert suffix_dedup.dedup(empty).collect() == []
    (row,) = suffix_dedup.dedup(table(spark, [(1, "x" * 199)])).collect()
    assert (row.n_bytes, row.removed, bytes(row.kept)) == (199, [], b"x" * 199)
    with pytest.raises(ValueError):
        suffix_dedup.dedup(empty, width=10, gram=11)


def test_only_the_spans_stay_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "scratch", lambda spark: f"file://{tmp_path}")
    rows = rows_of(7, 24)
    done = suffix_dedup.dedup(table(spark, rows), width=24, gram=6, start=6)
    full = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if spark.read.parquet(str(p)).count()]
    assert full == ["spans"]
    assert len(done.collect()) == len(rows)  # and nothing else is read


def test_tables_go_one_by_one(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "scratch", lambda spark: f"file://{tmp_path}/")
    tables = common.Tables()
    a, b = tables.settle(spark.range(1000), "a"), tables.settle(spark.range(5), "b")
    with pytest.raises(ValueError):
        tables.settle(b, "a")
    tables.drop("a")
    assert b.count() == 5 and sorted(tables.paths) == ["b"]
    assert {p.name[0]: spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()} == {"a": 0, "b": 5}


def test_settled_tables_leave_no_shuffle_files(spark, settings):
    settings(common.CLEAN_SHUFFLES, "false")
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p for p in local.rglob("shuffle_*") if p.exists()}
    before = files()
    found = common.Tables().settle(spark.range(200_000).repartition(3, "id"), "shuffled")
    assert found.count() == 200_000
    assert not [p for p in files() - before if p.stat().st_size > 2000]
    assert spark.conf.get(common.CLEAN_SHUFFLES) == "false"


def test_bitmaps_grow_with_their_keys_within_bounds():
    bits = [suffix_dedup.roomy(count) for count in (0, 1 << 21, (1 << 21) + 1, 1 << 23, 1 << 40)]
    assert bits == [1 << 24, 1 << 24, 1 << 25, 1 << 26, 1 << 26]

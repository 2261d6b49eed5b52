"""Decontamination, top-k, language-model scoring, Jaccard join, token store and packing."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from tarnwell.llm import (
    common,
    components,
    decontamination,
    jaccard_join,
    language_id,
    packing,
    ppm,
    secret_scan,
    token_store,
    voronoi_topk,
)
from tarnwell.llm.voronoi_topk import top_k

DOCS = "doc_id bigint, text string, size int, `key` string"


def table(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, 7, "k") for i, t in rows], DOCS)


def words_of(rng, size, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(size)]


# Decontamination -----------------------------------------------------------------------


def test_every_window_with_two_changed_words_has_a_seed():
    width, allowed = decontamination.WINDOW, decontamination.WINDOW - decontamination.SAME
    for changed in combinations(range(width), allowed):
        assert any(
            not any(start + offset in changed for offset in mask)
            for mask in decontamination.MASKS
            for start in range(width - mask[-1])
        )


def test_every_short_item_with_as_many_changed_words_as_may_be_has_a_seed():
    for size in range(1, decontamination.WINDOW):
        allowed = size - -(-8 * size // 10)
        masks = decontamination.short_masks(size)
        assert all(list(mask) == sorted(mask) and set(mask) <= set(range(size)) for mask in masks)
        for count in range(allowed + 1):
            for changed in combinations(range(size), count):
                assert any(not set(mask) & set(changed) for mask in masks)


def brute_overlaps(docs, items):
    return {(d, i) for d, i, *_ in brute_overlap_rows(docs, items)}


def brute_overlap_rows(docs, items):
    """Rows of each document and item: first and last seed in a contaminated window, seeds, best share."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rows = {}
    for (doc, text), times in Counter(docs).items():
        a = words(text)
        for item, item_text in items:
            b = words(item_text)
            width = min(len(b), decontamination.WINDOW)
            short = len(b) < decontamination.WINDOW
            masks = decontamination.short_masks(width) if short and b else decontamination.MASKS
            seeds, best = set(), 0
            out = 0 if short else 2  # as many words of a window may be outside as may differ
            for i in range(-out, len(a) - width + out + 1) if b else ():
                for j in range(-out, len(b) - width + out + 1):
                    same = [0 <= i + k < len(a) and 0 <= j + k < len(b) and a[i + k] == b[j + k] for k in range(width)]
                    if 10 * sum(same) < 8 * width:
                        continue
                    best = max(best, sum(same) / width)
                    for number, mask in enumerate(masks):
                        for k in range(1 if short else width - mask[-1]):
                            if all(same[k + offset] for offset in mask):
                                seeds.add((i + k, j + k, number))
            if best:
                at = [x for x, _, _ in seeds]
                rows.setdefault((doc, text, item), set()).add((min(at), max(at), times * len(seeds), best))
    return {(d, i, *found) for (d, _, i), each in rows.items() for found in each}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words_of(rng, size))) for i, size in enumerate([13, 14, 30, 50, 5, 1, 12, 8, 9, 10, 11, 3])]
    items += [(17, None), (18, ""), (19, items[2][1]), (2, items[2][1])]
    docs = []
    for i in range(160):
        words = words_of(rng, rng.randint(0, 60), 5000)
        passage = rng.choice(items)[1]
        if i % 2 and passage:
            passage = passage.split()
            begin = rng.randrange(max(1, len(passage) - 15))
            passage = passage[begin : begin + rng.randint(10, 30)]
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, ", ".join(words).title()))
    for i, (_, text) in enumerate(items[4:12]):  # each word of a short item changed in turn
        words = text.split()
        docs += [(200 + 20 * i + k, f"before {' '.join([*words[:k], 'other', *words[k + 1 :]])} after") for k in range(len(words))]
    cut = [text.split() for _, text in items[:4]]
    docs += [(400 + i, " ".join(w[:11])) for i, w in enumerate(cut)] + [(410 + i, " ".join(w[-11:])) for i, w in enumerate(cut)]
    docs += [(420 + i, " ".join(w[:10])) for i, w in enumerate(cut)]
    docs += [(120, None), (121, ""), (122, items[2][1].upper()), (122, items[2][1].upper()), (None, items[3][1])]
    docs.append((123, "x " * 1_500 + items[3][1]))
    rows = decontamination.find_overlaps(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = [(r.doc_id, r.item_id, r.first_word, r.last_word, r.seeds, r.best) for r in rows]
    assert set(found) == brute_overlap_rows(docs, items)
    assert len(found) == len(set(found)) and len(found) > 20
    # One changed word in an item of 8 to 12 words is found wherever it is.
    hits = {(d, i) for d, i, *_ in found}
    short = [(i, k) for i, (_, text) in enumerate(items[4:12]) if 8 <= len(text.split()) for k in range(len(text.split()))]
    assert len(short) == 50 and all((200 + 20 * i + k, 4 + i) in hits for i, k in short)


def test_contaminated_rows_go_and_columns_stay(spark):
    rng = random.Random(2)
    item = " ".join(words_of(rng, 20))
    docs = table(spark, [(1, "clean text"), (2, f"so {item} it"), (2, "clean too"), (3, None), (None, item), (None, "c")])
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.schema == docs.schema
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, "clean text"), (2, "clean too"), (3, None), (None, "c")]
    )
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == 6
    assert decontamination.drop_contaminated(docs.limit(0), items).count() == 0


# Top-k ---------------------------------------------------------------------------------


def brute_top(rows, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(float(np.float32(x)) * 1024) for x in v]))
    best = {}
    for q, v in whole:
        if q % 10:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)
        best[q] = [(r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores[:k], 1)]
    return best


@pytest.mark.parametrize("case", ["plain", "ties", "odd", "large", "few"])
def test_top_k_equals_brute_force(spark, case):
    rng = random.Random(case)
    n = 4 if case == "few" else 700
    scale = 1e15 if case == "large" else 1.0
    rows = [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in range(n)]
    if case == "ties":
        rows = [(i, [1.0, 0.5] if i % 3 == 0 else [float(rng.randrange(3)), 1.0]) for i in range(n)]
    if case == "odd":
        rows += [(700, None), (701, [1.0, None]), (702, [math.nan]), (703, [math.inf]), (704, []), (710, [2.0]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cell int, score string")
    found = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 10 == 0, k=5).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in found.items()} == brute_top(rows, 5)


def test_blocks_hold_neighbouring_pivots_and_no_more_queries_than_they_may(monkeypatch):
    monkeypatch.setattr(voronoi_topk, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(2)
    for _ in range(50):
        pivots = rng.normal(size=(rng.integers(1, 40), 3))
        counts = rng.integers(0, 14, len(pivots)) * rng.integers(0, 3, len(pivots))
        first, number = voronoi_topk.blocks_of(counts, pivots)
        held = Counter()
        for count, block, blocks in zip(counts.tolist(), first, number, strict=True):
            assert blocks == max(1, -(-count // 10))
            for i in range(blocks):
                held[block + i] += count / blocks
        assert max(held.values()) <= 10
    line = np.arange(20.0)[:, None]
    first, _ = voronoi_topk.blocks_of(np.full(20, 3), line)
    assert first == sorted(first) and max(Counter(first).values()) == 3


def test_groups_are_cut_into_chunks_of_like_size_however_rows_repeat(spark):
    rows = [(i % 3, [1], 0, i) for i in range(900)] + [(9, [2], 1, 1000 + i) for i in range(20)]
    grouped = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>, cell int, `row` bigint")
    sizes = voronoi_topk.chunked(grouped, [9, 1]).groupBy("cell", "chunk").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("case", ["plain", "ties"])
def test_top_k_of_many_chunks_and_blocks_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(voronoi_topk, "CHUNK_ROWS", 20)
    monkeypatch.setattr(voronoi_topk, "QUERY_BLOCK", 7)
    rng = random.Random(case)
    rows = [(i, [rng.gauss(0, 1) + 8 * (i % 5 == k) for k in range(5)]) for i in range(600)]
    if case == "ties":
        rows = [(i, [float(rng.randrange(3)), 1.0]) for i in range(600)] + [(7, [1.0, 1.0])] * 90
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 10 == 0, k=5).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in found.items()} == brute_top(rows, 5)


def test_rows_go_to_the_blocks_that_asked_for_them_and_to_no_others(spark, monkeypatch):
    monkeypatch.setattr(voronoi_topk, "QUERY_BLOCK", 30)
    settled, settle = {}, voronoi_topk.settle
    monkeypatch.setattr(voronoi_topk, "settle", lambda df, name: settled.setdefault(name, settle(df, name)))
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.1) + 9 * (i // 10 % 5 == k) for k in range(5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    result = top_k(df, F.col("vec_id") % 10 == 0, k=5)
    assert result.count() == 5 * 150
    asked = settled["sent"].select("cell", "chunk", "block").distinct()
    blocks, cells = asked.select("block").distinct().count(), asked.select("cell", "chunk").distinct().count()
    assert blocks >= 5 and asked.count() < blocks * cells / 2  # far groups don't get each other's rows
    plan = result._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 10 == 0).collect() == []


# Language model ------------------------------------------------------------------------


def brute_scores(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda b: re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)) + [None]
    contexts, words, k = defaultdict(Counter), Counter(), ppm.ORDER
    padded = lambda b: bytes([255]) * k + b + b"\xff"
    for d, b in rows:
        if not held(d):
            words.update(tokens(b))
            s = padded(b)
            for i in range(k, len(s)):
                for n in range(k + 1):
                    contexts[s[i - n : i]][s[i]] += 1
    total, distinct, out = sum(words.values()), len(words), []
    for d, b in rows:
        s, score = padded(b), 0.0
        for i in range(k, len(s)):
            excluded = set()
            for n in range(k, -1, -1):
                seen = contexts.get(s[i - n : i])
                if not seen:
                    continue
                left = {x: c for x, c in seen.items() if x not in excluded}
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    score += math.log10(left[s[i]] / whole)
                    break
                score += math.log10(len(left) / whole) if left else 0.0
                excluded |= set(seen)
            else:
                score -= math.log10(256 - len(excluded))
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(b))
        known = sum(words[w] > 0 for w in tokens(b))
        out.append((d, held(d), len(tokens(b)), known, total, base, score))
    return out


@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_scores_equal_brute_force(spark, block_bytes):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab  cdé.\nA", k=rng.randint(0, 80)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "zz Ünknown \0 words"), (5, rows[5][1]), (62, "only once seen ñ" * 300)]
    found = ppm.score(table(spark, rows), block_bytes=block_bytes).collect()
    expected = brute_scores([(d, (t or "").encode()) for d, t in rows])
    key = lambda r: (r[0] is None, r[0], r[2])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)


def test_scoring_with_nothing_to_learn(spark):
    assert ppm.score(table(spark, []).limit(0)).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = ppm.score(table(spark, [(only_held, "abc")])).collect()
    assert row.score == pytest.approx(4 * math.log10(1 / 256))
    assert (row.train_tokens, row.n_tokens, row.n_known) == (0, 2, 0)


def test_words_are_hashed_together_and_only_long_ones_one_by_one(monkeypatch):
    hashed, own = [], ppm.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ppm.xxhash, "xxh3_64_intdigest", lambda word: hashed.append(word) or own(word))
    texts = [
        b"", b" ", b"One two\x1cthree\x0b\x0cONE", "\u00a0\u00e9t\u00e9 \u00c9T\u00c9 \u65e5\u672c".encode(), b"\t\n\r one  ",
        b"a a\0 a\0\0 \0 \0\0", b"abcdefgh abcdefghi abcdefgi hgfedcba " + b" ".join(b"x" * n for n in range(1, 80)),
        b"x" * 70 + b"\n" + b"X" * 70 + b" " + b"x" * 69 + b"y", b"one", b"12345678" * 8, b"12345678" * 8 + b"9", b"\x85 \xff",
    ]
    keys, sizes = ppm.word_keys(texts)
    words = [[*t.lower().split(), None] for t in texts]  # None: the end
    assert sizes.tolist() == [len(w) for w in words]
    known = {}
    for key, word in zip(keys.tolist(), [w for text in words for w in text], strict=True):
        assert known.setdefault(word, key) == key
    assert known[None] == ppm.END_WORD and len(set(known.values())) == len(known)
    assert hashed and all(len(word) > ppm.LONG for word in hashed)
    rng = np.random.default_rng(3)
    many = [bytes(rng.choice(list(b"ab \n"), n).tolist()) for n in rng.integers(0, 60, 300)]
    split = [t.split() for t in many]
    keys, sizes = ppm.word_keys(many)
    assert sizes.tolist() == [len(w) + 1 for w in split]
    words = [w for text in split for w in [*text, None]]
    assert len(set(zip(keys.tolist(), words, strict=True))) == len(set(keys.tolist())) == len(set(words))


def test_counts_of_keys_are_merged():
    keys = np.random.default_rng(1).integers(-50, 50, 1000)
    assert ppm.distinct(keys).tolist() == sorted(set(keys.tolist()))
    found, numbers = ppm.merged([ppm.counted(keys[:400]), ppm.counted(keys[400:]), ppm.counted(keys[:0])])
    assert dict(zip(found.tolist(), numbers.tolist(), strict=True)) == Counter(keys.tolist())


def test_parts_of_a_long_text_add_up():
    text = ("héllo wörld " * 400_000).encode()
    codes = ppm.windows([text, b"", b"x"])
    assert len(codes) == len(text) + 1 + 1 + 2


# Jaccard join --------------------------------------------------------------------------


def brute_links(rows, percent=85, width=4):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows))


def jaccard_rows(seed, near=40):
    rng = random.Random(seed)
    texts = []
    for size in [*range(1, 30), 60, 120, 300]:
        base = words_of(rng, size)
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(9))
            if rng.random() < 0.4:
                words = words[: -rng.randint(1, 1 + size // 12)] or words
            texts.append(" ".join(words))
    base = words_of(rng, 150)
    for _ in range(near):  # many near copies of one text, linked or nearly so
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"z{rng.randrange(50)}"
        texts.append("\t".join(words).upper())
    texts += [texts[100]] * 12 + [None, "", " \n", "x " * 20_000]
    rng.shuffle(texts)
    return [*enumerate(texts), (3, texts[3]), (None, texts[10]), (None, "alone one two three four")]


@pytest.mark.parametrize(
    ("long_list", "small", "percent", "width", "cells"),
    [
        (64, None, 85, 4, None),
        (6, None, 85, 4, 1),  # an order that knows nothing
        (3, 0, 85, 4, 64),
        (6, None, 80, 5, None),
        (2, 0, 60, 2, 1),
    ],
)
def test_links_equal_brute_force(spark, monkeypatch, long_list, small, percent, width, cells):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4 if cells == 1 else 16)
    if cells:
        monkeypatch.setattr(jaccard_join, "CELLS", cells)
        monkeypatch.setattr(jaccard_join, "CELLS_IN_ROW", cells)
    if small is not None:
        monkeypatch.setattr(jaccard_join, "MOST_SMALL", small)
    rows = jaccard_rows(3)
    found = jaccard_join.link(table(spark, rows), percent=percent, width=width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.links) for r in found) == brute_links(rows, percent, width)


@pytest.mark.parametrize("percent", [60, 80, 85, 99])
def test_linked_sets_meet_in_as_many_lists_as_counted_on(spark, percent):
    sizes = [(a, b) for a in range(1, 120) for b in range(a, 100 * a // percent + 1)]
    rows = spark.createDataFrame(sizes, "a int, b int").select(
        "a",
        "b",
        jaccard_join.list_overlap(F.col("a"), F.col("b"), percent).alias("meet"),
        *(jaccard_join.least_overlap(F.col(c), percent).alias(f"least_{c}") for c in "ab"),
        jaccard_join.listed(F.col("a"), percent).alias("listed"),
    )
    for r in rows.collect():
        share = jaccard_join.overlap(r.a, r.b, percent)
        if share > r.a:
            continue  # these can't link
        prefixes = [jaccard_join.prefix_size(x, percent) for x in (r.a, r.b)]
        assert r.listed == prefixes[0]
        assert 1 <= r.meet == min(share - x + p for x, p in zip((r.a, r.b), prefixes, strict=True))
        assert max(r.least_a, r.least_b) <= r.meet


def test_common_phrases_make_no_clusters_of_unrelated_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1 << 10)  # every cell has many elements
    monkeypatch.setattr(jaccard_join, "CELLS_IN_ROW", 1 << 10)
    seen = []
    compared = jaccard_join.compared_in_blocks
    monkeypatch.setattr(jaccard_join, "compared_in_blocks", lambda clusters, *rest: (seen.append(clusters.groupBy("cluster").count().collect()), compared(clusters, *rest))[1])
    rng = random.Random(21)
    phrases = [" ".join(words_of(rng, 12, 10**6)) for _ in range(50)]
    texts = []
    for _ in range(1200):
        parts = [*rng.sample(phrases, 4), *(" ".join(words_of(rng, 15, 10**7)) for _ in range(5))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    base = words_of(rng, 80, 10**6)
    for _ in range(100):  # a real group of near copies
        words = list(base)
        words[rng.randrange(80)] = f"z{rng.randrange(90)}"
        texts.append(" ".join(words))
    found = jaccard_join.link(table(spark, list(enumerate(texts)))).collect()
    assert all(r.component_id == r.doc_id and r.links == 0 for r in found if r.doc_id < 1200)
    assert sum(r.links > 0 for r in found) > 90
    assert max([r["count"] for rows in seen for r in rows], default=0) <= 100


def test_only_blocks_of_like_sizes_are_compared(spark):
    members = [(i, size) for i, size in enumerate([10] * 5 + [11] * 5 + [14] * 5 + [100] * 5 + [117] * 5)]
    sets = spark.createDataFrame([(i, n, 1, list(range(n))) for i, n in members], "cid bigint, size int, weight bigint, tokens array<bigint>")
    clusters = spark.createDataFrame([(i, 0) for i, _ in members], "cid bigint, cluster bigint")
    links = jaccard_join.compared_in_blocks(clusters, sets, 85).filter("links > 0").groupBy("a").agg(F.sum("links")).collect()
    expected = {i: sum(100 * min(n, m) >= 85 * max(n, m) for j, m in members if j != i) for i, n in members}
    assert dict(map(tuple, links)) == expected


def test_a_set_is_made_once_however_often_its_row_is_repeated(spark, monkeypatch):
    made = []
    settle = jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df, name: (made.append((name, out := settle(df, name))), out)[1])
    rng = random.Random(22)
    base = words_of(rng, 60)
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base))] * 300 + [(2, " ".join(near))] * 300
    found = jaccard_join.link(table(spark, rows)).collect()
    assert {(r.doc_id, r.component_id, r.links) for r in found} == {(1, 1, 599), (2, 1, 599)}
    assert [df.count() for name, df in made if name == "tokens"] == [2]


def test_one_row_of_each_component_stays(spark):
    rows = jaccard_rows(4, near=10)
    docs = table(spark, rows)
    kept = jaccard_join.keep_first(docs)
    assert kept.schema == docs.schema
    expected = Counter(d for (d, n, c, _) in brute_links(rows).elements() if d is None or n == 0 or d == c)
    found = Counter(r.doc_id for r in kept.collect())
    assert found.pop(3) == 1 and expected.pop(3) == 2  # the repeated row
    assert found == expected - Counter([None])  # of the two without an id one is a copy


def test_joins_of_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert jaccard_join.link(empty).collect() == []
    assert jaccard_join.keep_first(empty).collect() == []
    nothing = table(spark, [(1, None), (2, "")])
    assert sorted(map(tuple, jaccard_join.link(nothing).select("doc_id", "n_shingles", "component_id", "links").collect())) == [
        (1, 0, 1, 0),
        (2, 0, 2, 0),
    ]


@pytest.mark.parametrize("part", [500_000, 10])
@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    expected = {x: x for e in edges for x in e}
    for _ in expected:
        for a, b in edges:
            expected[a] = expected[b] = min(expected[a], expected[b])
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {x: r for x, r in expected.items() if any(x in e and e[0] != e[1] for e in edges)}


# Token store ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TEXTS = [
    "The quick, brown fox... it's WE'LL don't a...b !!x",
    "Été Å. x y \x1c z1 café! J̌ T̈ ẞ ΑΣ. İ, ǅ",
    "<|endoftext|> <|EndOfText|> «guillemets», ¿qué? ½ ² 漢字。",
    "  \n\t ",
    "",
    None,
    "a" * 5000,
]


def test_ids_equal_the_tokenizers_own(tokenizer_path):
    rng = random.Random(8)
    marks = [".", ",", "!?", "...", "'s", "é", " ", " ", "\n", "A", "b", "1", "_", "»", "́", "<|"]
    texts = TEXTS + ["".join(rng.choices(marks + ["the", "Fox", "über"], k=30)) for _ in range(300)]
    encoder = token_store.WordEncoder(tokenizer_path)
    for _ in range(2):  # the second time all words are known
        ids, sizes = encoder.encode(texts)
        expected = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert sizes.tolist() == list(map(len, expected))
        assert ids.tolist() == [i for x in expected for i in x]


def test_ids_of_plain_words_are_asked_of_the_model_alone_and_once_a_worker(monkeypatch, tokenizer_path):
    own = Tokenizer.from_file(tokenizer_path)
    letters = [chr(c) for c in range(1, 0x300)]
    odd = [f"{c} a{c} {c}b, x{c}y\u0301 {c}" for c in letters] + ["ȺȾ İI ẞ Ⱥ\u0301 ÉTÉ ÉTÉ,", "\x0b a\x0c\r", " , b", "b b,b b"]
    expected = [own.encode(t, add_special_tokens=False).ids + [1] for t in odd]
    encoder = token_store.WordEncoder(tokenizer_path)
    for texts, ids_of in ((odd, expected), (odd[::-1], expected[::-1]), ([], [])):
        ids, sizes = encoder.encode(texts)
        assert sizes.tolist() == list(map(len, ids_of))
        assert ids.tolist() == [i for x in ids_of for i in x]

    monkeypatch.setattr(token_store, "CACHED_WORDS", 0)  # all words are older ones after each call
    plain = ["Latin cétait lètters ÉTÉ plainly", None, " again  plainly "]
    expected = [i for t in plain for i in own.encode(t or "", add_special_tokens=False).ids + [1]]
    asked = []
    monkeypatch.setattr(encoder, "learn_each", asked.extend)
    encoder.tokenizer = None
    assert encoder.encode(plain)[0].tolist() == expected
    encoder.spaced = None
    assert [encoder.encode(plain)[0].tolist() for _ in range(3)] == [expected] * 3
    assert asked == []


def test_words_of_letters_that_a_vocabulary_lacks(tmp_path, tokenizer_path):
    with open(tokenizer_path, encoding="utf-8") as file:
        parts = json.load(file)
    parts["model"] |= {"vocab": {c: i for i, c in enumerate("abc")}, "merges": []}
    parts["added_tokens"] = []
    parts["post_processor"] = None
    path = tmp_path / "small.json"
    path.write_text(json.dumps(parts))
    own = Tokenizer.from_file(str(path))
    assert token_store.splits_at_words(str(path))
    texts = ["ab xyz ca, Xb", "x", "cab", "été ab"]
    expected = [own.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    ids, sizes = token_store.WordEncoder(str(path)).encode(texts)
    assert sizes.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("length", [16, 2048])
def test_files_give_back_what_was_written(spark, tmp_path, tokenizer_path, length):
    rng = random.Random(9)
    rows = [(i, " ".join(words_of(rng, rng.randint(0, 200)))) for i in range(100)]
    rng.shuffle(rows)
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "again"), (7, "again")]
    folder = f"file://{tmp_path}/store"
    index = token_store.write_store(table(spark, rows).repartition(5), tokenizer_path, folder, length=length)
    found = token_store.read_store(index).collect()
    own = Tokenizer.from_file(tokenizer_path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    start, expected = 0, Counter()
    for doc_id, text in order:
        if doc_id == 7:
            continue
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        start_of = start if doc_id is None or doc_id < 7 else None
        start += len(ids)
        expected[doc_id, start_of, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start if r.doc_id is None or r.doc_id < 7 else None, r.n_tokens, r.ids_crc32) for r in found if r.doc_id != 7) == expected
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [d for d, _ in order]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    for file in {r.file for r in index.collect()}:
        reader = token_store.SequenceReader(file)
        batches = [reader.batch(i) for i in range(reader.file.num_record_batches)]
        assert {b.schema.field("ids").type for b in batches} == {pa.list_(pa.uint16(), length)}
        masks = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in batches])
        held = sum(r.n_tokens for r in index.filter(F.col("file") == file).collect())
        assert masks.sum() == held and masks[:held].all() and len(masks) - held < length


def test_reading_within_a_batch_copies_nothing(tmp_path):
    file = token_store.SequenceFile(f"file://{tmp_path}/x.arrow", 8, np.dtype("<u2"), {})
    many = np.arange(5000, dtype="<u2")
    for start in range(0, 5000, 700):
        file.append(many[start : start + 700])
    file.close()
    reader = token_store.SequenceReader(f"file://{tmp_path}/x.arrow")
    view = reader.ids(10, 50)
    assert not view.flags.owndata and view.tolist() == list(range(10, 60))
    assert reader.ids(2000, 2500).tolist() == list(range(2000, 4500))  # over batches
    assert reader.ids(0, 0).tolist() == []


def test_a_large_vocabulary_takes_four_bytes(spark, tmp_path):
    big = Tokenizer(models.WordLevel({f"t{i}": i for i in range(70_000)} | {"[UNK]": 70_000}, unk_token="[UNK]"))
    big.normalizer, big.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit()
    big.save(str(tmp_path / "big.json"))
    index = token_store.write_store(table(spark, [(1, "t69999 t5")]), str(tmp_path / "big.json"), f"file://{tmp_path}/s")
    (row,) = token_store.read_store(index).collect()
    assert row.ids_crc32 == zlib.crc32(np.array([69_999, 5, 1], "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizers_ids_are_stored(spark, tmp_path, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    assert token_store.splits_at_words(path) == (name == "word_bpe_49k.json")
    texts = ["One line\nand two.", "  Spaces  between ", "ÜBER <|endoftext|> été", "", None, "UPPER lower"]
    index = token_store.write_store(table(spark, list(enumerate(texts))), path, f"file://{tmp_path}/store")
    own = Tokenizer.from_file(path)
    expected = {}
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        expected[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_store(index).collect()} == expected
    assert token_store.LengthCounter(path).lengths(texts) == [expected[i][0] for i in range(len(texts))]


def test_lengths_of_plain_words_are_asked_of_the_model_alone_and_once_a_worker(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = [
        "  One line\x1cand two.\t", "\xa0\x85 a\u2028b\n", "ÜBER été ﬁn e\u0301t\u00e9 Œuvre,ÿ ªº ʰ", "İstanbul ÉTÉ é", "Ωmega ÉTÉ UPPER, ǅ",
        "don't can't've 12a ²x a-b--c --- !?", "<|endoftext|> X<|startoftext|>y foo<|", "日本語 word, 日本", "x" * 3000 + " " + "é" * 999,
        "\x0b\x0c\r", "", None, "straße ŉ İ. ß; Ⱥ ĳ.", "\x00a\x7f b\u200dc \U0001f600ok",
    ]
    expected = [len(own.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    counter = token_store.counter_at(path)
    assert counter is token_store.counter_at(path)
    assert counter.lengths(texts) == expected
    assert [counter.lengths([t])[0] for t in texts] == expected
    assert counter.lengths([]) == []

    asked = []
    monkeypatch.setattr(token_store.WordEncoder, "learn", lambda self, words: asked.extend(words))
    plain = ["Latin cétait lètters ÉTÉ plainly"]
    assert counter.lengths(plain) == [len(own.encode(plain[0], add_special_tokens=False).ids) + 1]
    assert asked == []
    monkeypatch.setattr(token_store, "COUNTED_WORDS", 0)  # all words are older ones after each call
    assert [counter.lengths(texts) for _ in range(3)] == [expected] * 3
    assert asked == []


@pytest.mark.parametrize(
    "task",
    [
        language_id.count_batches,
        jaccard_join.sketch_counter(5, 64, 8),
        secret_scan.scan,
        lambda _: [token_store.encoder_at(public_tokenizers_path())],
    ],
)
def test_words_that_a_worker_remembers_go_when_it_gets_other_work(task):
    counter = token_store.counter_at(public_tokenizers_path())
    counter.lengths(["some words to remember"])
    list(task(iter([])))
    assert all(value is not counter for value in common.KEPT.values())
    assert token_store.counter_at(public_tokenizers_path()) is not counter
    assert len(common.KEPT) == 1


def public_tokenizers_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_an_empty_store(spark, tmp_path, tokenizer_path):
    index = token_store.write_store(table(spark, []).limit(0), tokenizer_path, f"file://{tmp_path}/none")
    assert token_store.read_store(index).collect() == []


# Packing -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
    most = rng.randint(1, 5)

    def padding(limits):
        return sum(n * (min(x for x in limits if x >= s) - s) for s, n in histogram.items())

    sizes = sorted(histogram)
    best = min(
        padding((*rest, sizes[-1]))
        for k in range(min(most, len(sizes)))
        for rest in combinations(sizes[:-1], k)
    )
    buckets = packing.optimal_buckets(histogram, most)
    assert buckets.padding == best == padding(buckets.limits)
    assert len(buckets.limits) <= most


def test_every_token_is_in_one_batch_within_the_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 5, 9, 30, 77, 250]))) for i in range(150)]
    rows += [(150, None), (151, " \t\n"), (None, "a b"), (4, rows[4][1]), (152, "long " * 50_000), (153, " x\x1c y")]
    packed = packing.pack(table(spark, rows), buckets=4, context=64, budget=256).collect()
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.n_tokens
        assert 1 <= r.n_tokens <= r.padded <= 64 and (r.piece == 0 or r.n_tokens <= 64)
    expected = Counter()
    for doc_id, text in rows:
        expected[doc_id] += len(re.findall("[^\x20\x09-\x0d]+", text or "")) + 1
    assert lengths == expected
    batches = defaultdict(list)
    for r in packed:
        batches[r.bucket, r.shard, r.batch].append(r)
    for members in batches.values():
        assert len({r.padded for r in members}) == 1
        assert sum(r.padded for r in members) <= 256
        assert sorted(r.place for r in members) == list(range(len(members)))
    full = [256 // members[0].padded == len(members) for members in batches.values()]
    shards = {key[:2] for key in batches}
    assert full.count(False) <= len(shards)


def test_lengths_are_those_of_the_store(spark, tokenizer_path):
    rng = random.Random(23)
    rows = [(i, " ".join(words_of(rng, rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "again"), (7, "again"), (200, "unspaced" * 900)]
    docs = spark.createDataFrame(
        [(i, t, 1, 2, "b", "s", 3) for i, t in rows],
        "doc_id bigint, text string, piece int, bucket int, batch string, shard string, total int",
    )
    packed = packing.pack(docs, tokenizer_path, buckets=4, context=64, budget=256).collect()
    own = Tokenizer.from_file(tokenizer_path)
    expected = Counter()
    for doc_id, text in rows:
        expected[doc_id] += len(own.encode(text or "", add_special_tokens=False).ids) + 1
    found = Counter()
    for r in packed:
        found[r.doc_id] += r.n_tokens
        assert 1 <= r.n_tokens <= r.padded <= 64
    assert found == expected


def test_a_document_keeps_an_id_that_is_no_number(spark, tokenizer_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "name string, text string")
    for path in (tokenizer_path, None):
        packed = packing.pack(docs, path, id_column="name").collect()
        assert {(r.doc_id, r.n_tokens) for r in packed} == {("a", 3), ("b", 1)}


def test_packing_an_empty_table(spark):
    assert packing.pack(table(spark, []).limit(0)).collect() == []

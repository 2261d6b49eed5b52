"""Cross-tokenizer alignment against brute force over every pair of tokens."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnwell.llm import alignment

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id bigint, text string, block string, pair int, n int, place string"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def table(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "b", 1, 2, "p") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def own():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute_groups(own, text):
    """Lists of ids on both sides, from byte ranges; None without tokens."""
    if not text:
        return None
    a, b = own
    letters = alignment.byte_letters()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in b_ids]
    b_bytes = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in zip(b_ids, pieces, strict=True)
    ]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    groups, i, j, left, right = [([], [])], 0, 0, 0, 0
    while i < len(a_ids) or j < len(b_ids):
        if left <= right and i < len(a_ids):
            groups[-1][0].append(a_ids[i])
            left, i = left + len(a_bytes[i]), i + 1
        else:
            groups[-1][1].append(b_ids[j])
            right, j = right + len(b_bytes[j]), j + 1
        if left == right and groups[-1][0] and groups[-1][1]:
            groups.append(([], []))
    return groups[:-1]


def brute(own, rows):
    found = [(d, brute_groups(own, t)) for d, t in rows]
    links = [[(a, b) for x, y in groups or [] for a in x for b in y] for _, groups in found]
    counts = Counter(pair for pairs in links for pair in set(pairs))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (doc_id, groups), pairs in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        out[
            doc_id,
            sum(len(x) for x, _ in groups or []),
            sum(len(y) for _, y in groups or []),
            len(groups or []),
            len(pairs),
            sum(counts[p] == most[p[0]] for p in pairs),
            sum(counts[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
            text if groups else None,
        ] += 1
    return out


ODD = [
    None, "", " ", "\n\n \t", "<|endoftext|> <s> <unk> <0x41>", "a▁b", "naïve café 漢字 \x00 x", "🙂🙂 flags 🇩🇪",
    "…" * 40, "a" * 3000, "don't you'll WE'RE", "１２３ ½ ² ǅ", "  leading and trailing  ", "x́y​z\xa0w",
]


@pytest.mark.parametrize("block_bytes", [300, alignment.BLOCK_BYTES])
@pytest.mark.parametrize("at_once", [7, alignment.LINKS_AT_ONCE])
def test_rows_equal_brute_force(spark, monkeypatch, own, block_bytes, at_once):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
    rng = random.Random(11)
    letters = "the cat sat on a mat. Über Straße! ,éß漢🙂\n0123"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 120)))) for i in range(80)]
    rows += [(100 + i, text) for i, text in enumerate(ODD)]
    rows += [(3, rows[3][1]), (4, "other text of one id"), (None, "no id"), (None, None)]
    found = alignment.align(table(spark, rows), A_PATH, B_PATH, with_groups=True, block_bytes=block_bytes)
    assert found.columns == [*RESULT, "groups"]
    assert Counter(map(tuple, found.collect())) == brute(own, rows)


def test_many_links_of_one_group_are_expanded_in_parts(monkeypatch):
    a, b = np.array([5, 6, 5, 7], np.int64), np.array([1, 2, 1], np.int64)
    found = alignment.Aligned(a, b, np.array([3, 4]), np.array([2, 3]))
    expected = Counter((x, y) for x in (5, 6, 5) for y in (1, 2)) + Counter([(7, 1)])
    for at_once in (1, 2, 3, 100):
        monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
        names, times = found.pairs()
        assert dict(zip([(n >> 32, n & 0xFFFFFFFF) for n in names.tolist()], times.tolist(), strict=True)) == expected
        assert names.tolist() == sorted(names.tolist())
    assert found.n_links() == 7


def test_fast_ids_are_the_librarys_own(own):
    rng = random.Random(12)
    tokens = alignment.ByteLevelTokens(A_PATH)
    assert tokens.fast is not None
    texts = ["".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x300), rng.randrange(0xD800)])) for _ in range(30)) for _ in range(2000)]
    assert tokens.encode(texts) == [own[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_files_that_ask_for_more_take_the_library(tmp_path, own):
    with open(A_PATH, encoding="utf-8") as file:
        parts = json.load(file)
    parts["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(parts))
    tokens = alignment.ByteLevelTokens(str(other))
    assert tokens.fast is None
    assert tokens.encode(["ABC Def"]) == [own[0].encode(" abc def", add_special_tokens=False).ids]


def test_an_empty_table_and_texts_without_tokens(spark):
    assert alignment.align(table(spark, []).limit(0), A_PATH, B_PATH).collect() == []
    nothing = alignment.align(table(spark, [(1, None), (2, ""), (3, "▁")]), A_PATH, B_PATH).collect()
    assert sorted(map(tuple, nothing)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]

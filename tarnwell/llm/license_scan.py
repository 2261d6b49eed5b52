"""Licence scan by matching statistics over a generalised suffix automaton.

The words of all licence templates go into one suffix automaton. A document's words are
streamed through it, which gives, at each word, the longest stretch ending there that
occurs in some template, and by the suffix links the longest that occurs in each other
place of a template. Stretches that can't be made longer there and are long enough become
matches; per template, matches that go forward in document and template alike are
chained, and every place that covers a template well enough gives its label.

Notices of different licences may share nearly all their words. Where a template's chain
lies, the words that tell it from each such sibling must be there as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tarnwell.llm.common import in_small_batches

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8, all that is beyond ASCII is in words

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Public licence notices, word for word, with the label of each.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
    ),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ),
    (
        "gpl-3.0",
        "This work is licensed under the GNU General Public License, version 3",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is "
        "free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]
MIN_MATCH = 3  # words in a row that make a match
MAX_GAP = 8  # words that may stand between two chained matches
COVERED = 0.8  # share of a template's words that gives its label

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, spans string"
)


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:  # what ends with a longer stretch ends with its suffix too
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, before: int, symbol: int, target: int) -> int:
        clone = self._state(self.length[before] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while before >= 0 and self.next[before].get(symbol) == target:
            self.next[before][symbol] = clone
            before = self.link[before]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:  # an earlier sequence has this stretch
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, symbol, target)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._split(at, symbol, target)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest stretch that ends at each word and occurs in a sequence."""
        state, length = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield state, length

    def shorter(self, state: int, least: int) -> list[tuple[tuple[int, int], int]]:
        """Ends in sequences of what the state's suffixes of ``least`` words or more add, with their lengths."""
        found, have, at = [], self.ends[state], self.link[state]
        while at > 0 and self.length[at] >= least:
            found += [(end, self.length[at]) for end in sorted(self.ends[at] - have)]
            have, at = self.ends[at], self.link[at]
        return found

    def matches(self, symbols: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(sequence, start in ``symbols``, start in the sequence, length) of all common stretches.

        Of those that the words before and after make no longer in either, and that have
        ``least`` words.
        """
        found: list[tuple[int, int, int, int]] = []
        known: dict[int, list[tuple[tuple[int, int], int]]] = {}
        before: dict[tuple[int, int], int] = {}

        def ended(at: int, now: dict[tuple[int, int], int]) -> None:
            for (sequence, end), length in before.items():
                if now.get((sequence, end + 1)) != length + 1:
                    found.append((sequence, at - length, end - length, length))

        at = 0
        for at, (state, length) in enumerate(self.statistics(symbols)):
            now: dict[tuple[int, int], int] = {}
            if length >= least:
                if state not in known:
                    known[state] = self.shorter(state, least)
                now = dict(known[state]) | dict.fromkeys(self.ends[state], length)
            if before:
                ended(at, now)
            before = now
        ended(at + 1, {})
        return found


class LicenseMatcher:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text) for _, text in templates]
        phrases = [words_of(phrase) for phrase in base]
        self.base_labels = list(base.values())
        self.ids: dict[bytes, int] = {}
        for sequence in sequences + phrases:
            for word in sequence:
                self.ids.setdefault(word, len(self.ids))
        self.phrases = [[self.ids[w] for w in phrase] for phrase in phrases]
        self.sizes = [len(sequence) for sequence in sequences]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in s] for s in sequences])
        self.telling = [
            [
                frozenset(self.ids[word] for word in own)
                for other_label, other in zip(self.labels, sequences, strict=True)
                if other_label != label and (own := telling(sequence, other))
            ]
            for label, sequence in zip(self.labels, sequences, strict=True)
        ]

    def base_places(self, symbols: np.ndarray) -> list[np.ndarray]:
        """Starts of each base phrase."""
        places = []
        for phrase in self.phrases:
            room = len(symbols) - len(phrase) + 1
            at = np.flatnonzero(symbols[: max(room, 0)] == phrase[0])
            for k, symbol in enumerate(phrase[1:], 1):
                at = at[symbols[at + k] == symbol]
            places.append(at)
        return places

    def covered(self, symbols: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, share covered, first word, end) of chains of matches.

        Of each template that matches, the best chain, and if that covers the template
        every other chain that does and overlaps none of them.
        """
        known = symbols >= 0
        edges = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
        per_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start < MIN_MATCH:
                continue
            for template, at, place, length in self.automaton.matches(symbols[start:end].tolist(), MIN_MATCH):
                per_template.setdefault(template, []).append((int(start) + at, place, length))
        return [
            (template, *chain)
            for template, found in per_template.items()
            for chain in covering_chains(found, self.sizes[template])
            if chain[0] < COVERED or self.told_apart(template, symbols[max(chain[1] - MAX_GAP, 0) : chain[2] + MAX_GAP])
        ]

    def told_apart(self, template: int, symbols: np.ndarray) -> bool:
        """Whether the words that tell a template from each of its siblings are there, most at least."""
        there = set(symbols.tolist()) if self.telling[template] else set()
        return all(len(own & there) >= COVERED * len(own) for own in self.telling[template])


def telling(words: list[bytes], sibling: list[bytes]) -> set[bytes]:
    """Words that a template has and its sibling hasn't in their place; none if they aren't siblings."""
    blocks = SequenceMatcher(None, words, sibling, autojunk=False).get_matching_blocks()
    shared = {place for block in blocks for place in range(block.a, block.a + block.size)}
    if len(shared) < COVERED * len(words):
        return set()
    return {word for place, word in enumerate(words) if place not in shared} - set(sibling)


def covering_chains(matches: list[tuple[int, int, int]], size: int) -> list[tuple[float, int, int]]:
    """The best chain; if it covers the template, also the others before and after it."""
    matches = sorted(set(matches))
    best = best_chain(matches, size)
    if best[0] < COVERED:
        return [best]
    before = [m for m in matches if m[0] + m[2] <= best[1]]
    after = [m for m in matches if m[0] >= best[2]]
    return [*chains_in_turn(before, size), best, *chains_in_turn(after, size)]


def best_chain(matches: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
    """Largest share of a template that matches going forward in both texts cover.

    Matches are (start in document, start in template, length), in order. Only matches
    within the reach of a whole template can be chained, which keeps this linear in a
    long document.
    """
    starts = [m[0] for m in matches]
    best: list[tuple[int, int]] = []  # words covered, first word of the chain
    top = (0, 0, 0)
    for i, (at, _, length) in enumerate(matches):
        best.append(chain_ending(i, 0, matches, starts, best, size))
        top = max(top, (best[i][0], -best[i][1], at + length))
    return min(1.0, top[0] / size), -top[1], top[2]


def chain_ending(i: int, low: int, matches, starts, best, size: int) -> tuple[int, int]:
    """Words covered and first word of the best chain of matches from ``low`` on to the i-th."""
    at, place, length = matches[i]
    words, first = length, at
    for j in range(bisect_left(starts, at - size - MAX_GAP, low), i):
        other_at, other_place, other_length = matches[j]
        shared = max(other_at + other_length - at, other_place + other_length - place, 0)
        gap = max(at - other_at - other_length, place - other_place - other_length)
        if other_place < place and shared < length and gap <= MAX_GAP:
            if best[j][0] + length - shared > words:
                words, first = best[j][0] + length - shared, best[j][1]
    return words, first


def chains_in_turn(matches: list[tuple[int, int, int]], size: int) -> list[tuple[float, int, int]]:
    """Chains that cover a template and don't overlap, of those that do the best.

    A chain is taken when no match that overlaps it or follows closely can still make a
    better one. Matching goes on at its end, so a long document's many notices take
    time in proportion to their number.
    """
    starts = [m[0] for m in matches]
    best: list[tuple[int, int]] = []
    found = []
    top, reach, low, first_top, i = None, 0, 0, None, 0
    while i < len(matches) or top:
        if top and (i == len(matches) or starts[i] > reach + MAX_GAP):
            if -top[1] > first_top:  # it pushed out one that began earlier
                found += chains_in_turn([m for m in matches[low:i] if m[0] + m[2] <= -top[1]], size)
            found.append((min(1.0, top[0] / size), -top[1], top[2]))
            i = low = bisect_left(starts, top[2], low)
            del best[low:]
            top = first_top = None
            continue
        at, _, length = matches[i]
        best.append(chain_ending(i, low, matches, starts, best, size))
        words, first = best[i]
        better = (words, -first, at + length)
        if words >= COVERED * size and (top is None or first < top[2] and better > top):
            top = better
            first_top = first if first_top is None else min(first, first_top)
            near = range(bisect_left(starts, at - size - MAX_GAP, low), i + 1)
            reach = max(matches[j][0] + matches[j][2] for j in near if best[j][1] < top[2])
        elif top and first < top[2]:
            reach = max(reach, at + length)
        i += 1
    return found


def scanner(templates, base):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = LicenseMatcher(templates, base)
        ids = matcher.ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                symbols = np.array([ids.get(w, -1) for w in words], dtype=np.int32)
                places = matcher.base_places(symbols)
                starts = np.concatenate(places)
                base_labels = {
                    label for label, at in zip(matcher.base_labels, places, strict=True) if len(at)
                }
                chains = matcher.covered(symbols)
                named = [c for c in chains if c[1] >= COVERED]
                labels = base_labels | {matcher.labels[c[0]] for c in named}
                spans = sorted({(c[2], c[3], matcher.labels[c[0]]) for c in named})
                rows.append(
                    (
                        doc_id,
                        len(words),
                        len(starts),
                        int(starts.min()) if len(starts) else None,
                        int(starts.max()) if len(starts) else None,
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(labels)),
                        max([0.0, *(c[1] for c in chains)]),
                        ",".join(f"{label}:{start}:{end}" for start, end, label in spans),
                    )
                )
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype(
                {"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"}
            )

    return scan


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    base: dict[str, str] = BASE,
) -> DataFrame:
    """One row per input row: base places and labels, labels, best coverage and spans.

    ``spans`` is ``label:first word:end`` for each place that covers a template of the
    label, copies of a notice and notices inside others included; ``score`` is the largest
    share of any template that is covered, 0 without a match. A null or empty text has no
    words, no places and score 0; a very long one is read whole, in time that grows with
    its length. Repeated rows give repeated rows, a null id is kept, other columns are
    ignored, an empty table gives an empty result.
    No shuffle; what a task holds is the templates' automaton and one batch.
    """
    return in_small_batches(docs).selectExpr(
        f"CAST(`{id_column}` AS bigint) AS doc_id", f"CAST(`{text_column}` AS string) AS text"
    ).mapInPandas(scanner(templates, base), SCHEMA)

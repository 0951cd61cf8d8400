"""License scans: a generalised suffix automaton of licence tokens gives matching statistics, chained into template spans."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import Words, blocks, byte_class, code_points, hash_word

# Phrases whose words, standing together, give a label of themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licences, as their authors tell users to write them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# One-line notices.
SHORT = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2.0": "Licensed under the GNU General Public License, version 2",
    "gpl-3.0": "Licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "Licensed under the Mozilla Public License, version 2.0",
}
#: Least words of a match that counts, most words between two matches of a span (in the text and in the
#: template), and the least share of the template, and of the span, that the matches cover.
MATCH, GAP, SHARE = 4, 12, 0.75


def default_templates() -> dict[str, tuple[str, ...]]:
    """The texts of each label: notices, one-line notices, and the licences in full, from ``licence_texts``."""
    out: dict[str, tuple[str, ...]] = {}
    full = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
    for texts in (TEMPLATES, SHORT, full):
        for label, text in texts.items():
            out[label] = (*out.get(label, ()), text)
    return out


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; each state knows the templates in which its strings occur, and where."""

    def __init__(self, lines: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owners = [-1], [0], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for i, line in enumerate(lines):
            last = 0
            for at, word in enumerate(line, 1):
                last = self._extend(last, word, 1 << i)
                self.ends[last].append((i, at))
        self.longer: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            self.longer[self.link[state]].append(state)
        self.places = lru_cache(maxsize=None)(self._places)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.owners[self.link[state]] |= self.owners[state]

    def _state(self, length: int, link: int, moves: dict[int, int], owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(owner)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of q that are no longer than p's by more than one word."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, owner: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            if self.length[q] != self.length[last] + 1:
                q = self._split(last, word, q)
            self.owners[q] |= owner
            return q
        now = self._state(self.length[last] + 1, 0, {}, owner)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return now

    def _places(self, state: int) -> tuple[tuple[int, int], ...]:
        """(template, words before its end) of each place where the state's strings stand."""
        out, work = [], [state]
        while work:
            now = work.pop()
            out += self.ends[now]
            work += self.longer[now]
        return tuple(out)

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """For each word, the length of the longest template substring that ends there, and its state."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state, size = 0, 0
            out.append((size, state))
        return out


class Scanner:
    """Templates, their automaton, and phrases, in word hashes."""

    def __init__(self, templates: tuple, phrases: tuple):
        self.table = byte_class("alnum")
        lines = []
        for _, text in templates:  # a label may have several
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            lines.append(Words(data, np.array([0, len(data)]), self.table).hashes())
        self.known = np.unique(np.concatenate(lines)) if lines else np.zeros(0, dtype=np.uint64)
        self.names = [name for name, _ in templates]
        self.lengths = [len(x) for x in lines]
        self.automaton = SuffixAutomaton([np.searchsorted(self.known, x).tolist() for x in lines])
        self.phrases = [(np.array([hash_word(w.encode()) for w in phrase.split()], dtype=np.uint64), label) for phrase, label in phrases]

    def phrase_places(self, words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Word numbers of the block where each phrase starts; a phrase never runs from one row into the next."""
        out = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(hashes[: max(len(hashes) - len(phrase) + 1, 0)] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[hashes[at + k] == phrase[k]]
            row = np.searchsorted(words.first, at, "right")
            out.append((at[at + len(phrase) <= words.first[row]], label) if len(at) else (at, label))
        return out

    def spans(self, words: Words, hashes: np.ndarray) -> dict[int, list[tuple[int, int, int, float, str]]]:
        """By row: (first word, word after the last, words covered, share, template) of each span.

        A match lies within a run of words that occur in some template, so only runs of MATCH or
        more such words are streamed through the automaton.
        """
        found: dict[int, list[tuple[int, int, int, float, str]]] = {}
        if not len(self.known) or not len(hashes):
            return found
        number = np.searchsorted(self.known, hashes)
        number[number == len(self.known)] = 0
        known = self.known[number] == hashes
        edge = np.zeros(len(hashes) + 1, dtype=bool)
        edge[words.first] = True
        start = np.flatnonzero(known & (edge[:-1] | np.concatenate([[True], ~known[:-1]])))
        stop = np.flatnonzero(known & (edge[1:] | np.concatenate([~known[1:], [True]]))) + 1
        long = stop - start >= MATCH
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            row = int(np.searchsorted(words.first, a, "right")) - 1
            stats = self.automaton.statistics(number[a:b].tolist())
            for i, (size, state) in enumerate(stats):
                if size >= MATCH and (i + 1 == len(stats) or stats[i + 1][0] != size + 1):
                    matches.setdefault(row, []).append((a + i + 1 - size, a + i + 1, state))
        for row, each in matches.items():
            anchors: dict[int, list[tuple[int, int, int]]] = {}  # by template: text start, text end, template end
            for a, b, state in each:
                for k, end in self.automaton.places(state):
                    anchors.setdefault(k, []).append((a, b, end))
            spans = [span for k, those in anchors.items() for span in self._chains(those, self.lengths[k], self.names[k])]
            kept: list[tuple[int, int, int, float, str]] = []
            for span in sorted(spans, key=lambda s: (-s[2], -s[3], s[0], s[4])):
                if all(span[1] <= x[0] or span[0] >= x[1] for x in kept):
                    kept.append(span)
            if kept:
                base = int(words.first[row])
                found[row] = sorted((a - base, b - base, n, share, name) for a, b, n, share, name in kept)
        return found

    @staticmethod
    def _chains(anchors: list[tuple[int, int, int]], length: int, name: str) -> list[tuple[int, int, int, float, str]]:
        """Chains of matches that advance in the text and in the template, with small gaps, and cover enough of both."""
        anchors.sort()
        best: list[tuple[int, int]] = []  # words covered by the best chain that ends here, and where it starts
        out, oldest = [], 0
        reach = 0
        for i, (a, b, end) in enumerate(anchors):
            begin, top = end - (b - a), (b - a, a)
            reach = max(reach, b - a)
            while anchors[oldest][0] + reach + GAP < a:
                oldest += 1
            for j in range(oldest, i):
                _, b0, end0 = anchors[j]
                overlap = max(0, b0 - a, end0 - begin)
                if overlap < b - a and a - b0 <= GAP and begin - end0 <= GAP and end0 < end and best[j][0] + b - a - overlap > top[0]:
                    top = (best[j][0] + b - a - overlap, best[j][1])
            best.append(top)
            share = top[0] / max(length, b - top[1])
            if share >= SHARE:
                out.append((top[1], b, top[0], share, name))
        return out


@lru_cache(maxsize=2)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(templates, phrases)


_SPANS = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def _scan(templates: tuple, phrases: tuple):
    def run(batches):
        scanner = _scanner(templates, phrases)
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                words = Words(data, offsets, scanner.table)
                hashes = words.hashes()
                n = len(offsets) - 1
                n_words = np.diff(words.first)
                places = scanner.phrase_places(words, hashes)
                at = np.concatenate([x for x, _ in places]) if places else np.zeros(0, dtype=np.int64)
                row = np.searchsorted(words.first, at, "right") - 1
                count = np.bincount(row, minlength=n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, row, at - words.first[row])
                np.maximum.at(high, row, at - words.first[row])
                base: list[set[str]] = [set() for _ in range(n)]
                for x, label in places:
                    for r in set((np.searchsorted(words.first, x, "right") - 1).tolist()):
                        base[r].add(label)
                spans = scanner.spans(words, hashes)
                place = code_points(data) if spans else None
                all_spans: list[list[dict]] = [[] for _ in range(n)]
                score = np.zeros(n)
                for r, found in spans.items():
                    w, o = int(words.first[r]), int(offsets[r])
                    all_spans[r] = [
                        {"template": t, "first_word": a, "end_word": b, "start": int(place[words.starts[w + a]] - place[o]), "end": int(place[words.ends[w + b - 1]] - place[o]), "covered": c, "share": x} for a, b, c, x, t in found
                    ]
                    score[r] = max(x for _, _, _, x, _ in found)
                score = np.where((count > 0) & (score < 0.5), 0.5, score)
                labels = [sorted(base[r] | {s["template"] for s in all_spans[r]}) for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_words), pa.array(count), pa.array(low, mask=count == 0), pa.array(high, mask=count == 0), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()), pa.array(score), pa.array(all_spans, _SPANS)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str | tuple[str, ...]] | None = None, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are lower-cased (A-Z) and split into runs of ASCII letters, digits and non-ASCII characters.
    ``n_base`` counts the places where a phrase's words stand consecutively; ``first_word`` and
    ``last_word`` are the least and greatest start, null without any. Matching statistics against the
    templates' suffix automaton give maximal matches of 4 or more words, with their places in the templates.
    Matches that advance both in the text and in one template, with at most 12 words between two in either,
    are chained; a chain is a span if it covers 0.75 of the template's words and of its own. Of spans that
    overlap, whatever their template, the one that covers most words stays (then the greater share, the
    earlier, the lesser name). ``score`` is the greatest share, at least 0.5 where a phrase stands; 0 with
    neither. Labels are distinct, sorted and comma-joined, '' without any.

    Templates (by default notices and full texts; a label may have several) and phrases are arguments of
    fixed size. A null or empty text has no words; a text of any length is scanned whole. Null ids, repeated
    rows and ties keep a row each; an empty table gives none; other columns are ignored.
    """
    given = default_templates() if templates is None else templates
    texts = tuple(sorted((label, text) for label, each in given.items() for text in ((each,) if isinstance(each, str) else each)))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<template:string,first_word:long,end_word:long,start:long,end:long,covered:long,share:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan(texts, tuple(phrases.items())), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Phrase collocation mining: candidates from a hashed sketch's upper bounds, exact counts by Aho-Corasick automata, scores of the weakest cut."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import cut
from .textblocks import LOWER, U64, Words, blocks, hash_word, mix, runs, windows

WORDS, LEAST, PERCENT, TOP = 5, 100, 100, 2000
UNKNOWN = "und"

#: Bytes of text for one of a sketch's counters, and the most counters: beyond it the bounds get looser, the results stay.
BYTES_A_COUNTER, MOST_COUNTERS = 48, 1 << 29
#: Numbers of words (first, last) of the sketches; a later one has those phrases alone whose parts reach the earlier ones' threshold.
LEVELS = ((1, 2), (3, 64))
#: Counters of one row of the sketch's table; phrases that are sorted and combined before the shuffle.
_PART_BITS, _FLUSH = 18, 1 << 22
#: Phrases that a task holds before it sends them, or their counts, on.
_HELD = 1 << 20
#: Bytes of text for a share of the candidates' hashes.
BYTES_A_SHARE = 4 << 20
#: Characters of the candidates of one automaton.
AUTOMATON_CHARS = 1 << 24

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False


def _grouped(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each word's group, by its place among the groups, and its piece, by a number that grows."""
    row = np.searchsorted(offsets, words.starts, "right") - 1
    coded = rows.column(0).dictionary_encode()
    piece = np.cumsum(_PIECE_END[data], dtype=np.int32)[words.starts] + row if len(row) else row
    return coded.indices.to_numpy(zero_copy_only=False)[row], piece, coded.dictionary.to_pylist()


class Phrases:
    """The phrases of a block of (group, text) rows: hashes of those of each number of words, by their first word."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, most: int):
        self.words = words = Words(data, offsets, _WORD)
        group, piece, groups = _grouped(rows, data, offsets, words)
        seeds = np.array([hash_word(g.encode() + b"\n") for g in groups], dtype=U64)
        self.hashes: list[np.ndarray] = []
        self.inside: list[np.ndarray] = []  # whether so many words from here on stand in one piece
        word, rolled = words.hashes(), seeds[group] if len(group) else np.zeros(0, dtype=U64)
        for m in range(1, most + 1):
            n = max(len(word) - m + 1, 0)
            rolled = (rolled[:n] + word[m - 1 :]) * U64(0x9E3779B97F4A7C15)
            rolled ^= rolled >> U64(29)
            self.inside.append(piece[:n] == piece[m - 1 :])
            self.hashes.append(mix(rolled))
        self.text = LOWER[data]

    def lines(self, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, sizes) of the phrases of m words from ``at`` on: one space between words, a newline after the last."""
        word, ends = runs(at, m), np.cumsum(m)
        size = self.words.ends[word] - self.words.starts[word] + 1
        data = self.text[np.minimum(runs(self.words.starts[word], size), len(self.text) - 1)]
        after = np.cumsum(size)
        data[after - 1] = 0x20
        data[after[ends - 1] - 1] = 0x0A
        return data, np.diff(after[ends - 1], prepend=0)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's counters in the sketch's two rows, which are the halves of one array."""
    half = np.uint32(1 << bits - 1)
    return (h >> U64(65 - bits)).astype(np.uint32), h.astype(np.uint32) & (half - np.uint32(1)) | half


def _reach(phrases: Phrases, sketches: list[np.ndarray], bits: int, upto: int) -> list[np.ndarray]:
    """By number of words up to ``upto`` and first word: whether a phrase reaches the threshold by its sketch, as do all its parts.

    Phrases longer than a sketch has are taken if all their parts of the most words that it has are.
    """
    good: list[np.ndarray] = []
    for m in range(1, upto + 1):
        h, inside = phrases.hashes[m - 1], phrases.inside[m - 1]
        now = inside.copy() if m == 1 else inside & good[-1][: len(h)] & good[-1][1 : len(h) + 1]
        if heavy := [sketch for (_, last), sketch in zip(LEVELS, sketches, strict=False) if m <= last][:1]:
            for k in (0, 1):
                at = np.flatnonzero(now)
                counter = _places(h[at], bits)[k]
                now[at] = heavy[0][counter >> 3] >> (7 - (counter & 7)).astype(np.uint8) & 1 > 0
        good.append(now)
    return good


def _counters(shared: list, bits: int, least: int, first: int, last: int):
    """Arrow function: (group, text) to rows (part, counts) of a sketch of 2 ** bits counters of the phrases of ``first`` to ``last``
    words all of whose parts reach the earlier sketches' threshold, combined within stretches of a task."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        part = at >> np.uint32(_PART_BITS)
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        packed = np.stack([at & np.uint32((1 << _PART_BITS) - 1), np.minimum(n, least)]).astype("<u4")
        packed[0, 1:] = np.diff(packed[0])  # wraps where a part begins
        packed[0, head] = at[head] & np.uint32((1 << _PART_BITS) - 1)
        bodies = [pa.compress(packed[:, a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(head, [*head[1:], len(at)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), pa.array(np.diff(np.append(head, len(at))).astype(np.int32)), pa.array(bodies, pa.binary())], ["part", "entries", "counts"])

    def run(batches):
        sketches = [s.value for s in shared]
        held, size = [], 0
        for batch in batches:
            for some, data, offsets in blocks(batch):
                phrases = Phrases(some, data, offsets, last)
                for h, good in list(zip(phrases.hashes, _reach(phrases, sketches, bits, last), strict=True))[first - 1 :]:
                    held += _places(h[good], bits)
                    size += 2 * len(held[-1])
                    if size >= _FLUSH:
                        yield rows(held)
                        held, size = [], 0
        if size:
            yield rows(held)

    return run


def _summed(least: int):
    """Arrow function: the counters' rows, those of a part together, to (part, bits): a bit for each counter that reaches ``least``."""

    def run(batches):
        part, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for p, n, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, total = p, np.zeros(1 << _PART_BITS, dtype=np.int64)
                step, count = np.frombuffer(pa.decompress(body, 8 * n, "zstd"), dtype="<u4").reshape(2, -1)
                total[np.cumsum(step, dtype=np.int64)] += count
        if part is not None:
            yield out()

    return run


def _candidates(shared: list, bits: int, most: int, shares: int):
    """Arrow function: (group, text) to rows (share, phrases): those phrases of two words or more, each once a task, that reach the
    threshold by the sketches, packed by share of their hashes.

    One that stands inside a longer such phrase wherever the task meets it isn't named: the longer one names it.
    """

    def rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        share, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(share, kind="stable")
        data = data[runs((np.cumsum(size) - size)[order], size[order])].tobytes()
        share, ends = share[order], np.cumsum(np.append(0, size[order]))
        first = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
        bodies = [zlib.compress(data[a : b - 1], 1) for a, b in zip(ends[first].tolist(), [*ends[first[1:]].tolist(), len(data)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(share[first].astype(np.int32)), pa.array(bodies, pa.binary())], ["share", "phrases"])

    def run(batches):
        sketches, held, size = [s.value for s in shared], [], 0
        seen = np.zeros(0, dtype=U64)
        for batch in batches:
            for some, data, offsets in blocks(batch):
                phrases = Phrases(some, data, offsets, most)
                good = _reach(phrases, sketches, bits, most)
                places = []
                for m in range(2, most + 1):
                    own = good[m - 1].copy()
                    if m < most:
                        longer = good[m]
                        own[: len(longer)] &= ~longer
                        own[1 : len(longer) + 1] &= ~longer
                    places.append(np.flatnonzero(own))
                at, number = np.concatenate([np.zeros(0, dtype=np.int64), *places]), np.repeat(np.arange(2, most + 1), [len(x) for x in places])
                new, which = np.unique(np.concatenate([np.zeros(0, dtype=U64), *(h[x] for h, x in zip(phrases.hashes[1:], places, strict=True))]), return_index=True)
                fresh = seen[np.minimum(np.searchsorted(seen, new), max(len(seen) - 1, 0))] != new if len(seen) else np.ones(len(new), dtype=bool)
                new, which = new[fresh], which[fresh]
                if len(new):
                    named, sizes = phrases.lines(at[which], number[which])
                    held.append(((new % U64(shares)).astype(np.int64), sizes, named))
                    size += len(new)
                    seen = np.sort(np.concatenate([seen, new]), kind="stable")  # two sorted stretches, which are merged
                if size >= _HELD:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _distinct(batches):
    """Arrow function: packed phrases, those of a share together, to each phrase once."""
    share, found = None, set()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["phrase"])
    for batch in batches:
        for s, body in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            if s != share and found:
                yield out()
                found = set()
            share = s
            found.update(zlib.decompress(body).decode().split("\n"))
    if found:
        yield out()


def _with_parts(phrases: DataFrame) -> DataFrame:
    """The phrases and all their parts, each once."""
    part = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    return phrases.select(F.split("phrase", " ").alias("w")).select(F.explode(part).alias("phrase")).distinct()


class Table:
    """Rows by their hashes, in open addressing. Rows may share a hash: who looks one up says whether it is the one that is meant."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(4, (2 * len(hashes)).bit_length())
        self.mask, self.empty = U64(size - 1), next(x for x in range(len(hashes) + 1) if not (hashes == U64(x)).any())
        self.hashes, self.rows = np.full(size, self.empty, dtype=U64), np.full(size, -1, dtype=np.int32)
        todo, at = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(todo):
            free = self.rows[at] < 0
            self.rows[at[free]] = todo[free]
            rest = self.rows[at] != todo
            self.hashes[at[~rest]] = hashes[todo[~rest]]
            todo, at = todo[rest], at[rest] + 1 & int(self.mask)

    def find(self, hashes: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """For each hash its row, of which ``same`` (places in ``hashes``, rows) is true; else -1."""
        out, todo, wanted = np.full(len(hashes), -1, dtype=np.int64), None, hashes
        at = (hashes & self.mask).astype(np.int64)
        while todo is None or len(todo):
            here = self.hashes[at]
            equal = here == wanted
            hit = np.flatnonzero(equal)
            rows, places = self.rows[at[hit]], hit if todo is None else todo[hit]
            if same:
                right = (rows < 0) | same(places, rows)
                equal[hit[~right]] = False
                rows, places = rows[right], places[right]
            out[places] = rows
            more = np.flatnonzero(~equal & (here != self.empty))
            todo = more if todo is None else todo[more]
            at, wanted = at[more] + 1 & int(self.mask), wanted[more]
        return out


class Automaton:
    """Aho-Corasick automaton over the numbers of words, for phrases all of whose beginnings are phrases too: state i + 1 is phrase i, 0 the root.

    It is walked by many pieces at once, a word of each in a step. A word is found by its hash and then compared as it stands.
    """

    def __init__(self, phrases: pa.Array):
        split = pc.split_pattern(phrases.cast(pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        data = np.frombuffer((coded.dictionary.cast(pa.large_binary()).buffers()[2] or b""), dtype=np.uint8)
        ends = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64)[coded.dictionary.offset :][: len(coded.dictionary) + 1]
        self.known = Words.spanning(data, ends[:-1], ends[1:])
        self.parts = windows(data)
        self.words = Table(self.known.hashes())
        number, first = coded.indices.to_numpy().astype(np.int64), np.asarray(split.offsets).astype(np.int64)
        size, n = np.diff(first), len(phrases)
        self.first = np.zeros(len(ends) - 1, dtype=np.int64)  # the state after a word from the root
        self.fail, self.before, self.last = (np.zeros(n + 1, dtype=np.int64) for _ in range(3))
        state = np.zeros(n, dtype=np.int64)  # of each phrase's beginning so far
        keys = np.zeros(n, dtype=U64)
        levels = [np.flatnonzero(size == m) for m in range(1, int(size.max(initial=0)) + 1)]
        for m, own in enumerate(levels, 1):
            word = number[first[own] + m - 1]
            if m == 1:
                self.first[word] = own + 1
            self.before[own + 1], self.last[own + 1] = state[own], word
            keys[own] = self._key(state[own], word)
            longer = np.flatnonzero(size > m)
            word = number[first[longer] + m - 1]
            if m == 1:
                state[longer] = self.first[word]
            elif len(longer):
                level = np.sort(keys[own])
                order = own[np.argsort(keys[own])]
                state[longer] = order[np.searchsorted(level, self._key(state[longer], word))] + 1
        self.to = np.concatenate([np.zeros(0, dtype=np.int64), *(own + 1 for own in levels[1:])])
        self.steps = Table(mix(keys[self.to - 1]))
        for own in levels[1:]:
            self.fail[own + 1] = self.step(self.fail[self.before[own + 1]], self.last[own + 1])

    @staticmethod
    def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return state.astype(U64) << U64(32) | word.astype(U64)

    def numbers(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for one of no phrase."""
        size, known = words.ends - words.starts, self.known
        parts = windows(LOWER[words.data])

        def same(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
            # equal hashes of words of one size up to eight bytes are of equal words, as each step of the hash can be undone
            right = size[places] == known.ends[rows] - known.starts[rows]
            long = np.flatnonzero(right & (size[places] > 8))
            n = size[places[long]]
            here, there = runs(words.starts[places[long]], n // 8, 8), runs(known.starts[rows[long]], n // 8, 8)
            differ = np.bincount(np.repeat(np.arange(len(long)), n // 8), weights=parts[here] != self.parts[there], minlength=len(long)) > 0
            # the last eight bytes, which may overlap those before
            right[long] = ~differ & (parts[words.ends[places[long]] - 8] == self.parts[known.ends[rows[long]] - 8])
            return right

        return self.words.find(hashes, same)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out = np.where(word >= 0, self.first[word] if len(self.first) else 0, 0)
        todo = np.flatnonzero((state > 0) & (word >= 0))
        state, word = state[todo], word[todo]
        while len(todo):
            keys = self._key(state, word)
            row = self.steps.find(mix(keys))  # the mix can be undone: equal hashes are of equal keys
            hit = row >= 0
            out[todo[hit]] = self.to[row[hit]]
            state = self.fail[state]
            more = ~hit & (state > 0)
            todo, state, word = todo[more], state[more], word[more]
        return out

    def states(self, number: np.ndarray, piece: np.ndarray, most: int) -> np.ndarray:
        """The state after each word; a piece begins at the root. Long pieces are walked in stretches, each from ``most`` - 1 words before it."""
        out = np.zeros(len(number), dtype=np.int64)
        head = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(head, len(number)))
        many = -(-size // _STRETCH)
        begin = runs(head, many, _STRETCH)
        end = np.minimum(begin + _STRETCH, np.repeat(head + size, many))
        at = np.maximum(begin - (most - 1), np.repeat(head, many))
        order = np.argsort(at - end, kind="stable")
        begin, end, at = begin[order], end[order], at[order]
        state = np.zeros(len(at), dtype=np.int64)
        left = np.searchsorted(at - end, -np.arange(int((end - at).max(initial=0))), "left")  # how many have a word more
        for k, n in enumerate(left.tolist()):
            here = at[:n] + k
            state = self.step(state[:n], number[here])
            own = here >= begin[:n]
            out[here[own]] = state[own]
        return out


#: Words of a piece that are walked one after the other.
_STRETCH = 64


@lru_cache(maxsize=1)
def _automaton(shared) -> Automaton:
    """A worker holds one at a time."""
    return Automaton(shared.value)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def _counted(shared, most: int, with_words: bool):
    """Arrow function: (group, text) to rows (lang, chunk, counts): how often the task's texts hold each phrase, overlapping occurrences
    included, packed by _CHUNK phrase numbers; chunk -1 has the number of words.

    A state that a word leads to stands for the longest phrase that ends there, those it fails to for the others.
    """

    def run(batches):
        automaton = _automaton(shared)
        codes: dict[str, int] = {}
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def row(group: str, chunk: int, packed: np.ndarray) -> tuple:
            return group, chunk, packed.shape[1], pa.compress(packed.astype("<u8").tobytes(), "zstd", asbytes=True)

        def out() -> Iterator[pa.RecordBatch]:
            rows = [row(group, -1, np.array([[0], [n]])) for group, n in words.items()] if with_words else []
            if held:
                groups, (keys, n) = list(codes), _merged(held)
                number = (keys & _STATE).astype(np.int64) - 1
                chunk = keys >> U64(32) << U64(32) | (number // _CHUNK).astype(U64)
                first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
                rows += [row(groups[int(keys[a] >> U64(32))], int(number[a]) // _CHUNK, np.stack([number[a:b] % _CHUNK, n[a:b]])) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
            held.clear()
            words.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["lang", "chunk", "entries", "counts"])

        for batch in batches:
            for some, data, offsets in blocks(batch):
                found = Words(data, offsets, _WORD)
                group, piece, groups = _grouped(some, data, offsets, found)
                for g, n in zip(groups, np.bincount(group, minlength=len(groups)).tolist(), strict=True):
                    codes.setdefault(g, len(codes))
                    if n:
                        words[g] += n
                state = automaton.states(automaton.numbers(found, found.hashes()), piece, most)
                code = np.array([codes[g] for g in groups], dtype=U64)[group]
                keys, n = np.unique((code << U64(32) | state.astype(U64))[state > 0], return_counts=True)
                while len(keys):
                    held.append((keys, n))
                    size += len(keys)
                    to = automaton.fail[(keys & _STATE).astype(np.int64)]
                    keys, n = (keys >> U64(32) << U64(32) | to.astype(U64))[to > 0], n[to > 0]
                if size > _FLUSH:
                    held[:] = [_merged(held)]
                    size = len(held[0][0])
                    if size > _HELD:
                        yield from out()
                        size = 0
        yield from out()

    return run


_STATE = U64((1 << 32) - 1)


#: Phrases whose counts are packed in one row.
_CHUNK = 4096


def _totals(shared, least: int):
    """Arrow function: the rows of ``_counted``, those of a language and chunk together, to (lang, phrase, f), without the rare ones;
    a null phrase has the number of words."""

    def run(batches):
        now, total = None, None

        def out() -> pa.RecordBatch:
            if now[1] < 0:
                langs, phrases, f = [now[0]], [None], total[:1].tolist()
            else:
                some = np.flatnonzero(total >= least)
                langs, phrases, f = [now[0]] * len(some), shared.value.take(pa.array(now[1] * _CHUNK + some)), total[some].tolist()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrases if isinstance(phrases, pa.Array) else pa.array(phrases, pa.string()), pa.array(f, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, chunk, n, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (lang, chunk) != now:
                    if now is not None:
                        yield out()
                    now, total = (lang, chunk), np.zeros(_CHUNK, dtype=np.int64)
                at, count = np.frombuffer(pa.decompress(body, 16 * n, "zstd"), dtype="<u8").astype(np.int64).reshape(2, -1)
                total[at] += count
        if now is not None:
            yield out()

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", group_col: str = "lang", most: int = WORDS, least: int = LEAST, most_counters: int = MOST_COUNTERS, automaton_chars: int = AUTOMATON_CHARS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f), (lang, n)): exact counts of all phrases of 1 to ``most`` words that stand ``least`` times or more, and of all words.

    Two scans add the hashed phrases up in sketches of two rows, whose counters are upper bounds: that of one and two words, then
    that of longer ones all of whose pairs of words reach ``least`` by the first. A sketch is combined within a task, summed by
    shuffle, and reaches the driver as one bit a counter, at most ``most_counters`` bits. A third scan takes
    the phrases that reach ``least`` by their sketch, as do all their parts. A last one counts them, in one automaton a pass, of at most
    about ``automaton_chars`` characters, those of one first word together; what the sketches let through wrongly goes then.
    """
    group = F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN))
    given = docs.select(group.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(_PART_BITS, (size // BYTES_A_COUNTER).bit_length()), most_counters.bit_length() - 1)
    context, sketches = docs.sparkSession.sparkContext, []
    for first, last in LEVELS:
        if first <= most:
            counters = given.mapInArrow(_counters(list(sketches), bits, least, first, min(last, most)), "part int, entries int, counts binary")
            summed = counters.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(least), "part int, bits binary")
            heavy = np.zeros(1 << bits - 3, dtype=np.uint8)
            for r in summed.collect():  # a bit a counter, summed by all tasks at once
                heavy[r["part"] << _PART_BITS - 3 : r["part"] + 1 << _PART_BITS - 3] = np.frombuffer(r["bits"], dtype=np.uint8)
            sketches.append(context.broadcast(heavy))
    packed = given.mapInArrow(_candidates(sketches, bits, most, 64 + size // BYTES_A_SHARE), "share int, phrases binary")
    candidates = cut(_with_parts(packed.repartition("share").sortWithinPartitions("share").mapInArrow(_distinct, "phrase string")))
    chars = candidates.agg(F.sum(F.length("phrase") + 2)).first()[0] or 0
    shares = 1 + chars // automaton_chars
    found = None
    for share in range(shares):
        mine = candidates.where(F.pmod(F.xxhash64(F.substring_index("phrase", " ", 1)), F.lit(shares)) == share)
        phrases = context.broadcast(mine.toArrow().column("phrase").cast(pa.string()).combine_chunks())
        packed = given.mapInArrow(_counted(phrases, most, not share), "lang string, chunk int, entries int, counts binary").repartition("lang", "chunk").sortWithinPartitions("lang", "chunk")
        some = cut(packed.mapInArrow(_totals(phrases, least), "lang string, phrase string, f long"))
        phrases.destroy()
        found = some if found is None else found.unionByName(some)
    for sketch in sketches:
        sketch.destroy()
    return found.where("phrase is not null"), found.where("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame, text_col: str = "text", group_col: str = "lang", most: int = WORDS, least: int = LEAST, percent: int = PERCENT, top: int = TOP, most_counters: int = MOST_COUNTERS, automaton_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of characters other than space and tab within the pieces that ``. , ; : ! ?`` and line ends part, with A-Z
    lower-cased. A candidate has 2 to ``most`` words and stands ``least`` times or more. Cut after its first k words, its
    parts stand l and r times, and the cut scores floor(1000 a n / (l r)), n being the language's words; the lowest cut
    counts, of equal ones the least k. Arithmetic is in decimals of 38 digits. A candidate goes if a longer
    one that holds its words side by side stands at least ``percent`` of its times. Ranks are by score and a, the
    highest first, then by the phrase's bytes.

    A null language is ``und``; a null or empty text has no words; repeated rows count as often as they stand; an empty
    table gives no rows; other columns are ignored. A text is scanned whole, however long.
    """
    f, n = phrase_counts(docs, text_col, group_col, most, least, most_counters, automaton_chars)
    words = F.split("phrase", " ")
    longer = f.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where("size(w) > 1")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    named = lambda phrase, count: f.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(count))
    both = cuts.join(named("head", "l"), ["lang", "head"]).join(named("tail", "r"), ["lang", "tail"]).join(n, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(23,0)")
    scored = both.withColumn("score", F.call_function("div", (product * wide("n")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer phrase stands no more often than those it holds, so one word more is enough to look at
    inner = longer.where("size(w) > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(percent) * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(_SHARES)).alias("share"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Shares of a language's phrases that are ranked apart, before the first of each meet.
_SHARES = 32


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

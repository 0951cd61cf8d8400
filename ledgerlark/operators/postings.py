"""Stored postings: impact blocks with upper bounds, positions delta-coded in binary; block-max top-k for many questions in one job.

The index is one table. Texts are dealt into shards by length, the longest into the first, those of one length class by hashed id; a
shard numbers its texts by length, the longest first, and blocks are runs of BLOCK numbers, the same for all terms. A row holds one
term's postings in one shard: a hot term has a row for each shard, so neither writing nor searching brings a term together. Rows are
stored by hashed term. Questions meet the shards in rounds, the longest texts first: what a round finds bounds the next ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import ENDS, stem
from ..functions.text import STOP_WORDS, tokens
from ..functions.vectors import hashed_embedding
from ..sources.commits import cut
from .lexicon import WEIGHT, _stands, cover_density, parsed
from .retrieval import POOL, fuse_by, knn_batch

#: Bytes of text in a shard on average, texts of a block, folders by hashed term.
SHARD_BYTES, BLOCK, BUCKETS = 8 << 20, 64, 64
#: Length classes of a doubling, shards of the first round, and how many times as many a round reaches as the one before.
CLASSES, FIRST, GROWTH = 8, 8, 8
#: Questions, and words of them, that meet a shard in one task at most; questions that are read at once, and tasks that there should be.
ASKED, WORDS, READ, TASKS = 1 << 18, 1 << 21, 256, 48
#: Shards of a task at most; blocks of a shard's texts times questions, and postings, that are met at once.
DECK, CELLS, POSTINGS = 8, 1 << 15, 1 << 21

ROW = "shard int, term string, n long, most long, blocks binary, docs binary, counts binary, places binary"
_NAMES = ["shard", "term", "n", "most", "blocks", "docs", "counts", "places"]
_STOP = frozenset(STOP_WORDS)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the least of one, two or four bytes each, which a first byte names."""
    width = next(w for w in (1, 2, 4) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., counts[0] numbers; then those of starts[1], and so on."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _packed_each(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``_packed`` of each stretch of numbers between two bounds; none is empty."""
    n = np.diff(bounds)
    most = np.maximum.reduceat(numbers, bounds[:-1]) if len(n) else n
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    ends = np.cumsum(np.append(0, 1 + n * width))
    data = np.zeros(ends[-1], dtype=np.uint8)
    data[ends[:-1]] = width
    wide = np.repeat(width, n)
    at = np.repeat(ends[:-1] + 1, n) + _runs(np.zeros_like(n), n) * wide
    for b in range(4):
        some = wide > b
        data[at[some] + b] = numbers[some] >> 8 * b & 255
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data)])


def _unpacked_each(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values that ``_packed`` made, and the bounds of each one's."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    values = pa.concat_arrays(column.chunks)
    ends = np.frombuffer(values.buffers()[1], dtype="<i4")[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)
    width = data[ends[:-1]].astype(np.int64)
    n = (np.diff(ends) - 1) // width
    wide = np.repeat(width, n)
    at = np.repeat(ends[:-1] + 1, n) + _runs(np.zeros_like(n), n) * wide
    numbers = data[at].astype(np.int64)
    for b in range(1, 4):
        some = wide > b
        numbers[some] |= data[at[some] + b].astype(np.int64) << 8 * b
    return numbers, np.cumsum(np.append(0, n))


def _inverted(key, table):
    """One shard's texts (shard, course_id, text in lower case) to its rows; the one without a term has the texts' ids and how many
    words, without stop words, each has."""
    split = pc.split_pattern_regex(table.column("text").combine_chunks().cast(pa.large_string()), "[^a-z0-9]+")
    words, ends = split.flatten().dictionary_encode(), np.asarray(split.offsets)
    doc = np.repeat(np.arange(len(split)), np.diff(ends))
    codes = words.indices.to_numpy()
    known = words.dictionary.to_pylist()
    some = np.array([bool(w) for w in known], dtype=bool)[codes] if known else np.zeros(0, dtype=bool)
    codes, doc = codes[some], doc[some]
    size = np.bincount(doc, minlength=len(split))
    ids = table.column("course_id").to_numpy()
    order = np.lexsort((ids, -size))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + 1
    terms: dict[str, int] = {}
    inflected = pc.match_substring_regex(words.dictionary, ENDS).to_pylist()
    term_of = np.array([-1 if not w or w in _STOP else terms.setdefault(stem(w) if other else w, len(terms)) for w, other in zip(known, inflected, strict=True)], dtype=np.int64)
    term = term_of[codes] if len(codes) else codes.astype(np.int64)
    term, doc, place = term[term >= 0], number[doc[term >= 0]], place[term >= 0]
    sort = np.argsort(term * max(len(order), 1) + doc, kind="stable")
    term, doc, place = term[sort], doc[sort], place[sort]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, dtype=int)
    counts = np.diff(np.append(first, len(term)))
    own = np.bincount(doc, minlength=len(order))
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    ends = np.append(first, len(term))
    doc, term = doc[first], term[first]
    bounds = np.searchsorted(term, np.arange(len(terms) + 1))
    begin, n = bounds[:-1], np.diff(bounds)
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK))) if len(term) else first
    entries = np.searchsorted(term[head], np.arange(len(terms) + 1))
    held = np.diff(entries)
    at, beside = _runs(3 * entries[:-1], held), np.repeat(held, held)
    blocks = np.empty(3 * len(head), dtype=np.int64)
    most = np.maximum.reduceat(counts, head) if len(head) else head
    for k, x in enumerate((doc[head] // BLOCK, most, np.diff(np.append(head, len(term))))):
        blocks[at + k * beside] = x
    steps = np.diff(doc, prepend=0)
    steps[begin] = doc[begin]
    packed = [_packed_each(blocks, 3 * entries), _packed_each(steps, bounds), _packed_each(counts, bounds), _packed_each(gaps, ends[bounds])]
    of_all = [b"", ids[order].astype("<i8").tobytes(), _packed(own), b""]
    columns = [pa.array([key[0].as_py()] * (1 + len(n)), pa.int32()), pa.array(["", *terms], pa.string()), pa.array(np.append(len(ids), n), pa.int64())]
    columns.append(pa.array(np.append(own.max(initial=0), np.maximum.reduceat(counts, begin) if len(n) else n), pa.int64()))
    columns += [pa.concat_arrays([pa.array([x], pa.binary()), each]) for x, each in zip(of_all, packed, strict=True)]
    return pa.table(columns, names=_NAMES)


def build(chunk: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index's rows for texts (course_id, text), whose ids are keys; rows without id or text are left out. Texts move once, by shard.

    Short length classes share a shard, one of more than ``shard_bytes`` has shards of its own, so a task's share of texts doesn't grow
    with the table.
    """
    size = F.octet_length("text").cast("long")
    given = chunk.where("course_id is not null and text is not null").select("course_id", F.lower("text").alias("text"), size.alias("bytes"), F.floor(F.log2(size + 1) * CLASSES).cast("int").alias("length"))
    classes, shards, held = [], 0, shard_bytes
    for length, size in given.groupBy("length").agg(F.sum("bytes")).orderBy(F.desc("length")).collect():
        if held + size <= shard_bytes:
            classes.append((length, shards - 1, 1))
            held += size
        else:
            classes.append((length, shards, many := -(-size // shard_bytes) or 1))
            shards, held = shards + many, size if many == 1 else shard_bytes
    of = lambda values: F.create_map(*[F.lit(x) for pair in zip([-1, *(c[0] for c in classes)], [0, *values], strict=True) for x in pair])[F.col("length")]
    shard = of([c[1] for c in classes]) + F.pmod(F.xxhash64("course_id"), of([c[2] for c in classes]))
    return given.select(shard.cast("int").alias("shard"), "course_id", "text").groupBy("shard").applyInArrow(_inverted, ROW)


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write(chunk: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the index below ``path``, a folder for each bucket of hashed terms, sorted by term."""
    rows = build(chunk, shard_bytes).withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(path)


class Shard:
    """One shard's rows of the terms that are asked for."""

    def __init__(self, rows: pa.Table):
        whole = pc.equal(rows.column("term"), "")
        (every,), rows = rows.filter(whole).to_pylist(), rows.filter(pc.invert(whole))
        self.ids = np.frombuffer(every["docs"], dtype="<i8")
        self.terms = {t: k for k, t in enumerate(rows.column("term").to_pylist())}
        numbers, bounds = _unpacked_each(rows.column("blocks"))
        held = np.diff(bounds) // 3
        at, beside = _runs(bounds[:-1], held), np.repeat(held, held)
        self.block, self.most, self.sizes = numbers[at], numbers[at + beside], numbers[at + 2 * beside]
        self.entries = np.cumsum(np.append(0, held))  # of each term
        self.starts = np.cumsum(self.sizes) - self.sizes
        steps, self.first = _unpacked_each(rows.column("docs"))  # of each term's postings
        ends = np.cumsum(steps)
        self.docs = ends - np.repeat(ends[self.first[:-1]] - steps[self.first[:-1]], np.diff(self.first))
        self.counts = _unpacked_each(rows.column("counts"))[0]
        self._places, self._read = rows.column("places"), {}  # null: no question needs them
        self.greatest = np.maximum.reduceat(self.most, self.entries[:-1]) if len(held) else held  # count of each term
        self.longest = np.maximum.reduceat(_unpacked(every["counts"]), np.arange(0, len(self.ids), BLOCK))  # of each block's texts
        self.blocks = len(self.longest)

    def places(self, term: str, doc: int) -> list[int]:
        """Where a term stands in a text, from 1; [] if it doesn't."""
        k = self.terms.get(term)
        if k is None:
            return []
        a, b = self.first[k], self.first[k + 1]
        if k not in self._read:
            counts, gaps = self.counts[a:b], _unpacked(self._places[k].as_py())
            ends = np.cumsum(counts)
            total = np.cumsum(gaps)
            self._read[k] = ends, total - np.repeat(total[ends - counts] - gaps[ends - counts], counts)
        at = int(np.searchsorted(self.docs[a:b], doc))
        if at == b - a or self.docs[a + at] != doc:
            return []
        ends, places = self._read[k]
        return places[ends[at] - self.counts[a + at] : ends[at]].tolist()

    def _of(self, terms: list[str]) -> np.ndarray:
        """The numbers of the terms' entries, one for each block that a term stands in."""
        numbers = np.array([self.terms[t] for t in terms if t in self.terms], dtype=np.int64)
        return _runs(self.entries[numbers], self.entries[numbers + 1] - self.entries[numbers])

    def _postings(self, entries: np.ndarray) -> np.ndarray:
        return _runs(self.starts[entries], self.sizes[entries])

    def top(self, must: list[list[str]], none: list[str], phrases: list[list[str]], limit: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, scores, postings of the question's terms, those opened): the best ``limit`` texts, ties by id, of those that may
        score ``least``, the last score that is kept of other shards' texts.

        A text's score is at most WEIGHT times the number of its places that the question's words take, so a block's is at most that of
        the greatest counts in it, or of its longest text. Blocks are opened in the order of this bound, until it is below the last score
        kept.
        """
        entries = self._of(sorted({t for group in must for t in group}))
        total = int(self.sizes[entries].sum())
        ids, scores, opened = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        if not len(must) or any(not any(t in self.terms for t in group) for group in must):
            return ids, scores, total, 0
        bound = np.minimum(np.bincount(self.block[entries], weights=self.most[entries], minlength=self.blocks), self.longest)
        order = np.flatnonzero((bound > 0) & (WEIGHT * bound >= least - 1e-9))
        if not len(order):
            return ids, scores, total, 0
        order = order[np.argsort(-bound[order], kind="stable")]
        rank = np.full(self.blocks, len(order))
        rank[order] = np.arange(len(order))
        entries = entries[rank[self.block[entries]] < len(order)]
        entries = entries[np.argsort(rank[self.block[entries]], kind="stable")]
        ends = np.searchsorted(rank[self.block[entries]], np.arange(len(order) + 1))
        banned = np.unique(self.docs[self._postings(self._of(none))])
        simple, at, step = len(must) == 1 and not len(phrases), 0, max(1, limit // BLOCK)
        while at < len(order) and not (len(ids) >= limit and WEIGHT * bound[order[at]] < scores[-1] - 1e-9):
            to = min(at + step, len(order))
            which = self._postings(entries[ends[at] : ends[to]])
            opened += len(which)
            sums = np.bincount(self.docs[which], weights=self.counts[which])
            docs = np.flatnonzero(sums)
            sums = sums[docs]
            fits = ~np.isin(docs, banned) & (WEIGHT * sums >= least - 1e-9)
            if simple:
                found = WEIGHT * sums
            else:
                for group in must:
                    fits &= np.isin(docs, self.docs[self._postings(self._of(sorted(set(group))))])
                found = np.zeros(len(docs))
                for i in np.flatnonzero(fits):
                    if len(ids) >= limit and WEIGHT * sums[i] < scores[-1] - 1e-9:
                        continue
                    here = {t: p for t in {t for group in must for t in group} if (p := self.places(t, int(docs[i])))}
                    fits[i] = all(_stands(here, phrase) for phrase in phrases)
                    found[i] = cover_density(here, must) if fits[i] else 0
                fits &= found > 0
            ids, scores = np.concatenate([ids, self.ids[docs[fits]]]), np.concatenate([scores, found[fits]])
            best = np.lexsort((ids, -scores))[:limit]
            ids, scores = ids[best], scores[best]
            at, step = to, step * 2
        return ids, scores, total, opened


    def tops(self, asked: np.ndarray, terms: np.ndarray, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """``top`` for many questions of one group of words each, which stand for term ``terms`` in question ``asked``, the questions in
        order: ``best`` gets what it keeps; (postings of each question's terms, those opened).

        A question whose terms' greatest counts, summed, can't reach its last score opens nothing. Others are taken some at a time.
        """
        number = asked * len(self.terms) + terms
        asked, terms = np.divmod(np.unique(number), max(len(self.terms), 1))
        n = len(best.least)
        total = np.bincount(asked, weights=(self.first[1:] - self.first[:-1])[terms], minlength=n).astype(np.int64)
        reach = np.minimum(np.bincount(asked, weights=self.greatest[terms], minlength=n), self.longest.max(initial=0))
        live = (reach > 0) & (WEIGHT * reach >= best.least - 1e-9)
        opened = np.zeros(n, dtype=np.int64)
        which = np.flatnonzero(live)
        if not len(which):
            return total, opened
        some = live[asked]
        asked, terms = asked[some], terms[some]
        share = np.maximum(np.arange(len(which)) * self.blocks // CELLS, np.cumsum(total[which]) // POSTINGS)
        cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)], strict=True):
            mine = slice(np.searchsorted(asked, which[a]), np.searchsorted(asked, which[b - 1], "right"))
            opened[which[a:b]] = self._tops(which[a:b], np.searchsorted(which[a:b], asked[mine]), terms[mine], best)
        return total, opened

    def _tops(self, which: np.ndarray, asked: np.ndarray, terms: np.ndarray, best: Best) -> np.ndarray:
        n, blocks = len(which), self.blocks
        held = self.entries[terms + 1] - self.entries[terms]
        entries, of = _runs(self.entries[terms], held), np.repeat(asked, held)
        bound = np.minimum(np.bincount(of * blocks + self.block[entries], weights=self.most[entries], minlength=n * blocks).reshape(n, blocks), self.longest)
        bound[WEIGHT * bound < best.least[which, None] - 1e-9] = 0
        order = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(blocks)[None, :], axis=1)
        many, rank = (bound > 0).sum(axis=1), rank[of, self.block[entries]]
        sorted_bound = np.take_along_axis(bound, order, axis=1)
        opened, at, step, active = np.zeros(n, dtype=np.int64), 0, max(1, best.limit // BLOCK), many > 0
        while active.any():
            to = min(at + step, blocks)
            now = active[of] & (rank < to) & (rank < many[of])
            mine, chosen = of[now], entries[now]
            size = self.sizes[chosen]
            postings = self._postings(chosen)
            opened += np.bincount(mine, weights=size, minlength=n).astype(np.int64)
            place = np.cumsum(active) - 1  # among the active questions
            first = (place[mine] * (to - at) + rank[now] - at) * BLOCK
            sums = np.bincount(np.repeat(first, size) + self.docs[postings] % BLOCK, weights=self.counts[postings])
            cell = np.flatnonzero(sums)
            question = np.flatnonzero(active)[cell // ((to - at) * BLOCK)]
            doc = order[question, at + cell // BLOCK % (to - at)] * BLOCK + cell % BLOCK
            best.add(which[question], self.ids[doc], WEIGHT * sums[cell])
            left = active[of] & (rank >= to)
            of, entries, rank = of[left], entries[left], rank[left]
            at, step = to, step * 2
            active &= many > at
            if at < blocks:
                active &= ~(best.full[which] & (WEIGHT * sorted_bound[:, at] < best.least[which] - 1e-9))
        return opened


class Best:
    """Of each of n questions the ``limit`` best texts so far, and the score and id that a text must not be behind."""

    def __init__(self, least: np.ndarray, last: np.ndarray, limit: int):
        self.least, self.last, self.limit = least.copy(), last.copy(), limit
        self.full = least > 0
        self.question, self.ids, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, question: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Texts of questions, each but once."""
        ahead = (scores > self.least[question] + 1e-9) | (scores > self.least[question] - 1e-9) & (ids <= self.last[question])
        question, ids, scores = question[ahead], ids[ahead], scores[ahead]
        if not len(question):
            return
        touched = np.zeros(len(self.least), dtype=bool)
        touched[question] = True
        old = touched[self.question]
        question, ids, scores = (np.concatenate([x[old], y]) for x, y in ((self.question, question), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, question))
        question, ids, scores = question[order], ids[order], scores[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        first = place < self.limit
        last = place == self.limit - 1
        self.least[question[last]], self.last[question[last]], self.full[question[last]] = scores[last], ids[last], True
        self.question, self.ids, self.scores = (np.concatenate([x[~old], y[first]]) for x, y in ((self.question, question), (self.ids, ids), (self.scores, scores)))


FOUND = "key long, course_id long, score double, postings long, opened long"


def _answered(limit: int, told: bool = True):
    """Arrow cogroup function: the rows of some shards and the questions of a block to their best texts there, and, if it is to be
    told, a row a shard of how much was opened.

    Questions of one group of words are answered together, each shard by what those before it have left to find; others one by one.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        stats: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            q = asked.column("q").combine_chunks()
            many = lambda field: pc.fill_null(pc.list_value_length(q.field(field)), 0).to_numpy(zero_copy_only=False)
            simple = (many("must") == 1) & (many("none") == 0) & (many("phrases") == 0)
            keys, least, last = (asked.column(c).to_numpy() for c in ("key", "least", "last"))
            together, others = np.flatnonzero(simple), np.flatnonzero(~simple)
            groups = q.field("must").take(pa.array(together)).flatten()
            words = groups.flatten().dictionary_encode()
            asks, word = np.repeat(np.arange(len(together)), pc.list_value_length(groups).to_numpy()), words.indices.to_numpy()
            best = Best(least[together], last[together], limit)
            number = rows.column("shard").to_numpy()
            for s in np.unique(number).tolist():
                shard = Shard(rows.filter(pa.array(number == s)))
                known = pa.array(list(shard.terms), pa.string())
                term = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()[word] if len(words) else word
                meets = WEIGHT * shard.longest.max(initial=0) >= best.least - 1e-9
                some = (term >= 0) & meets[asks]
                postings, opened = shard.tops(asks[some], term[some].astype(np.int64), best)
                if told:
                    for part, x in zip(stats, (keys[together][meets], postings[meets], opened[meets]), strict=True):
                        part.append(x)
                for at in range(0, len(others), READ):
                    mine = others[at : at + READ]
                    for key, question, reach in zip(keys[mine].tolist(), q.take(pa.array(mine)).to_pylist(), least[mine].tolist(), strict=True):
                        if WEIGHT * shard.longest.max(initial=0) < reach - 1e-9:
                            continue
                        ids, scores, total, seen = shard.top(question["must"], question["none"], question["phrases"], limit, reach)
                        for part, x in zip(out, (np.full(len(ids), key), ids, scores), strict=True):
                            part.append(x)
                        for part, x in zip(stats if told else (), ([key], [total], [seen]), strict=False):
                            part.append(np.array(x, dtype=np.int64))
            for part, x in zip(out, (keys[together][best.question], best.ids, best.scores), strict=True):
                part.append(x)
        flat = [np.concatenate([np.zeros(0, dtype=kind), *part]) for part, kind in zip([*out, *stats], ("i8", "i8", "f8", "i8", "i8", "i8"), strict=True)]
        best_rows = pa.table({"key": flat[0], "course_id": flat[1], "score": flat[2], "postings": pa.nulls(len(flat[0]), pa.int64()), "opened": pa.nulls(len(flat[0]), pa.int64())})
        counts = pa.table({"key": flat[3], "course_id": pa.nulls(len(flat[3]), pa.int64()), "score": pa.nulls(len(flat[3]), pa.float64()), "postings": flat[4], "opened": flat[5]})
        return pa.concat_tables([best_rows, counts])

    return run


def _asked(questions: DataFrame) -> DataFrame:
    """(key, q): each distinct question that something must stand for, its key the least query_id that asks it."""
    return questions.groupBy("question").agg(F.min("query_id").alias("key")).select("key", parsed("question").alias("q")).where("size(q.must) > 0")


def _best(found: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` texts of every key with their rank, ties by id."""
    by = Window.partitionBy("key").orderBy(F.col("score").desc(), "course_id")
    return found.where("course_id is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def answered(indexed: DataFrame, questions: DataFrame, limit: int = POOL, block: int = ASKED, told: bool = True) -> DataFrame:
    """(key, course_id, score, postings, opened): of some shards each the best texts of each distinct question, whose key is the least
    query_id that asks it; if it is to be told, a row without a course a shard has how many postings the question's terms have there,
    and how many were opened.

    Only the asked terms' rows are read, and each block of questions gets those of its own terms, with their places only if a question
    of several groups or with a phrase asks for the term. Blocks are large, as the index is shuffled once for each of them.

    Shards are met in rounds, those of the longest texts first. A text scores WEIGHT times its words at most, so a question meets a later
    shard only if the longest text there may reach the last of its best ``limit`` texts so far; there it opens what may reach it. Where
    a round has more shards than tasks are wanted, up to DECK of like lengths share a task and one copy of the questions.
    """
    given = cut(_asked(questions))  # the rules run once
    tops = cut(indexed.where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == "")).select("shard", F.col("most").alias("longest")))
    last = tops.agg(F.max("shard")).first()[0]
    several = (F.size("q.must") > 1) | (F.size("q.phrases") > 0)
    n, words, places = given.agg(F.count("*"), F.coalesce(F.sum(F.size(F.flatten("q.must"))), F.lit(0)), F.max(several)).first()
    found, read, done, to = None, given.withColumns({"least": F.lit(0.0), "last": F.lit(0).cast("long")}), 0, FIRST
    while True:
        enough = min(-(-n // READ), -(-TASKS // max(1, min(to, 1 + (last or 0)) - done)))
        blocks = max(1, -(-n // block), -(-words // WORDS), enough)
        parted = read.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        wanted = parted.select("part", several.alias("places_too"), F.explode(F.array_union(F.flatten("q.must"), F.array_append("q.none", ""))).alias("term"))
        wanted = wanted.groupBy("part", "term").agg(F.max("places_too").alias("places_too")).withColumn("bucket", _bucket(F.col("term")))
        here = (F.col("shard") >= done) & (F.col("shard") < to)
        deck = F.floor((F.col("shard") - done) / max(1, min(DECK, (min(to, 1 + (last or 0)) - done) * blocks // TASKS))).cast("int").alias("deck")
        held = F.when(F.col("places_too"), F.col("places")) if places else F.lit(None).cast("binary")
        rows = indexed.where(here).join(wanted, ["bucket", "term"]).withColumn("places", held).select(F.col("part").alias("part"), deck, *_NAMES)
        decks = tops.where(here).groupBy(deck).agg(F.max("longest").alias("longest"))
        met = parted.join(F.broadcast(decks), F.lit(WEIGHT) * F.col("longest") >= F.col("least") - 1e-9).select("part", "deck", "key", "q", "least", "last")
        more = rows.groupBy("part", "deck").cogroup(met.groupBy("part", "deck")).applyInArrow(_answered(limit) if told else _answered(limit, told=False), FOUND)
        over = last is None or to > last
        more = more if over else cut(more)
        found = more if found is None else found.unionByName(more)
        if over:
            return found
        least = _best(found, limit).where(F.col("rank") == limit).select("key", F.col("score").alias("least"), F.col("course_id").alias("last"))
        read = given.join(least, "key", "left").select("key", "q", F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("last", F.lit(0)).cast("long").alias("last"))
        done, to = to, to * GROWTH


def merged(found: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, course_id, score, rank): the shards' best texts of every question, the best first, ties by id."""
    top = _best(found, limit)
    asked = questions.groupBy("question").agg(F.min("query_id").alias("key"))
    named = questions.join(asked.withColumnRenamed("question", "same"), F.col("question") == F.col("same")).select("query_id", "key")
    return named.join(top, "key").select("query_id", "course_id", "score", "rank")


def search(indexed: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """The same rows as ``lexicon.search`` gives for the same texts and questions (query_id, question), from the stored index."""
    return merged(answered(indexed, questions, limit, told=False), questions, limit)


def opened(indexed: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """(key, postings, opened): of each distinct question's postings in the index, how many the search opens."""
    terms = _asked(questions).select("key", F.explode(F.array_distinct(F.flatten("q.must"))).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    known = indexed.select("bucket", "term", "n").join(terms, ["bucket", "term"]).groupBy("key").agg(F.sum("n").alias("postings"))
    seen = answered(indexed, questions, limit).where("course_id is null").groupBy("key").agg(F.sum("opened").alias("opened"))
    return seen.join(known, "key", "left").select("key", F.coalesce("postings", F.lit(0)).alias("postings"), "opened")


def hybrid_batch(vectors: DataFrame, indexed: DataFrame, questions: DataFrame, limit: int, pool: int = POOL) -> DataFrame:
    """(query_id, course_id, rrf, rank): vector and lexical lists, of ``pool`` rows each, of every question (query_id, question,
    embedding), fused by reciprocal rank, the best first, ties by id."""
    near = knn_batch(vectors, questions.select("query_id", "embedding"), pool)
    fused = fuse_by("query_id", near, search(indexed, questions.select("query_id", "question"), pool))
    by = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "course_id")
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def ask(chunk: DataFrame, indexed: DataFrame, questions: DataFrame, limit: int, width: int = 64, pool: int = POOL) -> DataFrame:
    """(query_id, course_id, rrf, rank) from the questions' texts alone (query_id, question): texts (course_id, text) and questions are
    embedded by the same model, and the words of a question, joined by or, are looked up in the stored index of the same texts."""
    questions = cut(questions.select("query_id", "question"))
    vectors = chunk.select("course_id", hashed_embedding(F.col("text"), width).alias("embedding"))
    words = F.array_join(F.array_distinct(tokens(F.col("question"))), " or ")
    asked = questions.select("query_id", words.alias("question"), hashed_embedding(F.col("question"), width).alias("embedding"))
    return hybrid_batch(vectors, indexed, asked, limit, pool)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, bucket int").parquet(path)

"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import cut
from .textblocks import LOWER, Words, blocks, byte_class, code_points

WINDOW = 10
#: Bytes of benchmark texts that one automaton holds, about 300 MB in a task; a larger benchmark is dealt into shares
#: of that size. Texts of 4 MB can't hold more distinct words than there are word numbers.
MOST_BYTES = 4 << 20


class Matcher:
    """Automaton over windows of word numbers. Numbers start above the surrogates, so that a text is a Python string."""

    BASE = 0xE000
    MOST_WORDS = 0x10FFFF - BASE
    OTHER = 0x20 - BASE  # stands for a word of no benchmark text

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.table = byte_class("alnum")
        texts = [text.encode() for _, text in items]
        offsets = np.cumsum([0, *map(len, texts)])
        words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, self.table)
        self.known, example, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > self.MOST_WORDS:
            raise ValueError("too many distinct benchmark words for one automaton; lower most_bytes")
        low = LOWER[words.data]
        self.words = [low[words.starts[i] : words.ends[i]].tobytes() for i in example]
        line = self._string(number)
        owners: dict[str, set[int]] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            for at in range(a, max(b - window + 1, min(a + 1, b))):
                owners.setdefault(line[at : min(at + window, b)], set()).add(i)
        self.ids = [item for item, _ in items]
        self.windows = [(len(k), sorted(v)) for k, v in owners.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, key in enumerate(owners):
            self.automaton.add_word(key, i)
        if owners:
            self.automaton.make_automaton()

    def _string(self, numbers: np.ndarray) -> str:
        return (numbers + self.BASE).astype("<u4").tobytes().decode("utf-32-le")

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """The block's words, and for each row with matches (row, [(first word, word after the last, window number)]).

        Words get their numbers by hash; where a window matches they are compared as they stand.
        """
        words = Words(data, offsets, self.table)
        found = []
        if self.windows and len(words.starts):
            hashes = words.hashes()
            number = np.searchsorted(self.known, hashes)
            number[number == len(self.known)] = 0
            known = self.known[number] == hashes
            line = self._string(np.where(known, number, self.OTHER))
            low = LOWER[data]
            same: dict[int, bool] = {}

            def stands(k: int) -> bool:
                if k not in same:
                    same[k] = low[words.starts[k] : words.ends[k]].tobytes() == self.words[number[k]]
                return same[k]

            for row in np.unique(np.searchsorted(words.first, np.flatnonzero(known), "right") - 1):
                start, end = int(words.first[row]), int(words.first[row + 1])
                hits = [(at - self.windows[k][0] + 1, at + 1, k) for at, k in self.automaton.iter(line, start, end)]
                if hits := [(a - start, b - start, k) for a, b, k in hits if all(map(stands, range(a, b)))]:
                    found.append((int(row), hits))
        return words, found


@lru_cache(maxsize=2)
def _matcher(items: tuple, window: int) -> Matcher:
    return Matcher(list(items), window)


def _joined(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch or overlap as one."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["first_word"], s["end_word"])):
        if out and span["first_word"] <= out[-1]["end_word"]:
            if span["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": span["end_word"], "end": span["end"]}
        else:
            out.append(dict(span))
    return out


def _scan(shared, window: int):
    """Arrow function: (doc_id, text, n_words, items, spans) with the share's hits added."""

    def run(batches):
        matcher = _matcher(shared.value, window)
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                words, found = matcher.scan(data, offsets)
                items, spans = ({} for _ in range(2))
                place = code_points(data) if found else None
                for row, hits in found:
                    items[row] = sorted({matcher.ids[i] for _, _, k in hits for i in matcher.windows[k][1]} | set(rows.column(3)[row].as_py()))
                    w, start = words.first[row], place[offsets[row]]
                    ends = {(a, b) for a, b, _ in hits}
                    mine = [{"first_word": a, "end_word": b, "start": int(place[words.starts[w + a]] - start), "end": int(place[words.ends[w + b - 1]] - start)} for a, b in ends]
                    spans[row] = _joined(mine + rows.column(4)[row].as_py())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(words.first)), _with(rows.column(3), items), _with(rows.column(4), spans)], _COLUMNS)

    return run


def _with(column: pa.Array, new: dict[int, list]) -> pa.Array:
    """The column with some rows replaced."""
    if not new:
        return column
    at = sorted(new)
    mask = np.zeros(len(column), dtype=bool)
    mask[at] = True
    kept, put = np.where(mask, 0, np.arange(len(column))), np.full(len(column), -1)
    put[at] = np.arange(len(at))
    both = pa.concat_arrays([column, pa.array([new[i] for i in at], column.type)])
    return both.take(pa.array(np.where(mask, len(column) + put, kept)))


_COLUMNS = ["doc_id", "text", "n_words", "items", "spans"]
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<first_word:long,end_word:long,start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, items, spans.

    Texts are lower-cased (A-Z) and split into runs of ASCII letters, digits and non-ASCII characters.
    Each ``window`` consecutive words of a benchmark text are one pattern; a shorter text is one
    pattern as a whole, a wordless one none. ``items`` are the sorted ids (as text) whose patterns
    occur, ``spans`` the merged hit ranges as word numbers and as character offsets into the text.

    The benchmark's size is checked: each ``most_bytes`` of its texts are one share, broadcast and scanned
    for by one automaton in one pass; a benchmark of one share (the usual case) means one scan of the
    documents. Passes follow one another and each adds its hits to the row, with a checkpoint between
    two, so that no executor holds more than one automaton for each of its tasks.

    Null ids and rows that repeat are kept as they are; a null text has no words. Items with a null
    id or text are skipped, items that repeat an id count once. An empty table gives no rows, an empty
    benchmark no hits. Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    found = given.withColumns({"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast(_SPANS_SQL)})
    for number, share in enumerate(_shares(benchmark, item_col, most_bytes)):
        found = (cut(found) if number else found).mapInArrow(_scan(_shared(share), window), f"doc_id {kind}, text string, n_words long, items array<string>, spans {_SPANS_SQL}")
    return found.drop("text")


def _shares(benchmark: DataFrame, item_col: str, most_bytes: int) -> list[DataFrame]:
    """(item, body) of the benchmark, dealt by hashed item into shares of about ``most_bytes``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").alias("body")).where("item is not null and body is not null")
    total = items.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    n = -(-total // most_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def _shared(items: DataFrame):
    rows = items.distinct().collect()
    return items.sparkSession.sparkContext.broadcast(tuple(sorted((r["item"], r["body"]) for r in rows)))


def _clean(shared, window: int, text: str):
    def run(batches):
        matcher = _matcher(shared.value, window)
        for batch in batches:
            for rows, data, offsets in blocks(batch, text):
                keep = np.ones(len(offsets) - 1, dtype=bool)
                keep[[row for row, _ in matcher.scan(data, offsets)[1]]] = False
                yield rows.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark pattern; a null text stays. The benchmark is dealt as in ``contamination``."""
    for number, share in enumerate(_shares(benchmark, item_col, most_bytes)):
        docs = (cut(docs) if number else docs).mapInArrow(_clean(_shared(share), window, text_col), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))

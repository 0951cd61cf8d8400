"""Fuzzy line dedup: character-shingle MinHash, banded buckets, exact Jaccard, distributed union-find."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .clusters import BUCKETS, bucket_links, combined, components, cut, distinct_by_row, hub_join, release
from .textblocks import LOWER, U64, Words, blocks, mix, runs, stream

SHINGLE, BANDS, ROWS, PERCENT = 8, 10, 4, 80

_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False
_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[[0x20, *range(0x09, 0x0E)]] = False


class Lines:
    """The lines of a block that aren't blank, without white space at their ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        raw = Words(data, offsets, _NOT_NEWLINE)
        starts, ends = raw.starts, raw.ends
        while len(loose := np.flatnonzero((starts < ends) & ~_VISIBLE[data[np.minimum(starts, len(data) - 1)]])):
            starts[loose] += 1
        while len(loose := np.flatnonzero((starts < ends) & ~_VISIBLE[data[ends - 1]])):
            ends[loose] -= 1
        some = starts < ends
        self.starts, self.ends = starts[some], ends[some]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        self.number = breaks[self.starts] - breaks[offsets[self.row]]
        self.data = data

    @cached_property
    def hashes(self) -> np.ndarray:
        return Words.spanning(self.data, self.starts, self.ends).hashes()

    @cached_property
    def _shingles(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The hash of the eight characters from each character of the block on, and each byte's character number (None: the same)."""
        data = LOWER[self.data]
        place = None
        if len(data) and data.max() > 0x7F:
            place = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum((data & 0xC0) != 0x80, out=place[1:])
            data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        value = np.zeros(len(data) + SHINGLE, dtype=U64)
        value[: len(data)] = data
        for k, factor in enumerate(_FACTORS):  # 2, then 4, then 8 characters
            more = value[: -1 << k] * factor
            more += value[1 << k :]
            value = more
        value = value[: len(data)]
        value ^= value >> U64(29)
        value *= _FACTORS[0]
        value ^= value >> U64(32)
        return value, place

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into which) of each shingle of eight characters; a shorter line has one, of itself."""
        value, place = self._shingles
        starts, ends = self.starts[which], self.ends[which]
        if place is not None:
            starts, ends = place[starts], place[ends]
        number = np.maximum(ends - starts - SHINGLE + 1, 1)
        values = value[runs(starts, number)]
        short = np.flatnonzero(ends - starts < SHINGLE)
        values[(np.cumsum(number) - number)[short]] = mix(self.hashes[which[short]] + U64(99))
        return values, np.repeat(np.arange(len(which)), number)


_FACTORS = stream(41, 3) | U64(1)


def _occurrences(batches):
    for batch in batches:
        for rows, data, offsets in blocks(batch):
            lines = Lines(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(lines.row)), pa.array(lines.number), pa.array(lines.hashes.view(np.int64))], ["doc_id", "line_no", "node"])


def _banded(batches):
    def signed():
        for batch in batches:
            for _, data, offsets in blocks(batch, most=1 << 18):
                lines = Lines(data, offsets)
                nodes, which = np.unique(lines.hashes, return_index=True)
                grams, owner = lines.grams(which)
                signature, _ = minhash.signatures(grams, owner, len(which), BANDS * ROWS)
                yield nodes.view(np.int64), minhash.bands(signature, ROWS)

    yield from combined(signed())


def _wanted_bodies(batches):
    """Arrow function: (doc_id, text, wanted) to (node, body) of the lines that are wanted."""
    for batch in batches:
        for rows, data, offsets in blocks(batch):
            lines = Lines(data, offsets)
            wanted = rows.column(rows.schema.get_field_index("wanted"))
            asked = wanted.flatten().to_numpy().view(U64)
            asked_row = np.repeat(np.arange(rows.num_rows), wanted.value_lengths().to_numpy())
            # a line is asked for if its hash is, in the same row
            keys = mix(asked + asked_row.astype(U64) * U64(0x9E3779B97F4A7C15))
            mine = mix(lines.hashes + lines.row.astype(U64) * U64(0x9E3779B97F4A7C15))
            which = np.flatnonzero(np.isin(mine, keys))
            _, one = np.unique(lines.hashes[which], return_index=True)
            which = which[one]
            starts, sizes = lines.starts[which], lines.ends[which] - lines.starts[which]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            body = pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(data[runs(starts, sizes)])])
            yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[which].view(np.int64)), body.cast(pa.string())], ["node", "body"])


def _expand(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines to their distinct shingle hashes and rows; each body is one line."""
    parts, at = [], 0
    for rows, data, offsets in blocks(pa.RecordBatch.from_arrays([bodies], ["text"])):
        lines = Lines(data, offsets)
        grams, owner = lines.grams(np.arange(len(lines.starts)))
        parts.append(distinct_by_row(grams, lines.row[owner] + at))
        at += rows.num_rows
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))


def _rewrite(text_at: int, dropped_at: int):
    """Arrow function: the rows, their text column without the lines that ``dropped`` numbers."""

    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(text_at), batch.column(dropped_at), strict=True):
                if gone.is_valid:
                    numbers = set(gone.as_py())
                    out.append("\n".join(line for i, line in enumerate((text.as_py() or "").split("\n")) if i not in numbers))
                else:
                    out.append(text.as_py())
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(out, batch.schema.field(text_at).type))

    return run


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, dropped): the numbers, from 0, of each document's lines that another line stands for.

    Lines are compared with A-Z lower-cased and without white space at their ends; blank ones are left
    alone. Two lines link when their sets of eight-character shingles (a shorter line is its own) overlap by
    ``percent`` hundredths of their union, confirmed on the whole sets of lines that share one of 10 bands of
    4 bins (a link at 0.8 is missed with odds of 0.5 %, at 0.85 of 0.1 %). Of each component of lines the first by (doc_id,
    line number) stays. Equal lines are folded before, so a line that stands in a third of all documents
    costs a count; only hashes and counts of lines are shuffled, and texts only for lines with a candidate.

    Documents without such lines, and those with a null id or text, have no row. Rows that repeat an
    id and a text count as one document. An empty table gives no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    lines = cut(given.mapInArrow(_occurrences, "doc_id long, line_no long, node long"))
    first = cut(lines.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")))

    def bodies_of(nodes: DataFrame) -> DataFrame:
        homes = first.join(nodes, "node").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("node").alias("wanted"))
        return given.join(homes.hint("shuffle_hash"), "doc_id").mapInArrow(_wanted_bodies, "node long, body string").dropDuplicates(["node"])

    found = cut(components(bucket_links(given.mapInArrow(_banded, BUCKETS), bodies_of, _expand, percent)).withColumnRenamed("id", "node").join(first, "node"))
    release(docs.sparkSession)
    keepers = found.groupBy("component").agg(F.min("first").alias("keeper"))
    linked = found.join(keepers, "component").select("node", "keeper", "n")
    repeated = first.where("n > 1").join(linked, "node", "left_anti").select("node", F.col("first").alias("keeper"), "n")
    known = cut(linked.unionByName(repeated))
    gone = hub_join(lines, known, "node", lines.count()).where((F.col("doc_id") != F.col("keeper.doc_id")) | (F.col("line_no") != F.col("keeper.line_no")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "dropped", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the lines that go, and ``dropped_col``: their numbers, null without any."""
    if dropped_col in docs.columns:
        raise ValueError(f"{dropped_col} is a column of the table; name another dropped_col")
    gone = duplicate_lines(docs, id_col, text_col, **options).withColumnRenamed("dropped", dropped_col)
    key = next(f"key{i}" for i in range(len(docs.columns) + 2) if f"key{i}" not in [*docs.columns, dropped_col])
    joined = docs.join(gone.withColumnRenamed("doc_id", key).hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(key), "left").select(*docs.columns, dropped_col)
    return joined.mapInArrow(_rewrite(docs.columns.index(text_col), len(docs.columns)), joined.schema)


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the lines that go; a document of which nothing but blank lines is left goes too, unless it was so before."""
    out = without_duplicate_lines(docs, id_col, text_col, dropped_col := "dropped" if "dropped" not in docs.columns else "dropped_lines", **options)
    return out.where(F.col(dropped_col).isNull() | F.col(text_col).rlike(r"[^\x20\t-\r]")).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = without_duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\n]*[^\x20\t-\r][^\n]*"), F.lit(0))).cast("long")
    return rewritten.select("doc_id", lines.alias("n_kept"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

"""Best-fit packing: token pieces into sequences by vector best-fit over residual capacities."""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import cut

CAPACITY = 2048
END_ID = 0


@lru_cache(maxsize=2)
def _encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of ``byte_bpe_50k.json`` from its rank file, with the json's added tokens."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take in more than their own text")
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


#: White space that the encoder's pattern walks back over, in runs so long that its stack may not hold them.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


def token_ids(text: str, ranks_path: str | None = None, added: bool = False) -> list[int]:
    """The ids and an end id. With ``added``, the json's added tokens (<|endoftext|>) get their ids wherever
    they stand, as by default in the tokenizers library; without, they are text like any other.

    In a long run of white space the pattern parts all but the last character, or all at the text's end, as one token's
    text; such runs are parted here and go past the pattern, so that one of any length can be encoded.
    """
    encoder = _encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encode = (lambda t: encoder.encode(t, allowed_special="all")) if added else encoder.encode_ordinary
    if len(text) < 65536 or not _LONG_SPACE.search(text):
        return [*encode(text), END_ID]
    names = sorted(encoder.special_tokens_set) if added else []
    ids: list[int] = []
    for part in re.split(f"({'|'.join(map(re.escape, names))})", text) if names else [text]:
        at = 0
        for run in _LONG_SPACE.finditer(part):
            end = run.end() - (run.end() < len(part))
            ids += encode(part[at : run.start()])
            ids += encoder._encode_single_piece(part[run.start() : end])
            at = end
        ids += encode(part[at:])
    return [*ids, END_ID]


def _pieces(capacity: int, ranks_path: str | None):
    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = np.array(token_ids(text.as_py() or "", ranks_path, added=True), dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at, piece, start, length, crc = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def plan(counts: dict[int, int], capacity: int, most_docs: int, most_cost: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.5), rule: str = "dot") -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit over length classes: (length, first rank, ranks, first sequence, copies, offset) of each slot.

    A piece of n tokens asks for (n, 1, n * n) of a sequence's (tokens, documents, attention cost). An
    open sequence takes, among the classes that fit every residual, the one of greatest weighted dot
    product with the residual ('dot') or of least weighted residual norm after it ('norm'). The filled
    pattern is repeated as often as its classes last, so the work depends on the number of lengths.
    Ranks first .. first + ranks - 1 of a length fill ``copies`` places in a row of each sequence.
    """
    full = np.array([capacity, most_docs, most_cost], dtype=float)
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[n] for n in lengths], dtype=np.int64)
    asks = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    share, weight = asks / full, np.array(weights)
    rank, sequence, slots = np.zeros_like(left), 0, []
    while left.any():
        used, residual, order = np.zeros_like(left), np.array([capacity, most_docs, most_cost], dtype=np.int64), []
        while True:
            fits = (asks <= residual).all(axis=1) & (left > used)
            if not fits.any():
                break
            now = residual / full
            score = share @ (weight * now) if rule == "dot" else -(weight * (now - share) ** 2).sum(axis=1)
            k = int(np.flatnonzero(fits)[np.argmax(score[fits])])
            # as long as the class stays the best it is taken again; the residuals only shrink
            used[k] += 1
            residual -= asks[k]
            if order and order[-1][0] == k:
                order[-1][1] += 1
            else:
                order.append([k, 1])
        if not order:
            raise ValueError("a piece exceeds a sequence's capacities")
        times = int((left[used > 0] // used[used > 0]).min())
        offset = 0
        for k, copies in order:
            slots.append((int(lengths[k]), int(rank[k]), times * copies, sequence, copies, offset))
            rank[k] += times * copies
            offset += int(lengths[k]) * copies
        left -= used * times
        sequence += times
    return slots


def _assign(shared):
    def run(batches):
        slots = shared.value
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            within = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + within // slot[:, 4], slot[:, 5] + within % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in _KEPT), pa.array(sequence), pa.array(offset)], [*_KEPT, "sequence_id", "offset"])

    return run


_KEPT = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_docs: int | None = None, most_cost: int | None = None, rule: str = "dot", ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text becomes its token ids and an end id; a null or empty text is the end id alone. Only texts
    of more than ``capacity`` ids are cut, their first piece taking the remainder. Pieces go into
    sequences by vector best-fit under the token, document-count and attention-cost capacities (by
    default the last two bind no sequence that the first allows).

    Only the number of pieces of each length, at most ``capacity`` numbers, reaches the driver, which
    plans on them; pieces get their rank among those of their length from counts by partition, and
    the plan, a few slots for each length, turns ranks into places. No piece is dropped and every
    sequence is gapless from offset 0.

    Null ids and repeated rows are packed like any other; an empty table gives no rows; other columns
    are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(capacity, ranks_path), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"))
    placed = pieces.withColumn("part", F.spark_partition_id())
    by_part = cut(placed.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(plan(totals, capacity, most_docs or capacity, most_cost or capacity * capacity, rule=rule)), dtype=np.int64).reshape(-1, 6)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.select("part", "length", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = placed.withColumn("local", local).join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    return ranked.select(*_KEPT, "rank").mapInArrow(_assign(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

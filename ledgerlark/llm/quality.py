"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent semantic space."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import U64, Words, blocks, byte_class, mix, windows

#: Bounds of the fit: labelled rows, terms, latent dimensions, voters, and bytes in a block.
MOST_LABELLED, TERMS, RANK, NEIGHBOURS, BLOCK = 4096, 1024, 64, 15, 1 << 20
_TRIGRAMS, _WORDS = 640, 320  # hashed terms; the last 64 stand for the shape of a text: repetition, word and line lengths

_NEWLINES = np.ones(256, dtype=bool)
_NEWLINES[0x0A] = False


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of damped term rates over the whole texts: hashed character trigrams (as bytes) and words; then shape terms, 0 or 1."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, TERMS), dtype=np.float32)
    trigram = windows(data) & U64(0xFFFFFF)
    inside = row[:-2] == row[2:] if len(row) > 2 else np.zeros(0, dtype=bool)
    term = (mix(trigram[: len(inside)] + U64(77)) % U64(_TRIGRAMS)).astype(np.int64)
    out[:, :_TRIGRAMS] = np.bincount((row[: len(inside)] * _TRIGRAMS + term)[inside], minlength=n * _TRIGRAMS).reshape(n, _TRIGRAMS) / np.maximum(sizes, 1)[:, None]
    shape = out[:, _TRIGRAMS + _WORDS :]
    for at, table in ((0, byte_class("space")), (16, _NEWLINES)):
        words = Words(data, offsets, table)
        number = np.diff(words.first)
        owner = np.repeat(np.arange(n), number)
        hashes = words.hashes()
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=n)
        repeated = 1 - distinct / np.maximum(number, 1)
        long = np.bincount(owner, weights=words.ends - words.starts, minlength=n) / np.maximum(number, 1)
        shape[np.arange(n), at + np.minimum((repeated * 8).astype(int), 7)] = 1
        shape[np.arange(n), at + 8 + np.minimum(np.log2(long + 1).astype(int), 7)] = 1
        if not at:
            term = (hashes % U64(_WORDS)).astype(np.int64)
            out[:, _TRIGRAMS : _TRIGRAMS + _WORDS] = np.bincount(owner * _WORDS + term, minlength=n * _WORDS).reshape(n, _WORDS) / np.maximum(number, 1)[:, None]
            again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            again = np.bincount(owner[1:][again], minlength=n) / np.maximum(number, 1)
            shape[np.arange(n), 56 + np.minimum((again * 16).astype(int), 7)] = 1
    upper = np.bincount(row, weights=(data >= 0x41) & (data <= 0x5A), minlength=n) / np.maximum(sizes, 1)
    shape[np.arange(n), 32 + np.minimum((upper * 8).astype(int), 7)] = 1
    shape[np.arange(n), 40 + np.minimum(np.log2(sizes + 1).astype(int), 15)] = 1
    out[:, : _TRIGRAMS + _WORDS] = np.log1p(out[:, : _TRIGRAMS + _WORDS] * 1000)
    return out


def _features(batches):
    for batch in batches:
        for rows, data, offsets in blocks(batch, most=BLOCK):
            counts = term_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.tobytes() for x in counts.astype(np.float16)], pa.binary())], ["quality", "counts"])


class Model:
    """Term weights, a projection to the latent space, and the labelled vectors there."""

    def __init__(self, counts: np.ndarray, quality: np.ndarray, rank: int = RANK):
        self.quality = quality.astype(np.float64)
        # a term's weight: how far the labels' means lie apart, in deviations within a label, over the term's own deviation
        groups = [counts[quality == label] for label in (0, 1)]
        self.weight = np.ones(counts.shape[1], dtype=np.float32)
        if all(map(len, groups)):
            spread = np.sqrt(sum(g.var(axis=0) * len(g) for g in groups) / len(counts)) + 1e-3 * (1 + counts.std(axis=0))
            apart = np.abs(groups[1].mean(axis=0) - groups[0].mean(axis=0)) / spread
            self.weight = (apart / spread).astype(np.float32)
        self.centre = counts.mean(axis=0, dtype=np.float64).astype(np.float32) if len(counts) else np.zeros(counts.shape[1], dtype=np.float32)
        self.projection = np.zeros((counts.shape[1], 1), dtype=np.float32)
        if len(counts):
            x = self._weighted(counts)
            _, vectors = np.linalg.eigh(x.T @ x)
            self.projection = np.ascontiguousarray(vectors[:, ::-1][:, : min(rank, len(counts))], dtype=np.float32)
        self.vectors = self.latent(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = (counts - self.centre) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def latent(self, counts: np.ndarray) -> np.ndarray:
        y = self._weighted(counts) @ self.projection
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among each row's nearest labelled vectors, by exact cosine, weighted by similarity.

        Similarities are compared to five places, and all that tie with the last neighbour vote, so the
        order of the labelled rows doesn't matter.
        """
        if not len(self.quality):
            return np.full(len(counts), 0.5)
        near = np.round(self.latent(counts) @ self.vectors.T, 5)
        k = min(neighbours, near.shape[1])
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        row, voter = np.nonzero(near >= last[:, None])
        weight = np.maximum(near[row, voter], 1e-6).astype(np.float64) ** 8
        n = len(counts)
        return np.bincount(row, weights=weight * self.quality[voter], minlength=n) / np.bincount(row, weights=weight, minlength=n)


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch, most=BLOCK):
                parts = [slice(i, min(i + 512, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 512)]
                scores = [model.score(term_counts(data[offsets[p.start] : offsets[p.stop]], offsets[p.start : p.stop + 1] - offsets[p.start])) for p in parts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most_labelled`` labelled rows, those of least hashed id; null labels and ids are skipped.

    An id with both labels counts as unlabelled; of several texts of one id the least is taken. The bound
    holds what reaches the driver: a label and 2 KB of term counts for each row.
    """
    known = labels.select(F.col(id_col).cast("long").alias("key"), F.col("quality").cast("int").alias("quality")).where("key is not null and quality in (0, 1)")
    known = known.groupBy("key").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most_labelled).collect()
    spark = docs.sparkSession
    small = spark.createDataFrame([(r["key"], r["quality"]) for r in chosen], "key long, quality int")
    text = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    given = text.join(F.broadcast(small), "key").groupBy("key", "quality").agg(F.min("text").alias("text"))
    rows = given.select("quality", "text").mapInArrow(_features, "quality int, counts binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["counts"]), bytes(r["counts"]), r["quality"]))
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(r["counts"], dtype=np.float16)
    quality = np.array([r["quality"] for r in rows], dtype=np.int64)
    del rows
    return Model(counts, quality)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score from 0 to 1, higher where label 1 is likelier.

    A whole text becomes damped rates of hashed character trigrams and words, and shape terms, weighted by
    how well each parts the labels and projected to the latent space. Its exact cosines with all labelled
    vectors, which are broadcast and bounded by the fit, pick 15 neighbours and all that tie with the last,
    whose labels vote by similarity. A null text is empty; a model without labels gives 0.5. Null ids and repeated rows keep a row each; an empty
    table gives none; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(shared, least: float, text: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch, text, most=BLOCK):
                for p in (slice(i, min(i + 512, len(offsets) - 1)) for i in range(0, len(offsets) - 1, 512)):
                    score = model.score(term_counts(data[offsets[p.start] : offsets[p.stop]], offsets[p.start : p.stop + 1] - offsets[p.start]))
                    yield rows.slice(p.start, p.stop - p.start).filter(pa.array(score >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more; without labels all stay. Columns keep their names and values."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    return docs.mapInArrow(_keep(shared, least, text_col), docs.schema)

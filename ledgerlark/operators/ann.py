"""An inverted-file index over vectors: a coarse quantiser fitted on a bounded sample, every row indexed, recall measured."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import _nearest, knn_batch

#: Most vectors of the sample that the quantiser is fitted on, most cells, vectors of a cell that meet queries at once.
SAMPLE, CELLS, BLOCK = 20_000, 1024, 65_536


@dataclass(frozen=True)
class Quantiser:
    """Unit centroids of the cells, and how many of the nearest cells a query looks into."""

    centroids: np.ndarray
    probes: int


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector that isn't zero, those vectors at unit length)."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    vectors = [np.asarray(v, dtype=float) for v in column.take(pa.array(rows)).to_pylist()]
    good = [i for i, v in enumerate(vectors) if len(v) and np.isfinite(v).all() and v.any()]
    if not good:
        return np.zeros(0, dtype=int), np.zeros((0, 0))
    x = np.stack([vectors[i] for i in good])
    return rows[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, k: int = 10, recall: float = 0.95, sample: int = SAMPLE, most_cells: int = CELLS, rounds: int = 8) -> Quantiser:
    """Cells by spherical k-means over at most ``sample`` vectors, those of least hashed id, and the number of cells to look
    into: the least that finds ``recall`` of the k nearest of a twentieth of the sample within the sample.

    The sample is bounded, so it may meet on the driver. Cells are about the square root of the sample's size.
    """
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("course_id"), "course_id").limit(sample).select("embedding").toArrow()
    _, x = _units(rows.column("embedding").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())))
    if not len(x):
        return Quantiser(np.zeros((0, 0)), 0)
    cells = int(min(most_cells, max(1, np.sqrt(len(x)))))
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.maximum(size, 1e-300), centroids)
    own = (x @ centroids.T).argmax(axis=1)
    asked = x[:: max(1, len(x) // max(1, len(x) // 20))]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # place[q, c]: how near the query cell c is
    found = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1
    return Quantiser(centroids, min(cells, probes + 1))


def _cells(shared, most: int | None):
    """Arrow function: (id, embedding) to (id, embedding, cell), one row for each of the ``most`` nearest cells (None: the quantiser's probes)."""

    def run(batches):
        quantiser = shared.value
        for batch in batches:
            rows, x = _units(batch.column(1))
            if len(rows):
                n = quantiser.probes if most is None else most
                cell = np.argsort(-(x @ quantiser.centroids.T), axis=1, kind="stable")[:, :n]
                kept = batch.take(pa.array(np.repeat(rows, n)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.ravel(), pa.int32())], ["id", "embedding", "cell"])

    return run


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(id, embedding, cell) of every vector that isn't null or zero; to be written partitioned by cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)
    return _asked(vectors.select(F.col("course_id").alias("id"), "embedding"), shared, 1)


def _asked(rows: DataFrame, shared, most: int | None) -> DataFrame:
    return rows.mapInArrow(_cells(shared, most), "id long, embedding array<double>, cell int")


def search(indexed: DataFrame, queries: DataFrame, quantiser: Quantiser, limit: int, block: int = BLOCK) -> DataFrame:
    """(query_id, course_id, distance, rank): the nearest rows among those of each query's cells, ties by id.

    A cell of any size is dealt into blocks of about ``block`` rows, each of which meets the cell's queries.
    """
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))  # at most CELLS rows
    asked = _asked(queries.select(F.col("query_id").alias("id"), "embedding"), shared, None).join(F.broadcast(sizes), "cell")
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").groupBy("cell", "part")
    right = indexed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").groupBy("cell", "part")
    near = left.cogroup(right).applyInArrow(_nearest(limit), "query_id long, course_id long, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", "course_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def recall(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hits, exact): how many of each query's exact k nearest rows the index finds, over all rows."""
    quantiser = fit(vectors.select("course_id", F.col("embedding").cast("array<double>").alias("embedding")), k)
    doubles = lambda df: df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = search(index(doubles(vectors), quantiser), doubles(queries), quantiser, k)
    exact = knn_batch(vectors, queries, k).select("query_id", "course_id")
    both = exact.join(found.select("query_id", "course_id", F.lit(1).alias("hit")), ["query_id", "course_id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("exact"))

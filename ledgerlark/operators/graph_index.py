"""A graph index over vectors: one navigable graph for each shard of rows, beam search for many queries, and a merge of partial top-k.

Rows are dealt into shards of a bounded size by hashed id. A shard's graph links each row to near rows that no nearer link leads to,
and to some far ones; a sample of its rows are entries, and also the centres of cells, which give the shard an
inverted file beside the graph. Shards are built and searched apart, so the work is linear in the rows, and a query's answer is the best of all
shards' answers. A shard with few rows is searched exactly.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import cut
from .retrieval import FEW, QUERY_BLOCK, TASKS, knn_batch

#: Rows of a shard on average; links kept of a row's own and in all; candidates for them; far links; rows for one entry.
SHARD, OWN, LINKS, NEAR, FAR, ENTRY = 12_500, 24, 48, 64, 8, 32
#: Longer detours that a link may save; a beam's width; cells that are looked into; rows below which a shard is searched exactly.
ALPHA, BEAM, PROBES, EXACT = 1.2, 64, 12, 512
METHODS = ("exact", "cells", "graph")


def _pruned(x: np.ndarray, near: np.ndarray, own: int, alpha: float) -> np.ndarray:
    """Of each row's candidates ``near`` (the nearest first), up to ``own`` (-1: none): a candidate goes if a link taken before it is nearer to
    it, by the factor alpha, than the row is. Rows go through this in chunks, candidates of all of a chunk at once."""
    out = np.full((len(near), own), -1, dtype=np.int32)
    chunk = max(1, (1 << 24) // (near.shape[1] * x.shape[1] + 1))
    for at in range(0, len(near), chunk):
        some = near[at : at + chunk]
        points = x[some]
        mine = 2 - 2 * np.einsum("nd,ncd->nc", x[at : at + len(some)], points)
        between = 2 - 2 * points @ points.transpose(0, 2, 1)
        alive = np.arange(at, at + len(some))[:, None] != some
        rows = np.arange(len(some))
        for k in range(own):
            first = alive.argmax(axis=1)
            left = alive[rows, first]
            out[at + rows[left], k] = some[left, first[left]]
            alive &= (alpha * alpha * between[rows, first] > mine) & left[:, None]
            alive[rows, first] = False
            if not alive.any():
                break
    return out


def _linked(x: np.ndarray, seed: int) -> np.ndarray:
    """Links of each row (-1: none): pruned near ones in both directions, and far ones by chance."""
    n = len(x)
    c = min(NEAR, n - 1)
    near = np.empty((n, c), dtype=np.int32)
    for at in range(0, n, 1024):
        product = x[at : at + 1024] @ x.T
        product[np.arange(len(product)), np.arange(at, at + len(product))] = -np.inf
        best = np.argpartition(-product, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(product, best, axis=1), axis=1, kind="stable")
        near[at : at + 1024] = np.take_along_axis(best, order, axis=1)
    own = _pruned(x, near, min(OWN, c), ALPHA)
    source, k = np.nonzero(own >= 0)
    pairs = np.stack([np.concatenate([source, own[source, k]]), np.concatenate([own[source, k], source])])
    pairs = np.unique(pairs, axis=1)
    close = np.einsum("nd,nd->n", x[pairs[0]], x[pairs[1]]) if x.shape[1] * pairs.shape[1] < 1 << 28 else np.concatenate([np.einsum("nd,nd->n", x[a], x[b]) for a, b in zip(np.array_split(pairs[0], 64), np.array_split(pairs[1], 64), strict=True)])
    pairs = pairs[:, np.lexsort((-close, pairs[0]))]
    first = np.searchsorted(pairs[0], np.arange(n))
    place = np.arange(pairs.shape[1]) - first[pairs[0]]
    links = np.full((n, LINKS), -1, dtype=np.int32)
    kept = place < LINKS - FAR
    links[pairs[0][kept], place[kept]] = pairs[1][kept]
    links[:, LINKS - FAR :] = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return links


NODE = "shard int, node int, id long, embedding array<float>, links array<int>, cell int"


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector of the first one's width that isn't zero and is finite, those vectors at unit length)."""
    column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, dtype=int)
    width = next((int(n) for n in sizes if n), 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    rows = np.flatnonzero((sizes == width) & column.is_valid().to_numpy(zero_copy_only=False)) if width else np.zeros(0, dtype=int)
    starts = np.cumsum(sizes) - sizes
    x = flat[starts[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, max(width, 1)), dtype=np.float32)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good] / np.linalg.norm(x[good].astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _built(key, table):
    """Arrow function: a shard's rows (shard, id, embedding) to its nodes."""
    rows, x = _units(table.column("embedding"))
    shard = key[0].as_py()
    if not len(x):
        return pa.table({"shard": pa.array([], pa.int32()), "node": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "links": pa.array([], pa.list_(pa.int32())), "cell": pa.array([], pa.int32())})
    n, width = x.shape
    centre = x[::ENTRY]
    cell = np.concatenate([(x[at : at + 4096] @ centre.T).argmax(axis=1) for at in range(0, n, 4096)]).astype(np.int32)
    links = _linked(x, shard) if n > EXACT else np.full((n, LINKS), -1, dtype=np.int32)
    listed = lambda flat, w: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(flat.ravel()))
    return pa.table({"shard": pa.array(np.full(n, shard, dtype=np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)), "id": table.column("id").take(pa.array(rows)), "embedding": listed(x, width), "links": listed(links, LINKS), "cell": pa.array(cell)})


def build(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(shard, node, id, embedding, links, cell) of every vector (course_id, embedding) that isn't null, zero or without end; to be written by shard."""
    given = vectors.where("course_id is not null and embedding is not null").select(F.col("course_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    shards = F.lit(max(1, round(given.count() / shard_rows)))
    return given.withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("int")).groupBy("shard").applyInArrow(_built, NODE)


def write(vectors: DataFrame, path: str, shard_rows: int = SHARD) -> None:
    build(vectors, shard_rows).write.partitionBy("shard").parquet(path)


class Shard:
    """One shard's nodes, and three ways to find those nearest to a query of unit length; each gives node numbers and cosines."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("node").combine_chunks()
        n = table.num_rows
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        self.ids, self.x, self.links = table.column("id").to_numpy(), flat("embedding").reshape(n, -1), flat("links").reshape(n, -1)
        cell = table.column("cell").to_numpy()
        self.entries = np.arange(0, n, ENTRY)
        self.centres = self.x[self.entries]
        self.members = np.argsort(cell, kind="stable")
        self.first = np.searchsorted(cell[self.members], np.arange(len(self.entries) + 1))
        self.cell, self.radius = cell, None

    def exact(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        near = self.x @ q
        best = np.argpartition(-near, k - 1)[:k] if k < len(near) else np.arange(len(near))
        return best, near[best]

    def cells(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        near = self.centres @ q
        nodes = np.concatenate([self.members[self.first[c] : self.first[c + 1]] for c in np.argsort(-near)[:PROBES]])
        near = self.x[nodes] @ q
        best = np.argsort(-near, kind="stable")[:k]
        return nodes[best], near[best]

    def graph(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From the nearest entries on, the links of the nearest rows not yet followed, until the beam's rows have all been."""
        if len(self.x) <= EXACT:
            return self.exact(q, k)
        width = max(BEAM, 2 * k)
        near = self.centres @ q
        some = np.argsort(-near)[:4]
        nodes, near = self.entries[some], near[some]
        seen = np.zeros(len(self.x), dtype=bool)
        seen[nodes] = True
        done = np.zeros(len(nodes), dtype=bool)
        while not done.all():
            to = np.flatnonzero(~done)[:4]  # sorted by nearness
            done[to] = True
            new = np.unique(self.links[nodes[to]])
            new = new[new >= 0]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            nodes, near = np.concatenate([nodes, new]), np.concatenate([near, self.x[new] @ q])
            done = np.concatenate([done, np.zeros(len(new), dtype=bool)])
            order = np.argsort(-near, kind="stable")[:width]
            nodes, near, done = nodes[order], near[order], done[order]
        return nodes[:k], near[:k]

    def checked(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The graph's rows, then all rows of each cell that may hold nearer ones: no angle to a row is less than that to its cell's centre
        less the cell's widest. So the answer is exact, and the nearer the graph's rows are, the fewer cells are read."""
        nodes, near = self.graph(q, k)
        if len(self.x) <= EXACT:
            return nodes, near
        if self.radius is None:
            own = np.concatenate([np.einsum("nd,nd->n", self.x[at : at + 4096], self.centres[self.cell[at : at + 4096]]) for at in range(0, len(self.x), 4096)])
            self.radius = np.zeros(len(self.centres))
            np.maximum.at(self.radius, self.cell, np.arccos(np.clip(own, -1, 1)))
        reach = np.arccos(np.clip(near[-1], -1, 1)) if len(near) >= k else np.pi
        open_ = np.flatnonzero(np.arccos(np.clip(self.centres @ q, -1, 1)) - self.radius <= reach + 2e-3)
        nodes = np.unique(np.concatenate([nodes, *[self.members[self.first[c] : self.first[c + 1]] for c in open_]]))
        near = self.x[nodes] @ q
        best = np.argsort(-near, kind="stable")[:k]
        return nodes[best], near[best]


FOUND = "query_id long, course_id long, distance double, ms double"


def _answered(limit: int, method: str):
    """Arrow cogroup function: a shard's nodes and queries (query_id, embedding) to each query's nearest rows and the time it took here."""

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if nodes.num_rows and asked.num_rows:
            shard = Shard(nodes)
            rows, q = _units(asked.column("embedding"))
            query_ids = asked.column("query_id").to_numpy()[rows]
            for query_id, one in zip(query_ids, q if q.shape[1] == shard.x.shape[1] else [], strict=False):
                began = time.perf_counter()
                best, _ = getattr(shard, method)(one, limit)
                took = 1000 * (time.perf_counter() - began)
                distance = np.round(1 - shard.x[best].astype(float) @ one.astype(float), 9) + 0.0
                for part, x in zip(out, (np.full(len(best), query_id), shard.ids[best], distance, np.full(len(best), took)), strict=True):
                    part.append(x)
        flat = [np.concatenate([np.zeros(0, dtype=kind), *part]) for part, kind in zip(out, ("i8", "i8", "f8", "f8"), strict=True)]
        return pa.table(dict(zip(("query_id", "course_id", "distance", "ms"), flat, strict=True)))

    return run


def answered(indexed: DataFrame, queries: DataFrame, limit: int, method: str = "graph", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, course_id, distance, ms): of each shard the nearest rows to every query (query_id, embedding), found by one of METHODS
    or by ``Shard.checked``.

    Queries meet a shard in blocks, so that neither side of a task grows with both tables. The nodes are shuffled once for each block of
    queries, so blocks are large, but where there would be few tasks.
    """
    shards, n = indexed.select("shard").distinct(), queries.count()
    blocks = F.lit(max(1, -(-n // block), min(-(-n // FEW), -(-TASKS // max(1, shards.count())))))
    asked = queries.where("embedding is not null").select(F.col("query_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.pmod(F.xxhash64("query_id"), blocks.cast("long")).alias("part"))
    numbers = sorted(r["shard"] for r in shards.collect())  # one number for each SHARD rows
    every = F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<int>")).alias("shard")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("part")
    left = indexed.select("*", parts).groupBy("shard", "part")
    return left.cogroup(asked.select("*", every).groupBy("shard", "part")).applyInArrow(_answered(limit, method), FOUND)


def merged(found: DataFrame, limit: int) -> DataFrame:
    """(query_id, course_id, distance, rank) of the shards' partial answers: the nearest first, ties by id."""
    by = Window.partitionBy("query_id").orderBy("distance", "course_id")
    return found.select("query_id", "course_id", "distance").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def search(indexed: DataFrame, queries: DataFrame, limit: int, method: str = "graph") -> DataFrame:
    return merged(answered(indexed, queries, limit, method), limit)


def recall(indexed: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, method: str = "graph") -> DataFrame:
    """(query_id, hits, exact): how many of each query's exact k nearest rows the index finds, over all rows; rows as near as the last
    of the exact ones count, whichever of them is listed."""
    return hits(knn_batch(vectors, queries, k), search(indexed, queries, k, method))


def hits(exact: DataFrame, found: DataFrame) -> DataFrame:
    """The same of answers that are there already."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("exact"))
    near = last.join(found, "query_id", "left")
    return near.groupBy("query_id", "exact").agg(F.count_if(F.col("distance") <= F.col("last") + 1e-6).alias("hits")).select("query_id", "hits", "exact")


def synthetic(spark: SparkSession, rows: int, width: int, centroids: int = 64, seed: int = 7) -> DataFrame:
    """(course_id, embedding): unit vectors around a number of centroids, the same in every run; for measurements, not for queries."""

    def made(batches):
        centre = np.random.default_rng(seed).normal(size=(centroids, width))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = np.stack([centre[i % centroids] + np.random.default_rng(int(i)).normal(size=width) for i in ids]).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(x.ravel()))], ["course_id", "embedding"])

    return spark.range(rows).withColumnRenamed("id", "course_id").mapInArrow(made, "course_id long, embedding array<float>")


def crossover(vectors: DataFrame, queries: DataFrame, sizes: list[int], k: int, store, shard_rows: int = SHARD) -> list[dict]:
    """A row for each size and method: rows, build seconds, median milliseconds of a question, recall; and the least size at which the
    method's median is under that of exact search (None: at no size).

    A size takes the vectors of least hashed id. A question's time is that of its slowest shard, as shards answer side by side; each shard
    answers one question at a time. ``store`` gives a new folder for each size.
    """
    rows = []
    for n in sizes:
        some = vectors.where("embedding is not null").orderBy(F.xxhash64("course_id"), "course_id").limit(n)
        folder, began = store(), time.perf_counter()
        write(some, folder, shard_rows)
        built = time.perf_counter() - began
        indexed = some.sparkSession.read.parquet(folder)
        nearest = cut(knn_batch(indexed.select(F.col("id").alias("course_id"), "embedding"), queries, k))  # once for all methods
        for method in METHODS:
            found = cut(answered(indexed, queries, k, method))  # for its times and for its recall
            time_of = found.groupBy("query_id").agg(F.max("ms").alias("ms"))
            median = time_of.agg(F.median("ms").alias("ms")).first()["ms"]
            hit = hits(nearest, merged(found, k)).agg(F.sum("hits").alias("hits"), F.sum("exact").alias("exact")).first()
            rows.append({"n": n, "method": method, "build_sec": round(built, 2) if method != "exact" else 0.0, "median_ms": round(median or 0.0, 3), "recall": round((hit["hits"] or 0) / max(hit["exact"] or 0, 1), 4)})
    exact = {r["n"]: r["median_ms"] for r in rows if r["method"] == "exact"}
    for r in rows:
        r["overtakes_at"] = next((x["n"] for x in rows if x["method"] == r["method"] != "exact" and x["median_ms"] < exact[x["n"]]), None)
    return rows

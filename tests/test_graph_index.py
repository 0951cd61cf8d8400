"""The graph index: recall against exact search, its pruning against a plain version, and the cases that break an index."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import graph_index as gi

SF = "/root/testdata/sf0.01"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "course_id long, embedding array<float>")


def clustered(n, width=16, centres=12, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, width))[rng.integers(0, centres, n)] * 2 + rng.normal(size=(n, width))


def test_pruning():
    x = clustered(80).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:31].astype(np.int32)
    d = lambda a, b: float(np.linalg.norm(x[a] - x[b]))
    for i, links in enumerate(gi._pruned(x, near, 8, 1.2)):
        kept = []
        for c in near[i]:
            if len(kept) < 8 and all(1.2 * d(p, c) > d(i, c) - 1e-5 for p in kept):
                kept.append(int(c))
        assert [int(v) for v in links if v >= 0] == kept


@pytest.mark.parametrize("method", gi.METHODS)
@pytest.mark.parametrize("shard_rows", [700, 10_000])
def test_recall(spark, tmp_path, method, shard_rows):
    x = clustered(2500)
    vectors = table(spark, x)
    gi.write(vectors, str(tmp_path / "index"), shard_rows)
    indexed = spark.read.parquet(str(tmp_path / "index"))
    queries = vectors.where("course_id % 20 = 0").select(F.col("course_id").alias("query_id"), "embedding")
    found = gi.recall(indexed, vectors, queries, 10, method).collect()
    assert len(found) == 125 and all(r["exact"] == 10 for r in found)
    assert sum(r["hits"] for r in found) >= (1250 if method == "exact" else 1200)
    first = {r["query_id"]: r["course_id"] for r in gi.search(indexed, queries, 3, method).where("rank = 1").collect()}
    assert first == {q: q for q in range(0, 2500, 20)}


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, []), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "course_id long, embedding array<float>, shard long")
    gi.write(vectors, str(tmp_path / "index"))
    indexed = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r["id"] for r in indexed.collect()) == [1, 1, 6, 8]
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["course_id"], r["distance"]) for r in gi.search(indexed, queries.where("query_id < 4"), 3).orderBy("query_id", "rank").collect()] == [(1, 1, 0.0), (1, 1, 0.0), (1, 6, 0.0)]
    assert gi.build(vectors.limit(0)).count() == 0 and gi.search(gi.build(vectors.limit(0)), queries, 3).count() == 0


def test_equal_vectors_are_found(spark, tmp_path):
    x = np.concatenate([np.tile(clustered(1), (900, 1)), clustered(900, seed=5)])
    gi.write(table(spark, x), str(tmp_path / "index"))
    indexed = spark.read.parquet(str(tmp_path / "index"))
    queries = table(spark, x[1700:1710], 1700).withColumnRenamed("course_id", "query_id")
    assert {r["course_id"] for r in gi.search(indexed, queries, 1).collect()} == set(range(1700, 1710))
    near = gi.search(indexed, table(spark, x[:1]).withColumnRenamed("course_id", "query_id"), 10).collect()
    assert len(near) == 10 and all(r["distance"] < 1e-6 for r in near)


def test_crossover_series(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("course_id"), "embedding")
    queries = vectors.where("course_id % 20 = 0").select(F.col("course_id").alias("query_id"), "embedding").limit(15)
    folders = iter(range(9))
    rows = gi.crossover(vectors, queries, [100, 600], 10, lambda: str(tmp_path / str(next(folders))))
    assert [(r["n"], r["method"]) for r in rows] == [(n, m) for n in (100, 600) for m in gi.METHODS]
    assert all(r["recall"] >= 0.9 and r["median_ms"] > 0 for r in rows) and all(r["overtakes_at"] in (None, 100, 600) for r in rows)


def test_cells_bounds_complete_what_the_graph_misses():
    """A graph without links finds its entries only; the check after it finds all."""
    x = np.random.default_rng(5).normal(size=(2000, 8)).astype(np.float32)
    given = pa.table({"shard": pa.array(np.zeros(len(x), dtype=np.int32)), "id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    nodes = gi._built((pa.scalar(0, pa.int32()),), given)
    none = pa.array([[-1] * gi.LINKS] * len(x), pa.list_(pa.int32()))
    shard = gi.Shard(nodes.set_column(nodes.column_names.index("links"), "links", none))
    for q in shard.x[::100]:
        exact = set(shard.exact(q, 10)[0].tolist())
        assert set(shard.checked(q, 10)[0].tolist()) == exact and set(shard.graph(q, 10)[0].tolist()) != exact

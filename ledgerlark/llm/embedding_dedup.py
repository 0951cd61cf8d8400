"""Embedding near-dedup: int8 tile products with an error bound for each vector, and full precision where they can't decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import components, cut, hub_join

THRESHOLD, TILE = 0.98, 4096
_STRIPE = 512  # rows of a tile whose products are held at once


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as unit vectors in double precision) for each width; vectors that can't link are left out.

    A vector is divided by its greatest component first, so that its norm neither over- nor underflows.
    """
    column = column.cast(pa.large_list(pa.float64())) if len(column) else column
    if not len(column):
        return []
    values = column.flatten()
    width = column.value_lengths().fill_null(0).to_numpy()
    start = np.cumsum(width) - width
    plain = values.fill_null(np.nan).to_numpy()
    out = []
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        x = plain[start[rows][:, None] + np.arange(w)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good][:, None]
        out.append((rows[good], x / np.sqrt((x * x).sum(axis=1))[:, None]))
    return out


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes from -127 to 127, scale, error) of each row, where error is the exact norm of unit - scale * codes."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.linalg.norm(unit - scale[:, None] * codes, axis=1)


def _coded(batches):
    """Arrow function: (vec_id, label, embedding) to those that can link, with int8 codes, their scale and error."""
    for batch in batches:
        usable = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for rows, unit in _matrices(batch.column(2)):
            rows, unit = rows[usable[rows]], unit[usable[rows]]
            codes, scale, error = quantised(unit)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], ["vec_id", "label", "embedding", "codes", "scale", "error"])


class _Found:
    """Links of a task between rows of its table: a count for each vector, and no more edges than join the linked."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.of = np.unique(ids, return_inverse=True)
        self.total = np.zeros(len(self.ids), dtype=np.int64)
        self.root = np.arange(len(self.ids))
        self.edges = [np.zeros((2, 0), dtype=np.int64)]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.of[x], self.of[y]
        if (a == b).any():
            a, b = a[a != b], b[a != b]
        n = len(self.ids)
        self.total += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        while len(a):
            left, right = self.root[a], self.root[b]
            apart = left != right
            a, b, left, right = a[apart], b[apart], left[apart], right[apart]
            # the first pair of each upper root joins it to a lower one; what is still apart comes again
            upper, first = np.maximum(left, right), np.full(n, -1)
            first[upper[::-1]] = np.arange(len(a))[::-1]
            first = first[first >= 0]
            self.edges.append(np.stack([a[first], b[first]]))
            parent = np.arange(n)
            parent[upper[first]] = np.minimum(left, right)[first]
            while (parent != (up := parent[parent])).any():
                parent = up
            self.root = parent[self.root]

    def rows(self) -> list[np.ndarray]:
        """Columns a, b, n: a count of each linked vector (b null as -1), then the edges."""
        some, edges = np.flatnonzero(self.total), np.concatenate(self.edges, axis=1)
        none = np.full(len(some), -1)
        return [self.ids[np.concatenate([some, edges[0]])], np.append(none, edges[1]), np.append(self.total[some], np.zeros(edges.shape[1], dtype=np.int64))]


def _tiles(table: pa.Table):
    """For each width in a pair of tiles: (rows on the left, on the right, stripes). A stripe is (row on the left from,
    products of codes, their slack) for up to 512 rows; within one tile only pairs above the diagonal are to be used."""
    side, scale, error = (table.column(c).to_numpy() for c in ("side", "scale", "error"))
    codes = table.column("codes").combine_chunks()
    width = np.diff(np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1])
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()

    def stripes(left, right, w):
        # codes and their sums are whole numbers that single precision holds for widths up to 1040
        kind = np.float32 if w <= 1040 else np.float64
        p, q = (np.frombuffer(b"".join(codes.take(pa.array(x)).to_pylist()), dtype=np.int8).reshape(-1, w).astype(kind) for x in (left, right))
        for at in range(0, len(left), _STRIPE):
            m = left[at : at + _STRIPE]
            rough = (p[at : at + _STRIPE] @ q.T).astype(np.float64) * (scale[m][:, None] * scale[right][None, :])
            # |u.v - (s p).(t q)| <= |u - s p| |t q| + |u| |v - t q|, and |t q| <= 1 + |v - t q|; both
            # numbers are the same whichever of the two is on the left
            slack = (error[m][:, None] + error[right][None, :]) + error[m][:, None] * error[right][None, :] + 1e-12
            if one:
                rough[np.arange(len(m))[:, None] + at >= np.arange(len(right))[None, :]] = -np.inf
            yield at, rough, slack

    for w in np.unique(width):
        left, right = np.flatnonzero((width == w) & (side == 0)), np.flatnonzero((width == w) & (side == (0 if one else 1)))
        if len(left) and len(right):
            yield left, right, stripes(left, right, int(w))


def _output(table: pa.Table, found: _Found, still_open: np.ndarray) -> pa.Table:
    a, b, n = found.rows()
    b = pa.array(found.ids[b] if len(found.ids) else b, mask=b < 0)
    rows = table.select(["label", "i", "j", "side", "row"]).take(pa.array(still_open))
    columns = [pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x, pa.nulls(len(a), x.type)]) for x in rows.columns]
    rest = [pa.concat_arrays([pa.nulls(len(still_open), pa.int64()), pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x.cast(pa.int64())]) for x in (a, b, n)]
    return pa.table([*columns, *rest], names=["label", "i", "j", "side", "row", "a", "b", "n"])


def _sure(threshold: float):
    """Arrow function over the codes of a pair of tiles: links that the bounds prove, and the rows with a pair that they leave open."""

    def run(table: pa.Table) -> pa.Table:
        found = _Found(table.column("vec_id").to_numpy())
        still_open = np.zeros(table.num_rows, dtype=bool)
        for left, right, stripes in _tiles(table):
            for at, rough, slack in stripes:
                x, y = np.nonzero(rough - slack >= threshold)
                found.add(left[at + x], right[y])
                x, y = np.nonzero((rough + slack >= threshold) & (rough - slack < threshold))
                still_open[left[at + x]] = still_open[right[y]] = True
        return _output(table, found, np.flatnonzero(still_open))

    return run


def _exact(threshold: float):
    """Arrow function over the open rows of a pair of tiles, with their vectors: the links among the pairs left open."""

    def run(table: pa.Table) -> pa.Table:
        found = _Found(table.column("vec_id").to_numpy())
        unit = {int(row): vector for rows, vectors in _matrices(table.column("embedding").combine_chunks()) for row, vector in zip(rows, vectors, strict=True)}
        for left, right, stripes in _tiles(table):
            a, b = np.stack([unit[k] for k in left.tolist()]), np.stack([unit[k] for k in right.tolist()])
            for at, rough, slack in stripes:
                x, y = np.nonzero((rough + slack >= threshold) & (rough - slack < threshold))
                for part in range(0, len(x), 1 << 16):
                    m, n = at + x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                    linked = np.einsum("ij,ij->i", a[m], b[n]) >= threshold
                    found.add(left[m[linked]], right[n[linked]])
        return _output(table, found, np.zeros(0, dtype=np.int64))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their widths are equal, and their cosine in
    double precision is ``threshold`` or more. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing, nor do those with a null id or label.

    The vectors of a label are dealt by hashed row into tiles of about ``tile``, so a label of any size
    spreads over many tasks, each of which holds two tiles. Only int8 codes are dealt, with each vector's
    scale and the exact norm of its quantisation error, which bounds how far a product of codes can be from
    the cosine. Pairs that the bound proves are counted there; of pairs it leaves open, only the vectors,
    never the pairs, are listed, fetched and multiplied in double precision in a second round. A task
    returns a count for each vector and no more edges than join the linked ones.

    ``n_links`` counts the other vectors linked directly; ``component_id`` is the least id reachable,
    the row's own included (null for a null id). Rows that repeat an id are one vertex: their vectors'
    links add up, and links between them don't count. An empty table gives no rows; other columns are
    ignored.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    kind, listed = (given.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    coded = cut(given.mapInArrow(_coded, f"vec_id long, label {kind}, embedding {listed}, codes binary, scale double, error double").withColumn("row", F.monotonically_increasing_id()))
    sizes = cut(coded.groupBy("label").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tiled = hub_join(coded.drop("embedding"), sizes, "label", total).withColumn("own", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    dealt = tiled.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "row", "vec_id", "codes", "scale", "error")
    out = f"label {kind}, i int, j int, side int, row long, a long, b long, n long"
    sure = cut(dealt.groupBy("label", "i", "j").applyInArrow(_sure(threshold), out))
    fetched = sure.where("row is not null").select("label", "i", "j", "side", "row").join(coded.drop("label"), "row")
    found = sure.unionByName(cut(fetched.groupBy("label", "i", "j").applyInArrow(_exact(threshold), out))).where("row is null")
    counts = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "vec_id")
    out = given.select("vec_id").join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

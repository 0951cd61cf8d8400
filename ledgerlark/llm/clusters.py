"""Distributed union-find over edges, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .textblocks import U64, blocks


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local one is set once, in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor and are not computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that no live plan reads; Spark frees them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


#: A key with more than one in HUBS of all rows is a hub. By arithmetic there are fewer than HUBS, so they can be broadcast.
HUBS = 500


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over ``edges``; ids without an edge to another id are absent.

    Alternating large-star and small-star steps: each is one aggregation and one join on the node, and the
    number of steps grows with the logarithm of the components' size. Edges of hubs meet the hub's least
    neighbour by a broadcast of at most 500 hubs, so that neither a component nor a hub's edges meet in one task.
    Null ends are ignored, repeated edges and loops change nothing, and an empty input gives no rows.
    """
    links = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    while not (state := _state(links))["stars"]:
        total, parts = state["links"], 1 + state["links"] // LINKS_IN_PART
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _beside_least(both, 2 * total, state["most"], F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        small = _beside_least(large, total, state["most_up"], F.min("v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        links = cut(small.where("u != v").coalesce(parts).distinct().coalesce(parts))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Links of a partition, at least; fewer links than shuffle partitions would make files of a few bytes.
LINKS_IN_PART = 1 << 18


def _state(links: DataFrame) -> Row:
    """stars: whether each u has one v and no v is a u; the number of links; the most that a vertex has, in all and as u."""
    ends = links.select("u", F.lit(1).alias("n")).unionByName(links.select(F.col("v").alias("u"), F.lit(None).cast("int").alias("n")))
    seen = ends.groupBy("u").agg(F.count("n").alias("up"), F.count_if(F.col("n").isNull()).alias("down"))
    crossed = F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") > 0))
    most = lambda x: F.coalesce(F.max(x), F.lit(0))
    return seen.agg((crossed == 0).alias("stars"), F.coalesce(F.sum("up"), F.lit(0)).alias("links"), most(F.col("up") + F.col("down")).alias("most"), most("up").alias("most_up")).first()


def _beside_least(ends: DataFrame, total: int, most: int, least: Column) -> DataFrame:
    """``ends`` (u, v), each with m, the ``least`` of its u; there are at most ``total`` rows, and at most ``most`` of one u."""
    known = ends.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    joined = hub_join(ends, known, "u", total) if most > _hub(total) else ends.join(known, "u")
    return joined.select("u", "v", "m")


def _hub(total: int) -> int:
    return total // HUBS + 8


def hub_join(rows: DataFrame, known: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``known``, one row of each key with n, its number of rows.

    Keys with more than one in HUBS of all rows, of which there can't be more than HUBS, come by broadcast, so that
    their rows stay where they are; the others meet by a shuffle. ``rows`` is read twice.
    """
    hubs = F.broadcast(known.where(F.col("n") > _hub(total)))
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(known, key))


#: Texts of a batch to (grams, row of each): hashes of the sets that links compare, as ``distinct_by_row`` gives them.
Expand = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


_KEY_BITS = U64(48)
_ROWS = 1 << 16


def distinct_by_row(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted by row (as given) and hash. Their upper 48 bits count, the others become zero."""
    parts = []
    for at in range(0, int(row[-1]) + 1 if len(row) else 0, _ROWS):
        inside = slice(*np.searchsorted(row, [at, at + _ROWS]))
        keys = np.sort((row[inside] - at).astype(U64) << _KEY_BITS | grams[inside] >> U64(16))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        keys = keys[new]
        parts.append((keys << U64(16), (keys >> _KEY_BITS).astype(np.int64) + at))
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (grams, row)


#: Rows of the buckets that ``combined`` gives.
BUCKETS = "band long, node long, others array<long>"
#: Nodes whose bands are grouped before the shuffle; star members that meet their centre in one stretch of a task.
GROUPED_NODES, STAR_MEMBERS = 1 << 16, 4096


def combined(signed: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(nodes, keys of each node's bands) to rows (band, node, others): one for each band of a stretch of a task.

    ``node`` is the least of the stretch's nodes with that band, ``others`` the others, null without any. This
    is the combination before the shuffle: a band that many nodes share sends one row per stretch.
    """
    nodes, keys, size = [], [], 0
    for some, their in signed:
        nodes.append(some)
        keys.append(their)
        size += len(some)
        if size >= GROUPED_NODES:
            yield _grouped(np.concatenate(nodes), np.concatenate(keys))
            nodes, keys, size = [], [], 0
    if size:
        yield _grouped(np.concatenate(nodes), np.concatenate(keys))


def _grouped(nodes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    nodes, which = np.unique(nodes.astype(np.int64), return_index=True)
    flat = keys[which].ravel()
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], nodes[order // keys.shape[1]]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    rest = np.diff(np.append(np.flatnonzero(first), len(flat))) - 1
    ends = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(rest == 0, False)), pa.array(owner[~first]))
    return pa.RecordBatch.from_arrays([pa.array(flat[first].view(np.int64)), pa.array(owner[first]), others], ["band", "node", "others"])


def _compared(expand: Expand, percent: int):
    """Arrow function: (centre, share, head, node, body), a centre's own row before its members', to confirmed (a, b)."""

    def run(batches):
        held, centre = np.zeros(0, dtype=U64), None  # grams of the centre that the next rows may belong to
        for batch in batches:
            for rows in (part.slice(at, _ROWS >> 1) for part, _, _ in blocks(batch, "body", most=1 << 19) for at in range(0, part.num_rows, _ROWS >> 1)):
                heads, centres = rows.column(2).to_numpy(zero_copy_only=False), rows.column(0).to_numpy()
                grams, row = expand(rows.column(4))
                n = rows.num_rows
                group = np.cumsum(heads)  # 0: the centre held
                size = np.bincount(row, minlength=n)
                of_head = heads[row]
                keys = group[row].astype(U64) << _KEY_BITS | grams >> U64(16)
                known = np.concatenate([held >> U64(16), keys[of_head]])  # sorted, as groups and each row's hashes are
                mine = keys[~of_head]
                at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                both = np.bincount(row[~of_head][known[at] == mine] if len(known) else [], minlength=n)
                sizes = np.concatenate([[len(held)], size[heads]])
                enough = ~heads & (100 * both >= percent * (size + sizes[group] - both))
                assert not (~heads & (group == 0)).any() or centre == centres[0]
                yield pa.RecordBatch.from_arrays([rows.column(3).filter(pa.array(enough)), rows.column(0).filter(pa.array(enough))], ["a", "b"])
                if heads.any():
                    last = int(np.flatnonzero(heads)[-1])
                    held, centre = grams[row == last], int(centres[last])

    return run


def confirmed(stars: DataFrame, bodies: DataFrame, expand: Expand, percent: int) -> DataFrame:
    """Those star edges (a, b), b the centre (a table that is cut, as it is read twice), whose nodes' bodies (node, body) have sets that overlap enough.

    A body goes once to each centre it may link with, and a centre's own body once to each 4096 of its members.
    """
    shares = stars.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(STAR_MEMBERS)).cast("int").alias("shares"))
    members = hub_join(stars, shares, "b", stars.count()).select(F.col("a").alias("node"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(False).alias("head"))
    centres = shares.select(F.col("b").alias("node"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("head"))
    dealt = members.unionByName(centres).join(bodies, "node").select("centre", "share", "head", "node", "body")
    return dealt.repartition("centre", "share").sortWithinPartitions("centre", "share", F.desc("head")).mapInArrow(_compared(expand, percent), "a long, b long")


def bucket_links(buckets: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], expand: Expand, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join all nodes of ``buckets`` (``combined``) that share a band and overlap enough.

    A bucket gives star-shaped candidate edges, each node to the bucket's least one, not all pairs.
    ``bodies_of`` gives (node, body) for the nodes of stars, ``expand`` their whole sets, on which the
    stars are confirmed. Where that leaves a bucket's other nodes in several components, those outside the
    largest one are compared with the rest in blocks of a bounded size, so that no link hangs on the choice
    of centre; a block returns no more links than join its components. Buckets of one centre (one for each
    band at most) are compared as one, of those with the same nodes only one is, and those of one block
    share a task's call in packs.
    """
    bucket = Window.partitionBy("band")
    shared = buckets.select("*", F.min("node").over(bucket).alias("centre"), F.max("node").over(bucket).alias("top")).where("centre < top or others is not null")
    every_node = F.explode(F.concat(F.array("node"), F.coalesce("others", F.array().cast("array<long>")))).alias("node")
    spread = cut(shared.select("band", "centre", every_node).distinct())
    release(buckets.sparkSession)
    stars = cut(spread.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    bodies = cut(bodies_of(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()))
    release(buckets.sparkSession)
    star_of = cut(components(confirmed(stars, bodies, expand, percent)).withColumnRenamed("id", "node"))
    links = star_of.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    members = spread.where("node != centre").select("centre", "node").distinct()
    left = members.join(star_of, "node", "left").select("centre", "node", F.coalesce("component", "node").alias("component"))
    several = left.groupBy("centre").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("y"), F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
    chosen = several.groupBy("n", "x", "y").agg(F.min("centre").alias("centre"))
    unequal = hub_join(left, chosen.select("centre", "n"), "centre", stars.count()).drop("n")
    sized = cut(unequal.join(bodies.select("node", F.octet_length("body").alias("size")), "node"))
    parts = sized.groupBy("centre", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    total = parts.groupBy("centre").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", "component")).alias("main_bytes"))
    block = lambda n, size: F.ceil(F.greatest(n / F.lit(BLOCK_NODES), size / F.lit(BLOCK_BYTES), F.lit(1.0))).cast("int")
    total = total.select("centre", "n", F.col("top.component").alias("main"), block(F.col("n"), F.col("bytes")).alias("columns"), block(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("main_bytes")).alias("rows"))
    placed = cut(hub_join(sized, total, "centre", sized.count()).drop("n"))
    single = (F.col("rows") == 1) & (F.col("columns") == 1)
    small = placed.where(single).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    packs = F.lit(1 + max(small["n"] // BLOCK_NODES, small["bytes"] // BLOCK_BYTES)).cast("long")
    pack = F.when(single, -1 - F.pmod(F.xxhash64("centre"), packs)).otherwise(F.pmod("centre", F.lit(2**63 - 1).cast("long")))
    rows = placed.drop("size").withColumn("pack", pack).join(bodies, "node")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.where("component != main").select("*", every("columns").alias("other"))
    whole = rows.select("*", every("rows").alias("other"))
    shown = lambda df, side, i, j: df.select("pack", "centre", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "node", "component", "body")
    dealt = shown(outside, 0, mine("rows"), F.col("other")).unionByName(shown(whole, 1, F.col("other"), mine("columns")))
    return links.unionByName(dealt.groupBy("pack", "i", "j").applyInArrow(_block_links(expand, percent), "a long, b long"))


BLOCK_NODES, BLOCK_BYTES, _COLUMNS = 512, 4 << 20, 4096
#: Bytes of a pack's buckets whose sets are held at once.
PACK_BYTES = 1 << 20


def _overlaps(left: np.ndarray, right: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``left`` with those of rows ``right``."""
    n = len(left) + len(right)
    side, place = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    side[left] = True
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    on_left = side[owner]
    both, number = np.unique(grams, return_inverse=True)
    shared = (np.bincount(number[on_left], minlength=len(both)) > 0) & (np.bincount(number[~on_left], minlength=len(both)) > 0)
    use = shared[number]
    column, owner, on_left = (np.cumsum(shared) - 1)[number[use]], owner[use], on_left[use]
    order = np.argsort(column, kind="stable")
    column, owner, on_left = column[order], owner[order], on_left[order]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, total := int(shared.sum()), _COLUMNS):
        cut_ = slice(*np.searchsorted(column, [at, at + _COLUMNS]))
        c, o, l = column[cut_] - at, owner[cut_], on_left[cut_]  # noqa: E741
        wide = min(_COLUMNS, total - at)
        x, y = np.zeros((len(left), wide), dtype=np.float32), np.zeros((len(right), wide), dtype=np.float32)
        x[place[o[l]], c[l]] = 1
        y[place[o[~l]], c[~l]] = 1
        overlap += x @ y.T
    return overlap.astype(np.int64)


def _block_links(expand: Expand, percent: int):
    """Arrow function over one block, or a pack of buckets of one block each: links between components, as few as join them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("centre").combine_chunks()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        out = []
        centres = table.column("centre").to_numpy()
        starts = np.concatenate([np.flatnonzero(np.append(True, centres[1:] != centres[:-1])) if len(centres) else [0], [len(centres)]])
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(table.column("body")), 0).to_numpy())])
        at = 0
        while at < len(starts) - 1:  # buckets of some bytes at a time, as their sets are many times their texts
            to = max(at + 1, int(np.searchsorted(size[starts], size[starts[at]] + PACK_BYTES, "right")) - 1)
            links(table.slice(starts[at], starts[to] - starts[at]), root, parent, out)
            at = to
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    def links(table: pa.Table, root: Callable[[int], int], parent: dict[int, int], out: list[tuple[int, int]]) -> None:
        centre, side, node, component = (table.column(c).to_numpy() for c in ("centre", "side", "node", "component"))
        flat, owner = expand(table.column("body").combine_chunks())
        size = np.bincount(owner, minlength=len(node))
        bounds = np.concatenate([[0], np.flatnonzero(centre[1:] != centre[:-1]) + 1, [len(centre)]])
        inside = np.searchsorted(owner, bounds)
        for start, end, first, last in zip(bounds[:-1], bounds[1:], inside[:-1], inside[1:], strict=True):
            left, right = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end] == 1)
            overlap = _overlaps(left - start, right - start, flat[first:last], owner[first:last] - start)
            enough = 100 * overlap >= percent * (size[left][:, None] + size[right][None, :] - overlap)
            for i, j in zip(*np.nonzero(enough & (component[left][:, None] != component[right][None, :])), strict=True):
                x, y = root(int(component[left[i]])), root(int(component[right[j]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(node[left[i]]), int(node[right[j]])))

    return run

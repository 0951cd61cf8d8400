"""Hybrid retrieval: exact vector search, lexical search, reciprocal-rank fusion, reranking and filter intersection."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..functions.vectors import cosine_distance
from ..schemas import POOL, RRF_K


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank: the cut is a distributed top-k, the window sees only its rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def knn(vectors: DataFrame, query: list[float], limit: int = POOL) -> DataFrame:
    """Exact nearest rows by cosine distance, ties by id."""
    near = vectors.select("course_id", cosine_distance(F.col("embedding"), F.array(*map(F.lit, query))).alias("distance")).where("distance is not null")
    return ranked(near, [F.col("distance"), F.col("course_id")], limit)


#: Vectors and queries that meet in one task at most, tasks that there should be if there are queries for them, queries of a task at least.
BLOCK, QUERY_BLOCK, TASKS, FEW = 65536, 16384, 48, 256


def _true(mask: np.ndarray) -> np.ndarray:
    """Where a mask, as one row, is true; it is so at few places, so eight are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _nearest(limit: int, step: int = 16384, most: int = 256, pairs: int = 1 << 22):
    """Arrow cogroup function: each query's nearest rows of a block. Products in single precision pick the rows that may be among them,
    with room for their error; the distances of these are taken in double precision, so they don't depend on the block."""

    def unit(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = block.column("id").to_numpy()
        rows = block.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        size = np.sqrt((rows * rows).sum(axis=1))
        good = np.isfinite(size) & (size > 0)
        return ids[good], rows[good] / size[good, None]

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        (query_ids, queries), (ids, rows) = unit(asked), unit(block)
        best = [(np.array([], dtype="i8"), np.array([], dtype="f8"))] * len(query_ids)
        width = queries.shape[1]
        room = 1e-8 + 4 * (width + 2) * float(np.finfo(np.float32).eps)
        least = np.full(len(query_ids), -np.inf)
        asked32 = queries.astype(np.float32)
        for at in range(0, len(ids) if len(query_ids) else 0, step):
            part, of = rows[at : at + step], ids[at : at + step]
            part32, k = part.astype(np.float32).T, min(limit, len(of))
            for to in range(0, len(query_ids), most):
                product = asked32[to : to + most] @ part32
                if not at and k == limit:
                    least[to : to + most] = np.partition(product, len(of) - k, axis=1)[:, len(of) - k] - room
                of_query, of_row = np.divmod(_true(product >= least[to : to + most, None]), len(of))
                some = max(1, pairs // max(width, 1))
                near = [1 - (part[of_row[i : i + some]] * queries[to + of_query[i : i + some]]).sum(axis=1) for i in range(0, len(of_row), some)]
                distance = np.round(np.concatenate([np.zeros(0), *near]), 9) + 0.0
                bounds = np.searchsorted(of_query, np.arange(min(most, len(query_ids) - to) + 1))
                for i in np.flatnonzero(np.diff(bounds)):
                    mine = slice(bounds[i], bounds[i + 1])
                    held_ids, held = np.concatenate([best[to + i][0], of[of_row[mine]]]), np.concatenate([best[to + i][1], distance[mine]])
                    first = np.lexsort((held_ids, held))[:limit]
                    best[to + i] = held_ids[first], held[first]
                    if len(first) == limit:
                        least[to + i] = max(least[to + i], 1 - held[first[-1]] - room)
        flat = lambda arrays, kind: np.concatenate([np.array([], dtype=kind), *arrays])
        return pa.table({"query_id": flat([np.full(len(near), q) for q, (near, _) in zip(query_ids, best, strict=True)], "i8"), "course_id": flat([x for x, _ in best], "i8"), "distance": flat([x for _, x in best], "f8")})

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, limit: int = POOL, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest rows of every query (query_id, embedding): distance to nine places, ties by id, zero vectors out.

    Each block of queries meets each block of vectors in one task, which keeps the best ``limit`` rows a
    query over products of smaller parts; the blocks' rows are merged by query. The work is that of all
    queries against all rows. What is shuffled are the vectors once for each block of queries and the queries once for each
    block of vectors: a block of queries is large, but where there would be few tasks.
    """
    blocks, asked = -(-vectors.count() // block) or 1, queries.count()
    query_blocks = max(1, -(-asked // query_block), min(-(-asked // FEW), -(-TASKS // blocks)))

    def deal(df: DataFrame, key: str, own: str, number: int, other: str, others: int) -> DataFrame:
        """The rows, each in its own block, once for each block of the other side; the two sides may come from one table."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other)
        some = df.where("embedding is not null")
        return some.select(F.col(key).alias("id"), F.col("embedding").alias("embedding"), F.pmod(F.xxhash64(key), F.lit(number)).alias(own), every)

    left = deal(queries, "query_id", "q", query_blocks, "v", blocks).groupBy("q", "v")
    right = deal(vectors, "course_id", "v", blocks, "q", query_blocks).groupBy("q", "v")
    near = left.cogroup(right).applyInArrow(_nearest(limit), "query_id long, course_id long, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", "course_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def parsed_query(text: str) -> dict[str, list]:
    """Web-search syntax: words and "phrases" must all stand, '-word' must not, 'or' joins its neighbours."""
    out: dict[str, list] = {"all": [], "none": [], "phrases": []}
    join = False
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)([A-Za-z0-9]+)', text.lower()):
        words = [w for w in re.findall("[a-z0-9]+", m[2] if m[2] is not None else m[4]) if w not in STOP_WORDS or w == "or"]
        if not words:
            continue
        if words == ["or"] and m[2] is None:
            join = True
            continue
        if (m[1] or m[3]) == "-":
            out["none"] += words
        elif m[2] is not None and len(words) > 1:
            out["phrases"].append(words)
            out["all"] += [[w] for w in words]
        elif join and out["all"]:
            out["all"][-1] += words
        else:
            out["all"] += [[w] for w in words]
        join = False
    return out


def lexical(chunk: DataFrame, text: str, limit: int = POOL) -> DataFrame:
    """Chunks that match the query, by the summed frequency of its terms, ties by id.

    Frequencies order single-term queries as cover density does; for several terms this is a named
    simplification. Stop words don't count.
    """
    q = parsed_query(text)
    words = tokens(F.col("text"))
    hit = F.lit(bool(q["all"]))
    for group in q["all"]:
        hit = hit & F.arrays_overlap(F.col("words"), F.array(*map(F.lit, group)))
    for word in q["none"]:
        hit = hit & ~F.array_contains("words", word)
    for phrase in q["phrases"]:
        hit = hit & F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")
    terms = sorted({w for group in q["all"] for w in group})
    found = chunk.select("course_id", words.alias("words")).where(hit)
    score = F.size(F.filter("words", lambda w: w.isin(*terms))) if terms else F.lit(0)
    return ranked(found.select("course_id", score.alias("score")), [F.col("score").desc(), F.col("course_id")], limit)


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: the sum over lists of 1 / (k + rank)."""
    every = lists[0].select("course_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("course_id", "rank"))
    return every.groupBy("course_id").agg(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank"))).alias("rrf"))


def fuse_by(key: str, *lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """The same for many questions at once, told apart by ``key``."""
    every = lists[0].select(key, "course_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "course_id", "rank"))
    return every.groupBy(key, "course_id").agg(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank"))).alias("rrf"))


def hybrid(vectors: DataFrame, chunk: DataFrame, query: list[float], text: str, limit: int, use_lexical: bool = True) -> DataFrame:
    """Fused top rows, the best first, ties by id."""
    lists = [knn(vectors, query)] + ([lexical(chunk, text)] if use_lexical else [])
    return ranked(fuse(*lists), [F.col("rrf").desc(), F.col("course_id")], limit)


def rerank(found: DataFrame, chunk: DataFrame, text: str, by_overlap: bool = True) -> DataFrame:
    """New ranks by overlap with the query's terms, equal scores in the old order; without it the order stays."""
    if not by_overlap:
        return found.select("course_id", "rank").withColumn("score", (F.lit(0) - F.col("rank")).cast("double")).withColumn("new_rank", F.col("rank"))
    terms = sorted({w for group in parsed_query(text)["all"] for w in group})
    bodies = chunk.join(found.select("course_id"), "course_id", "left_semi").select("course_id", F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.array(*map(F.lit, terms)))).cast("double").alias("score"))
    scored = found.select("course_id", "rank").join(bodies, "course_id", "left")
    return scored.withColumn("new_rank", F.row_number().over(Window.orderBy(F.coalesce("score", F.lit(float("-inf"))).desc(), "rank")))


def intersect(filtered: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Filtered listings of found courses in search order; where none are, the filtered ones in their own order.

    Found ones come first, so the first ``limit`` rows show whether there are any: the search runs once, and the window sees
    those rows only.
    """
    order = [F.col("rank").asc_nulls_last(), F.col("term_rank").desc(), F.col("id")]
    top = filtered.join(found.select("course_id", "rank"), "course_id", "left").orderBy(*order).limit(limit)
    some = F.max("rank").over(Window.partitionBy(F.lit(1))).isNotNull()
    return top.withColumn("some", some).where(~F.col("some") | F.col("rank").isNotNull()).drop("some").orderBy(*order)

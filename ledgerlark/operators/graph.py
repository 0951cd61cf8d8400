"""Prerequisite walks over a cyclic edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import cut


def prereq_chain(relation: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, course_id, depth) reachable from each start by resolved edges, up to ``max_depth``.

    Level by level with a distinct each, so cycles and many paths don't multiply rows; a node that a
    cycle meets again appears at each of its depths. A null end is no edge. Each level is kept in the shared folder before the next
    reads it, so a level is one join of the last one's rows with the edges, whatever came before; the walk ends with a level
    that is empty.
    """
    edges = cut(relation.where("course_id is not null and requires_id is not null").select("course_id", "requires_id").distinct())
    level = start.where("course_id is not null").select(F.col("course_id").alias("start"), F.col("course_id"))
    out = None
    for depth in range(1, max_depth + 1):
        level = cut(level.join(edges, "course_id").select("start", F.col("requires_id").alias("course_id")).distinct())
        rows = level.select("start", "course_id", F.lit(depth).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        if level.isEmpty():
            break
    return out

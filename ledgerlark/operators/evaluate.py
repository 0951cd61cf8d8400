"""Retrieval evaluation: ranking metrics, filter comparison, summaries, the regression gate and the ablation ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import GATE_TOLERANCE
from .reports import element_at_share


def ndcg(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary relevance, 1 / log2(place + 1); 0 without relevant ids."""
    gain = lambda n: F.lit(1.0) / F.log2(n.cast("double") + 2)
    hits = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ideal = total(F.transform(F.slice(relevant, 1, k), lambda _, i: gain(i)))
    return F.when(F.size(relevant) > 0, total(hits) / ideal).otherwise(0.0)


def recall(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(relevant)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """Over the whole list; 0 without a hit."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))


def field_diffs(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(item_id, key, kind) of two tables of (item_id, key, value): missing, extra, mismatch, or fee_x100."""
    a, e = actual.withColumnRenamed("value", "a"), expected.withColumnRenamed("value", "e")
    both = a.join(e, ["item_id", "key"], "full_outer")
    hundred = F.col("key").contains("fee") & ((F.col("a").try_cast("double") == F.col("e").try_cast("double") * 100) | (F.col("a").try_cast("double") * 100 == F.col("e").try_cast("double")))
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(hundred, "fee_x100").otherwise("mismatch")
    return both.where(~F.col("a").eqNullSafe(F.col("e"))).select("item_id", "key", kind.alias("kind"))


def summarize(results: DataFrame, by: list[str]) -> DataFrame:
    """Means per group (one row over all for no ``by``), nulls skipped, with refusal figures and latency percentiles.

    A percentile is the element at floor(p n), from 0, of the sorted latencies, the last at most; latencies are
    counted by value before they meet.
    """
    share = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    true = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    rows = results.groupBy(*by).agg(
        F.count("*").alias("items"), F.avg("ndcg_10").alias("ndcg_10"), F.avg("recall_10").alias("recall_10"), F.avg("mrr").alias("mrr"), true("filter_exact"),
        F.avg(F.when(F.col("expect_refuse"), F.col("refused").cast("double"))).alias("refusal_accuracy"), F.count_if(F.col("refused") & ~F.col("expect_refuse")).alias("false_refusals"),
    )
    latency = element_at_share(results, by, "latency_ms", {"p50": share(0.5), "p95": share(0.95)}) if by else element_at_share(results.withColumn("all", F.lit(1)), ["all"], "latency_ms", {"p50": share(0.5), "p95": share(0.95)}).drop("all")
    if not by:
        return rows.join(latency, F.lit(True), "left")
    keys = {c: f"{c} of latency" for c in by}
    same = F.lit(True)
    for c, other in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(f"`{other}`"))
    return rows.join(latency.withColumnsRenamed(keys), same, "left").drop(*keys.values())


def gate(current: dict[str, float], baseline: dict[str, float], tolerance: float = GATE_TOLERANCE) -> list[str]:
    """Metrics, in percent points, that fell by more than the tolerance."""
    return [k for k in baseline if current[k] < baseline[k] - tolerance]


def gate_rows(current: DataFrame, baseline: DataFrame, metrics: tuple[str, ...] = ("filter_exact", "ndcg_10"), tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """(metric, cur, base, failed) of two one-row summaries, in percent points."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) * 100).alias(name)) for m in metrics])).alias("x")).select("x.*")
    return long(current, "cur").join(long(baseline, "base"), "metric").withColumn("failed", F.col("cur") < F.col("base") - tolerance)


# The ladder's cumulative configurations.
LADDER = (
    {"row": 1, "name": "vector, no prefix", "prefix": False, "lexical": False, "rerank": False, "filter": False},
    {"row": 2, "name": "vector", "prefix": True, "lexical": False, "rerank": False, "filter": False},
    {"row": 3, "name": "hybrid", "prefix": True, "lexical": True, "rerank": False, "filter": False},
    {"row": 4, "name": "hybrid, reranked", "prefix": True, "lexical": True, "rerank": True, "filter": False},
    {"row": 5, "name": "with filter", "prefix": True, "lexical": True, "rerank": False, "filter": True},
    {"row": 6, "name": "with filter, reranked", "prefix": True, "lexical": True, "rerank": True, "filter": True},
)


def score(items: DataFrame, retrieved: DataFrame, k: int = 10) -> DataFrame:
    """All items in one job: ``items`` has (item_id, relevant), ``retrieved`` (item_id, id, rank)."""
    lists = retrieved.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
    rows = items.join(lists, "item_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<bigint>")))
    return rows.select("item_id", ndcg(F.col("retrieved"), F.col("relevant"), k).alias("ndcg_10"), recall(F.col("retrieved"), F.col("relevant"), k).alias("recall_10"), reciprocal_rank(F.col("retrieved"), F.col("relevant")).alias("mrr"))


def table_text(rows: list[dict], columns: list[str]) -> str:
    """A markdown table of report rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in rows])

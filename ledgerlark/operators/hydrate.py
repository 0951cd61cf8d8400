"""Live facts for chosen listings: nested fees, per-course top listings, request order, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested_fees(fee: DataFrame) -> DataFrame:
    """(listing_id, fees): each listing's fee lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "label", "amount_cents")))
    return fee.groupBy("listing_id").agg(F.transform(ordered, lambda f: F.struct(f["label"].alias("label"), f["amount_cents"].alias("amount_cents"))).alias("fees"))


def hydrate(view: DataFrame, fee: DataFrame, ids: DataFrame) -> DataFrame:
    """Cards of the requested listings in their order; ``ids`` has (id, position), unknown ids have no card.

    The requested ids cut the fee lines before they are aggregated.
    """
    wanted = ids.select("id", "position")
    fees = nested_fees(fee.join(wanted.select(F.col("id").alias("listing_id")).distinct(), "listing_id", "left_semi"))
    cards = view.join(wanted, "id").join(fees, F.col("id") == F.col("listing_id"), "left").drop("listing_id")
    return cards.withColumn("fees", F.coalesce("fees", F.array().cast("array<struct<label:string,amount_cents:bigint>>"))).orderBy("position")


def requested(spark, ids: list[str]) -> DataFrame:
    """Digits-only ids, in order of their first place."""
    seen = list(dict.fromkeys(i for i in ids if i.isdigit()))
    return spark.createDataFrame([(int(i), k) for k, i in enumerate(seen)], "id long, position int")


def per_course(view: DataFrame, n: int) -> DataFrame:
    """Each course's ``n`` latest live listings."""
    by = Window.partitionBy("course_id").orderBy(F.col("term_rank").desc_nulls_last(), "id")
    return view.where(~F.col("is_gone")).withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def latest_per_course(view: DataFrame) -> DataFrame:
    """One listing per course, the one of the latest term, of equal terms the one of least id."""
    best = F.min_by(F.struct("id", "term", "term_rank", "status"), F.struct((-F.col("term_rank")).alias("r"), "id"))
    return view.groupBy("course_id").agg(best.alias("l")).select("course_id", "l.*")


def observation_window(listing: DataFrame) -> DataFrame:
    """(observing_since, terms_observed); 'unknown' and 0 over no listings."""
    dated = F.struct("term_season", "term_year")
    return listing.agg(F.coalesce(F.min("starts_on").cast("string"), F.lit("unknown")).alias("observing_since"), F.count_distinct(F.when(F.col("term_year").isNotNull(), dated)).alias("terms_observed"))


def refreshed_epoch(epoch: DataFrame, listing: DataFrame) -> DataFrame:
    """The epoch row (id 1) with the number of dated terms seen by now; without the row there is none."""
    seen = observation_window(listing).select("terms_observed")
    return epoch.drop("terms_observed").crossJoin(F.broadcast(seen)).where("id = 1")

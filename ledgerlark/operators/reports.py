"""Report aggregates over the catalogue: absence rates, code shapes, key signatures, medians, provenance and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absence(listing: DataFrame) -> DataFrame:
    """One row: how many listings there are, and in how many each of six facts is missing or unknown."""
    null = lambda c: F.count_if(F.col(c).isNull())
    unknown = lambda c: F.count_if(F.col(c) == "unknown")
    return listing.agg(
        F.count("*").alias("total"),
        null("starts_on").alias("starts_null"),
        unknown("campus").alias("campus_unknown"),
        unknown("delivery_mode").alias("delivery_unknown"),
        null("total_fee_cents").alias("fee_null"),
        null("term_season").alias("term_null"),
        null("is_evening").alias("evening_null"),
    )


def code_shapes(course: DataFrame, code: str) -> DataFrame:
    """One row: codes with letters, bare numbers, and missing ones."""
    c = F.col(code)
    return course.agg(
        F.count("*").alias("total"), F.count_if(c.rlike("[A-Za-z]")).alias("code"), F.count_if(c.rlike("^[0-9]+$")).alias("bare_int"), F.count_if(c.isNull()).alias("missing")
    )


def absence_alerts(rows: DataFrame, day: Column, missing: Column, keys: Column, days: int = 7, tolerance: float = 0.05) -> DataFrame:
    """Per day: share of missing values, its mean over the ``days`` days before that have rows, how many key signatures
    rows have, and whether to raise an alert: the share is above the mean by more than ``tolerance``, or keys vary."""
    daily = rows.groupBy(day.alias("day")).agg(
        F.avg(missing.cast("double")).alias("rate"), F.count_distinct(F.array_join(F.array_sort(keys), ",")).alias("signatures")
    )
    number = F.datediff("day", F.lit("1970-01-01"))
    week = Window.orderBy(number).rangeBetween(-days, -1)  # one row a day reaches the window
    with_mean = daily.withColumn("baseline", F.avg("rate").over(week))
    over = F.coalesce(F.col("rate") > F.col("baseline") + tolerance, F.lit(False))
    return with_mean.withColumn("alert", over | (F.col("signatures") > 1))


def element_at_share(rows: DataFrame, by: list[str], value: str, index: dict[str, Column]) -> DataFrame:
    """For each group, the elements of its sorted values at given places (from 0, as Columns of n, the group's size).

    Equal values are counted before they meet, so a group's task sees its distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    group = Window.partitionBy(*by)
    upto = F.sum("times").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "n": F.sum("times").over(group)})
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at, F.col(value))).alias(name) for name, at in index.items()])


def lower_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The lower of the two middle values of each group."""
    return element_at_share(rows, by, value, {"median": F.floor((F.col("n") - 1) / 2)})


def key_frequency(rows: DataFrame, fields: str, key: str, limit: int = 20) -> DataFrame:
    """The ``limit`` most frequent values of one key of a map column."""
    value = F.col(fields)[key]
    counted = rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(limit)


def policy_texts(course: DataFrame, unit: DataFrame) -> DataFrame:
    """How many different refund policies the courses of a unit end up with, by hash of the text."""
    text = F.coalesce("refund_policy_override", "refund_policy")
    return course.join(unit, "unit_id").groupBy("unit_id").agg(F.count_distinct(F.sha2(text, 256)).alias("policies"))


def churn(rows: DataFrame, created: str, changed: str) -> DataFrame:
    """One row: rows changed more than a day after they were created, and in how many months that happened."""
    late = F.col(changed) > F.col(created) + F.expr("INTERVAL 1 DAY")
    return rows.agg(F.count_if(late).alias("changed"), F.count_distinct(F.when(late, F.date_trunc("month", changed))).alias("months"))


def correlated(pages: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each page with its batch result; one without is a typed failure."""
    both = pages.join(results.select(key, F.lit(True).alias("there"), "raw_json"), key, "left")
    status = F.when(F.col("there").isNull(), "schema_error").when(F.col("raw_json").isNull(), "refused").otherwise("ok")
    return both.select(key, status.alias("status"), F.when(F.col("there").isNull(), "no result in the batch").alias("error"))


def pseudo_random(rows: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """A random choice of rows that is the same in every run: those of least hash of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(limit)

"""Observed history: term rollups, change logs, verdicts on what may be claimed, synthetic past terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import and_list, dollars, fnv1a


def term_rollup(listing: DataFrame) -> DataFrame:
    """Per course and term, over live and gone listings: counts, fee range, statuses, whether any is live."""
    return listing.groupBy("course_id", "term", "term_season", "term_year", "term_rank").agg(
        F.count("*").alias("n"), F.min("total_fee_cents").alias("min_fee"), F.max("total_fee_cents").alias("max_fee"), F.sort_array(F.collect_set("status")).alias("statuses"), F.bool_or(~F.col("is_gone")).alias("any_live")
    )


def history(listing: DataFrame, course: DataFrame) -> DataFrame:
    """One row per course: its terms in order, the number of dated terms, and whether it is offered now.

    Terms without a rank come last.
    """
    terms = term_rollup(listing).groupBy("course_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("term_rank", F.lit(2147483647)).alias("rank"), "term", "min_fee", "max_fee", "any_live"))).alias("terms"),
        F.count_distinct(F.when(F.col("term_year").isNotNull(), F.struct("term_season", "term_year"))).alias("terms_seen"),
        F.bool_or("any_live").alias("offered_now"),
    )
    return course.select(F.col("id").alias("course_id"), "course_title").join(terms, "course_id", "left")


def verdict(terms_seen: Column) -> Column:
    """No history: not_found; one term is no pattern: insufficient; two or more: grounded."""
    return F.when(terms_seen.isNull(), "not_found").when(terms_seen <= 1, "insufficient").otherwise("grounded")


def compose_history(found: DataFrame, observing_since: str) -> DataFrame:
    """History rows with a verdict and prose that claims no more than the verdict allows."""
    terms = F.transform("terms", lambda t: t["term"])
    fees = F.filter(F.transform("terms", lambda t: t["min_fee"]), lambda x: x.isNotNull())
    first, last = F.try_element_at(fees, F.lit(1)), F.try_element_at(fees, F.lit(-1))
    held = F.concat(F.lit(" The fee held at "), dollars(first), F.lit("."))
    moved = F.concat(F.lit(" The fee went from "), dollars(first), F.lit(" to "), dollars(last), F.lit("."))
    trend = F.when(first.isNull() | (F.size(fees) < 2), "").when(first == last, held).otherwise(moved)
    now = F.when(F.col("offered_now"), " It is listed now.").otherwise(" It hasn't appeared since.")
    title, said = F.coalesce("course_title", F.lit("That course")), verdict(F.col("terms_seen"))
    once = F.concat(title, F.lit(f" was seen in one term only, since {observing_since}; that shows no pattern."), now)
    often = F.concat(title, F.lit(" was seen in "), and_list(terms), F.lit("."), trend, now)
    prose = F.when(said == "not_found", F.concat(title, F.lit(" isn't in the catalogue."))).when(said == "insufficient", once).otherwise(often)
    return found.withColumn("verdict", said).withColumn("prose", prose)


def changes(observed: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """A row for each observation that differs from the one before it, nulls equal to nulls."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    return observed.withColumn("old_value", before).withColumn("is_first", first).where(~F.col("is_first") & ~F.col("old_value").eqNullSafe(F.col(value))).drop("is_first").withColumnRenamed(value, "new_value")


def changed_fields(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) for each watched column that two states of a table differ in."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"b.{c}").cast("string").alias("old_value"), F.col(f"a.{c}").cast("string").alias("new_value")) for c in watched]
    both = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    return both.select(F.col(f"a.{key}").alias(key), F.explode(F.array(*pairs)).alias("c")).select(key, "c.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def archetype(course_id: Column) -> Column:
    """A third each of courses recur, return after a gap, and are new."""
    return F.element_at(F.array(*map(F.lit, ("recurring", "returning", "current_only"))), (fnv1a(course_id.cast("string")) % 3 + 1).cast("int"))


def synthetic_history(latest: DataFrame) -> DataFrame:
    """Past listings of each course's latest: 1 and 2 years back if recurring, 2 if returning; fees fall 4 % a year to whole dollars."""
    kind = archetype(F.col("course_id"))
    back = F.when(kind == "recurring", F.array(F.lit(1), F.lit(2))).when(kind == "returning", F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    rows = latest.withColumn("archetype", kind).withColumn("years_back", F.explode(back))
    fee = F.floor(F.col("total_fee_cents") * F.pow(F.lit(0.96), F.col("years_back")) / 100 + F.lit(0.5)) * 100
    return rows.select(
        "course_id",
        "archetype",
        "years_back",
        (F.col("term_year") - F.col("years_back")).alias("term_year"),
        "term_season",
        (F.col("term_rank") - 10 * F.col("years_back")).alias("term_rank"),
        fee.cast("long").alias("total_fee_cents"),
        F.concat(F.lit("synthetic://"), F.col("course_id").cast("string"), F.lit("/"), F.col("years_back").cast("string")).alias("detail_url"),
    )


SYNTHETIC = "synthetic://"


def is_synthetic(url: Column) -> Column:
    """Marks listings that the synthetic loader wrote; its clearer keeps the others."""
    return F.coalesce(url.startswith(SYNTHETIC), F.lit(False))


def archetype_histogram(course: DataFrame) -> DataFrame:
    """How many courses each archetype has."""
    return course.groupBy(archetype(F.col("id")).alias("archetype")).agg(F.count("*").alias("n"))


def first_change_to(changed: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, first_at): when a thing first changed to ``value``; things that never did have no row."""
    return changed.where(F.col("new_value") == value).groupBy(key).agg(F.min(at).alias("first_at"))

"""Typed listing filters: predicates, filtered listings, counts, and what relaxing each predicate would return."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListingFilter:
    """None constrains nothing; bounds are inclusive but for ``starts_before``."""

    campus: str | None = None
    program: str | None = None
    unit: str | None = None
    term: str | None = None
    starts_before: str | None = None
    starts_after: str | None = None
    max_fee_cents: int | None = None
    min_fee_cents: int | None = None
    delivery_mode: str | None = None
    is_evening: bool | None = None
    status: str | None = None
    open_for_reg: bool | None = None
    min_hours: float | None = None
    max_hours: float | None = None
    include_gone: bool | None = None

    def without(self, key: str) -> ListingFilter:
        return ListingFilter(**{f.name: getattr(self, f.name) for f in fields(self) if f.name != key})


def predicates(f: ListingFilter, as_of: str) -> dict[str, Column]:
    """A condition for each key that constrains; null column values never match, but for an absent deadline."""
    c, out = F.col, {}
    for key, column in (("campus", "campus"), ("program", "program"), ("unit", "unit_name"), ("term", "term"), ("delivery_mode", "delivery_mode"), ("status", "status"), ("is_evening", "is_evening")):
        if (value := getattr(f, key)) is not None:
            out[key] = c(column) == F.lit(value)
    if f.max_fee_cents is not None:
        out["max_fee_cents"] = c("total_fee_cents") <= f.max_fee_cents
    if f.min_fee_cents is not None:
        out["min_fee_cents"] = c("total_fee_cents") >= f.min_fee_cents
    if f.min_hours is not None:
        out["min_hours"] = c("contact_hours") >= f.min_hours
    if f.max_hours is not None:
        out["max_hours"] = c("contact_hours") <= f.max_hours
    if f.starts_after is not None:
        out["starts_after"] = c("starts_on") >= F.lit(f.starts_after).cast("date")
    if f.starts_before is not None:
        out["starts_before"] = c("starts_on") < F.lit(f.starts_before).cast("date")
    if f.open_for_reg:
        out["open_for_reg"] = c("registration_deadline").isNull() | (c("registration_deadline") >= F.lit(as_of).cast("date"))
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def listing_view(listing: DataFrame, course: DataFrame, unit: DataFrame) -> DataFrame:
    """Listings with their course's and unit's columns. Catalyst prunes what a query doesn't read and picks the joins."""
    c = course.select(F.col("id").alias("course_id"), "course_title", "program", "contact_hours", "unit_id")
    u = unit.select(F.col("id").alias("unit_id"), F.col("name").alias("unit_name"))
    return listing.join(c, "course_id").join(u, "unit_id", "left")


def live(view: DataFrame, f: ListingFilter) -> DataFrame:
    return view if f.include_gone else view.where(~F.col("is_gone"))


LISTING_COLUMNS = ("id", "course_id", "course_title", "term", "term_rank", "campus", "delivery_mode", "status", "is_evening", "starts_on", "registration_deadline", "total_fee_cents", "contact_hours", "unit_name")


def filter_listings(view: DataFrame, f: ListingFilter, as_of: str, limit: int | None = None) -> DataFrame:
    """Matching listings, the latest term first, then by id."""
    out = live(view, f).where(_all(predicates(f, as_of).values())).select(*LISTING_COLUMNS).orderBy(F.col("term_rank").desc_nulls_last(), "id")
    return out.limit(limit) if limit else out


def count_listings(view: DataFrame, f: ListingFilter, as_of: str) -> DataFrame:
    return live(view, f).where(_all(predicates(f, as_of).values())).agg(F.count("*").alias("n"))


def relax(view: DataFrame, f: ListingFilter, as_of: str) -> DataFrame:
    """(relaxed, matches, total, min_fee, max_fee) for each predicate whose dropping would return more.

    One scan counts the matches of the filter and of every filter with one predicate fewer.
    """
    every = predicates(f, as_of)
    hits = {"": _all(every.values())} | {k: _all(c for other, c in every.items() if other != k) for k in every}
    aggs = [a for k, hit in hits.items() for a in (F.count_if(hit).alias(f"n_{k}"), F.min(F.when(hit, F.col("total_fee_cents"))).alias(f"lo_{k}"), F.max(F.when(hit, F.col("total_fee_cents"))).alias(f"hi_{k}"))]
    one = live(view, f).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("relaxed"), F.col(f"n_{k}").alias("matches"), F.col("n_").alias("total"), F.col(f"lo_{k}").alias("min_fee"), F.col(f"hi_{k}").alias("max_fee")) for k in every])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("matches > total").orderBy(F.col("matches").desc(), "relaxed")


def dollars_text(cents: int) -> str:
    return f"${cents // 100}" if cents % 100 == 0 else f"${cents / 100:.2f}"


def relax_label(key: str, f: ListingFilter) -> str:
    """What a chip says of the predicate."""
    value = getattr(f, key)
    return {
        "max_fee_cents": lambda: f"under {dollars_text(value)}",
        "min_fee_cents": lambda: f"over {dollars_text(value)}",
        "min_hours": lambda: f"at least {value:g} hours",
        "max_hours": lambda: f"at most {value:g} hours",
        "starts_after": lambda: f"starting from {value}",
        "starts_before": lambda: f"starting before {value}",
        "is_evening": lambda: "evenings" if value else "not evenings",
        "open_for_reg": lambda: "open for registration",
        "delivery_mode": lambda: str(value).replace("_", " "),
    }.get(key, lambda: str(value))()


def ids_matching(course: DataFrame, patterns: list[str]) -> DataFrame:
    """Courses whose title is like any of the patterns, in either case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("course_title").ilike(p)
    return course.where(hit).select("id", "course_title")

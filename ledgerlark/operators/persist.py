"""Persisting extractions and composed crawls: one plan gives every table's new state, one commit publishes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import derive_rows
from ..sources.commits import Commit, Store
from . import ingest as ing
from .indexing import course_key
from .temporal import changed_fields

#: Columns whose changes are logged.
WATCHED = ("status", "total_fee_cents", "starts_on", "campus", "delivery_mode")


def replace_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """A course's raw edges are replaced by the new ones; resolved edges stay, and take source and kind of a new one of the same text."""
    keys = ["course_id", "raw_text"]
    stays = old.where("requires_id is not null").unionByName(old.where("requires_id is null").join(new.select("course_id").distinct(), "course_id", "left_anti"))
    both = stays.alias("o").join(new.dropDuplicates(keys).alias("n"), keys, "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return both.select(*keys, "o.requires_id", pick("source"), pick("kind"))


def persist(rows: DataFrame, course: DataFrame, listing: DataFrame, fee: DataFrame, model: str, at: Column) -> dict[str, DataFrame]:
    """New states of extraction, course, listing, listing_change and listing_fee after a batch of extractions.

    ``rows`` has one row per page: source_page_id, outcome ('ok' or a failure), group_url, course_title, the watched
    columns and fee_rows. Failures leave a typed extraction row and touch nothing else. Of pages of one course the
    least page id's title stays. ``persist_extracted`` publishes all of them by one commit.
    """
    good = rows.where("outcome = 'ok'").withColumn("course_key", course_key(F.col("group_url"), F.col("course_title")))
    extraction = rows.select("source_page_id", F.col("outcome").alias("status"), F.lit(model).alias("model"), at.alias("observed_at"))
    courses = good.groupBy(F.col("course_key").alias("key")).agg(F.min_by("course_title", "source_page_id").alias("course_title"))
    new = good.select("source_page_id", "course_key", *WATCHED)
    change = changed_fields(listing.select("source_page_id", *WATCHED), new.select("source_page_id", *WATCHED), "source_page_id", list(WATCHED))
    fees = good.select("source_page_id", F.explode("fee_rows").alias("f")).select("source_page_id", "f.ord", "f.label", "f.amount_cents", "f.is_total")
    kept = fee.join(good.select("source_page_id").distinct(), "source_page_id", "left_anti")
    return {
        "extraction": extraction,
        "course": ing.upsert(course, courses, "key"),
        "listing": ing.upsert(listing, new, "source_page_id"),
        "listing_change": change.withColumn("observed_at", at),
        "listing_fee": kept.unionByName(fees),
    }


#: Columns of the store's tables that a first commit leaves without rows.
EXTRACTION = "source_page_id long, status string, model string, observed_at timestamp"
COURSE = "key string, course_title string"
CHANGE = "source_page_id long, field string, old_value string, new_value string, observed_at timestamp"


def seed(store: Store, listing: DataFrame, fee: DataFrame) -> int:
    """The first commit of a store: listings and fee lines, and the other tables without rows."""
    commit, empty = store.begin(), lambda schema: store.spark.createDataFrame([], schema)
    for name, rows in {"extraction": empty(EXTRACTION), "course": empty(COURSE), "listing": listing, "listing_change": empty(CHANGE), "listing_fee": fee}.items():
        commit.replace(name, rows)
    return commit.publish()


def persist_extracted(store: Store, pages: DataFrame, model: str, at: Column) -> int:
    """Derive listing facts from extracted pages and publish all five tables together; the commit's version.

    ``pages`` has source_page_id, outcome, group_url, course_title and what ``derive_rows`` reads. Extractions and changes are
    appended, the other tables replaced. A failure leaves the store as it was; where another job has changed a table that
    was read, the work is done again on its result.
    """
    rows = derive_rows(pages).select("source_page_id", "outcome", "group_url", "course_title", *WATCHED, "fee_rows")

    def build(commit: Commit) -> None:
        old = {name: commit.read(name) for name in ("course", "listing", "listing_fee")}
        new = persist(rows, old["course"], old["listing"], old["listing_fee"], model, at)
        for name, df in new.items():
            if name in old:
                commit.replace(name, df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old[name].schema]))
            else:
                commit.append(name, df)

    return store.transact(build)


def ledger(opened: DataFrame, closed: DataFrame, swept: DataFrame) -> DataFrame:
    """Crawl runs (id, started_at, finished_at, pages_seen, status, swept) from append-only logs of openings, closings and sweeps.

    A run without a closing is 'running'; of several closings the latest counts.
    """
    last = closed.groupBy("id").agg(F.max_by(F.struct("finished_at", "pages_seen", "status"), "finished_at").alias("c"))
    runs = opened.join(last, "id", "left").join(swept.select("id").distinct().withColumn("was_swept", F.lit(True)), "id", "left")
    return runs.select("id", "started_at", "c.finished_at", "c.pages_seen", F.coalesce("c.status", F.lit("running")).alias("status"), F.coalesce("was_swept", F.lit(False)).alias("swept"))


def last_good(runs: DataFrame, without: int) -> DataFrame:
    """The most pages that another good run saw; 0 without any."""
    return runs.where((F.col("status") == "ok") & (F.col("id") != without)).agg(F.coalesce(F.max("pages_seen"), F.lit(0)).alias("last_good"))


def crawl(state: DataFrame, snapshot: DataFrame, fetched: DataFrame, rules: list[tuple[bool, str]], runs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One crawl run: robots, conditional fetches, page state, new snapshots, gated sweep and counters.

    ``state`` has url, content_hash, first_seen_at, last_seen_at, disappeared_at; ``snapshot`` page_id and content_hash;
    ``fetched`` url, content_hash, not_modified, error, group_url. Pages that robots.txt bars aren't fetched; a page
    with an error stays as it was.
    """
    allowed = ing.robots_allowed(F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1), rules)
    kind = F.when(~allowed, "skipped_robots").when(F.col("error").isNotNull(), "error").when(F.col("not_modified"), "not_modified").otherwise("fetched")
    tried = fetched.withColumn("kind", kind)
    seen = tried.where("kind in ('fetched', 'not_modified')")
    after = ing.observe(state, seen.select("url", "content_hash", "not_modified"), now)
    changed = seen.where("kind = 'fetched'").select(F.col("url").alias("page_id"), "content_hash")
    before = state.select("url", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    outcome = tried.join(before, "url", "left")
    differs = (F.col("kind") == "fetched") & F.col("known") & ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    is_new = F.col("kind").isin("fetched", "not_modified") & F.col("known").isNull()
    counted = outcome.select("kind", is_new.alias("is_new"), F.coalesce(differs, F.lit(False)).alias("course_changed"), F.lit(False).alias("listing_changed"), "group_url")
    return {
        "state": ing.sweep(after, runs, seen.count(), now),
        "snapshot": ing.snapshots(snapshot, changed),
        "summary": ing.crawl_summary(counted),
    }

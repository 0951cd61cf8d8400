"""The catalogue as one object: search, filter, relax, hydrate, history and window over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utc_stamp
from ..schemas import CANDIDATE_LIMIT, FILTER_LIMIT, HISTORY_CHANGES
from . import filters as flt
from . import hydrate as hyd
from . import temporal as tmp
from .filters import ListingFilter
from .retrieval import hybrid


def model_embeddings(chunk: DataFrame, embedding: DataFrame, model_id: int) -> DataFrame:
    """Chunks with their embedding by one model: the model is filtered before the join, so others are never shuffled."""
    chosen = embedding.where(F.col("model_id") == model_id).select("chunk_id", "embedding")
    return chunk.join(chosen, "chunk_id")


def unembedded(chunk: DataFrame, embedding: DataFrame, model_id: int) -> DataFrame:
    """Chunks that the model hasn't embedded yet."""
    return chunk.join(embedding.where(F.col("model_id") == model_id).select("chunk_id"), "chunk_id", "left_anti")


def ensure_models(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry (id, name, kind, dims) with a row for each wanted (name, kind, dims) that it lacks, numbered on by name.

    A registry has few rows: it is the one table here that a single task may number.
    """
    known = registry.select("name", "kind")
    new = wanted.dropDuplicates(["name", "kind"]).join(known, ["name", "kind"], "left_anti")
    last = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.withColumn("place", F.row_number().over(Window.orderBy("name", "kind"))).crossJoin(F.broadcast(last))
    return registry.unionByName(numbered.select((F.col("last") + F.col("place")).cast("long").alias("id"), "name", "kind", "dims"))


def chunk_body(chunk: DataFrame) -> DataFrame:
    """(course_id, body): the first chunk of each course, its context before its text."""
    body = F.concat(F.coalesce(F.concat("context_prefix", F.lit(" ")), F.lit("")), "text")
    return chunk.where("ord = 0").select("course_id", body.alias("body"))


def cards(listing: DataFrame, course: DataFrame, page: DataFrame, fee: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live cards of ``wanted`` (id, position, why), in order: the listing's and the course's facts, dates as text, fees
    nested in order, and when the facts were last checked against their page, or else last seen. Unknown ids have none."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    ids = wanted.select("id", "position", "why")
    fees = hyd.nested_fees(fee.join(ids.select(F.col("id").alias("listing_id")).distinct(), "listing_id", "left_semi"))
    rows = listing.join(ids, "id").join(course.withColumnRenamed("id", "course_id"), "course_id")
    rows = rows.join(page.select("source_page_id", "last_hash_comparison_at"), "source_page_id", "left")
    rows = rows.join(fees.withColumnRenamed("listing_id", "id"), "id", "left")
    return rows.select(
        "position", "id", "course_id", "course_title", "external_course_id", "track", "contact_hours",
        F.coalesce("delivery_mode", F.lit("unknown")).alias("delivery_mode"), F.coalesce("campus", F.lit("unknown")).alias("campus"),
        "term", day("starts_on"), day("ends_on"), "is_evening", "schedule_text", "status", "total_fee_cents", day("registration_deadline"),
        "registration_deadline_rule", "registration_url", "registration_keyword", "detail_url",
        utc_stamp(F.coalesce("last_hash_comparison_at", "last_seen_at")).alias("checked_at"),
        F.coalesce("fees", F.array().cast("array<struct<label:string,amount_cents:bigint>>")).alias("fees"), "why",
    )


def listings_for_courses(view: DataFrame, wanted: DataFrame, per_course: int) -> DataFrame:
    """Each wanted course's latest live listings, in the order in which the courses (course_id, position) are asked for."""
    asked = wanted.groupBy("course_id").agg(F.min("position").alias("position"))
    return hyd.per_course(view.join(asked, "course_id"), per_course).orderBy("position", "place")


def knowledge_search(registry: DataFrame, name: str, chunk: DataFrame, embedding: DataFrame, vector: list[float], text: str, limit: int) -> DataFrame:
    """Hybrid search by the embeddings of the model of that name (chunk_id, model_id, embedding; a chunk is its course's);
    nothing is found, by words neither, while the model has no embeddings."""
    model = registry.where((F.col("name") == name) & (F.col("kind") == "embedding")).select(F.col("id").alias("model_id"))
    vectors = embedding.join(F.broadcast(model), "model_id").select(F.col("chunk_id").alias("course_id"), "embedding")
    indexed = vectors.select("course_id").limit(1).select(F.lit(True).alias("indexed"))
    return hybrid(vectors, chunk, vector, text, limit).crossJoin(F.broadcast(indexed)).drop("indexed")


class Engine:
    """The catalogue's questions, over one set of tables; every answer is a lazy DataFrame."""

    def __init__(self, listing: DataFrame, course: DataFrame, unit: DataFrame, fee: DataFrame, chunk: DataFrame, vectors: DataFrame, as_of: str):
        self.listing, self.course, self.fee, self.chunk, self.vectors, self.as_of = listing, course, fee, chunk, vectors, as_of
        self.view = flt.listing_view(listing, course, unit)

    def search(self, vector: list[float], text: str, limit: int) -> DataFrame:
        return hybrid(self.vectors, self.chunk, vector, text, limit)

    def filter(self, f: ListingFilter, limit: int = FILTER_LIMIT) -> DataFrame:
        return flt.filter_listings(self.view, f, self.as_of, limit)

    def count(self, f: ListingFilter) -> DataFrame:
        return flt.count_listings(self.view, f, self.as_of)

    def relax(self, f: ListingFilter) -> DataFrame:
        return flt.relax(self.view, f, self.as_of)

    def listings_for(self, found: DataFrame, per_course: int = 1, limit: int = CANDIDATE_LIMIT) -> DataFrame:
        wanted = found.select("course_id", F.col("rank").alias("position"))
        return listings_for_courses(self.view, wanted, per_course).limit(limit)

    def hydrate(self, ids: DataFrame) -> DataFrame:
        return hyd.hydrate(self.view, self.fee, ids)

    def window(self) -> DataFrame:
        return hyd.observation_window(self.listing)

    def history(self, change: DataFrame) -> DataFrame:
        return course_history(self.listing, self.course, change)


def course_history(listing: DataFrame, course: DataFrame, change: DataFrame, latest: int = HISTORY_CHANGES) -> DataFrame:
    """Every course's history: its terms, number of dated terms, verdict, and the latest changes of its listings.

    ``change`` has (listing_id, observed_at, id, field, old_value, new_value); the latest come first, of equal times
    the greatest id. A course keeps at most ``latest`` of them: that is the report's feature, and the cut is made
    before the shuffle too.
    """
    by = Window.partitionBy("course_id").orderBy(F.col("observed_at").desc(), F.col("id").desc())
    mine = change.join(listing.select(F.col("id").alias("listing_id"), "course_id"), "listing_id")
    top = mine.withColumn("place", F.row_number().over(by)).where(F.col("place") <= latest)
    event = F.struct("place", "listing_id", "id", "field", "old_value", "new_value", utc_stamp(F.col("observed_at")).alias("observed_at"))
    events = top.groupBy("course_id").agg(F.array_sort(F.collect_list(event)).alias("changes"))
    return tmp.history(listing, course).join(events, "course_id", "left").withColumn("verdict", tmp.verdict(F.col("terms_seen")))

"""Extraction, upsert, index and batched evaluation queries, each with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters as flt
from ..operators import indexing as idx
from ..operators import ingest as ing
from ..sources.catalog import Catalog
from .base_sql import BASE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = BASE + sql
        return f

    return register


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'refused' WHEN event_id % 10 = 0 THEN 'schema_error' ELSE 'ok' END AS status, CASE WHEN event_id % 11 <> 0 AND event_id % 10 <> 0 THEN CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) END AS k FROM events")
def extraction_decode(c):
    key = F.col("event_id")
    raw = c.table("events").select("event_id", F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("raw_json"))
    out = idx.decode_extractions(raw, "k int")
    return out.select("event_id", "status", F.when(F.col("status") == "ok", F.col("fields.k")).alias("k"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'g' || c_nationkey ELSE 't:' || lower(c_mktsegment) END AS key, arg_max(c_name, c_custkey) AS c_name, max(c_custkey) AS c_custkey, count(*) AS writes FROM customer GROUP BY 1")
def course_upsert(c):
    group = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("g"), F.col("c_nationkey").cast("string")))
    return idx.last_writer(c.table("customer"), idx.course_key(group, F.col("c_mktsegment")), "c_custkey", ["c_name", "c_custkey"])


@query(", o AS (SELECT id, status, total_fee_cents FROM listing WHERE id % 3 <> 0), n AS (SELECT id, 'closed' AS status, CASE WHEN id % 4 <> 0 THEN total_fee_cents + 1 END AS total_fee_cents FROM listing WHERE id % 2 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, coalesce(n.total_fee_cents, o.total_fee_cents) AS total_fee_cents FROM o FULL JOIN n ON o.id = n.id")
def upsert_listings(c):
    rows = c.listing.select("id", "status", "total_fee_cents")
    new = rows.where("id % 2 = 0").select("id", F.lit("closed").alias("status"), F.when(F.col("id") % 4 != 0, F.col("total_fee_cents") + 1).alias("total_fee_cents"))
    return ing.upsert(rows.where("id % 3 <> 0"), new, "id", keep_old=("total_fee_cents",))


@query("SELECT listing_id, ord, amount_cents FROM listing_fee WHERE listing_id % 5 <> 0 UNION ALL SELECT listing_id, ord, amount_cents + 100 FROM listing_fee WHERE listing_id % 5 = 0 AND ord = 0")
def replace_fee_lines(c):
    fee = c.listing_fee.select("listing_id", "ord", "amount_cents")
    new = fee.where("listing_id % 5 = 0 and ord = 0").withColumn("amount_cents", F.col("amount_cents") + 100)
    return ing.replace_children(fee, new, "listing_id")


@query("SELECT d.doc_id AS course_id, least(32767, greatest(1, CAST(ceil(length(text) / 4.0) AS INTEGER))) AS token_count FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def index_worklist(c):
    return idx.index_chunks(c.chunk, c.chunk_embedding).select("course_id", "token_count")


@query("SELECT id, id || ' | ' || course_title || ' | ' || term || ' | ' || campus || ' | ' || status AS line, CAST(ceil(length(id || ' | ' || course_title || ' | ' || term || ' | ' || campus || ' | ' || status) / 4.0) AS BIGINT) AS tokens FROM listing_view WHERE NOT is_gone")
def compact_index(c):
    return idx.compact_lines(flt.listing_view(c.listing, c.course, c.unit))


@query("SELECT 'new' AS kind, item_id FROM benchmark WHERE item_id % 3 = 0 AND item_id % 4 <> 0 UNION ALL SELECT 'orphan', item_id FROM benchmark WHERE item_id % 4 = 0 AND item_id % 3 <> 0")
def golden_set_reconcile(c):
    items, keep = (c.table("benchmark").where(f"item_id % {n} = 0").select("item_id") for n in (4, 3))
    new, orphans = idx.reconcile(items, keep, "item_id")
    return new.select(F.lit("new").alias("kind"), "item_id").unionByName(orphans.select(F.lit("orphan").alias("kind"), "item_id"))


def _course_lines(c, courses):
    found = idx.get_course(flt.listing_view(c.listing, c.course, c.unit), c.listing_fee, courses.select(F.col("id").alias("course_id")))
    line = lambda x: F.concat_ws(":", x["id"].cast("string"), x["term"], x["status"], x["n_fees"].cast("string"))
    return found.select("course_id", "course_title", F.array_join(F.transform("listings", line), ",").alias("listings"))


@query(", f AS (SELECT listing_id, count(*) AS n_fees FROM listing_fee GROUP BY listing_id) SELECT course_id, course_title, string_agg(id || ':' || term || ':' || status || ':' || coalesce(n_fees, 0), ',' ORDER BY id) AS listings FROM listing_view LEFT JOIN f ON id = listing_id WHERE NOT is_gone GROUP BY course_id, course_title")
def get_course(c):
    return _course_lines(c, c.course)


@query(", f AS (SELECT listing_id, count(*) AS n_fees FROM listing_fee GROUP BY listing_id) SELECT course_id, course_title, string_agg(id || ':' || term || ':' || status || ':' || coalesce(n_fees, 0), ',' ORDER BY id) AS listings FROM listing_view LEFT JOIN f ON id = listing_id WHERE NOT is_gone GROUP BY course_id, course_title")
def get_course_all(c):
    return _course_lines(c, c.course)


@query("SELECT c.id AS course_id, CASE WHEN c.id % 7 = 0 THEN 'own ' || c.id ELSE 'unit ' || u.name END AS policy FROM course c LEFT JOIN unit u ON c.unit_id = u.id")
def course_policy(c):
    course = c.course.select(F.col("id").alias("course_id"), "unit_id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("own "), F.col("id").cast("string"))).alias("refund_policy_override"))
    return idx.policy(course, c.unit.select(F.col("id").alias("unit_id"), F.concat(F.lit("unit "), "name").alias("refund_policy")))


@query("SELECT user_id, CAST(ceil(date_diff('second', min(ts), TIMESTAMP '2024-02-01') / 3600.0) AS BIGINT) AS stale_hours FROM events GROUP BY user_id")
def freshness_hours(c):
    seconds = tx.whole_seconds(F.min("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return c.table("events").groupBy("user_id").agg(F.ceil(seconds / 3600).alias("stale_hours"))


@query("SELECT (SELECT max(page_id) FROM pages WHERE page_id % 2 = 0) AS last_good, (SELECT min(ts) FROM events) AS observing_since")
def run_ledger(c):
    good = c.page.where("page_id % 2 = 0").agg(F.max("page_id").alias("last_good"))
    return good.crossJoin(F.broadcast(c.table("events").agg(F.min("ts").alias("observing_since"))))


@query()
def ablation_ladder(c):
    """Known-item questions of all texts whose id is divisible by 20, against all texts."""
    return idx.ablation(idx.known_items(c.chunk), c.chunk)

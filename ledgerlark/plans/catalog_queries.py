"""Filter, hydration, history and graph queries, each with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import hydrate as hyd
from ..operators import reports as rep
from ..operators import temporal as tmp
from ..operators.filters import ListingFilter
from ..operators.graph import prereq_chain
from ..sources.catalog import TODAY, Catalog
from .base_sql import BASE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SHOWN = "id, course_id, course_title, term, term_rank, campus, delivery_mode, status, is_evening, starts_on, registration_deadline, total_fee_cents, contact_hours, unit_name"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = BASE + sql
        return f

    return register


def _view(c: Catalog) -> DataFrame:
    return flt.listing_view(c.listing, c.course, c.unit)


def _filtered(name: str, f: ListingFilter, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: flt.filter_listings(_view(Catalog(spark, sf_dir)), f, TODAY)
    ORACLE[name] = f"{BASE} SELECT {SHOWN} FROM listing_view WHERE {where}"


_filtered("filter_listings_multi", ListingFilter(campus="Newark", status="open", max_fee_cents=20_000_000, min_hours=5, starts_after="1995-06-01"), "NOT is_gone AND campus = 'Newark' AND status = 'open' AND total_fee_cents <= 20000000 AND contact_hours >= 5 AND starts_on >= DATE '1995-06-01'")
_filtered("filter_fee_band", ListingFilter(min_fee_cents=1_000_000, max_fee_cents=5_000_000), "NOT is_gone AND total_fee_cents BETWEEN 1000000 AND 5000000")
_filtered("filter_date_window", ListingFilter(starts_after="1996-01-01", starts_before="1996-03-01"), "NOT is_gone AND starts_on >= DATE '1996-01-01' AND starts_on < DATE '1996-03-01'")
_filtered("filter_null_discipline", ListingFilter(is_evening=False, max_hours=30), "NOT is_gone AND is_evening = FALSE AND contact_hours <= 30")
_filtered("filter_open_for_reg", ListingFilter(open_for_reg=True, status="open"), f"NOT is_gone AND status = 'open' AND (registration_deadline IS NULL OR registration_deadline >= DATE '{TODAY}')")
_filtered("filter_include_gone", ListingFilter(include_gone=True, delivery_mode="hybrid", campus="Camden"), "delivery_mode = 'hybrid' AND campus = 'Camden'")
_filtered("filter_unit_program", ListingFilter(unit="NATION_7", program="BUILDING"), "NOT is_gone AND unit_name = 'NATION_7' AND program = 'BUILDING'")
_filtered("filter_term", ListingFilter(term="Fall 1996"), "NOT is_gone AND term = 'Fall 1996'")


@query("SELECT count(*) AS n FROM listing_view WHERE NOT is_gone AND campus = 'Newark' AND is_evening = TRUE AND total_fee_cents <= 10000000")
def count_listings(c):
    return flt.count_listings(_view(c), ListingFilter(campus="Newark", is_evening=True, max_fee_cents=10_000_000), TODAY)


_RELAX = {"campus": "campus = 'Camden'", "status": "status = 'waitlist'", "max_fee_cents": "total_fee_cents <= 3000000", "is_evening": "is_evening = TRUE"}


def _relax_sql() -> str:
    parts = []
    for k in _RELAX:
        rest = " AND ".join(v for other, v in _RELAX.items() if other != k)
        parts.append(f"SELECT '{k}' AS relaxed, count(*) AS matches, min(total_fee_cents) AS min_fee, max(total_fee_cents) AS max_fee FROM listing_view WHERE NOT is_gone AND {rest}")
    return f", r AS ({' UNION ALL '.join(parts)}), t AS (SELECT count(*) AS total FROM listing_view WHERE NOT is_gone AND {' AND '.join(_RELAX.values())}) SELECT relaxed, matches, total, min_fee, max_fee FROM r, t WHERE matches > total"


@query(_relax_sql())
def relax_single_drop(c):
    return flt.relax(_view(c), ListingFilter(campus="Camden", status="waitlist", max_fee_cents=3_000_000, is_evening=True), TODAY)


@query("SELECT id, course_title FROM course WHERE course_title ILIKE '%00001%' OR course_title ILIKE 'customer%77'")
def title_match_ilike(c):
    return flt.ids_matching(c.course, ["%00001%", "customer%77"])


@query("SELECT course_id, id, term, place FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY term_rank DESC, id) AS place FROM listing_view WHERE NOT is_gone) WHERE place <= 2")
def listings_per_course_topn(c):
    return hyd.per_course(_view(c), 2).select("course_id", "id", "term", "place")


@query("SELECT course_id, id, term, term_rank, status FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY term_rank DESC, id) AS k FROM listing) WHERE k = 1")
def latest_listing_distinct_on(c):
    return hyd.latest_per_course(c.listing)


_WANTED = ["999999999", "7", "3", "32", "abc", "3", "33"]


@query(", w AS (SELECT * FROM (VALUES (999999999, 0), (7, 1), (3, 2), (32, 3), (33, 4)) t(wid, position)) SELECT position, id, course_title, status, coalesce((SELECT string_agg(label || ':' || amount_cents, ',' ORDER BY ord) FROM listing_fee f WHERE f.listing_id = v.id), '') AS fees FROM listing_view v JOIN w ON v.id = w.wid")
def hydrate_in_request_order(c):
    cards = hyd.hydrate(_view(c), c.listing_fee, hyd.requested(c.spark, _WANTED))
    return cards.select("position", "id", "course_title", "status", F.array_join(F.transform("fees", lambda f: F.concat_ws(":", f["label"], f["amount_cents"].cast("string"))), ",").alias("fees"))


@query("SELECT listing_id, string_agg(amount_cents::VARCHAR, ',' ORDER BY ord) AS amounts, count(*) AS n_fees, max(amount_cents) AS total_fee FROM listing_fee GROUP BY listing_id")
def hydrate_cards_nested_fees(c):
    fees = hyd.nested_fees(c.listing_fee)
    return fees.select("listing_id", F.array_join(F.transform("fees", lambda f: f["amount_cents"].cast("string")), ",").alias("amounts"), F.size("fees").cast("long").alias("n_fees"), F.array_max(F.transform("fees", lambda f: f["amount_cents"])).alias("total_fee"))


@query("SELECT CAST(min(starts_on) AS VARCHAR) AS observing_since, count(DISTINCT term_season || term_year) AS terms_observed FROM listing")
def terms_observed(c):
    return hyd.observation_window(c.listing)


@query("SELECT course_id, term, term_rank, count(*) AS n, min(total_fee_cents) AS min_fee, max(total_fee_cents) AS max_fee, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, bool_or(NOT is_gone) AS any_live FROM listing GROUP BY course_id, term, term_rank")
def term_rollup(c):
    return tmp.term_rollup(c.listing).select("course_id", "term", "term_rank", "n", "min_fee", "max_fee", F.array_join("statuses", ",").alias("statuses"), "any_live")


_TERMS = ", t AS (SELECT course_id, term, term_rank, min(total_fee_cents) AS min_fee, bool_or(NOT is_gone) AS any_live FROM listing GROUP BY course_id, term, term_rank)"


@query(_TERMS + ", h AS (SELECT course_id, count(*) AS terms_seen, string_agg(term, ',' ORDER BY term_rank, term) AS terms, bool_or(any_live) AS offered_now FROM t GROUP BY course_id) SELECT c.id AS course_id, terms_seen, terms, offered_now, CASE WHEN terms_seen IS NULL THEN 'not_found' WHEN terms_seen <= 1 THEN 'insufficient' ELSE 'grounded' END AS verdict FROM course c LEFT JOIN h ON c.id = h.course_id")
def history_verdict(c):
    found = tmp.history(c.listing, c.course)
    return tmp.compose_history(found, "1995").select("course_id", "terms_seen", F.array_join(F.transform("terms", lambda t: t["term"]), ",").alias("terms"), "offered_now", "verdict")


@query(_TERMS + ", f AS (SELECT course_id, first(min_fee ORDER BY term_rank, term) AS first_fee, last(min_fee ORDER BY term_rank, term) AS last_fee, count(*) AS terms FROM t GROUP BY course_id) SELECT course_id, first_fee, last_fee, terms, last_fee - first_fee AS drift FROM f")
def fee_trend(c):
    terms = F.col("terms")
    found = tmp.history(c.listing, c.course).where("terms is not null")
    rows = found.select("course_id", F.element_at(terms, 1)["min_fee"].alias("first_fee"), F.element_at(terms, -1)["min_fee"].alias("last_fee"), F.size(terms).cast("long").alias("terms"))
    return rows.withColumn("drift", F.col("last_fee") - F.col("first_fee"))


@query(_TERMS + ", r AS (SELECT course_id, count(DISTINCT split_part(term, ' ', 1)) AS seasons, count(*) AS terms FROM t GROUP BY course_id) SELECT course_id, terms FROM r WHERE seasons = 4")
def runs_every_season(c):
    rolled = tmp.term_rollup(c.listing)
    return rolled.groupBy("course_id").agg(F.count_distinct("term_season").alias("seasons"), F.count("*").alias("terms")).where("seasons = 4").select("course_id", "terms")


@query("SELECT user_id AS listing_id, event_type AS field, event_id, round(value, 6) AS new_value, round(old, 6) AS old_value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k > 1 AND old IS DISTINCT FROM value")
def change_log(c):
    return tmp.changes(c.observation, ["listing_id", "field"], ["ts", "event_id"], "value").select("listing_id", "field", "event_id", F.round("new_value", 6).alias("new_value"), F.round("old_value", 6).alias("old_value"))


_AFTER = "SELECT id, CASE WHEN id % 4 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN NULL ELSE total_fee_cents END AS total_fee_cents, campus, delivery_mode, starts_on FROM listing"


@query(f", a AS ({_AFTER}), d AS (SELECT l.id, 'status' AS field, l.status AS old_value, a.status AS new_value FROM listing l JOIN a ON l.id = a.id UNION ALL SELECT l.id, 'total_fee_cents', CAST(l.total_fee_cents AS VARCHAR), CAST(a.total_fee_cents AS VARCHAR) FROM listing l JOIN a ON l.id = a.id) SELECT id, field, old_value, new_value FROM d WHERE old_value IS DISTINCT FROM new_value")
def watched_field_changes(c):
    watched = ["status", "total_fee_cents", "campus", "delivery_mode", "starts_on"]
    before = c.listing.select("id", *watched)
    after = before.withColumn("status", F.when(F.col("id") % 4 == 0, "closed").otherwise(F.col("status"))).withColumn("total_fee_cents", F.when(F.col("id") % 10 != 0, F.col("total_fee_cents")))
    return tmp.changed_fields(before, after, "id", watched)


@query(", walk(s, k, d) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, 1 FROM nation UNION SELECT s, (k * 7 + 3) % 25, d + 1 FROM walk WHERE d < 10) SELECT s AS start, k AS course_id, d AS depth FROM walk")
def prereq_chain_all(c):
    return prereq_chain(c.relation, c.relation.select("course_id"))


@query(
    ", e AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), w AS (SELECT a AS start, b AS course_id, 1 AS depth FROM e WHERE b IS NOT NULL"
    " UNION SELECT w.start, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.course_id WHERE e.b IS NOT NULL AND w.depth < 10) SELECT start, course_id, depth FROM w"
)
def order_chain_all(c):
    """A walk over all orders: each leads to its customer's next one."""
    orders = c.table("orders")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return prereq_chain(orders.select(F.col("o_orderkey").alias("course_id"), following.alias("requires_id")), orders.select(F.col("o_orderkey").alias("course_id")))



@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE starts_on IS NULL) AS starts_null, count(*) FILTER (WHERE campus = 'unknown') AS campus_unknown, count(*) FILTER (WHERE delivery_mode = 'unknown') AS delivery_unknown,"
    " count(*) FILTER (WHERE total_fee_cents IS NULL) AS fee_null, count(*) FILTER (WHERE term_season IS NULL) AS term_null, count(*) FILTER (WHERE is_evening IS NULL) AS evening_null FROM listing"
)
def null_rate_report(c):
    return rep.absence(c.listing)


@query("SELECT status, count(*) AS n FROM listing GROUP BY status")
def status_histogram(c):
    return c.listing.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")


@query(", p AS (SELECT id, (registration_deadline IS NOT NULL)::INT + (is_evening IS NOT NULL)::INT + (contact_hours IS NOT NULL)::INT + (NOT is_gone)::INT AS present FROM listing_view) SELECT CASE WHEN present <= 1 THEN 'sparse' WHEN present <= 3 THEN 'core' ELSE 'rich' END AS band, count(*) AS n FROM p GROUP BY 1")
def presence_band(c):
    present = F.col("registration_deadline").isNotNull().cast("int") + F.col("is_evening").isNotNull().cast("int") + F.col("contact_hours").isNotNull().cast("int") + (~F.col("is_gone")).cast("int")
    return _view(c).select(F.when(present <= 1, "sparse").when(present <= 3, "core").otherwise("rich").alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM course) AS courses, (SELECT count(*) FROM listing) AS listings, (SELECT count(*) FROM listing_fee) AS fees")
def table_counts(c):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(c.course, "courses").crossJoin(F.broadcast(one(c.listing, "listings"))).crossJoin(F.broadcast(one(c.table("lineitem"), "fees")))


@query(
    "SELECT unit_id, count(DISTINCT CASE WHEN c.id % 7 = 0 THEN 'own ' || c.id % 3 ELSE 'unit ' || u.name END) AS policies FROM course c JOIN unit u ON c.unit_id = u.id GROUP BY unit_id"
)
def policy_uniformity(c):
    course = c.course.select("unit_id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("own "), (F.col("id") % 3).cast("string"))).alias("refund_policy_override"))
    return rep.policy_texts(course, c.unit.select(F.col("id").alias("unit_id"), F.concat(F.lit("unit "), "name").alias("refund_policy")))


@query("SELECT props->>'k' AS value, count(*) AS n FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def code_frequency_top20(c):
    return rep.key_frequency(c.table("events").select(F.from_json("props", "map<string,string>").alias("page_fields")), "page_fields", "k")


@query("SELECT lang, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS least, max(length(text)) AS most, count(*) FILTER (WHERE text ILIKE '%license%') AS licensed FROM documents GROUP BY lang")
def description_profile(c):
    n = F.length("text")
    return c.chunk.groupBy("lang").agg(F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(F.col("text").ilike("%license%")).alias("licensed"))


@query(
    ", e AS (SELECT min(ts) AS created, max(ts) AS changed FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE changed > created + INTERVAL 1 DAY) AS changed,"
    " count(DISTINCT date_trunc('month', changed)) FILTER (WHERE changed > created + INTERVAL 1 DAY) AS months FROM e"
)
def observation_churn(c):
    rows = c.observation.groupBy("listing_id").agg(F.min("ts").alias("created"), F.max("ts").alias("changed"))
    return rep.churn(rows, "created", "changed")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(course_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(
    f", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY term_rank DESC, id) AS k FROM listing) WHERE k = 1), a AS (SELECT *, {_FNV} % 3 AS kind FROM last), "
    "b AS (SELECT * FROM a JOIN (VALUES (0, 1), (0, 2), (1, 2)) t(of, years_back) ON kind = of) SELECT course_id, CASE kind WHEN 0 THEN 'recurring' ELSE 'returning' END AS archetype, years_back, term_year - years_back AS term_year, "
    "term_season, term_rank - 10 * years_back AS term_rank, CAST(floor(total_fee_cents * pow(0.96, years_back) / 100 + 0.5) * 100 AS BIGINT) AS total_fee_cents, 'synthetic://' || course_id || '/' || years_back AS detail_url FROM b"
)
def synthetic_history(c):
    latest = c.listing.join(hyd.latest_per_course(c.listing).select("id"), "id")
    return tmp.synthetic_history(latest)

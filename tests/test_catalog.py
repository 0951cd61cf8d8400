import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import answer as ans
from ledgerlark.operators import evaluate as ev
from ledgerlark.operators import filters as flt
from ledgerlark.operators import hydrate as hyd
from ledgerlark.operators import ingest as ing
from ledgerlark.operators import retrieval as ret
from ledgerlark.operators import temporal as tmp
from ledgerlark.operators.filters import ListingFilter
from ledgerlark.operators.graph import prereq_chain
from ledgerlark.streaming import stateful

D = dt.date


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        (1, 1, "Newark", "online_async", "open", 150000, D(2026, 3, 1), None, "Spring 2026", 20262, False),
        (2, 1, "New Brunswick", "in_person", "full", 250000, D(2026, 10, 1), True, "Fall 2026", 20264, False),
        (3, 2, "Online", "online_sync", "open", 50000, D(2026, 6, 1), None, "Summer 2026", 20263, False),
        (4, 2, "Newark", "online_async", "open", 100000, D(2026, 4, 1), None, "Spring 2026", 20262, True),
    ]
    listing = spark.createDataFrame(rows, "id long, course_id long, campus string, delivery_mode string, status string, total_fee_cents long, starts_on date, is_evening boolean, term string, term_rank int, is_gone boolean").withColumn("registration_deadline", F.lit(None).cast("date"))
    course = spark.createDataFrame([(1, "A", "Nonprofit Management", 12.0, 1), (2, "B", "Cybersecurity", 40.0, None)], "id long, course_title string, program string, contact_hours double, unit_id long")
    unit = spark.createDataFrame([(1, "U")], "id long, name string")
    return flt.listing_view(listing, course, unit)


@pytest.mark.parametrize(
    ("filter_", "ids"),
    [
        ({}, {1, 2, 3}), ({"include_gone": True}, {1, 2, 3, 4}), ({"campus": "Newark"}, {1}), ({"campus": "Newark", "include_gone": True}, {1, 4}), ({"max_fee_cents": 160000}, {1, 3}),
        ({"status": "open"}, {1, 3}), ({"is_evening": True}, {2}), ({"starts_before": "2026-05-01"}, {1}), ({"program": "Cybersecurity"}, {3}), ({"min_hours": 20}, {3}), ({"delivery_mode": "online_async"}, {1}),
        ({"open_for_reg": False}, {1, 2, 3}), ({"unit": "U"}, {1, 2}), ({"starts_after": "2026-03-01", "starts_before": "2026-06-01"}, {1}),
    ],
)
def test_filters(view, filter_, ids):
    f = ListingFilter(**filter_)
    assert {r["id"] for r in flt.filter_listings(view, f, "2026-01-01").collect()} == ids
    assert flt.count_listings(view, f, "2026-01-01").first()["n"] == len(ids)


def test_relax(spark):
    rows = [(1, "Newark", "open", 300000, True), (2, "Newark", "open", 150000, False), (3, "Online", "open", 100000, True)]
    view = spark.createDataFrame(rows, "id long, campus string, status string, total_fee_cents long, is_evening boolean").withColumn("is_gone", F.lit(False))
    f = ListingFilter(campus="Newark", is_evening=True, max_fee_cents=200000)
    found = {r["relaxed"]: r for r in flt.relax(view, f, "2026-01-01").collect()}
    assert {k: (r["matches"], r["total"]) for k, r in found.items()} == {"campus": (1, 0), "is_evening": (1, 0), "max_fee_cents": (1, 0)}
    assert flt.relax_label("max_fee_cents", f) == "under $2000"


def test_knn_batch(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0 if i % 35 else 0.0]) for i in range(300)] + [(900, [0.0, 0.0, 0.0]), (901, None)]
    vectors = spark.createDataFrame(rows, "course_id long, embedding array<float>")
    queries = vectors.where("course_id % 20 = 0").withColumnRenamed("course_id", "query_id")
    found = collections.defaultdict(list)
    for r in ret.knn_batch(vectors, queries, limit=7, block=64, query_block=4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["course_id"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    live = [(i, v) for i, v in rows if v and any(v)]
    assert found == {q: [i for _, i in sorted((round(1 - cos(v, w), 9), i) for i, v in live)[:7]] for q, w in live if q % 20 == 0}


def test_hybrid(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "course_id long, embedding array<float>")
    chunk = spark.createDataFrame([(1, "cybersecurity basics"), (2, "grant writing for nonprofits"), (3, "watercolor painting")], "course_id long, text string")
    first = lambda *a, **k: [r["course_id"] for r in ret.hybrid(vectors, chunk, *a, 3, **k).orderBy("rank").collect()]
    assert first([0.9, 0.1, 0.0], "cybersecurity")[0] == 1
    assert first([0.0, 0.0, 1.0], "grant writing")[0] == 2
    assert 3 in first([0.0, 0.0, 1.0], "grant writing")
    assert first([0.9, 0.1, 0.0], "grant writing", use_lexical=False)[0] == 1
    assert first([0.9, 0.1, 0.0], "grant writing")[0] == 2
    found = ret.hybrid(vectors, chunk, [0.9, 0.1, 0.0], "grant writing", 3)
    assert [r["new_rank"] for r in ret.rerank(found, chunk, "x", by_overlap=False).orderBy("rank").collect()] == [1, 2, 3]
    assert ret.parsed_query('"grant writing" or proposals -art') == {"all": [["grant"], ["writing", "proposals"]], "none": ["art"], "phrases": [["grant", "writing"]]}


def test_prereq_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, None)], "course_id long, requires_id long")
    rows = prereq_chain(edges, spark.createDataFrame([(1,)], "course_id long")).orderBy("depth").collect()
    assert [(r["course_id"], r["depth"]) for r in rows][:3] == [(2, 1), (3, 2), (1, 3)]
    assert max(r["depth"] for r in rows) == 10 and len(rows) == 10


def test_hydrate_order(spark, view):
    fee = spark.createDataFrame([(3, 1, "Total Fees", 41500), (3, 0, "Tuition", 40000)], "listing_id long, ord int, label string, amount_cents long")
    cards = hyd.hydrate(view, fee, hyd.requested(spark, ["999999", "3", "x", "1", "3"])).collect()
    assert [r["id"] for r in cards] == [3, 1]
    assert [f["label"] for f in cards[0]["fees"]] == ["Tuition", "Total Fees"] and cards[1]["fees"] == []


def test_crawl_scenario(spark):
    at = lambda day: F.to_timestamp(F.lit(f"2026-01-{day:02d} 00:00:00"))
    urls = [f"u{i}" for i in range(1, 6)]
    state = spark.createDataFrame([], "url string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, disappeared_at timestamp")
    runs = spark.createDataFrame([], "id int, pages_seen int, status string")

    def crawl(state, fetched, day):
        return ing.observe(state, spark.createDataFrame(fetched, "url string, content_hash string, not_modified boolean"), at(day))

    state = crawl(state, [(u, "h", False) for u in urls], 1)
    state = ing.sweep(state, runs, 5, at(1))
    assert state.where("disappeared_at is not null").count() == 0 and state.first()["swept"]
    runs = spark.createDataFrame([(1, 5, "ok"), (2, 9, "failed")], "id int, pages_seen int, status string")
    state = crawl(state.drop("swept"), [("u1", "h2", False), *((u, None, True) for u in urls[1:])], 2)
    assert {r["url"]: r["content_hash"] for r in state.collect()} == {"u1": "h2"} | {u: "h" for u in urls[1:]}
    refused = ing.sweep(crawl(state, [(u, None, True) for u in urls[:2]], 3), runs, 2, at(3))
    assert refused.where("disappeared_at is not null").count() == 0 and not refused.first()["swept"]
    swept = ing.sweep(crawl(state, [(u, None, True) for u in urls[:4]], 4), runs, 4, at(4))
    assert [r["url"] for r in swept.where("disappeared_at is not null").collect()] == ["u5"]
    back = crawl(swept.drop("swept"), [("u5", None, True)], 5)
    assert back.where("disappeared_at is not null").count() == 0


def test_robots():
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: Bot\nDisallow: /x"
    assert ing.robots_rules(text, "bot/1") == [(False, "/x")]
    assert (False, "/private") in ing.robots_rules(text, "other")
    assert ing.robots_rules("User-agent: a\nDisallow: /", "b") == []


def test_robots_paths(spark):
    rules = ing.robots_rules("User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n", "any")
    paths = {"/": True, "/private/x": False, "/private/open/1": True, "/a/b.pdf": False, "/a/b.pdfx": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["ok"] for r in df.select("p", ing.robots_allowed(F.col("p"), rules).alias("ok")).collect()} == paths


HTML = """<html><head><title>T</title></head><body><nav>chrome</nav><div role="main"><h1>Math Series</h1><p>First.</p><p>{description}</p>
<table><tr><td>Status</td><td>{status}</td></tr><tr><td>Course ID<br>Section ID</td><td>M1<br>MathSeries-94</td></tr><tr><td>$ 149</td><td>Tuition</td></tr><tr><td>$ 20</td><td>Total Fees</td></tr></table>
<a href="searchResults.cfm?couID=30092"><img alt="x" title="More offerings like this."></a></div></body></html>"""


def test_page_fields(spark):
    pages = [(1, HTML.format(status="Registration Available", description="d"), "http://h/a/b"), (2, HTML.format(status="Course Full", description="d"), "http://h/a/b"), (3, HTML.format(status="Registration Available", description="e"), "http://h/a/b"), (4, None, None)]
    rows = ing.segments(spark.createDataFrame(pages, "id int, html string, url string").select("id", ing.extract_fields("html", "url").alias("page"))).orderBy("id").collect()
    page = rows[0]["page"]
    assert page["title"] == "Math Series" and page["fields"] == {"status": "Registration Available", "courseId": "M1", "sectionId": "MathSeries-94"}
    assert [(f["amount"], f["label"]) for f in page["fees"]] == [("149", "Tuition"), ("20", "Total Fees")]
    assert page["group_url"] == "http://h/a/searchResults.cfm?couID=30092" and page["prose"] == "First.\nd"
    assert rows[0]["course_hash"] == rows[1]["course_hash"] and rows[0]["listing_hash"] != rows[1]["listing_hash"]
    assert rows[0]["course_hash"] != rows[2]["course_hash"] and rows[0]["listing_hash"] == rows[2]["listing_hash"]


def test_history(spark):
    rows = [(1, "Fall 2024", "Fall", 2024, 20244, 43000, "open", True), (1, "Fall 2025", "Fall", 2025, 20254, 44000, "full", True), (1, "Fall 2026", "Fall", 2026, 20264, 45000, "open", False), (2, "Fall 2026", "Fall", 2026, 20264, 10000, "open", False), (3, "Fall 2024", "Fall", 2024, 20244, 1000, "open", True), (3, "Fall 2025", "Fall", 2025, 20254, 1000, "open", True)]
    listing = spark.createDataFrame(rows, "course_id long, term string, term_season string, term_year int, term_rank int, total_fee_cents long, status string, is_gone boolean")
    course = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id long, course_title string")
    out = {r["course_id"]: r for r in tmp.compose_history(tmp.history(listing, course), "2024-01-01").collect()}
    assert [out[i]["verdict"] for i in (1, 2, 3, 4)] == ["grounded", "insufficient", "grounded", "not_found"]
    assert "Fall 2024, Fall 2025, and Fall 2026" in out[1]["prose"] and "$430 to $450" in out[1]["prose"]
    assert "hasn't appeared since" in out[3]["prose"] and "held at $10" in out[3]["prose"]


def test_changes(spark):
    before = spark.createDataFrame([(1, "open", 5, None)], "id long, status string, fee int, campus string")
    after = spark.createDataFrame([(1, "full", 5, None)], "id long, status string, fee int, campus string")
    assert [tuple(r) for r in tmp.changed_fields(before, after, "id", ["status", "fee", "campus"]).collect()] == [(1, "status", "open", "full")]


def test_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([9], [1]), ([], []), ([5, 1], [1])], "r array<long>, t array<long>")
    rows = df.select(ev.ndcg(F.col("r"), F.col("t"), 10), ev.recall(F.col("r"), F.col("t"), 10), ev.reciprocal_rank(F.col("r"), F.col("t"))).collect()
    assert rows[0][0] == pytest.approx((1 + 0.5) / (1 + 1 / 1.5849625), 1e-6) and rows[0][1:] == (1.0, 1.0)
    assert [tuple(r) for r in rows[1:3]] == [(0.0, 0.0, 0.0)] * 2
    assert rows[3][2] == 0.5
    assert ev.gate({"a": 97.9}, {"a": 100.0}) == ["a"] and ev.gate({"a": 98.0}, {"a": 100.0}) == []


def test_router():
    today = "2026-07-21"
    assert ans.route("Evening classes in Newark under $500", today).filter == ListingFilter(campus="Newark", max_fee_cents=50000, is_evening=True)
    assert ans.route("fully online courses this fall", today).filter.term == "Fall 2026"
    assert ans.next_term("Spring", today) == "Spring 2027"
    assert ans.route("Can I get a refund?", today) == ans.Route(refuse=True)
    assert ans.route("How often is grant writing offered?", today).history
    assert ans.route("watercolor", today) == ans.Route(search="watercolor")
    assert ans.decode_route({"filter": {"include_gone": False}}) == ans.Route()
    assert ans.decode_route({"filter": {"max_fee_cents": 100.4, "bad": 1}}).filter is None
    assert ans.decode_route({"filter": {"max_fee_cents": 100.4}}).filter == ListingFilter(max_fee_cents=100)


def test_answers(spark):
    refs = spark.createDataFrame([(0, 5, "a"), (1, 9, "b"), (2, 5, "c")], "place int, listing_id long, why string")
    allowed = spark.createDataFrame([(5,), (6,)], "id long")
    assert [tuple(r) for r in ans.grounded(refs, allowed).collect()] == [(5, 0, "a")]
    prose = spark.createDataFrame([("one two three four five six seven",)], "prose string")
    cards = spark.createDataFrame([(5, 0), (6, 1)], "id long, position int")
    rows = ans.events(prose, cards).collect()
    assert [r["event"] for r in rows] == ["filter", "prose", "prose", "card", "card", "window", "done"]
    assert "".join(r["data"] for r in rows if r["event"] == "prose") == "one two three four five six seven"
    assert ans.unfaithful(spark.createDataFrame([("It costs $5",), ("A fine course",)], "prose string")).count() == 1


def test_token_bucket(spark):
    tokens, last, allowed = 12.0, 0, []
    for _ in range(13):
        tokens, ok, wait = stateful.take(tokens, last, 0)
        allowed.append(ok)
    assert allowed == [True] * 12 + [False] and wait == 2
    assert stateful.take(tokens, 0, 2000)[1]
    rows = spark.createDataFrame([(k, 0) for k in (1, 2) for _ in range(13)], "key long, at_ms long")
    out = stateful.rate_limited(rows).groupBy("key").agg(F.count_if("allowed").alias("n")).collect()
    assert {r["key"]: r["n"] for r in out} == {1: 12, 2: 12}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, i * 10) for i in range(14)], "key long, at_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at_ms long").parquet(str(tmp_path / "in"))
    q = stateful.rate_limited_stream(stream).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("decisions").where("allowed").count() == 12


def test_session_lock(spark):
    runs = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (1, 3, 10, 12), (2, 4, 0, 1)], "session_id long, run_id long, started long, ended long")
    assert {r["run_id"]: r["acquired"] for r in stateful.session_locks(runs).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_empty_inputs(spark, view):
    none = view.where("false")
    assert flt.filter_listings(none, ListingFilter(), "2026-01-01").count() == 0
    assert hyd.observation_window(none.select("starts_on", F.lit("x").alias("term_season"), F.lit(1).alias("term_year"))).first()[:] == ("unknown", 0)


def test_filters_of_every_kind_meet_the_listings_that_fit(spark, monkeypatch):
    from ledgerlark.operators import answer as ans
    from ledgerlark.sources.catalog import TODAY

    monkeypatch.setattr(ans, "BLOCK", 2)
    listings = [(i, ("Newark", "Camden", None)[i % 3], ("hybrid", "online_sync")[i % 2], (True, False, None)[i % 3], i * 100, 10 - i, i % 5 == 0) for i in range(12)]
    view = spark.createDataFrame(listings, "id long, campus string, delivery_mode string, is_evening boolean, total_fee_cents long, term_rank int, is_gone boolean")
    view = view.selectExpr("*", "'Fall 2026' AS term", "'open' AS status", "10.0D AS contact_hours", "CAST(NULL AS DATE) AS registration_deadline")
    texts = ["Newark", "under $5", "under $6", "over $3", "hybrid in Newark under $8", "evening", "hybrid", "under $5", "anything", None, "at least 5 hours"]
    asked = ans.routed(spark.createDataFrame(list(enumerate(texts)), "item_id long, question string"), TODAY)
    kept = {r["item_id"]: r["route"]["filter"] for r in asked.collect()}
    found = {}
    for r in ans.answer_filters(asked, view, TODAY, 4).orderBy("item_id", "rank").collect():
        found.setdefault(r["item_id"], []).append(r["id"])
    for item, f in kept.items():
        fits = [x for x in listings if f is not None and not x[6]]
        for k, at in (("campus", 1), ("delivery_mode", 2), ("is_evening", 3)):
            fits = [x for x in fits if f[k] is None or x[at] == f[k]]
        fits = [x for x in fits if (f["max_fee_cents"] is None or x[4] <= f["max_fee_cents"]) and (f["min_fee_cents"] is None or x[4] >= f["min_fee_cents"])]
        assert found.get(item, []) == [x[0] for x in sorted(fits, key=lambda x: (-x[5], x[0]))[:4]], texts[item]
    assert len({tuple(v) for v in found.values()}) > 3


def test_only_a_few_pages_are_python_objects_at_once():
    import tracemalloc

    import pyarrow as pa

    cells = "".join(f"<tr><td>Label {i}</td><td>value {i}</td></tr>" for i in range(20))
    pages = pa.array([f"<h1>Page {k}</h1><p>{'prose ' * 50}</p><table>{cells}</table>" for k in range(3000)] + [None])
    tracemalloc.start()
    made = ing.extract_fields.func(pages, pa.array(["https://x/"] * 3000 + [None]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20
    assert len(made) == 3001 and made[2999].as_py()["title"] == "Page 2999" and made[2999].as_py()["fields"][3] == ("label3", "value 3")
    assert made[3000].as_py() == {"title": "", "fields": [], "fees": [], "prose": "", "group_url": None}

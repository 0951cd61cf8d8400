"""Queries against their SQL over small odd tables, put beside the other test tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import lexicon as lex

from .test_queries import ORACLE, QUERIES, SF, plain


@pytest.fixture
def folder(tmp_path):
    """A folder with the test tables; ``replace`` puts others in their places."""
    for path in glob.glob(f"{SF}/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    return tmp_path


def replace(folder, table, select):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    os.unlink(folder / f"{table}.parquet")
    con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")


def rows_of(spark, folder, name):
    """(the query's rows, its SQL's), both in one order."""
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(ORACLE[name])
    theirs, columns = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(theirs) == columns
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))
    return order([[r[c] for c in columns] for r in df.collect()]), order([[r[theirs.index(c)] for c in columns] for r in found.fetchall()])


@pytest.mark.parametrize("name", ["freshness_all", "freshness_labels", "freshness_hours"])
def test_ages_are_of_whole_seconds(spark, folder, name):
    """Times a part of a second before a minute's, an hour's and a day's end."""
    ends = "(TIMESTAMP '2024-01-31 23:59:00'), (TIMESTAMP '2024-01-31 22:00:00'), (TIMESTAMP '2024-01-31 20:00:00'), (TIMESTAMP '2024-01-29 00:00:00'), (TIMESTAMP '2024-02-01 00:00:00')"
    cuts = "(-1), (0), (1), (999), (500000), (999999), (1000000)"
    replace(folder, "events", f"SELECT row_number() OVER () AS event_id, t + to_microseconds(d) AS ts, row_number() OVER () AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM (VALUES {ends}) e(t), (VALUES {cuts}) c(d)")
    ours, sql = rows_of(spark, folder, name)
    assert ours == sql and len(ours) >= 28


@pytest.mark.parametrize("name", ["page_state_lookup", "crawl_pipeline"])
def test_pages_of_one_url_are_pages_of_their_own(spark, folder, name):
    replace(folder, "pages", "SELECT page_id * 3 + i AS page_id, CASE WHEN i < 2 THEN url WHEN page_id % 2 = 0 THEN url || '#top' END AS url, CASE WHEN i < 2 OR page_id % 3 > 0 THEN html || (i // 2) END AS html FROM pages, range(3) r(i)")
    ours, sql = rows_of(spark, folder, name)
    assert ours == sql


def test_courses_may_share_a_title(spark, folder):
    replace(folder, "customer", "SELECT * REPLACE ('Customer#' || (c_custkey % 20) AS c_name) FROM customer")
    ours, sql = rows_of(spark, folder, "agent_first_answers")
    assert ours == sql and len(ours) > 4


def test_a_word_of_all_texts_costs_no_more_than_a_rare_one(spark):
    """Of texts that all hold one word, each question meets those of its rare word only."""
    n = 400
    chunk = spark.range(n).select(F.col("id").alias("course_id"), F.concat(F.lit("common w"), F.col("id").cast("string")).alias("text"))
    asked = chunk.select(F.col("course_id").alias("query_id"), F.col("text").alias("question"))
    found = lex.search(lex.postings(chunk), asked)
    assert sorted((r["query_id"], r["course_id"]) for r in found.collect()) == [(i, i) for i in range(n)]
    rows, plans = [], [found._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        metric = plan.metrics().get("numOutputRows")
        rows += [metric.get().value()] if "Join" in plan.nodeName() and metric.isDefined() else []
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())] + ([plan.plan()] if plan.nodeName().endswith("QueryStage") else [])
    assert rows and max(rows) <= 4 * n

import glob
import math
import os

import duckdb
import pytest

from ledgerlark.plans import catalog_queries, detail_queries, pipeline_queries, text_queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = catalog_queries.QUERIES | text_queries.QUERIES | pipeline_queries.QUERIES | detail_queries.QUERIES
ORACLE = catalog_queries.ORACLE | text_queries.ORACLE | pipeline_queries.ORACLE | detail_queries.ORACLE


@pytest.fixture(scope="module")
def con():
    out = {}
    for folder in (SF, LARGER):
        out[folder] = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            out[folder].execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return out


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("folder", [SF, LARGER])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = con[folder].execute(ORACLE[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))
    assert order([[r[c] for c in columns] for r in df.collect()]) == order([[r[theirs.index(c)] for c in columns] for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_course_with_listings_is_hydrated(spark):
    live = QUERIES["compact_index"](spark, SF).count()
    found = [len(r["listings"].split(",")) for r in QUERIES["get_course_all"](spark, SF).collect()]
    assert sum(found) == live and len(found) == QUERIES["get_course"](spark, SF).count()


def test_crossover_over_the_table(spark):
    rows = QUERIES["crossover_recall"](spark, SF).collect()
    assert len(rows) == 12 and all(r["recall"] >= 0.9 and r["median_ms"] > 0 for r in rows) and {r["recall"] for r in rows if r["method"] == "exact"} == {1.0}

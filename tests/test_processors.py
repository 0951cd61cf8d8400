"""Streams with typed state and timers against the tables' functions, in several batches, after a restart, and with late rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.streaming import processors, stateful

SF = "/root/testdata/sf0.001"
FAR = 1 << 42


@pytest.fixture
def rocks(spark):
    spark.conf.set(*processors.STORE)
    yield spark
    spark.conf.unset(processors.STORE[0])


def run(spark, source, schema, stream, out, mark):
    """All that is there now, from where the last run ended."""
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream(given).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def parts(df, order, n, source):
    """Write rows in the order of their times to n files, within a file in any order, then one far ahead of all."""
    bounds = df.approxQuantile(order, [k / n for k in range(n + 1)], 0.0)
    for k in range(n):
        yield df.where((F.col(order) >= bounds[k]) & ((F.col(order) < bounds[k + 1]) if k + 1 < n else F.lit(True))).orderBy(F.xxhash64(*df.columns)).coalesce(1)


def test_buckets(rocks, tmp_path):
    spark, source, out, mark = rocks, *(str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 5).alias("key"), (F.unix_millis(F.col("ts").cast("timestamp")) / 36000).cast("long").alias("at_ms")).persist()
    schema = "key long, at_ms long"
    last = spark.createDataFrame([(-1, FAR)], schema)
    each = [*parts(rows, "at_ms", 3, source), last]
    for part in each[:2]:
        part.write.mode("append").parquet(source)
    run(spark, source, schema, processors.rate_limited, out, mark)
    assert spark.read.parquet(out).count() < rows.count()
    late = rows.limit(1).select("key", F.lit(0).cast("long").alias("at_ms"))  # later than the watermark: no decision
    for part in (late, *each[2:]):
        part.write.mode("append").parquet(source)
        run(spark, source, schema, processors.rate_limited, out, mark)
    found = spark.read.parquet(out).where("key >= 0")
    expected = stateful.rate_limited(rows)
    assert found.count() == expected.count() and found.exceptAll(expected).count() == 0
    assert {r["allowed"] for r in found.select("allowed").distinct().collect()} == {True, False}


def test_locks(rocks, tmp_path):
    spark, source, out, mark = rocks, *(str(tmp_path / x) for x in ("in", "out", "mark"))
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("run_id"), start.alias("started"), (start + (F.col("event_id") % 48) * 3600000).alias("ended")).persist()
    schema = "session_id long, run_id long, started long, ended long"
    last = spark.createDataFrame([(-1, 1, FAR, FAR)], schema)
    for part in [*parts(rows, "started", 3, source), last]:
        part.write.mode("append").parquet(source)
        run(spark, source, schema, processors.session_locks, out, mark)
    found = spark.read.parquet(out).where("session_id >= 0")
    decided = found.where("event <> 'expired'").select("session_id", "run_id", (F.col("event") == "acquired").alias("acquired"))
    expected = stateful.session_locks(rows)
    assert decided.count() == expected.count() and decided.exceptAll(expected).count() == 0
    held = found.where("event = 'acquired'").select("session_id", "run_id").join(rows.select("session_id", "run_id", "ended"), ["session_id", "run_id"])
    expired = found.where("event = 'expired'").select("session_id", "run_id", F.col("at_ms").alias("ended"))
    assert expired.count() == held.count() and expired.exceptAll(held).count() == 0  # each lock ends, the last ones without another run

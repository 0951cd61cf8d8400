"""Closed vocabularies, constants and table schemas of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies of the catalogue's closed columns.
VOCABULARY = {
    "status": ("open", "full", "waitlist", "closed", "unknown"),
    "delivery_mode": ("in_person", "online_sync", "online_async", "hybrid", "unknown"),
    "campus": ("New Brunswick", "Newark", "Camden", "Online", "Other", "unknown"),
    "term_season": ("Winter", "Spring", "Summer", "Fall"),
    "kind": ("required", "recommended", "corequisite", "concurrent"),
    "extraction_status": ("ok", "schema_error", "refused", "timeout"),
    "verdict": ("grounded", "insufficient", "not_found"),
}
# Limits and weights.
RRF_K, POOL, RERANK_POOL = 60, 50, 50
CANDIDATE_LIMIT, SEARCH_K, FILTER_LIMIT, EVAL_K, METRIC_K = 8, 12, 400, 20, 10
SWEEP_FRACTION, GATE_TOLERANCE, HISTORY_CHANGES, MAX_DEPTH = 0.8, 2.0, 100, 10
RATE_PER_MINUTE, RATE_BURST = 30, 12
EVENING_HOUR, TOKEN_CLAMP, PREFIX_CHARS = 17, 32767, 500

_text, _long, _int = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "source_page": _struct(id=_text, url=_text, content_hash=_text, course_hash=_text, listing_hash=_text, raw_markdown=_text, page_fields=T.MapType(_text, _text), http_status=_int, etag=_text, group_url=_text, first_seen_at=T.TimestampType(), last_seen_at=T.TimestampType(), disappeared_at=T.TimestampType()),
    "page_snapshot": _struct(source_page_id=_text, content_hash=_text, raw_markdown=_text, first_seen_at=T.TimestampType(), last_seen_at=T.TimestampType()),
    "crawl_run": _struct(id=_long, started_at=T.TimestampType(), finished_at=T.TimestampType(), pages_seen=_long, status=_text, swept=T.BooleanType()),
    "unit": _struct(id=_long, name=_text, campus=_text),
    "course": _struct(id=_long, unit_id=_long, course_title=_text, title_normalized=_text, group_url=_text, program=_text, contact_hours=T.DoubleType(), description=_text, audience=_text, prerequisite_text=_text),
    "listing": _struct(id=_long, course_id=_long, term=_text, term_year=_int, term_season=_text, term_rank=_int, starts_on=T.DateType(), registration_deadline=T.DateType(), is_evening=T.BooleanType(), delivery_mode=_text, campus=_text, status=_text, total_fee_cents=_long, disappeared_at=T.TimestampType()),
    "listing_fee": _struct(listing_id=_long, ord=_int, label=_text, amount_cents=_long, is_total=T.BooleanType()),
    "course_relation": _struct(course_id=_long, requires_id=_long, raw_text=_text, source=_text, kind=_text),
    "listing_change": _struct(listing_id=_long, observed_at=T.TimestampType(), field=_text, old_value=_text, new_value=_text),
    "extraction": _struct(source_page_id=_text, status=_text, raw_json=_text, error=_text, model=_text, prompt_version=_text, observed_at=T.TimestampType()),
    "chunk": _struct(id=_long, course_id=_long, ord=_int, context_prefix=_text, text=_text, token_count=_int),
    "chunk_embedding": _struct(chunk_id=_long, model_id=_long, embedding=T.ArrayType(T.FloatType())),
    "eval_item": _struct(id=_long, question=_text, shape=_text, expected_filter=_text, expected_ids=T.ArrayType(_long), reviewed_at=T.TimestampType()),
    "chat_message": _struct(id=_long, session_id=_text, role=_text, prose=_text, filter=_text, refused=T.BooleanType()),
    "feedback": _struct(message_id=_long, rating=_int, note=_text),
}


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def invalid(df: DataFrame) -> DataFrame:
    """Rows whose closed columns hold a value outside their vocabulary, with the column's name in ``violates``."""
    checks = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*VOCABULARY[c]), F.lit(c)) for c in df.columns if c in VOCABULARY]
    if not checks:
        return df.withColumn("violates", F.lit(None).cast("string")).where("false")
    return df.withColumn("violates", F.coalesce(*checks)).where("violates is not null")


def term_rank(year: Column, season: Column) -> Column:
    """Year times ten plus the season's number; unknown parts count nothing."""
    return F.coalesce(year, F.lit(0)) * 10 + F.when(season == "Winter", 1).when(season == "Spring", 2).when(season == "Summer", 3).when(season == "Fall", 4).otherwise(0)

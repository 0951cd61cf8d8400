"""Extraction decoding and persistence, course upserts, index building, golden-set seeding and batched evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import normalized_title
from ..functions.text import estimate_tokens, tokens
from ..functions.vectors import hashed_embedding
from ..schemas import EVAL_K, RRF_K
from ..sources.commits import cut, work_folder
from . import postings
from .evaluate import LADDER, score
from .retrieval import knn_batch


def decode_extractions(raw: DataFrame, schema: str) -> DataFrame:
    """Model output (id, raw_json) to typed fields with a status: what doesn't decode is a schema_error row, what is missing a refused one."""
    parsed = F.from_json("raw_json", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    status = F.when(F.col("raw_json").isNull(), "refused").when(F.col("fields").isNull() | F.col("fields._bad").isNotNull(), "schema_error").otherwise("ok")
    return raw.withColumn("fields", parsed).withColumn("status", status).withColumn("error", F.when(F.col("status") == "schema_error", F.col("fields._bad")))


def course_key(group_url: Column, title: Column) -> Column:
    """A course's natural key: its group's page, else its normalised title."""
    return F.coalesce(group_url, F.concat(F.lit("t:"), normalized_title(title)))


def last_writer(rows: DataFrame, key: Column, order: str, columns: list[str]) -> DataFrame:
    """One row per key, the latest by ``order``: an aggregate that combines before the shuffle."""
    return rows.groupBy(key.alias("key")).agg(F.max_by(F.struct(*columns), order).alias("last"), F.count("*").alias("writes")).select("key", "last.*", "writes")


def index_chunks(chunk: DataFrame, done: DataFrame, width: int = 64) -> DataFrame:
    """Chunks that have no embedding yet, with token count and embedding."""
    todo = chunk.join(done.select("course_id"), "course_id", "left_anti")
    return todo.select("course_id", F.lit(0).alias("ord"), estimate_tokens(F.col("text")).alias("token_count"), hashed_embedding(F.col("text"), width).alias("embedding"))


def compact_lines(view: DataFrame) -> DataFrame:
    """One short line per live listing, for a prompt that holds the whole index, and its rough token count."""
    line = F.concat_ws(" | ", F.col("id").cast("string"), "course_title", "term", "campus", "status")
    return view.where(~F.col("is_gone")).select("id", line.alias("line"), F.ceil(F.length(line) / 4).alias("tokens"))


def reconcile(items: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items to write, orphans to delete) of a golden set."""
    return keep.join(items.select(key), key, "left_anti"), items.join(keep.select(key), key, "left_anti")


_OVERLAP = "query_id long, course_id long, bare int, full int, words int, lang string, chunk_lang string, overlap int"
_SPACES = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B else 0x20 for b in range(256))


def _overlaps(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Arrow cogroup function: questions and their candidates with the text's language and how many of the question's words stand in it."""
    at = pc.index_in(pairs.column("course_id").combine_chunks(), value_set=texts.column("course_id").combine_chunks())
    place = at.to_numpy(zero_copy_only=False)
    bodies, asked = texts.column("text"), pairs.column("asked").combine_chunks()
    overlap, last, words = np.zeros(len(place), dtype=np.int32), None, frozenset()
    order = np.argsort(place, kind="stable")
    for i in range(0, len(order), 4096):
        for k, each in zip(order[i : i + 4096].tolist(), asked.take(pa.array(order[i : i + 4096])).to_pylist(), strict=True):
            if place[k] != last:
                last = place[k]
                words = frozenset((bodies[int(last)].as_py() or "").encode().translate(_SPACES).decode().split())
            overlap[k] = len(words.intersection(each))
    kept = pairs.select(["query_id", "course_id", "bare", "full", "words", "lang"])
    return kept.append_column("chunk_lang", texts.column("chunk_lang").take(at)).append_column("overlap", pa.array(overlap))


def ablation(items: DataFrame, chunk: DataFrame, width: int = 64, limit: int = EVAL_K) -> DataFrame:
    """Mean metrics of each ladder row over all questions, in one plan.

    ``items`` has (item_id, question, relevant, lang), ``chunk`` (course_id, text, lang), where the first line of a text
    is its prefix. Three pools a question, by vectors with and without the prefix and by words of a stored index, are searched once; a
    ladder row takes its pools' ranks, fuses them, reranks by overlap with the question, or keeps the candidates that fit
    the question's filter (here its language; all of them where none fits).
    """
    items = cut(items.select("item_id", "question", "relevant", "lang"))
    stored = work_folder(chunk.sparkSession)
    postings.write(chunk.select("course_id", "text"), stored)
    bare = F.regexp_replace("text", r"^[^\n]*\n", "")
    vectors = lambda text: chunk.select("course_id", hashed_embedding(text, width).alias("embedding"))
    asked = items.select(F.col("item_id").alias("query_id"), "question", hashed_embedding(F.col("question"), width).alias("embedding"))
    words = F.array_join(F.array_distinct(tokens(F.col("question"))), " or ")
    lists = {
        "bare": knn_batch(vectors(bare), asked.select("query_id", "embedding")),
        "full": knn_batch(vectors(F.col("text")), asked.select("query_id", "embedding")),
        "words": postings.search(postings.read(chunk.sparkSession, stored), asked.select("query_id", words.alias("question"))),
    }
    pools = None
    for name, found in lists.items():
        one = found.select("query_id", "course_id", *[F.when(F.lit(n == name), F.col("rank")).alias(n) for n in lists])
        pools = one if pools is None else pools.unionByName(one)
    pools = pools.groupBy("query_id", "course_id").agg(*[F.min(n).alias(n) for n in lists])
    known = items.select(F.col("item_id").alias("query_id"), "lang", F.array_distinct(tokens(F.col("question"))).alias("asked"))
    body = chunk.select("course_id", F.lower("text").alias("text"), F.col("lang").alias("chunk_lang"))
    parts = 1 + (chunk.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // postings.SHARD_BYTES
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("course_id"), F.lit(parts)))
    rows = dealt(pools.join(known, "query_id")).groupBy("part").cogroup(dealt(body).groupBy("part")).applyInArrow(_overlaps, _OVERLAP)
    ladder = chunk.sparkSession.createDataFrame([(r["row"], r["name"], r["prefix"], r["lexical"], r["rerank"], r["filter"]) for r in LADDER], "row int, name string, prefix boolean, lexical boolean, rerank boolean, filter boolean")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))
    each = rows.crossJoin(F.broadcast(ladder)).withColumn("rrf", part(F.when(F.col("prefix"), F.col("full")).otherwise(F.col("bare"))) + F.when(F.col("lexical"), part(F.col("words"))).otherwise(0.0))
    fits = F.col("chunk_lang").eqNullSafe(F.col("lang"))
    question = Window.partitionBy("row", "query_id")
    each = each.where("rrf > 0").withColumn("some", F.max(fits.cast("int")).over(question)).where(~F.col("filter") | fits | (F.col("some") == 0))
    order = [F.when(F.col("rerank"), F.col("overlap")).otherwise(0).desc(), F.col("rrf").desc(), "course_id"]
    best = each.withColumn("rank", F.row_number().over(question.orderBy(*order))).where(F.col("rank") <= limit)
    keyed = best.select(F.struct("row", "query_id").alias("item_id"), F.col("course_id").alias("id"), "rank")
    wanted = items.crossJoin(F.broadcast(ladder.select("row"))).select(F.struct("row", F.col("item_id").alias("query_id")).alias("item_id"), "relevant")
    scored = score(wanted, keyed).groupBy(F.col("item_id.row").alias("row")).agg(F.avg("ndcg_10").alias("ndcg_10"), F.avg("recall_10").alias("recall_10"), F.avg("mrr").alias("mrr"))
    return scored.join(F.broadcast(ladder.select("row", "name")), "row").select("row", "name", "ndcg_10", "recall_10", "mrr")


def known_items(chunk: DataFrame, words: int = 6) -> DataFrame:
    """Known-item questions: of every text whose id is divisible by 20, words from its middle; relevant are all texts equal to it."""
    split = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    part = F.slice(split, F.greatest(F.lit(1), (F.size(split) / 2).cast("int") - words // 2), words)
    same = chunk.groupBy(F.sha2("text", 256).alias("same")).agg(F.sort_array(F.collect_list("course_id")).alias("relevant"))
    asked = chunk.where("course_id % 20 = 0").select(F.col("course_id").alias("item_id"), F.array_join(part, " ").alias("question"), F.sha2("text", 256).alias("same"), "lang")
    return asked.join(same, "same").drop("same")


def get_course(view: DataFrame, fee: DataFrame, course_ids: DataFrame) -> DataFrame:
    """Courses with their live listings nested, each with its number of fee lines."""
    chosen = view.where(~F.col("is_gone")).join(course_ids, "course_id", "left_semi")
    lines = fee.join(chosen.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").groupBy("listing_id").agg(F.count("*").alias("n_fees"))
    rows = chosen.join(lines, F.col("id") == F.col("listing_id"), "left")
    nested = F.array_sort(F.collect_list(F.struct("id", "term", "status", F.coalesce("n_fees", F.lit(0)).alias("n_fees"))))
    return rows.groupBy("course_id", "course_title").agg(nested.alias("listings"))


def policy(course: DataFrame, unit: DataFrame) -> DataFrame:
    """A course's own refund policy, else its unit's."""
    return course.join(unit, "unit_id", "left").select("course_id", F.coalesce("refund_policy_override", "refund_policy").alias("policy"))


def reviewed(items: DataFrame) -> DataFrame:
    """Items that somebody has reviewed, in order; only these are evaluated."""
    return items.where("reviewed_at is not null").orderBy("item_id")


def course_details(view: DataFrame, fee: DataFrame, instructor: DataFrame, relation: DataFrame, policies: DataFrame) -> DataFrame:
    """Every course with a live listing: unit, refund policy, relations, and its live listings, each with its total fee
    lines and instructors, nested in order. Children are aggregated by their parent before they are joined."""
    live = view.where(~F.col("is_gone"))
    lines = fee.groupBy("listing_id").agg(F.count("*").alias("n_fees"), F.max("amount_cents").alias("largest_fee"))
    people = instructor.groupBy("listing_id").agg(F.sort_array(F.collect_set("name")).alias("instructors"))
    none = F.array().cast("array<string>")
    rows = live.join(lines.withColumnRenamed("listing_id", "id"), "id", "left").join(people.withColumnRenamed("listing_id", "id"), "id", "left")
    listing = F.struct("id", "term", "status", F.coalesce("n_fees", F.lit(0)).alias("n_fees"), "largest_fee", F.coalesce("instructors", none).alias("instructors"))
    nested = rows.groupBy("course_id", "course_title", "unit_name").agg(F.array_sort(F.collect_list(listing)).alias("listings"))
    needs = relation.groupBy("course_id").agg(F.sort_array(F.collect_set("requires_id")).alias("requires"))
    return nested.join(needs, "course_id", "left").join(policies, "course_id", "left").withColumn("requires", F.coalesce("requires", F.array().cast("array<bigint>")))


def compare_courses(details: DataFrame, wanted: DataFrame) -> DataFrame:
    """The details of the wanted courses (course_id, position), in the order in which they are asked for."""
    return details.join(wanted.groupBy("course_id").agg(F.min("position").alias("position")), "course_id").orderBy("position")

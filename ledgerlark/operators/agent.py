"""The batched agent: many questions from route to cards in one plan, and its evaluation over a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CANDIDATE_LIMIT, SEARCH_K
from . import evaluate as ev
from .answer import answer_filters, matches_filter, routed, summary_line
from .hydrate import per_course
from .lexicon import search
from .temporal import verdict


def answers(questions: DataFrame, view: DataFrame, posted: DataFrame, history: DataFrame, today: str, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """(item_id, kind, rank, id, line): what each question (item_id, question) gets.

    ``kind`` is 'refused' (no cards), 'history' (the best found course and what its observed terms allow to say),
    'cards' or 'nothing'. Cards are live listings: of a question with a filter those that fit it, of one with a search
    the latest of each found course, of one with both those that do both, in search order, or where none do those that
    fit the filter, the latest term first. A course is found if all words of the search stand in its text. ``posted`` are the courses' postings (``lexicon.postings``), ``history`` has
    (course_id, terms_seen). Questions are a stated set; equal ones are searched once.
    """
    asked = routed(questions.select("item_id", "question"), today)
    r = F.col("route")
    refused = asked.where(r["refuse"]).select("item_id", F.lit("refused").alias("kind"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("line"))
    words = F.coalesce(r["history"], r["search"])
    query = asked.where(~r["refuse"] & words.isNotNull()).select(F.col("item_id").alias("query_id"), words.alias("question"))
    found = search(posted, query, SEARCH_K).select(F.col("query_id").alias("item_id"), "course_id", F.col("rank").alias("found"))

    told = found.where("found = 1").join(asked.where(r["history"].isNotNull()).select("item_id"), "item_id").join(history, "course_id", "left")
    told = told.select("item_id", F.lit("history").alias("kind"), F.lit(1).alias("rank"), F.col("course_id").alias("id"), verdict(F.col("terms_seen")).alias("line"))

    open_ = asked.where(~r["refuse"] & r["history"].isNull())
    latest = per_course(view, 1)
    searched = found.join(open_.where(r["search"].isNotNull()).select("item_id", r["filter"].alias("filter")), "item_id")
    both = searched.join(view.where(~F.col("is_gone")).select(*view.columns), "course_id").where(F.col("filter").isNotNull() & matches_filter(F.col("filter"), today))
    only = searched.where("filter is null").join(latest, "course_id")
    by = Window.partitionBy("item_id").orderBy("found", F.col("term_rank").desc_nulls_last(), "id")
    hits = both.select("item_id", "found", "term_rank", "id").unionByName(only.select("item_id", "found", "term_rank", "id"))
    ranked = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("item_id", "id", "rank")
    filtered = answer_filters(open_, view, today, limit).join(ranked.select("item_id").distinct(), "item_id", "left_anti")
    shown = ranked.unionByName(filtered)
    cards = shown.join(summary_line(view.join(shown.select("id").distinct(), "id", "left_semi")), "id").select("item_id", F.lit("cards").alias("kind"), "rank", "id", "line")

    some = refused.unionByName(told).unionByName(cards)
    none = asked.select("item_id").join(some.select("item_id").distinct(), "item_id", "left_anti")
    return some.unionByName(none.select("item_id", F.lit("nothing").alias("kind"), F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("line")))


def run_eval(golden: DataFrame, found: DataFrame) -> DataFrame:
    """Scores of answers over a golden set (item_id, shape, expected_ids, expect_refuse, temporal): ranking metrics of the cards,
    whether refusals are right, and whether temporal questions went to history. To be summed up by ``evaluate.summarize``."""
    cards = found.where("kind = 'cards'").select("item_id", "id", "rank")
    scores = ev.score(golden.select("item_id", F.col("expected_ids").alias("relevant")), cards)
    kind = found.groupBy("item_id").agg(F.min("kind").alias("kind"))
    rows = golden.join(scores, "item_id").join(kind, "item_id", "left")
    refused = F.coalesce(F.col("kind") == "refused", F.lit(False))
    return rows.select("item_id", "shape", "ndcg_10", "recall_10", "mrr", refused.alias("refused"), "expect_refuse", (F.col("temporal") == (F.col("kind") == "history")).alias("routed"))

"""Questions to answers: a rule router, retrieval routes, grounding, follow-ups and the event sequence."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CANDIDATE_LIMIT
from ..sources.commits import cut
from .filters import ListingFilter


@dataclass(frozen=True)
class Route:
    """Exactly one of: a history query, a filter and/or a search, a refusal."""

    filter: ListingFilter | None = None
    search: str | None = None
    history: str | None = None
    refuse: bool = False


# Wordings that the router reads.
CAMPUSES = {"new brunswick": "New Brunswick", "newark": "Newark", "camden": "Camden"}
MODES = {"hybrid": "hybrid", "in person": "in_person", "in-person": "in_person", "classroom": "in_person", "self-paced": "online_async", "asynchronous": "online_async", "synchronous": "online_sync", "live online": "online_sync"}
SEATS = {"waitlist": "waitlist", "full": "full", "open seats": "open", "still open": "open", "available": "open"}
REFUSE = ("transcript", "refund", "parking", "visa", "dorm", "weather", "my grade", "scholarship", "financial aid")
HISTORY = ("usually", "how often", "every year", "every term", "offered before", "last offered", "historically", "history of", "each fall", "each spring", "each summer")
SEASONS = {"winter": "Winter", "spring": "Spring", "summer": "Summer", "fall": "Fall", "autumn": "Fall"}
_FILLER = re.compile(r"\b(?:which|what|are|is|there|any|courses?|classes?|class|do|you|have|offer(?:ed)?|show|me|find|the|a|an|for|in|on|at|about|with|of|i|want|can|take|that|under|over|below|above|dollars?|hours?|than|less|more|evenings?|online|campus|usually|how|often|please|open|seats?|still|available|next)\b|[?.!,$\d]+")


def next_term(season: str, today: str) -> str:
    """The next start of the season that isn't past; December belongs to its own year's Winter."""
    day = dt.date.fromisoformat(today)
    last = {"Winter": 2, "Spring": 5, "Summer": 8, "Fall": 11}[season]
    return f"{season} {day.year if day.month <= last else day.year + 1}"


def route(question: str, today: str) -> Route:
    """Deterministic rules in place of a model: money in cents, evenings, campuses, modes, seats, hours, seasons, refusals."""
    text = question.lower()
    if any(w in text for w in REFUSE):
        return Route(refuse=True)
    topic = re.sub(r"\s+", " ", _FILLER.sub(" ", text)).strip() or None
    if any(w in text for w in HISTORY):
        return Route(history=(topic or text)[:200])
    keys: dict = {}
    if m := re.search(r"(?:under|below|less than|at most|up to)\s*\$\s*([\d,]+(?:\.\d+)?)", text):
        keys["max_fee_cents"] = round(float(m[1].replace(",", "")) * 100)
    if m := re.search(r"(?:over|above|more than|at least)\s*\$\s*([\d,]+(?:\.\d+)?)", text):
        keys["min_fee_cents"] = round(float(m[1].replace(",", "")) * 100)
    if m := re.search(r"(?:at least|more than|over)\s*(\d+)\s*hours", text):
        keys["min_hours"] = float(m[1])
    if m := re.search(r"(?:at most|less than|under|up to)\s*(\d+)\s*hours", text):
        keys["max_hours"] = float(m[1])
    if re.search(r"\bevenings?\b|after work|at night", text):
        keys["is_evening"] = True
    for table, key in ((CAMPUSES, "campus"), (MODES, "delivery_mode"), (SEATS, "status")):
        for wording, value in table.items():
            if re.search(rf"\b{re.escape(wording)}\b", text):
                keys[key] = value
                topic = topic and (re.sub(r"\s+", " ", topic.replace(wording, " ")).strip() or None)
                break
    if re.search(r"\bonline\b", text) and "delivery_mode" not in keys:
        keys["campus"] = "Online"
    if re.search(r"can i (?:still )?(?:register|sign up|enrol)", text):
        keys["open_for_reg"] = True
    for word, season in SEASONS.items():
        if m := re.search(rf"\b{word}\b(?:\s+(\d{{4}}))?", text):
            keys["term"] = f"{season} {m[1]}" if m[1] else next_term(season, today)
            topic = topic and (re.sub(r"\s+", " ", topic.replace(word, " ")).strip() or None)
    return Route(filter=ListingFilter(**keys) if keys else None, search=topic)


_KEYS = ("campus", "term", "max_fee_cents", "min_fee_cents", "delivery_mode", "is_evening", "status", "open_for_reg", "min_hours", "max_hours")
ROUTE = (
    "refuse boolean, history string, search string, filter struct<campus:string,term:string,max_fee_cents:long,min_fee_cents:long,"
    "delivery_mode:string,is_evening:boolean,status:string,open_for_reg:boolean,min_hours:double,max_hours:double>"
)


def routed(questions: DataFrame, today: str) -> DataFrame:
    """The questions with ``route``: the rules of ``route`` for each, in Arrow batches; a null question has an empty search."""

    @F.pandas_udf(ROUTE)
    def decide(texts: pd.Series) -> pd.DataFrame:
        found = [route(t or "", today) for t in texts]
        filters = [None if r.filter is None else {k: getattr(r.filter, k) for k in _KEYS} for r in found]
        return pd.DataFrame({"refuse": [r.refuse for r in found], "history": [r.history for r in found], "search": [r.search for r in found], "filter": filters})

    return questions.withColumn("route", decide("question"))


def matches_filter(f: Column, as_of: str) -> Column:
    """Whether a listing's columns fit the filter struct ``f``; a null key, or a null filter, constrains nothing."""
    c = F.col
    day = F.lit(as_of).cast("date")
    conditions = [
        c("campus") == f["campus"], c("term") == f["term"], c("total_fee_cents") <= f["max_fee_cents"], c("total_fee_cents") >= f["min_fee_cents"],
        c("delivery_mode") == f["delivery_mode"], c("is_evening") == f["is_evening"], c("status") == f["status"],
        c("contact_hours") >= f["min_hours"], c("contact_hours") <= f["max_hours"],
    ]
    out = F.lit(True)
    for key, condition in zip(("campus", "term", "max_fee_cents", "min_fee_cents", "delivery_mode", "is_evening", "status", "min_hours", "max_hours"), conditions, strict=True):
        out = out & (f[key].isNull() | F.coalesce(condition, F.lit(False)))
    deadline = c("registration_deadline").isNull() | (c("registration_deadline") >= day)
    return out & (~F.coalesce(f["open_for_reg"], F.lit(False)) | deadline)


def answer_filters(questions: DataFrame, view: DataFrame, as_of: str, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """(item_id, id, rank): each routed question's first live listings by its filter, the latest term first, then by id.

    Questions are a stated set that meets all listings: equal filters are asked once, and a question without a filter
    asks for nothing here. The window keeps ``limit`` rows of a filter, which Spark cuts before its shuffle too.
    """
    asked = questions.where("route.filter is not null and not route.refuse and route.history is null").select("item_id", F.to_json("route.filter").alias("key"), "route.filter")
    asked = cut(asked)  # the rules run once
    distinct = cut(asked.groupBy("key").agg(F.first("filter").alias("filter")))
    hit = _meeting(view.where(~F.col("is_gone")), distinct, as_of)
    by = Window.partitionBy("key").orderBy(F.col("term_rank").desc_nulls_last(), "id")
    top = hit.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return asked.select("item_id", "key").join(top, "key").select("item_id", "id", "rank")


#: Keys of a filter that ask for one value; filters of no such key that meet all listings at once.
EQUAL, BLOCK = ("campus", "term", "delivery_mode", "is_evening", "status"), 4096


def _meeting(live: DataFrame, filters: DataFrame, as_of: str) -> DataFrame:
    """(key, id, term_rank) of each filter (key, filter) and each listing that fits it.

    Filters that constrain the same keys of EQUAL, at most 32 kinds, are joined on these, and their ranges are looked at after. Those
    that constrain none of them come in blocks, so that what is broadcast has a bound.
    """
    out = filters.sparkSession.createDataFrame([], f"key string, id {live.schema['id'].dataType.simpleString()}, term_rank {live.schema['term_rank'].dataType.simpleString()}")
    given = [F.col(f"filter.{k}").isNotNull().alias(k) for k in EQUAL]
    for kind in filters.groupBy(*given).count().collect():
        keys = [k for k in EQUAL if kind[k]]
        some = filters
        for k, there in zip(EQUAL, given, strict=True):
            some = some.where(there if kind[k] else ~there)
        if keys:
            named = some.select("key", "filter", *[F.col(f"filter.{k}").alias(f"asked_{k}") for k in keys])
            equal = [F.col(k) == F.col(f"asked_{k}") for k in keys]
            found = live.join(named, reduce(and_, equal) & matches_filter(F.col("filter"), as_of))
            out = out.unionByName(found.select("key", "id", "term_rank"))
        else:
            blocks = 1 + kind["count"] // BLOCK
            for block in range(blocks):
                mine = F.broadcast(some.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block))
                out = out.unionByName(live.join(mine, matches_filter(F.col("filter"), as_of)).select("key", "id", "term_rank"))
    return out


def decode_route(raw: dict | None) -> Route:
    """A raw decision to a route: nulls and include_gone=false go, a malformed or empty filter is none, one route wins."""
    raw = raw or {}
    if raw.get("refuse") is True:
        return Route(refuse=True)
    if raw.get("history"):
        return Route(history=str(raw["history"])[:200])
    keys = raw.get("filter")
    if isinstance(keys, dict):
        keys = {k: round(v) if k.endswith("_cents") else v for k, v in keys.items() if v is not None and not (k == "include_gone" and v is False)}
    try:
        filter_ = ListingFilter(**keys) if keys else None
    except TypeError:
        filter_ = None
    return Route(filter=filter_, search=raw.get("search") or None)


def candidates(filtered: DataFrame | None, found_listings: DataFrame | None, limit: int = 8) -> DataFrame:
    """Listings of both routes in search order, or of the one that ran; where both share none, the filtered ones."""
    from .retrieval import intersect

    if filtered is None:
        return found_listings.orderBy("rank", "place").limit(limit)
    if found_listings is None:
        return filtered.limit(limit)
    return intersect(filtered, found_listings.groupBy("course_id").agg(F.min("rank").alias("rank")), limit)


def grounded(refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Card references whose listing is a candidate, each once, at its first place."""
    first = refs.groupBy("listing_id").agg(F.min(F.struct("place", "why")).alias("first"))
    return first.join(allowed.select(F.col("id").alias("listing_id")).distinct(), "listing_id", "left_semi").select("listing_id", "first.place", "first.why")


def follow_ups(cards: DataFrame) -> DataFrame:
    """One row: questions about the single course, if the cards are of one."""
    one = cards.agg(F.count_distinct("course_id").alias("courses"), F.min("course_title").alias("title"))
    asked = F.array(F.concat(F.lit("When is "), F.col("title"), F.lit(" usually offered?")), F.concat(F.lit("What does "), F.col("title"), F.lit(" cost?")))
    return one.select("courses", F.when(F.col("courses") == 1, asked).otherwise(F.array().cast("array<string>")).alias("follow_ups"))


def follow_ups_by(cards: DataFrame, key: str) -> DataFrame:
    """The same for many answers at once, told apart by ``key``: (key, courses, follow_ups)."""
    one = cards.groupBy(key).agg(F.count_distinct("course_id").alias("courses"), F.min("course_title").alias("title"))
    asked = F.array(F.concat(F.lit("When is "), F.col("title"), F.lit(" usually offered?")), F.concat(F.lit("What does "), F.col("title"), F.lit(" cost?")))
    return one.select(key, "courses", F.when(F.col("courses") == 1, asked).otherwise(F.array().cast("array<string>")).alias("follow_ups"))


def summary_line(cards: DataFrame) -> DataFrame:
    """One line per candidate."""
    return cards.select("id", F.concat_ws(" · ", "course_title", "term", "campus", F.regexp_replace("delivery_mode", "_", " "), "status", F.concat(F.lit("$"), (F.col("total_fee_cents") / 100).cast("decimal(12,2)").cast("string"))).alias("line"))


def events(prose: DataFrame, cards: DataFrame, words: int = 6) -> DataFrame:
    """(seq, event, data): filter, prose parts, cards, window, done, in that order."""
    parts = prose.select(F.posexplode(F.regexp_extract_all("prose", F.lit(rf"\s*(?:\S+\s*){{1,{words}}}"), F.lit(0))).alias("n", "data")).select(F.lit(1).alias("step"), "n", F.lit("prose").alias("event"), "data")
    shown = cards.select(F.lit(2).alias("step"), F.col("position").alias("n"), F.lit("card").alias("event"), F.col("id").cast("string").alias("data"))
    fixed = prose.sparkSession.createDataFrame([(0, 0, "filter", ""), (3, 0, "window", ""), (4, 0, "done", "")], "step int, n int, event string, data string")
    every = parts.unionByName(shown).unionByName(fixed)
    return every.select(F.row_number().over(Window.orderBy("step", "n")).alias("seq"), "event", "data").orderBy("seq")


def unfaithful(answers: DataFrame) -> DataFrame:
    """Answers whose prose states a figure or a price; facts come from cards only."""
    return answers.where(F.col("prose").rlike(r"[$€£]|\d"))


def last_user_turn(message: DataFrame) -> DataFrame:
    """Each assistant message with the latest user text before it in its session, null without any."""
    before = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("role") == "user", F.col("prose")), ignorenulls=True).over(before)
    return message.withColumn("question", question).where("role = 'assistant'").select("session_id", "id", "question")


def promote_feedback(feedback: DataFrame, message: DataFrame, items: DataFrame) -> DataFrame:
    """Candidate evaluation items of down-voted answers: their question, once, unless it is an item already."""
    asked = last_user_turn(message).where("question is not null")
    down = feedback.where("rating = -1").select("session_id", "id", "refused")
    new = asked.join(down, ["session_id", "id"]).groupBy("question").agg(F.bool_or("refused").alias("refused"))
    shape = F.when(F.col("refused"), "unanswerable").otherwise("lookup")
    return new.join(items.select("question"), "question", "left_anti").select("question", shape.alias("shape"))

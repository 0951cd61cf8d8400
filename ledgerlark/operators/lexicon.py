"""Lexical search over stored postings: stemmed words with their positions, web-search syntax, cover density, many questions in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem
from ..functions.text import STOP_WORDS
from .retrieval import POOL, fuse_by, knn_batch, parsed_query

_WORDS = T.ArrayType(T.StringType())
#: Weight of a word in a cover, as for words without a weight of their own.
WEIGHT = 0.1


@F.pandas_udf(_WORDS)
def stems(words: pd.Series) -> pd.Series:
    """Each word's stem, null for a stop word."""
    return words.map(lambda each: None if each is None else [None if w in _STOP else stem(w) for w in each])


_STOP = frozenset(STOP_WORDS)


def postings(chunk: DataFrame) -> DataFrame:
    """(term, course_id, places): where each stemmed word stands in each text, from 1; stop words count as places only.

    To be written partitioned by hashed term, so that a question reads its terms' rows only. A null text has none.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    placed = chunk.select("course_id", F.posexplode(stems(words)).alias("at", "term")).where("term is not null")
    return placed.groupBy("term", "course_id").agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("places"))


QUERY = T.StructType([T.StructField("must", T.ArrayType(_WORDS)), T.StructField("none", _WORDS), T.StructField("phrases", T.ArrayType(_WORDS))])


@F.pandas_udf(QUERY)
def parsed(texts: pd.Series) -> pd.DataFrame:
    """Web-search syntax, stemmed: each group of ``must`` has a word that stands, no word of ``none`` does, phrases stand as they are."""
    found = [parsed_query(t or "") for t in texts]
    each = lambda key: [[[stem(w) for w in group] for group in q[key]] for q in found]
    return pd.DataFrame({"must": each("all"), "none": [[stem(w) for w in q["none"]] for q in found], "phrases": each("phrases")})


def cover_density(places: dict[str, list[int]], must: list[list[str]]) -> float:
    """The sum over the shortest stretches that satisfy every group of WEIGHT / (1 + words between)."""
    marks = sorted({(at, term) for group in must for term in group for at in places.get(term, ())})
    groups = [set(g) for g in must]
    total, begin = 0.0, 0
    while groups:
        last, open_ = -1, list(groups)
        for i in range(begin, len(marks)):
            open_ = [g for g in open_ if marks[i][1] not in g]
            if not open_:
                last = i
                break
        if last < 0:
            return total
        first, open_ = last, list(groups)
        for i in range(last, begin - 1, -1):
            open_ = [g for g in open_ if marks[i][1] not in g]
            if not open_:
                first = i
                break
        noise = (marks[last][0] - marks[first][0]) - (last - first)
        total += WEIGHT / (1 + max(noise, 0))
        begin = first + 1
    return total


def _stands(places: dict[str, list[int]], phrase: list[str]) -> bool:
    rest = [set(places.get(w, ())) for w in phrase]
    return any(all(at + k in rest[k] for k in range(len(phrase))) for at in rest[0])


@F.pandas_udf(T.DoubleType())
def _scores(must: pd.Series, none: pd.Series, phrases: pd.Series, terms: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for m, n, p, t, at in zip(must, none, phrases, terms, places, strict=True):
        here = {term: list(x) for term, x in zip(t, at, strict=True)}
        fits = len(m) and all(any(w in here for w in group) for group in m) and not any(w in here for w in n) and all(_stands(here, list(x)) for x in p)
        out.append(cover_density(here, [list(g) for g in m]) if fits else None)
    return pd.Series(out, dtype="float64")


def search(posted: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, course_id, score, rank) for all questions (query_id, question) in one job: the first ``limit`` texts that
    match, by cover density, ties by id. Questions without a word that must stand find nothing.

    Equal questions are asked once. A text that matches has a word of every group, so a question meets the texts of its group with
    the fewest postings, by term, and the postings of its other words by term and text: a word of all texts costs no more than a rare one.
    """
    asked = questions.groupBy("question").agg(F.min("query_id").alias("key"))
    read = asked.select("key", parsed("question").alias("q")).where("size(q.must) > 0")
    wanted = read.select("key", F.explode(F.array_distinct(F.concat(F.flatten("q.must"), "q.none"))).alias("term"))
    groups = read.select("key", F.posexplode("q.must").alias("place", "words")).select("key", "place", F.explode(F.array_distinct("words")).alias("term"))
    size = posted.join(groups.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    cost = groups.join(size, "term", "left").groupBy("key", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_set("term").alias("terms"))
    rarest = cost.groupBy("key").agg(F.min_by("terms", F.struct("cost", "place")).alias("terms")).select("key", F.explode("terms").alias("term"))
    pairs = posted.join(rarest, "term").select("key", "course_id").distinct()
    met = pairs.join(wanted, "key").join(posted, ["term", "course_id"]).groupBy("key", "course_id").agg(F.collect_list(F.struct("term", "places")).alias("hits"))
    scored = met.join(read, "key").select("key", "course_id", _scores("q.must", "q.none", "q.phrases", F.col("hits.term"), F.col("hits.places")).alias("score"))
    by = Window.partitionBy("key").orderBy(F.col("score").desc(), "course_id")
    top = scored.where("score is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    named = questions.join(asked.select(F.col("question").alias("same"), "key"), F.col("question") == F.col("same")).select("query_id", "key")
    return named.join(top, "key").select("query_id", "course_id", "score", "rank")


def hybrid_batch(vectors: DataFrame, posted: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """(query_id, course_id, rrf, rank): vector and lexical lists of every question (query_id, question, embedding), fused by
    reciprocal rank, the best first, ties by id."""
    near = knn_batch(vectors, questions.select("query_id", "embedding"))
    fused = fuse_by("query_id", near, search(posted, questions.select("query_id", "question")))
    by = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "course_id")
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)

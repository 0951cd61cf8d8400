"""Stored postings against search over postings made anew, the figures of what is opened, and the cases that break an index."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.text import tokens
from ledgerlark.operators import indexing
from ledgerlark.operators import lexicon as lex
from ledgerlark.operators import postings as pos
from ledgerlark.plans import detail_queries

from .test_lexicon import plain

SF = "/root/testdata/sf0.001"


def rows(found):
    out = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["course_id"], round(r["score"], 9)))
    return out


def corpus(n=400):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 40)}" for _ in range(60)] + ["the", "license", "licenses", "versions", "public"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 400]))) for i in range(n)}
    return texts | {1000: None, 1001: "", 1002: "license " * 5000, 1003: "É, the public-license VERSION!", 1004: texts[3], 1005: "the of and"}


QUESTIONS = {
    1: "license version", 2: "w1 or w2 or w3 or license", 3: "w5 or w6 -public", 4: '"public license"', 5: "", 6: None, 7: "the", 8: "license version", 9: "nowhere", 10: "license -nowhere", 11: "w1 w2 w3 w4", 12: "version or nowhere",
    13: '"license license" or w9', 14: "license license", 15: "w3 -w3", 16: " or ".join(f"w{i}" for i in range(41)),
}


@pytest.mark.parametrize(("shard_bytes", "limit"), [(20_000, 50), (1 << 25, 3), (1 << 25, 1000)])
def test_same_rows_as_without_an_index(spark, tmp_path, shard_bytes, limit):
    texts = corpus()
    chunk = spark.createDataFrame([(i, t, "zz") for i, t in texts.items()], "course_id long, text string, term string")
    asked = spark.createDataFrame(list(QUESTIONS.items()), "query_id long, question string")
    pos.write(chunk, str(tmp_path / "index"), shard_bytes)
    indexed = pos.read(spark, str(tmp_path / "index"))
    assert rows(pos.search(indexed, asked, limit)) == rows(lex.search(lex.postings(chunk), asked, limit))
    if limit == 50:
        found = rows(pos.search(indexed, asked, limit))
        for k in (1, 3, 4, 11, 13):
            assert [i for i, _ in found[k]] == [i for i, _ in plain(texts, QUESTIONS[k])]


def test_blocks_below_the_last_score_stay_shut(spark, tmp_path):
    chunk = spark.createDataFrame([(i, "word " * (1 + 9000 // (1 + i))) for i in range(3000)], "course_id long, text string")
    pos.write(chunk, str(tmp_path / "index"))
    indexed = pos.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word"), (2, "words")], "query_id long, question string")
    (first, second) = sorted(map(tuple, pos.opened(indexed, asked, 50).collect()))
    assert first == (1, 3000, 64) and second == (2, 3000, 64)
    assert [i for i, _ in rows(pos.search(indexed, asked))[1]] == list(range(50))


def test_no_texts(spark, tmp_path):
    chunk = spark.createDataFrame([(1, None), (None, "word")], "course_id long, text string")
    pos.write(chunk, str(tmp_path / "index"))
    indexed = pos.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word")], "query_id long, question string")
    assert pos.search(indexed, asked).count() == 0 and pos.search(indexed, asked.limit(0)).count() == 0


def test_a_text_finds_itself(spark, tmp_path):
    chunk = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("course_id"), "text")
    pos.write(chunk, str(tmp_path / "index"), 100_000)
    asked = chunk.where("course_id % 20 = 0").select(F.col("course_id").alias("query_id"), F.array_join(F.array_distinct(tokens(F.col("text"))), " or ").alias("question"))
    assert rows(pos.search(pos.read(spark, str(tmp_path / "index")), asked)) == rows(lex.search(lex.postings(chunk), asked))


def test_known_items_are_found_from_their_words(spark):
    chunk = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("course_id"), "text", "lang")
    items = indexing.known_items(chunk).collect()
    found = collections.defaultdict(set)
    for r in detail_queries.QUERIES["question_search"](spark, SF).collect():
        found[r["query_id"]].add(r["course_id"])
    asked = [r for r in items if len(r["question"].split()) == 6]
    assert asked and sum(bool(found[r["item_id"]] & set(r["relevant"])) for r in asked) >= 0.8 * len(asked)


def test_places_move_only_for_questions_that_need_them(spark, tmp_path, monkeypatch):
    pos.write(spark.createDataFrame([(i, f"red fox {i} fox") for i in range(50)], "course_id long, text string"), str(tmp_path / "index"))

    def lengths(limit):
        def run(rows, asked):
            n = sum(len(x or b"") for x in rows.column("places").to_pylist())
            return rows.select([]).append_column("key", [[n] * rows.num_rows]).slice(0, 1).append_column("course_id", [[0]]).append_column("score", [[0.0]]).append_column("postings", [[0]]).append_column("opened", [[0]])

        return run

    monkeypatch.setattr(pos, "_answered", lengths)
    moved = lambda question: sum(r["key"] for r in pos.answered(pos.read(spark, str(tmp_path / "index")), spark.createDataFrame([(1, question)], "query_id long, question string")).collect())
    assert moved("red or fox or 7") == 0 < moved("red fox")


def test_a_question_meets_later_shards_only_if_they_may_reach_its_best(spark, tmp_path):
    texts = {i: "word other " * (800 - 2 * i if i < 300 else 5) for i in range(400)} | {900: "rare", 901: None, 902: ""}
    chunk = spark.createDataFrame(list(texts.items()), "course_id long, text string")
    pos.write(chunk, str(tmp_path / "index"), 40_000)
    indexed = pos.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word or other"), (2, "rare"), (3, "word other"), (4, "words -other")], "query_id long, question string")
    assert rows(pos.search(indexed, asked, 20)) == rows(lex.search(lex.postings(chunk), asked, 20))
    met = collections.Counter(r["key"] for r in pos.answered(indexed, asked, 20).where("course_id is null").collect())
    shards = indexed.where("term = ''").count()
    assert shards > 30 and 3 * met[1] < shards and met[2] == shards
    assert {r["key"]: r["postings"] for r in pos.opened(indexed, asked, 20).collect()} == {1: 800, 2: 1, 3: 800, 4: 400}


def test_equal_long_texts_are_dealt_over_shards(spark):
    chunk = spark.createDataFrame([(i, "same words again " * 300) for i in range(400)] + [(1000, "short"), (1001, "")], "course_id long, text string")
    held = pos.build(chunk, 100_000).where("term = ''").select("n").collect()
    assert sum(r["n"] for r in held) == 402 and max(r["n"] for r in held) < 60


def test_memory_of_a_shard():
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"w{i % 1000:04d}" for i in range(1000))
    n = pos.SHARD_BYTES // len(text)
    table = pa.table({"course_id": list(range(n)), "text": [text] * n})
    tracemalloc.start()
    made = pos._inverted((pa.scalar(0, pa.int32()),), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.num_rows == 1001 and most < 300 << 20


@pytest.mark.parametrize(("cells", "postings", "limit"), [(1, 1, 3), (64, 500, 20), (1 << 15, 1 << 21, 50)])
def test_questions_of_one_group_are_answered_together(monkeypatch, cells, postings, limit):
    """The same texts, ties by id, postings and opened ones as question by question, also behind what other shards gave."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(pos, "CELLS", cells)
    monkeypatch.setattr(pos, "POSTINGS", postings)
    rng = random.Random(7)
    texts = [" ".join(f"v{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(900)]
    shard = pos.Shard(pos._inverted((pa.scalar(0, pa.int32()),), pa.table({"course_id": [(i * 7919) % 1000 for i in range(900)], "text": texts})))
    asked = [[f"v{rng.randint(0, 45)}" for _ in range(rng.randint(1, 6))] for _ in range(60)]
    least = np.array([rng.choice([0.0, 0.0, 0.1, 0.5, 2.0, 99.0]) for _ in asked])
    pairs = [(i, shard.terms[w]) for i, words in enumerate(asked) for w in words if w in shard.terms]
    best = pos.Best(least, np.full(len(asked), 1 << 40), limit)
    total, opened = shard.tops(np.array([i for i, _ in pairs]), np.array([t for _, t in pairs]), best)
    for i, words in enumerate(asked):
        ids, scores, n, seen = shard.top([words], [], [], limit, least[i])
        mine = best.question == i
        assert best.ids[mine].tolist() == ids.tolist() and np.allclose(best.scores[mine], scores)
        assert total[i] == n and opened[i] <= seen


def test_words_of_a_question_in_its_candidates():
    import pyarrow as pa

    texts = pa.table({"course_id": [1, 2, 3], "text": ["red fox, fox2 été", None, "the fox-red"], "chunk_lang": ["en", None, "de"], "part": [0, 0, 0]})
    asked = [["red", "fox"], ["fox2", "t", "x"], ["red"], ["fo"], ["red", "fox"]]
    pairs = pa.table({"query_id": [1, 2, 1, 3, 4], "course_id": [3, 1, 2, 1, 1], "bare": [1] * 5, "full": [1] * 5, "words": [1] * 5, "lang": ["en"] * 5, "asked": asked})
    found = indexing._overlaps(pairs, texts)
    assert found.column("overlap").to_pylist() == [2, 2, 0, 0, 2] and found.column("chunk_lang").to_pylist() == ["de", "en", None, "en", "en"]

import collections
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.stem import stem
from ledgerlark.functions.text import STOP_WORDS
from ledgerlark.operators import lexicon as lex
from ledgerlark.plans import detail_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("licenses", "licens"), ("license", "licens"), ("running", "run"), ("courses", "cours"), ("nursing", "nurs"), ("hopping", "hop"), ("hoping", "hope"), ("ponies", "poni"), ("caresses", "caress"), ("ties", "tie"),
        ("agreed", "agre"), ("generously", "generous"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"),
        ("national", "nation"), ("analogies", "analog"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("knightly", "knight"), ("dying", "die"), ("skies", "sky"),
        ("proceed", "proceed"), ("communities", "communiti"), ("bed", "bed"), ("consistency", "consist"), ("knots", "knot"), ("management", "manag"), ("psychology", "psycholog"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_cover_density():
    assert lex.cover_density({"a": [1], "b": [2]}, [["a"], ["b"]]) == pytest.approx(0.1)
    assert lex.cover_density({"a": [1], "b": [5]}, [["a"], ["b"]]) == pytest.approx(0.1 / 4)
    # from the b at 2 to the a at 9 isn't a least stretch, as the one from 8 lies within
    assert lex.cover_density({"a": [1, 9], "b": [2, 8]}, [["a"], ["b"]]) == pytest.approx(0.2)
    assert lex.cover_density({"a": [3, 7]}, [["a", "b"]]) == pytest.approx(0.2)
    assert lex.cover_density({"a": [3]}, [["a"], ["b"]]) == 0


def plain(texts, question):
    groups, none, phrases = [], [], []
    q = lex.parsed_query(question)
    groups = [{stem(w) for w in g} for g in q["all"]]
    none, phrases = {stem(w) for w in q["none"]}, [[stem(w) for w in p] for p in q["phrases"]]
    found = []
    for i, text in texts.items():
        words = re.findall("[a-z0-9]+", (text or "").lower())
        marks = [None if w in STOP_WORDS else stem(w) for w in words]
        here = set(marks)
        joined = "".join(f" {m} " for m in marks)
        if not groups or not all(g & here for g in groups) or none & here or not all("".join(f" {w} " for w in p) in joined for p in phrases):
            continue
        # every least stretch: it fits, and neither end can be left out
        score = 0.0
        at = [k for k, m in enumerate(marks) if any(m in g for g in groups)]
        for x in range(len(at)):
            for y in range(x, len(at)):
                inside = {marks[k] for k in at[x : y + 1]}
                if all(g & inside for g in groups):
                    less = [{marks[k] for k in at[x + 1 : y + 1]}, {marks[k] for k in at[x:y]}]
                    if not any(all(g & part for g in groups) for part in less):
                        score += 0.1 / (1 + (at[y] - at[x]) - (y - x))
                    break
        found.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(found)[:50]]


def test_search(spark):
    texts = {1: "The license of the licensing version", 2: "licenses expire; a version follows much later than the licence", 3: "version", 4: None, 5: "", 6: "open source licenses: version two, version three", 7: "public license version"}
    chunk = spark.createDataFrame([(i, t) for i, t in texts.items()], "course_id long, text string")
    asked = {1: "license version", 2: "licensed or versions", 3: 'license -public', 4: '"license version"', 5: "", 6: None, 7: "the", 8: "license version"}
    found = collections.defaultdict(list)
    for r in lex.search(lex.postings(chunk), spark.createDataFrame(list(asked.items()), "query_id long, question string")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["course_id"], round(r["score"], 9)))
    for k, question in asked.items():
        assert found[k] == (plain(texts, question) if question else []), question
    assert found[1] == found[8] and not found[7]


def test_batch_over_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r["query_id"]: r["question"] for r in detail_queries._questions(detail_queries.Catalog(spark, SF)).collect()}
    found = collections.defaultdict(list)
    for r in detail_queries.QUERIES["lexical_batch_top50"](spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["course_id"], r["score"]))
    assert asked
    for k, question in asked.items():
        expected = plain(texts, question)
        assert [i for i, _ in found[k]] == [i for i, _ in expected] and [s for _, s in found[k]] == pytest.approx([s for _, s in expected])


def test_versions(spark, tmp_path):
    from ledgerlark.sources import catalog

    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        catalog.read_table(spark, path)
    for n in (3, 5):
        catalog.replace_table(spark.range(n), path)
        assert catalog.read_table(spark, path).count() == n
    broken = spark.range(2).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        catalog.replace_table(broken, path)
    assert catalog.read_table(spark, path).count() == 5 and catalog.versions(spark, path).count() == 2


def test_true_places_of_a_mask():
    import numpy as np

    from ledgerlark.operators.retrieval import _true

    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (4, 16), (7, 9), (0, 4), (5, 1)):
        for share in (0, 0.1, 1):
            mask = rng.random(shape) < share
            assert _true(mask).tolist() == np.flatnonzero(mask).tolist()

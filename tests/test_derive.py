import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import derive as dv
from ledgerlark.functions import text as tx

D = dt.date


def values(spark, f, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (dv.sentinel_to_null, {" N/A ": None, "TBD": None, "n\\a": None, "--": None, " x ": "x", "": None, None: None}),
        (dv.parse_fee_cents, {"$1,234.50": 123450, "Free": None, "": None, ".": None, "1.2.3": 120, "149": 14900, None: None}),
        (dv.map_status, {"Registration Available": "open", "Course Full": "full", " waitlist": "waitlist", "huh": "unknown", None: "unknown"}),
        (dv.contact_hours, {"Alternate Route 45 - Hour Program": 45.0, "12.5 hours": 12.5, "none": None, None: None}),
        (dv.normalized_title, {"  A - B--C ": "a b c", None: None}),
        (lambda c: dv.delivery_mode(c, F.lit("hint")), {"Online Asynchronous": "online_sync", "Asynchronous/Self-Paced": "hint", "Hybrid": "hybrid", "Classroom": "in_person", "Online": "online_sync", None: "hint", "N/A": "hint"}),
        (lambda c: dv.derive_campus(c, F.lit("hint")), {"Alexandria, VA-DASH, Main Building": "Other", "Hill, Newark, NJ": "Newark", "Town, NJ": "hint", "Livingston Campus": "New Brunswick", "Online": "Online", None: "hint"}),
        (lambda c: dv.split_location(c)["room"], {"100 Rock, Room 3031 x": "3031", "Hall, Rm. B12": "B12", "Hall": None}),
        (lambda c: dv.split_location(c)["site"], {"100 Rock, Room 3031 x": "100 Rock", "TBA": None}),
        (lambda c: dv.split_format(c)["category"], {"-- Online: Canvas": "Online", "Classroom": "Classroom", None: None}),
        (lambda c: dv.split_format(c)["platform"], {"-- Online: Canvas": "Canvas", "Classroom": None}),
        (lambda c: dv.is_evening(c, F.lit("Class"), F.lit(None).cast("boolean")), {"6:00 PM - 9:00 PM": True, "9:00 AM - 6:00 PM": False, "12:30 pm": False, "TBA": None, None: None}),
        (lambda c: dv.parse_date_range(c)["starts_on"], {"10/05/2026 - 1/10/2027": D(2026, 10, 5), "Thursday, October 29, 2026": D(2026, 10, 29), "July 8 & 15, 2026": D(2026, 7, 8), "Oct 3 and Nov 4, 2026": D(2026, 10, 3), "TBD": None, "13/45/2026": None, None: None}),
        (lambda c: dv.parse_date_range(c)["ends_on"], {"10/05/2026 - 1/10/2027": D(2027, 1, 10), "July 8 & 15, 2026": D(2026, 7, 15), "1/2/2026 - 1/1/2026": D(2026, 1, 2)}),
        (lambda c: dv.parse_date_range(c)["failure"], {"": "empty", None: "empty", "TBD": "tbd", "Cancelled": "cancelled", "soon": "unparseable", "1/2/2026": None}),
        (lambda c: tx.collapsed(c), {" a \n b ": "a b", None: None}),
        (lambda c: tx.estimate_tokens(c), {"": 1, "abcde": 2}),
        (lambda c: tx.substring_between(c, "<", ">"), {"a<b>c": "b", "a<b": None, "ab>": None}),
        (lambda c: tx.remove_query_param(c, "utm_*"), {"http://h/?utm_a=1&b=2": "http://h/?b=2", "http://h/?utm_a=1": "http://h/", "http://h/?a=1&utm_b=2#f": "http://h/?a=1#f"}),
        (tx.fnv1a, {"": 2166136261, "a": 3826002220, "foobar": 3214735720}),
    ],
)
def test_scalar(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_deadline(spark):
    df = spark.createDataFrame([("Two business days prior", D(2026, 7, 20)), ("3 days prior to start", D(2026, 7, 20)), ("call", D(2026, 7, 20)), (None, None)], "r string, d date")
    assert [r[0] for r in df.select(dv.derive_deadline(F.col("r"), F.col("d"))).collect()] == [D(2026, 7, 16), D(2026, 7, 17), None, None]


def test_term(spark):
    df = spark.createDataFrame([(D(2026, 12, 5),), (D(2026, 3, 1),), (None,)], "d date")
    assert [r[0]["label"] for r in df.select(dv.derive_term(F.col("d"))).collect()][:2] == ["Winter 2026", "Spring 2026"]


def test_fees(spark):
    df = spark.createDataFrame([([("$400", "Tuition"), ("$415.00", "Total Fees"), ("ask", "Lab")],), ([],), (None,)], "fees array<struct<amount:string,label:string>>")
    rows = df.select(dv.derive_fees(F.col("fees")).alias("f")).select("f", dv.total_fee_cents(F.col("f")).alias("t")).collect()
    assert [(f["ord"], f["amount_cents"], f["is_total"], f["alert"]) for f in rows[0]["f"]] == [(0, 40000, False, False), (1, 41500, True, False), (2, 0, False, True)]
    assert [r["t"] for r in rows] == [41500, None, None]


def test_rows(spark):
    df = spark.createDataFrame([("Course Full", "10/05/2026", [("$5", "x")], "Online", "Newark", "6:00 PM", "T 12 hours", "one day prior", D(2026, 10, 6))], "page_status string, page_dates string, fees array<struct<amount:string,label:string>>, format string, location string, times string, title string, deadline_rule string, extracted_starts_on date")
    row = dv.derive_rows(df).first()
    assert (row["status"], row["starts_on"], row["total_fee_cents"], row["campus"], row["is_evening"], row["contact_hours"], row["registration_deadline"], row["date_conflict"]) == ("full", D(2026, 10, 5), 500, "Newark", True, 12.0, D(2026, 10, 4), True)


def test_labels(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(tx.dollars(F.lit(123400))) == "$1,234" and show(tx.dollars(F.lit(50))) == "$0.50"
    assert [show(tx.and_list(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))) for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b, and c"]
    assert show(tx.canonical_filter(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert show(tx.canonical_filter(F.lit(None).cast("map<string,string>"))) == ""


def test_hashed_embedding_word_by_word(spark):
    """Counts by crc32 as a loop over the words has them: rows that touch, long words, letters whose lower case is in ASCII, nulls."""
    import random
    import re
    import zlib

    import numpy as np

    from ledgerlark.functions.text import STOP_WORDS
    from ledgerlark.functions.vectors import hashed_embedding

    rng = random.Random(5)
    texts = ["", None, "a", "The of", "x" * 33 + " " + "Y" * 32 + " z" * 5, "İstanbul Kelvin Été", "abcdefgh abcdefghi abcdefghabcdefgh", "them an9 9"]
    texts += [" ".join("".join(rng.choice("aBthe19") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    found = dict(spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", hashed_embedding(F.col("text"), 16).alias("e")).collect())
    for i, t in enumerate(texts):
        plain = np.zeros(16)
        for word in re.findall("[a-z0-9]+", (t or "").lower()):
            if word not in STOP_WORDS:
                plain[zlib.crc32(word.encode()) % 16] += 1
        assert np.array_equal(found[i], (plain[None] / np.maximum(np.linalg.norm(plain[None], axis=1, keepdims=True), 1e-300))[0])


def test_words_that_end_otherwise_are_their_own_stems():
    import itertools
    import re

    from ledgerlark.functions.stem import ENDS, SPECIAL, STAYS, stem

    parts = ("y", "e", "ing", "ed", "ll", "a", "bcd", "s", "li", "9", "at", "ion", "al", "ous", "gener", "iz", "ogi")
    words = {"".join(p) for n in (1, 2, 3, 4) for p in itertools.product(parts, repeat=n)} | {*SPECIAL, *STAYS}
    assert [w for w in words if not re.search(ENDS, w) and stem(w) != w] == []

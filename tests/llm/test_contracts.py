"""Every registered query over the small test tables, against plain versions of its contract, or its SQL where it has one."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import quality
from ledgerlark.llm.queries import ORACLE_SQL, QUERIES

from .helpers import WORDS, lower
from .test_dedup import line_truth
from .test_text_ops import by_key

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def more_texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = base.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, FOLDER)
    assert set(found.columns) == set(expected.columns)
    rows = [tuple(r[c] for c in expected.columns) for r in found.collect()]
    assert collections.Counter(rows) == collections.Counter(expected.fetchall())


def test_op3_base_columns(spark, more_texts):
    kinds = {
        "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        "access": (r"(AKIA[A-Z0-9]+)", 16), "hex": (r"([0-9a-f]+)", 32),
    }
    found = by_key(QUERIES["op3_secret_scan"](spark, LARGER))
    assert set(found) == set(more_texts)
    some = 0
    for i, text in more_texts.items():
        base = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind) for n, (kind, (pattern, least)) in enumerate(kinds.items()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
        row = found[i][0]
        assert [row[f"n_{k}"] for k in kinds] == [sum(b[3] == k for b in base) for k in kinds]
        assert row["base_sha256"] == sha(",".join(b[2] for b in sorted(base)))
        spans = row["spans"].split(",") if row["spans"] else []
        assert {b[2] for b in base} <= set(spans)
        place = [(int(a), list(kinds).index(k), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert place == sorted(place) and all(0 <= a < b <= len(text) for a, _, b in place)
        some += bool(base)
    assert some


def test_op5_pieces(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op5_pack"](spark, FOLDER).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        each = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in each] == list(range(-(-len(ids) // 2048)))
        assert [r["length"] for r in each[1:]] == [2048] * (len(each) - 1)
        at = 0
        for r in each:
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for each in sequences.values():
        at = 0
        for r in sorted(each, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(sequences) <= total / 2048 * 1.02 + 2


def test_op6_rows(spark, texts):
    found = by_key(QUERIES["op6_quality"](spark, FOLDER))
    assert set(found) == set(texts)
    for i, (r,) in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_votes_by_brute_force():
    rng = np.random.default_rng(8)
    counts = rng.gamma(1, 1, (90, quality.TERMS)).astype(np.float32)
    labels = (counts[:, :5].sum(axis=1) > 5).astype(int)
    counts[30:40] = counts[20:30]  # repeated rows, some with another label
    model = quality.Model(counts, labels)
    asked = np.concatenate([rng.gamma(1, 1, (20, quality.TERMS)), counts[18:34], np.zeros((1, quality.TERMS))]).astype(np.float32)
    turned = rng.permutation(90)
    other = quality.Model(counts[turned], labels[turned])
    for row, score, again in zip(model.latent(asked), model.score(asked), other.score(asked), strict=True):
        near = sorted(((round(float(sum(np.float64(a) * b for a, b in zip(row, v, strict=True))), 5), q) for v, q in zip(model.vectors, labels, strict=True)), reverse=True)
        votes = [(max(s, 1e-6) ** 8, q) for s, q in near if s >= near[quality.NEIGHBOURS - 1][0]]
        assert abs(sum(w * q for w, q in votes) / sum(w for w, _ in votes) - score) < 0.02
        assert abs(score - again) < 0.02


def test_conflicting_labels_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert sorted(model.quality.tolist()) == [0, 1]
    assert len(quality.fit(docs, labels, most_labelled=1).quality) <= 1


def test_op8_base_columns(spark, more_texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found, some = by_key(QUERIES["op8_license_scan"](spark, LARGER)), 0
    assert set(found) == set(more_texts)
    for i, text in more_texts.items():
        words = WORDS.findall(lower(text))
        places = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        row = found[i][0]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = sorted({label for _, label in places})
        assert row["base_labels"] == ",".join(base) and 0 <= row["score"] <= 1
        labels = row["labels"].split(",") if row["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels)
        some += bool(places)
    assert some


def test_op9_rows(spark, texts):
    gone = line_truth(texts.items())
    found = by_key(QUERIES["op9_line_dedup"](spark, FOLDER))
    assert set(found) == set(texts)
    for i, text in texts.items():
        kept = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone.get(i, ()))
        row = found[i][0]
        assert row["dropped"] == ",".join(map(str, sorted(gone.get(i, ())))), i
        assert row["n_dropped"] == len(gone.get(i, ())) and row["text_sha256"] == sha(kept)
        assert row["n_kept"] == sum(bool(line.strip(" \t\x0b\x0c\r")) for line in kept.split("\n"))


def test_op10_rows(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    found = by_key(QUERIES["op10_chat_format"](spark, FOLDER), "conv_id")
    assert set(found) == set(turns)
    for conv, each in turns.items():
        each.sort()
        loss = "".join(t for _, role, t in each if role == "assistant")
        (row,) = found[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(each), sha("".join(f"{role}\n{t}\n" for _, role, t in each)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss)) and row["formatted_chars"] >= sum(len(t) for _, _, t in each)


def test_licence_texts_and_look_alikes(spark):
    from ledgerlark.llm.licenses import default_templates, scan_licenses

    full = {label: max(texts, key=len) for label, texts in default_templates().items()}
    rows = [(label, f"x y z {text} end") for label, text in full.items()]
    rows += [("out of order", " ".join(reversed(full["mit"].split("\n")))), ("half", full["mpl-2.0"][: len(full["mpl-2.0"]) // 2])]
    rows += [(t, t) for t in ("governed by the courts under the terms of the agreement", "Unless required by applicable law or agreed by both parties the rent is due", "We may not use this file except on Mondays")]
    rows += [("long", "the terms of the agreement " * 60_000)]
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for label in full:
        assert label in found[label]["labels"].split(",") and found[label]["score"] > 0.99, label
    for name in found.keys() - full.keys():
        assert found[name]["score"] == 0 or name in ("out of order", "half"), name
    assert "mit" not in found["out of order"]["labels"].split(",") and "mpl-2.0" not in found["half"]["labels"].split(",")


def test_recall_of_fuzzy_lines(spark):
    """Pairs of lines just over the threshold: short, long, and outside ASCII."""
    from ledgerlark.llm.line_dedup import duplicate_lines

    rng = np.random.default_rng(12)
    rows, pairs = [], 0
    for alphabet in ("abcdefghijklmnop", "αβγδεζηθικλμ", "日月火水木金土山川田"):
        for size in (50, 90, 400):
            for _ in range(60):
                line = "".join(rng.choice(list(alphabet), size))
                grams = lambda x: {x[k : k + 8] for k in range(len(x) - 7)}
                near, at = line, size - 1
                while at > size // 2 and len(grams(line) & grams(line[:at])) >= 0.82 * len(grams(line) | grams(line[:at])):
                    near, at = line[:at], at - 1
                rows += [(len(rows), line), (len(rows) + 1, near)]
                pairs += 1
    found = duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] % 2 for r in found)
    assert len(found) >= 0.99 * pairs


def test_benchmark_of_several_shares(spark):
    from ledgerlark.llm.decontaminate import clean, contamination

    words = [f"w{k}" for k in range(4000)]
    items = spark.createDataFrame([(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(100)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "w1 w2 w3"), (3, " ".join(words[5:16])), (4, None)], "doc_id long, text string")
    one, many = (sorted(map(tuple, contamination(docs, items, most_bytes=n).collect()), key=str) for n in (1 << 20, 2000))
    assert one == many and len(one[0][2]) == 100 and [len(r[2]) for r in one] == [100, 100, 0, 1, 0]
    assert sorted(r["doc_id"] for r in clean(docs, items, most_bytes=2000).collect()) == [2, 4]


def test_stages_on_an_empty_table_and_null_ids(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    empty, nulls = docs.where("false"), docs.limit(20).withColumn("doc_id", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0, name
        out = stage(spark, nulls, FOLDER).collect()
        assert all(r["doc_id"] is None for r in out), name
        if name in ("line dedup", "near-dedup"):
            assert len(out) == 20

"""WARC archives, conversation repair and collocations: plain versions of their contracts, and the cases that break them."""

import collections
import gzip
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import collocations, warc
from ledgerlark.llm.clusters import fresh_path
from ledgerlark.llm.conversation_repair import Chart, damaged, parse, repair
from ledgerlark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
PAGES = "page_id long, url string, html string, digest string, path string, size long"


def plain_pages(rows):
    least = {}
    for i, html in rows:
        if i is not None:
            least[html] = min(i, least.get(html, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        refers = least[html] if i is not None and len(data) >= 100 and least[html] != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return collections.Counter(out)


def test_op11_rows(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()]
    found = QUERIES["op11_warc"](spark, FOLDER).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(map(tuple, found.collect())) == plain_pages(pages)


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Nulls, empty, long and equal payloads, payloads that hold archives, urls that no header can hold, clashing columns."""
    inner = warc.member(warc.page_record(7, "http://a/", b"inner", "0", None)).decode("latin-1")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    nested = (stored.compress(warc.page_record(8, "http://a/", b"nested", "0", None)) + stored.flush()).decode("latin-1")
    same, noise = "s" * 100, "".join(chr(32 + x * 7919 % 90) for x in range(300_000))
    rows = [
        (5, "http://x/é \n", same), (3, None, same), (9, "u", same), (3, "u", same), (None, "u", same), (4, "u", "s" * 99), (2, "u", "s" * 99), (6, "u", None), (10, "u", ""),
        (11, "u", inner), (12, "u", nested * 40), (13, "u", noise), (-14, "u", noise), (15, "u", "ü" * 50), (16, "u", "ü" * 50), (None, None, None),
    ]
    return spark.createDataFrame([(*r, "zz", "zz", 1) for r in rows], PAGES), rows


def _read(spark, pages, **options):
    files = warc.write_warc(pages, fresh_path(spark), **options)
    return files, warc.read_warc(files, options.get("step", warc.RANGE))


@pytest.mark.parametrize("step", [1000, 70_000, 1 << 24])
def test_ranges_own_each_record_once(spark, odd_pages, step):
    pages, rows = odd_pages
    files = warc.write_warc(pages.repartition(2), fresh_path(spark), most=200_000)
    found = warc.read_warc(files, step).where("record_type != 'warcinfo'").collect()
    number = lambda x: int(x.removeprefix("urn:page:")) if x and x.startswith("urn:page:") else None
    mine = [(number(r["record_id"]), r["http_length"], r["payload_digest"].removeprefix("sha256:"), r["record_type"], number(r["refers_to"])) for r in found]
    assert collections.Counter(mine) == plain_pages([(i, html) for i, _, html in rows])
    for r in found:
        assert r["record_type"] == "revisit" and r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"].removeprefix("sha256:")
    for f in files.collect():
        inside = sorted((r["offset"], r["length"]) for r in warc.read_warc(files.where(F.col("path") == f["path"]), step).collect())
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(inside)) and sum(inside[-1]) == f["size"]


def test_standard_gzip_reads_the_archives(spark, odd_pages):
    files = warc.write_warc(odd_pages[0].coalesce(1), fresh_path(spark)).collect()
    with gzip.open(files[0]["path"].removeprefix("file:")) as f:
        assert f.read().count(b"WARC-Record-ID: ") >= 16


def test_damaged_archives_lose_only_what_is_damaged():
    members = [warc.member(warc.page_record(i, "u", bytes([i]) * 5000, "0", None)) for i in range(4)]
    data = b"\x1f\x8b\x08 no member " + members[0] + b"junk\x1f\x8b" + members[1][:-9] + members[2] + b"\x1f\x8b\x08" + members[3] + members[0][:40]
    for step in (1, 7, 64, 10_000):
        found = [x for at in range(0, len(data), step) for x in warc.records(warc.Source(io.BytesIO(data), len(data)), at, min(at + step, len(data)))]
        assert [x[2]["warc-record-id"] for x in found] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]


def test_magic_at_a_chunks_border(monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 64)
    members = [warc.member(warc.page_record(i, "u", str(i).encode() * (i % 37), "0", None)) for i in range(60)]
    data = b"".join(members)
    assert [int(x[2]["warc-record-id"][10:-1]) for x in warc.records(warc.Source(io.BytesIO(data), len(data)), 0, len(data))] == list(range(60))


def test_no_pages(spark, odd_pages):
    files = warc.write_warc(odd_pages[0].limit(0), fresh_path(spark))
    assert files.count() == 0 and warc.read_warc(files).count() == 0


# conversation repair


def cheapest(rows):
    """(cost, audit) by brute force over all edits of each row and all insertions; rows are (initial, fault)."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("b", "d") and e != "D" for (_, f), e in zip(rows, edits, strict=True)):
            continue
        stays = [(i if e == "K" else "r", e) for (i, _), e in zip(rows, edits, strict=True)]
        cost = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if f == "t" and e != "D" else 0) for (_, f), e in zip(rows, edits, strict=True))
        if best is not None and cost > best[0]:
            continue
        for n in range(3):
            if best is not None and cost + 5 * n > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                out, audit = [], []
                for k, (i, e) in enumerate([*stays, (None, None)]):
                    for _ in range(places.count(k)):
                        out.append("r")
                        audit.append("I")
                    if e:
                        audit.append(e)
                        out += [i] if e != "D" else []
                if fits(out):
                    best = min(filter(None, [best, (cost + 5 * n, "".join(audit))]))
    return best


def fits(out):
    """Whether roles, r standing for user or assistant, can be (s?(ua)+)?"""
    rest = out[1:] if out[:1] == ["s"] else out
    return not out or bool(rest) and len(rest) % 2 == 0 and all(x in ("r", "ua"[k % 2]) for k, x in enumerate(rest))


@pytest.mark.parametrize("n", range(5))
def test_chart_against_brute_force(n):
    kinds = [(i, f) for i in "suax" for f in ("", "t")] + [("u", "b"), ("a", "d")]
    for rows in itertools.islice(itertools.product(kinds, repeat=n), 0, None, 1 if n < 3 else 5 if n < 4 else 211):
        chart = Chart()
        for initial, fault in rows:
            chart.row(initial, fault in ("b", "d"), fault == "t")
        assert chart.best() == cheapest(rows), rows


def test_long_conversation_is_linear():
    chart = Chart()
    for k in range(20_000):
        chart.row("uuasx"[k % 5], k % 11 == 0, k % 7 == 0)
    cost, audit = chart.best()
    assert cost < 40_000 and sum(x != "I" for x in audit) == 20_000


def plain_repair(rows):
    """The contract's columns of one conversation after damage: rows of (turn, role, text), in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    chart = Chart()
    for i, f in zip(initials, faults, strict=True):
        chart.row(i, f in ("b", "d"), f == "t")
    cost, audit = chart.best()
    out, rest, want = [], list(rows), None
    for e in audit:
        row = rest.pop(0) if e != "I" else None
        if e == "D":
            continue
        role = row[1] if e == "K" else {None: "user", "s": "user", "a": "user", "u": "assistant"}[want]
        want = role[0]
        out.append(f"{role}:{row[2] if row else ''}")
    assert LEGAL.match("".join(x[0] for x in out))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        place = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += []
        if place:
            row = (turn, "user" if place == 4 else role, "" if place == 1 else re.sub("[.!?]", "", text) if place == 2 else text)
            out[conv] += [row] * (1 + (place == 3))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: sorted(rows, key=order) for conv, rows in out.items()}


def test_op12_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {conv: plain_repair(rows) for conv, rows in plain_damage(rows).items()}
    assert all(any(r[k] for r in found.values()) for k in range(6))


def test_odd_conversations(spark):
    long = "word " * 200_000
    rows = [
        (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 2, None, None), (1, 9, "assistant", long), (None, 1, "user", "x!"), (None, 1, "tool", "y?"), (None, None, None, None),
        (2, 0, "system", "s."), (3, 0, "assistant", "only."), (3, 0, "assistant", "only."), (4, 1, "", "\x1c."), (4, 7, "user", "Q"), (5, 0, "sys", "z."), (5, 1, "u", "z."), (5, 2, "assistant", "z. \t"),
    ]
    rows += [(6, k, ("user", "user", "assistant", "system")[k * k % 7 % 4], f"{k % 60}" + ".!x"[k % 3]) for k in range(200)]
    table = spark.createDataFrame([(*r, "zz", True) for r in rows], "conv_id long, turn long, role string, text string, audit string, present boolean")
    hurt = damaged(table)
    report = parse(hurt, F.col("present"))
    out = collections.defaultdict(list)
    for r in repair(hurt, report, F.col("present")).collect():
        out[r["conv_id"]].append((r["place"], f"{r['role']}:{r['text']}"))
    expected = {conv: plain_repair(rows) for conv, rows in plain_damage(rows).items()}
    found = {r["conv_id"]: (*tuple(r)[1:], hashlib.sha256("\n".join(t for _, t in sorted(out[r["conv_id"]])).encode()).hexdigest()) for r in report.collect()}
    assert found == expected
    whole = {r["conv_id"]: tuple(r)[1:] for r in parse(table.drop("present")).collect()}
    assert whole[5][-2:] == (0, "KKK") and whole[2][-2:] == (2, "D")
    assert parse(table.limit(0)).count() == 0 and repair(table.limit(0), report.limit(0)).count() == 0


# collocations


def plain_collocations(rows, least, percent=100, top=2000, most=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        around = collections.Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * around[p] < percent * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


ODD = [
    ("en", "New York, new york! NEW\tYORK new  york\nnew york"), (None, "new york new york"), ("en", None), ("en", ""), ("de", "a a a a a a a a; a a a"), ("en", "été ÉTÉ été ÉTÉ \x1c new york x"), ("de", "a a a. a a a a"),
    ("fr", "rien ici"), ("", "new york new york new york"), ("en", "long word " * 30_000), ("en", ".,;:!?\r\n \t"), ("en", "new york\x0bnew york\x0cnew york"), ("de", "    x y x y x y x y"),
]


@pytest.mark.parametrize(("least", "percent", "top"), [(2, 100, 2000), (3, 100, 5), (4, 60, 2000)])
def test_collocations_by_brute_force(spark, least, percent, top):
    docs = spark.createDataFrame([(t, g, "zz", 1) for g, t in ODD], "text string, lang string, phrase string, n long").repartition(3)
    for options in ({}, {"most_counters": 1 << 18, "automaton_chars": 300}):
        found = collocations.collocations(docs, least=least, percent=percent, top=top, **options)
        assert sorted(map(tuple, found.collect())) == plain_collocations(ODD, least, percent, top)


def test_scores_past_64_bits(spark):
    """The products are of decimals: counts near 10 ** 12 give the same as whole numbers do."""
    a, n, left, right = 999_999_999_989, 9_999_999_999_971, 1_234_567_890_123, 1_999_999_999_973
    row = spark.range(1).select(*(F.lit(x).cast("decimal(19,0)").alias(c) for c, x in (("a", a), ("n", n), ("l", left), ("r", right))))
    product = (F.lit(1000).cast("decimal(4,0)") * F.col("a")).cast("decimal(23,0)")
    assert row.select(F.call_function("div", (product * F.col("n")).cast("decimal(38,0)"), (F.col("l") * F.col("r")).cast("decimal(38,0)"))).first()[0] == 1000 * a * n // (left * right)


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0x7, 0])
def test_automaton_of_words(monkeypatch, mask):
    """Pieces of any length, words that share a hash, long words that differ in one byte; phrases whose ends are no phrases."""
    hashes = collocations.Words.hashes
    monkeypatch.setattr(collocations.Words, "hashes", lambda self: hashes(self) & np.uint64(mask))
    rng = random.Random(4)
    known = ["a", "été", "abcdefgh", "abcdefghi", "abcdefghj", "xbcdefghi", "abcdefghabcdefghabcdefgh1", "abcdefghXbcdefghabcdefgh1".lower(), "b" * 9]
    pieces = [[rng.choice([*known, "others", "abcdefghk"]) for _ in range(n)] for n in (1, 2, 3, 5, 64, 65, 400, 1000)]
    longest = {tuple(p[i : i + m]) for p in pieces for m in (2, 4, 5) for i in range(0, len(p) - m + 1, 17) if all(w in known for w in p[i : i + m])}
    phrases = sorted({p[:m] for p in longest for m in range(1, len(p) + 1)} | {(w,) for w in known})
    assert any(p[1:] not in phrases for p in phrases if len(p) > 2)
    automaton = collocations.Automaton(pa.array([" ".join(p) for p in phrases]))
    data = np.frombuffer(".".join(" ".join(p) for p in pieces).encode(), dtype=np.uint8)
    offsets = np.array([0, len(data)])
    words = collocations.Words(data, offsets, collocations._WORD)
    _, piece, _ = collocations._grouped(pa.record_batch({"lang": ["en"], "text": ["x"]}), data, offsets, words)
    counts, state = np.zeros(len(phrases) + 1, dtype=int), automaton.states(automaton.numbers(words, words.hashes()), piece, 5)
    while state.any():
        counts += np.bincount(state, minlength=len(counts))
        state = automaton.fail[state]
    assert counts[1:].tolist() == [sum(tuple(p[i : i + len(q)]) == q for p in pieces for i in range(len(p))) for q in phrases]


def test_no_documents_have_no_collocations(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0

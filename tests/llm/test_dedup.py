import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import minhash
from ledgerlark.llm.clusters import components
from ledgerlark.llm.embedding_dedup import near_vectors, quantised
from ledgerlark.llm.line_dedup import drop_duplicate_lines, duplicate_lines, without_duplicate_lines
from ledgerlark.llm.near_dedup import keep_one, near_duplicates

from .helpers import lower, prose, upper


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def word_sets(rows, width):
    out = collections.defaultdict(list)
    for i, text in rows:
        words = [w for w in lower(text).replace("\t", " ").replace("\n", " ").split(" ") if w]
        out[i].append(frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else []))
    return out


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    edges = spark.createDataFrame([*pairs, *pairs[:50], (None, 3)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    expected = union_find({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {i: c for i, c in expected.items() if i in linked}
    assert components(edges.where("false")).count() == 0


def test_densified_bins_agree():
    rng = np.random.default_rng(2)
    for overlap in (0.5, 0.85, 1.0):
        n = 40
        same = rng.integers(0, 2**63, int(2 * n * overlap / (1 + overlap)), dtype=np.uint64)
        sets = [np.concatenate([same, rng.integers(0, 2**63, n - len(same), dtype=np.uint64)]) for _ in range(2)]
        hashes, row = np.concatenate(sets), np.repeat([0, 1], n)
        signature, some = minhash.signatures(hashes, row, 3, 2048)
        truth = len(same) / (2 * n - len(same))
        assert some.tolist() == [True, True, False]
        assert abs((signature[0] == signature[1]).mean() - truth) < 0.2


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = word_sets([r for r in rows if r[0] is not None], width)
    flat = [(i, s) for i, each in sets.items() for s in each if s]
    links = [(a, b) for a, s in flat for b, t in flat if 100 * len(s & t) >= percent * len(s | t)]
    expected = union_find(sets, links)
    found = near_duplicates(docs, width=width, percent=percent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == expected.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        if r["doc_id"] is not None:
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    kept = keep_one(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in sets if expected[i] == i)


def test_chained_copies_without_a_common_centre(spark):
    """Each text is near its neighbours only; a bucket's least text isn't near all of its members."""
    words = prose(9, 400).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = [*words]
        words[k * 30 + 5] = f"new{k}"
        words[k * 30 + 15] = f"other{k}"
    rng = np.random.default_rng(3)
    rows = [(int(p), rows[i][1]) for i, p in enumerate(rng.permutation(12))]
    sets = word_sets(rows, 5)
    links = [(a, b) for a in sets for b in sets if 100 * len(sets[a][0] & sets[b][0]) >= 80 * len(sets[a][0] | sets[b][0])]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == union_find(sets, links)


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert duplicate_lines(no_docs).count() == 0
    assert drop_duplicate_lines(no_docs).columns == no_docs.columns


def line_truth(rows, percent=80):
    lines, sets = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        for k, line in enumerate((text or "").split("\n")):
            clean = lower(line).strip(" \t\x0b\x0c\r")
            if clean:
                lines.append((i, k, clean))
                data = clean.encode()
                sets[clean] = frozenset(data[j : j + 8] for j in range(max(1, len(data) - 7)))
    order = {x: n for n, x in enumerate(sorted(sets))}
    near = [(order[a], order[b]) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = union_find(set(order.values()), near)
    first = {}
    for i, k, x in lines:
        g = group[order[x]]
        first[g] = min(first.get(g, (i, k)), (i, k))
    gone = collections.defaultdict(set)
    for i, k, x in lines:
        if first[group[order[x]]] != (i, k):
            gone[i].add(k)
    return dict(gone)


def test_duplicate_lines(spark):
    passage = prose(20, 55)
    near = passage.replace(passage.split()[10], "zzz", 1)
    rows = [(1, f"{prose(21, 20)}\n{passage}\n\nshort"), (2, f"{passage}\n{prose(22, 20)}"), (3, f"  {upper(near)} \nshort\n SHORT"), (4, passage), (5, None), (6, ""), (7, "\n \n"), (8, prose(23, 9000)), (9, prose(23, 9000)), (9, prose(23, 9000))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, passage, 1, 2)], "doc_id long, text string, row int, dropped int")
    found = {r["doc_id"]: set(r["dropped"]) for r in duplicate_lines(docs).collect()}
    assert found == line_truth(rows)
    assert found[4] == {0} and found[2] == {0} and found[3] == {0, 1, 2}
    out = without_duplicate_lines(docs, dropped_col="gone")
    assert out.columns == [*docs.columns, "gone"]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] == rows[1][1].split("\n")[1] and texts[1] == rows[0][1] and texts[5] is None and texts[7] == "\n \n"
    left = drop_duplicate_lines(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 2, 5, 6, 7, 8]
    assert left.where("doc_id is null").count() == 1


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(40):
        for j in range(rng.integers(1, 5)):
            rows.append((len(rows), (base[i] * rng.uniform(0.1, 9) + rng.normal(size=16) * 0.12).tolist(), int(i % 3)))
    edge = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, [], 0), (905, rows[0][1], None), (906, rows[0][1], 0), (907, rows[0][1][:8], 0), (908, rows[0][1][:8], 0), (909, [float("inf")] + [0.0] * 15, 0)]
    every = rows + edge
    df = spark.createDataFrame([*[(i, v, label, 5, "x") for i, v, label in every], (None, rows[0][1], 0, 5, "x")], "vec_id long, embedding array<double>, label int, n_links int, side string")
    usable = [(i, np.array(v), label) for i, v, label in every if v and None not in v and label is not None and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, k in usable for b, y, m in usable if a != b and k == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    expected, count = union_find([i for i, _, _ in every], links), collections.Counter(a for a, _ in links)
    assert len(links) > 40
    for tile in (7, 1024):
        found = near_vectors(df, tile=tile).collect()
        assert len(found) == len(every) + 1
        for r in found:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"]) == (0, None)
            else:
                assert (r["n_links"], r["component_id"]) == (count[r["vec_id"]], expected[r["vec_id"]]), r
    assert near_vectors(df.where("false")).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = quantised(x)
    rough = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(rough - x @ x.T) <= error[:, None] * (1 + error[None, :]) + error[None, :] + 1e-12).all()


def test_hot_groups(spark):
    """A third of all rows are copies of one text, and a hundred more are near copies of each other."""
    base = prose(30, 120).split()
    rows = [(i, " ".join(base)) for i in range(100)]
    for i in range(100):
        words = [*base]
        words[i] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, prose(1000 + i, 60)) for i in range(100)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").collect()
    assert [(g["component_id"], g["n"]) for g in groups] == [(0, 200)]

"""Nearest vectors and near duplicates against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import WORD, documents, lower, no_documents, prose
from pipewatch.llm import sketch, vptree
from pipewatch.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, seed=2, n=400, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=dim))], 0) for i in range(n)]
    rows += [(1000 + i, rows[40][1], 1) for i in range(60)]  # more copies than neighbours asked for
    rows += [(2000, None, 0), (2020, [0.0] * dim, 0), (2040, [float("nan")] * dim, 0), (2060, [float("inf")] + [1.0] * (dim - 1), 0)]
    rows += [(2080, [None] + [1.0] * (dim - 1), 0), (None, rows[1][1], 0), (2100, [], 0), rows[3], (2120, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, VECTORS), rows


def nearest(rows, k):
    fine = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            scored = [(-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in fine if i != q and len(x) == len(y)]
            out[q] = [i for _, i in sorted(scored)][:k]
    return out


def test_factor_one_is_exact(spark):
    df, rows = vectors(spark)
    got = {}
    for r in sorted(vptree.search(df, df.filter("vec_id % 20 = 0"), 20, relax=1.0, shard=100, leaf=8).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    expected = nearest(rows, 20)
    assert {q for q, v in expected.items() if v} == set(got)
    for q in got:
        # Copies score alike to the last bit only where sums run in one order.
        assert got[q] == expected[q]


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(0, 2, 16)], 0) for i in rng.permutation(600)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in vptree.search(df, df.filter("vec_id % 20 = 0"), 20, relax=1.0, shard=250, leaf=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: v for q, v in nearest(rows, 20).items() if v}


def test_trees_leave_leaves_out_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 8))
    points = np.concatenate([c + rng.normal(scale=0.02, size=(64, 8)) for c in centres])
    lifted = np.column_stack([points, np.sqrt(np.maximum((points**2).sum(1).max() - (points**2).sum(1), 0))])
    queries = np.column_stack([points[::41], np.zeros(len(points[::41]))])
    seen = []

    class Counted(vptree.Search):
        def offer(self, q, members):
            seen.append(len(q) * len(members))
            super().offer(q, members)

    found = Counted(lifted, vptree.build(lifted, 16), 5, 1.0)(queries)
    assert (found == np.argsort(-(queries @ lifted.T), axis=1, kind="stable")[:, :5]).all()
    assert sum(seen) < 0.8 * len(queries) * len(points)


def test_production_factor_recalls(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    got = {}
    for r in vptree.query(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = nearest(rows, 20)
    hits = sum(len(set(v) & got[q]) for q, v in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_small_leaves_recall_with_a_factor(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in vptree.search(df, df.filter("vec_id % 20 = 0"), 20, shard=200, leaf=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = nearest([tuple(r) for r in df.collect()], 20)
    assert sum(len(set(v) & got[q]) for q, v in expected.items()) >= 0.9 * sum(map(len, expected.values()))


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert vptree.search(df, df, 20).count() == 0


def brute(rows, size, threshold=80):
    """component by doc_id, over rows of (doc_id, text)."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            w = WORD.findall(lower(text))
            sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    name = {d: d for d in sets}
    docs = sorted(sets)
    for a in docs:
        for b in docs:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= threshold * len(x | y):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {d: new if c == old else c for d, c in name.items()}
    return {d: (len(sets[d]), name[d]) for d in docs}


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(spark, size):
    rng = random.Random(9)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(120):  # copies at growing distance, around one text and in chains
        words = (rows[-1][1].split(" ") if i % 3 == 0 and rows else list(base))[:]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((500 + (i * 37) % 121, " ".join(words)))
    given = [(r.doc_id, r.text) for r in documents(spark).collect()] + rows
    df = spark.createDataFrame(given, "doc_id long, text string")
    expected = brute(given, size)
    got = sketch.near_duplicates(df, size=size).collect()
    assert len(got) == len(given)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 80).split(" ")
    rows = []
    for i in range(80):
        words = base[:]
        for _ in range(rng.randint(3, 9)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(sketch, "BLOCK", 7)
    got = sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    expected = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_texts_of_one_id_are_linked(spark):
    rng = random.Random(5)
    one, two = prose(rng, 30), prose(rng, 30)
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")
    assert {r.component_id for r in sketch.near_duplicates(df).collect()} == {1}


def test_texts_of_one_id_stay_where_they_are_told_apart(spark):
    rng = random.Random(6)
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(4, one, "x"), (5, one, "x"), (5, two, "x"), (6, two, "x"), (7, three, "x"), (7, three, "y"), (7, three, "x"), (8, None, "x"), (8, "", "x"), (8, "a word", "x"), (3, two + " more", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dup_id string").withColumn("source", F.col("dup_id"))
    runs = [sorted((r.doc_id, r.text or "", r.source) for r in sketch.one_of_each(df.repartition(n)).collect()) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]
    assert [r[:2] for r in runs[0]] == sorted([(3, two + " more"), (4, one), (7, three), (8, ""), (8, "a word")])


@pytest.mark.parametrize("k, threshold", [(32, 0.8), (64, 0.5)])
def test_few_pairs_at_the_threshold_share_less(k, threshold):
    t = sketch.surely_common(k, threshold)
    tail = lambda n: sum(math.comb(k, x) * threshold**x * (1 - threshold) ** (k - x) for x in range(n))
    assert tail(t) <= sketch.MISS < tail(t + 1)


def test_one_row_of_each_group_stays(spark):
    df = documents(spark)
    kept = sketch.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids.values()) == {1}
    expected = {c for _, c in brute([(r.doc_id, r.text) for r in df.collect()], 5).values()}
    assert set(ids) == expected | {None}


def test_no_documents(spark):
    assert sketch.near_duplicates(no_documents(spark)).count() == 0
    assert sketch.one_of_each(no_documents(spark)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    expected = {i: 1 for i in range(1, 51)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert got == expected


def test_values_in_common_among_the_lowest_of_the_union():
    rng = np.random.default_rng(2)
    k = 8
    sets = [np.sort(rng.choice(20, rng.integers(1, k + 1), replace=False)) for _ in range(60)]
    size = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    which, place = np.concatenate(sets), np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    for one in sets:
        mark = np.zeros(20, dtype=np.int64)
        mark[one] = np.arange(1, len(one) + 1)
        plain = [len(set(one) & set(x) & set(sorted(set(one) | set(x))[:k])) for x in sets]
        assert sketch.shared_lowest(mark, which, place, starts, k).tolist() == plain


def test_a_member_of_a_list_passes_once_and_values_are_moved_once(spark):
    rows = [(1, cid, n, 1, 100, 2, 100) for cid, n in ((1, 100), (2, 100), *((c, 60 + c) for c in range(3, 40)))]
    lists = spark.createDataFrame(rows, "v long, cid long, n long, low long, low_n long, middle long, middle_n long")
    none = spark.createDataFrame([], "node long, component long")
    groups = sketch.open_groups(lists, none, 0.8)
    assert sorted((r.g, r.cid, r.c) for r in groups.collect()) == [(2, c, c) for c in range(3, 40)]
    # Members that no other step of the list meets stay out.
    assert sketch.open_groups(lists.filter("cid < 4"), none, 0.8).count() == 0
    alike = [(c, list(range(c // 2 * 100, c // 2 * 100 + 30)) + [-c - 1]) for c in range(3, 40)]
    values = spark.createDataFrame(alike, "cid long, values array<int>")
    passed = sketch.matches(groups, values, "sketches", sketch.K, 0.8)
    assert sorted((r.a, r.b) for r in passed.collect()) == [(2, c) for c in range(4, 40)]
    assert [(r.a, r.b) for r in sketch.matches(groups, values, "sets", sketch.K, 0.8).sort("a").collect()] == [(c, c + 1) for c in range(4, 40, 2)]
    plan = passed._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Repartition" in line for line in plan.split("\n")) == 1 and plan.index("Repartition") < plan.index("Join")

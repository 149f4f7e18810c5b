"""The stored search index against BM25 of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pipewatch.operators import retrieval as rt

WORD = re.compile(r"[^\W_]+")


def corpus_rows(seed=3, n=400):
    """Texts of common and rare words, copies, an id twice, empty and null texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "Ünïcode ÜNÏCODE w3"), (2003, "W5-w5_w5")]
    return rows


def plain(rows, queries, k):
    docs = [(i, Counter(WORD.findall((t or "").lower())), t) for i, t in rows]
    lengths = [sum(c.values()) for _, c, t in docs if t is not None]
    mean, n = sum(lengths) / len(lengths), len(docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for q, text in queries:
        asked = Counter(WORD.findall((text or "").lower()))
        scored = []
        for i, c, _ in docs:
            gain = [
                asked[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                for w in asked
                if c[w]
            ]
            if gain:
                scored.append((-round(sum(gain), 6), i))
        out += [(q, i, -s, place + 1) for place, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


QUERIES = [(1, "w0 w1 w90"), (2, "w5 w5 w100 w119 w3"), (3, "nothing here"), (4, None), (5, ""), (6, "ünïcode"), (7, " ".join(f"w{i}" for i in range(120)))]


@pytest.mark.parametrize("sizes, passes", [({}, {}), ({"shard_docs": 50, "block_docs": 4}, {"pass_terms": 20}), ({"shard_docs": 1000, "block_docs": 1}, {})])
@pytest.mark.parametrize("k", [1, 5, 60])
def test_best_documents_are_those_of_all_scores(spark, sizes, passes, k):
    rows = corpus_rows()
    index = rt.write_index(spark.createDataFrame(rows, "id long, content string"), **sizes)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    got = sorted((r.query_id, r.id, r.score, r.place) for r in rt.search(index, queries, k, **passes).collect())
    expected = plain(rows, QUERIES, k)
    assert [(q, i, p) for q, i, _, p in got] == [(q, i, p) for q, i, _, p in expected]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in expected], abs=2e-6)


def test_text_ids_and_an_index_opened_again(spark, tmp_path):
    corpus = spark.createDataFrame([("d1", "valve pressure"), ("d2", "pressure"), (None, "pump")], "id string, content string")
    stored = rt.write_index(corpus, str(tmp_path / "index"), shard_docs=1)
    index = rt.open_index(spark, stored.path, stored.buckets)
    assert index.documents() == (3, 4 / 3)
    queries = spark.createDataFrame([("q", "pressure pump")], "incident string, text string")
    got = rt.search(index, queries, 2, qid="incident", qtext="text")
    assert got.columns == ["incident", "id", "score", "place"]
    assert [r.id for r in got.orderBy("place").collect()] == [None, "d2"]


def test_no_documents_and_no_queries(spark):
    empty = rt.write_index(spark.createDataFrame([], "id long, content string"))
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert rt.search(empty, queries).count() == 0
    index = rt.write_index(spark.createDataFrame(corpus_rows(), "id long, content string"))
    assert rt.search(index, queries.limit(0)).count() == 0


def test_a_search_moves_no_postings(spark):
    index = rt.write_index(spark.createDataFrame(corpus_rows(), "id long, content string"), shard_docs=20)
    lists = index.rows.filter("term = 'w1'").groupBy("shard").applyInArrow(lambda t: t.select(["shard"]), "shard long")
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()


def test_blocks_that_cannot_win_are_not_read():
    """Documents of a topic stand together; a search for its words reads few other blocks, and finds the same."""
    rng = np.random.default_rng(5)
    texts = [[f"t{i // 64}_{x}" for x in rng.integers(0, 5, 12)] + [f"c{x}" for x in rng.integers(0, 5, 12)] for i in range(2048)]
    group = pa.table({"shard": pa.array([0] * 2048), "doc": pa.array(range(2048)), "words": pa.array(texts)})
    names = [c.strip().split(" ")[0] for c in rt._schema("bigint").split(",")]
    table = pa.table(rt.invert(group, 64), names=names).slice(1)
    shard = rt.Shard(table, 24.0)
    asked = ["t7_1", "t7_2", "c0", "c1"]
    terms, weights = np.array([shard.terms[t] for t in asked]), np.array([3.0, 3.0, 0.2, 0.2])
    best, scores, read = shard.best(terms, weights, 5)
    everything = np.zeros(2048)
    for t, w in zip(asked, weights):
        counts = np.array([x.count(t) for x in texts])
        everything += w * counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * 24 / 24.0))
    order = np.lexsort((np.arange(2048), -np.round(everything, 6)))[:5]
    assert shard.ids.take(pa.array(best)).to_pylist() == order.tolist()
    postings = sum(sum(1 for x in texts if t in x) for t in asked)
    assert read < postings / 4


def test_every_document_is_scored(spark):
    """All pairs that share a term, whatever the passes; rows with one id are one document of the result."""
    rows = corpus_rows()
    rows += [(rows[3][0], "w0 w1 w2")]
    index = rt.write_index(spark.createDataFrame(rows, "id long, content string"), shard_docs=64, block_docs=8)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    want = {}
    for q, i, score, _ in plain(rows, QUERIES, len(rows)):
        want[q, i] = want.get((q, i), 0) + score
    for terms in (rt.PASS_TERMS, 3):
        got = [tuple(r) for r in rt.scores(index, queries, pass_terms=terms).collect()]
        assert len(got) == len(want) == len({r[:2] for r in got})
        assert all(abs(want[q, i] - s) < 1e-5 for q, i, s in got)
    assert max(len([1 for q, _ in want if q == n]) for n in (1, 2, 7)) > 100


def test_many_queries_of_few_shards(spark, monkeypatch):
    """Queries are cut into slices where shards are few, with the same answers; equal ones are answered once."""
    rows = corpus_rows()
    index = rt.write_index(spark.createDataFrame(rows, "id long, content string"))
    asked = [(100 * n + q, text) for n in range(40) for q, text in QUERIES if q != 7]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    monkeypatch.setattr(rt, "SLICE_TERMS", 30)
    want = plain(rows, asked, 5)
    got = sorted(tuple(r) for r in rt.search(index, queries).collect())
    assert [(q, i, p) for q, i, _, p in got] == [(q, i, p) for q, i, _, p in want]

    calls = []
    best = rt.Shard.best
    monkeypatch.setattr(rt.Shard, "best", lambda self, *a: calls.append(1) or best(self, *a))
    table = pa.table({"query": [q for q in range(50) for _ in range(2)], "term": ["w0", "w1"] * 50, "weight": [1.0, 2.0] * 50, "slice": [0] * 98 + [1] * 2})
    lists = index.rows.filter("term in ('w0', 'w1')").toArrow()
    answer = rt.answering(type("Sent", (), {"value": table}), 10.0, 5)
    assert answer((pa.scalar(0), pa.scalar(0)), lists).num_rows == 49 * 5 and len(calls) == 1


def test_queries_of_the_same_known_words_are_answered_once(spark):
    """Words that no document holds make no other question of a query; counts do."""
    rows = corpus_rows()
    index = rt.write_index(spark.createDataFrame(rows, "id long, content string"), shard_docs=100)
    asked = [(n, f"w0 id{n} w3 other{n}") for n in range(60)] + [(100, "W3 w0"), (101, "w3 w0 w0"), (102, "none"), (None, "w9")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    of, best = rt.answers(index, queries)
    asks = {r.query_id: r._ask for r in of.collect()}
    assert set(asks) == {*range(60), 100, 101, None} and len(set(asks.values())) == 3
    assert len({asks[n] for n in [*range(60), 100]}) == 1
    assert best.count() == 3 * 5
    want = plain(rows, [(-1 if q is None else q, text) for q, text in asked], 5)
    got = sorted((-1 if r.query_id is None else r.query_id, r.id, r.place) for r in rt.search(index, queries).collect())
    assert got == [(q, i, p) for q, i, _, p in want]


@pytest.mark.parametrize("repeated", [0, 20])
def test_rare_words_do_not_search_the_common_ones_again(monkeypatch, repeated):
    """Queries that differ in rare words only search their long lists once, with the answers of a search for each; whatever the bounds."""
    rng = random.Random(11)
    texts = [" ".join([*rng.choices([f"c{i}" for i in range(6)], k=rng.randint(2, 9)), *(f"t{rng.randrange(250)}" for _ in range(2))]) for _ in range(600)]
    ids = [i // 2 for i in range(repeated)] + list(range(100, 699 - repeated)) + [None]
    texts = [texts[i // 2 * 2] if i < repeated else text for i, text in enumerate(texts)]
    group = pa.table({"shard": pa.array([0] * 600), "doc": pa.array(ids, pa.int64()), "words": pa.array([t.split() for t in texts])})
    names = [c.strip().split(" ")[0] for c in rt._schema("bigint").split(",")]
    shard = rt.Shard(pa.table(rt.invert(group, 64), names=names).slice(1), 8.0)
    common = [["c0", "c1"], ["c1"], ["c2", "c3", "c4"], []]
    assert any(shard.repeats) == bool(repeated) and not all(shard.repeats)
    asked = []
    for q in range(300):
        words = {*common[q % 4], *(f"t{rng.randrange(250)}" for _ in range(rng.randint(0 if q % 4 < 3 else 1, 4)))}
        asked += [(q, shard.terms[w], 1.0 + len(w) / 7 + shard.terms[w] / 1000) for w in sorted(words) if w in shard.terms]
    of, terms, weights = (np.array(c) for c in zip(*asked))
    want = []
    for q in sorted(set(of.tolist())):
        docs, scores, _ = shard.best(terms[of == q], weights[of == q], 5)
        want += [(q, int(d), float(s)) for d, s in zip(docs, scores)]
    calls = []
    best = rt.Shard.best
    monkeypatch.setattr(rt.Shard, "best", lambda self, *a: calls.append(1) or best(self, *a))
    for lookups, at_once, searches in ((rt.LOOKUPS, rt.LOOKED_UP, 3), (rt.LOOKUPS, 100, 3), (40, rt.LOOKED_UP, None), (0, 1, None)):
        monkeypatch.setattr(rt, "LOOKUPS", lookups)
        monkeypatch.setattr(rt, "LOOKED_UP", at_once)
        calls.clear()
        got = sorted((int(q), int(d), float(s)) for q, d, s in zip(*shard.answer(of, terms, weights, 5)))
        assert got == sorted(want)
        assert len(calls) == searches if searches and not repeated else len(calls) > 3
    assert all(len(c) == 0 for c in shard.answer(of[:0], terms[:0], weights[:0], 5))

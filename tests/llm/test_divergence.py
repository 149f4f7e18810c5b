"""Source divergence against its SQL and a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, documents, lower, no_documents, saved
from pipewatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def spoken(spark, seed=6, n=300):
    """Documents of two large languages, of one whose terms are too rare, and of odd groups."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "hot", "hot", None, "é", ""])
        weights = [(hash_of(source, w) % 7) + 1 for w in words]
        text = rng.choice([" ", "1", ".\n", "_"]).join(rng.choice([w, w.upper(), w]) for w in rng.choices(words, weights, k=rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["x", "x", "y", None]), source))
    rows += [(900, "rare words of three documents", "z", s) for s in ("a", "b", None)]
    rows += [(901, None, "x", "silent"), (902, "123 - !", "x", "digits"), (903, "t" * 100000, "y", "long"), (904, "only one source", "w", "a"), (0, rows[0][1], rows[0][2], rows[0][3])]
    return spark.createDataFrame([(*r, 0, *["x"] * 7) for r in rows], SCHEMA)


def hash_of(source, word):
    return sum(map(ord, f"{source}{word}"))


def plain(rows, least=30, top=50):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(lower(text))
        groups[lang].add(source)
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        size = {s: sum(n[lang, s][t] for t in kept) for s in sources}

        def p(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        share = {s: {t: p(n[lang, s][t], size[s]) for t in kept} for s in sources}
        whole = {t: p(sum(n[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            far = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(far))]
            over = [(whole[t] - share[s][t], t.encode(), t) for t in kept if n[lang, s][t] and share[s][t] > whole[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(over)[:top])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"spill": 20, "dense": 8}])
def test_audit_as_a_plain_version(spark, settings):
    df = spoken(spark)
    got = divergence.audit(df, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = plain([(r.text, r.lang, r.source) for r in df.collect()])
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert sum(r[2] == "term" for r in expected) > 50 and any(r[4] == 0 and r[0] == "z" for r in expected)


def test_query_by_its_sql(spark, tmp_path):
    folder = saved(spark, tmp_path, documents=spoken(spark).unionByName(documents(spark)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in divergence.query(spark, folder).collect()) == sorted(con.execute(divergence.ORACLE).fetchall())


def test_no_rows_and_many_ranks(spark):
    assert divergence.audit(no_documents(spark)).count() == 0
    df = spoken(spark)
    got = divergence.audit(df, least=1, top=3)
    assert sorted(tuple(r) for r in got.collect()) == plain([(r.text, r.lang, r.source) for r in df.collect()], 1, 3)


def test_shares_of_counts_beyond_a_long(spark):
    rows = [(0, 10**9, 7), (10**12, 10**13, 10**6), (3 * 10**15, 4 * 10**15, 5)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]

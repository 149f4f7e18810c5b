"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cases import SCHEMA, documents, lower, no_documents, saved
from pipewatch.llm import text as tx
from pipewatch.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelled(spark, seed=3, n=300):
    """Texts of words with one or two letters changed, in several alphabets and lengths."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(20)] + ["aaaaa", "aaaaaa", "ababab", "bababa", "x" * 64]

    def typo(word):
        at, kind = rng.randrange(len(word)), rng.randrange(3)
        return word[:at] + ("" if kind == 0 else rng.choice("abcdé")) + word[at + (kind != 2) :]

    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            word = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                word = typo(word) or "a"
            out.append(rng.choice([word, word, word.upper(), word.title()]))
        rows.append((rng.choice([i, i, i, None]), rng.choice([" ", ", ", "\n", "-", "₤", "1"]).join(out)))
    rows += [(900, None), (901, ""), (902, "Ünïcode ÜNÏCODE ünïcode ÿÿÿÿÿ × ÷÷÷÷÷ ĀĀĀĀĀ"), (902, "z" * 100000), (903, "z" * 100000), (904, "z" * 100001), (905, "z" * 100000)]
    return spark.createDataFrame([(d, t, "en", "a", 0, *["x"] * 7) for d, t in rows], SCHEMA)


def counts(rows):
    seen = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    n = counts(rows)
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


@pytest.mark.parametrize("settings", [{}, {"spill": 10}])
def test_variants_are_those_of_all_pairs(spark, settings):
    df = spelled(spark)
    got = variants.variants(df, **settings)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    expected = plain([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(tuple(r) for r in got.collect()) == expected
    # Neighbours, and groups whose root is two steps away.
    assert sum(r[2] for r in expected) > 200 and any(r[3] is not None and r[5] != r[3] for r in expected)


def test_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = variants.query(spark, sf)
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == plain(rows)


def test_odd_rows_and_no_rows(spark, tmp_path):
    df = documents(spark)
    expected = plain([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(tuple(r) for r in variants.variants(df).collect()) == expected
    assert variants.query(spark, saved(spark, tmp_path, documents=no_documents(spark))).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(8)
    for _ in range(300):
        places = rng.sample(range(12), rng.randint(3, 7))
        grams = [(rng.randint(1, 20), p) for p in places]
        pairs = [(a, b) for a, b in combinations(grams, 2) if abs(a[1] - b[1]) >= 2]
        got = variants.pivots(grams)
        if pairs:
            assert abs(got[0][1] - got[1][1]) >= 2
            assert sum(g[0] for g in got) == min(a[0] + b[0] for a, b in pairs)


def test_checksums_go_on_from_a_prefix():
    words = ["a", "", "élan", "word", "x" * 1000]
    data, offsets = tx.buffers(pa.array(words))
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    got = variants.crc32(heads, data, offsets[:-1], offsets[1:])
    assert got.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)]

"""Line dedup against its SQL and a plain version."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from cases import SCHEMA, documents, lower, no_documents, prose, saved
from pipewatch.llm import linedup, perfect
from pipewatch.llm import text as tx

BLANK = " \t\n\r\x0b\x0c"
KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def lined(spark, seed=4, n=80):
    """Documents of lines, many of them shared, in odd cases of white space and letters."""
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(1, 6)) for _ in range(60)] + ["short", "é" * 9, "é" * 10, "a line of all", ""]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(pool)
            line = rng.choice([line, line.upper(), line.replace("É", "é"), f" \t{line}\r", f"{line}\x0c", line])
            lines.append(line)
        lines.append("A line of ALL" if i % 3 else "")
        rows.append((rng.choice([i * 7, i * 7, 35, None]), "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "twice the same\ntwice the same"), (504, "twice the same"), (505, "x" * 200000 + "\nlast"), (506, "x" * 200000)]
    return spark.createDataFrame([(d, t, "en", "a", 0, *["x"] * 7) for d, t in rows], SCHEMA)


def plain(rows):
    """(doc_id, lines, dropped, kept) per (doc_id, text)."""
    last = float("inf")
    key = lambda line: lower(line.strip(BLANK))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=KEY)


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "hot_least": 4, "hot": 40}, {"shard": 1, "hot_least": 1 << 40}])
def test_lines_as_a_plain_version_drops_them(spark, sizes):
    df = lined(spark).unionByName(documents(spark))
    got = linedup.dedup(df, **sizes)
    assert got.columns == [*df.columns, "line_total", "line_dropped"]
    rows = [(r.doc_id, r.line_total, r.line_dropped, r.text or "") for r in got.collect()]
    assert sorted(rows, key=KEY) == plain([(r.doc_id, r.text) for r in df.collect()])


def test_query_by_its_sql(spark, tmp_path):
    folder = saved(spark, tmp_path, documents=lined(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(linedup.ORACLE).fetchall(), key=KEY)
    got = linedup.query(spark, folder)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == expected
    assert sum(r[2] for r in expected) > 50
    plainly = [(d, n, x, hashlib.sha256(t.encode()).hexdigest()) for d, n, x, t in plain([(r.doc_id, r.text) for r in lined(spark).collect()])]
    assert sorted(plainly, key=KEY) == expected


def test_clashing_columns_and_no_rows(spark):
    df = lined(spark, n=10).withColumnsRenamed({"v": "line_gone", "cid": "line_total", "h": "doc"})
    got = linedup.dedup(df)
    assert [c for c in got.columns if c not in df.columns] == ["line_dropped"] and "doc" in got.columns
    assert {r.doc for r in got.collect()} == {"x"}
    assert linedup.dedup(no_documents(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40000])
def test_slots_are_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    sizes, bits = perfect.build(keys)
    slots = perfect.Slots(sizes, bits)
    assert sorted(slots.of(keys)) == list(range(len(keys)))
    strangers = slots.of(tx.mix(keys + np.uint64(5)))
    assert ((strangers >= perfect.STRANGER) & (strangers < max(1, len(keys)))).all()
    if n >= 1000:
        assert len(bits) * 8 < 4.2 * n


def test_strangers_are_told_by_fingerprints(spark):
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000))
    keys = spark.createDataFrame([(0, int(x), 2 + i % 2, i) for i, x in enumerate(h)], "shard long, h long, n long, owner long")
    (row,) = linedup.index(keys).collect()
    shard = linedup.Shard(*row[1:])
    owner, shared = shard.owner(h)
    assert shared.all() and (owner == np.arange(len(h))).all()
    assert not shard.owner(h + 1)[1][~np.isin(h + 1, h)].any()
    assert len(row.bits) + len(row.fingerprints) + len(row.counts) + len(row.owners) < 14 * len(h)

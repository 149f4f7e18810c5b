"""How far the sources of each language are from one another, by in-mapper stripes.

Each task folds whole documents into stripes: for a term of a language, in how many documents
it is and how often each source has it. A task's stripes are spilled when they
grow past a bound, and summed by key, source by source, so a frequent term never gathers the
counts of all tasks in one value. Merged, a stripe holds one count per source. It gives the term's
smoothed shares at once, and from them its part of every divergence: numpy adds up the
differences of all pairs of sources over a batch of stripes, so no table of pairs and terms is made.

Shares are whole numbers of a billionth, so all sums are exact and don't depend on their order.

Defined results: null text, lang and source are empty strings; rows that repeat a doc_id are documents
of their own; a group without terms takes part, its counts are 0; a language none of whose
terms is frequent enough has pairs of value 0 and no terms; an empty table gives no rows.
Only ``text``, ``lang`` and ``source`` are read. Terms are told apart by 64-bit hashes within a task, and by
themselves afterwards. A text is held in one task, whole; a stripe and the sums of pairs
take room by the number of a language's sources.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a language that a term is in, at least.
LEAST = 30
#: Added to every count, and the whole that shares are parts of.
SMOOTH, WHOLE = 5, 1_000_000_000
#: Terms reported per group.
TOP = 50
#: Cells of stripes a task holds before it hands them on.
SPILL = 1 << 19
#: Numbers of a batch of stripes that are laid out at once.
DENSE = 1 << 20

TERM = np.zeros(256, dtype=bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


class Stripes:
    """(term, group) cells with documents and occurrences, by hash. Parts are merged now and then."""

    def __init__(self, spill: int):
        self.spill = spill
        self.groups: dict[tuple[str, str], int] = {}
        self.names: dict[int, str] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        data, offsets = tx.buffers(texts)
        starts, ends, rows = tx.segments(TERM[data], offsets)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], dtype=np.int64)
        if not len(starts):
            return
        lowered = tx.LOWER[data]
        term, first, which = np.unique(tx.hashes(lowered, starts, ends), return_index=True, return_inverse=True)
        for h, at in zip(term.tolist(), first.tolist()):
            if h not in self.names:
                self.names[h] = lowered[starts[at] : ends[at]].tobytes().decode()
        # Once per document and term, with its occurrences there; then once per group and term.
        pair, n = np.unique(rows * len(term) + which, return_counts=True)
        row, which = pair // len(term), pair % len(term)
        cell, back = np.unique(group[row] * len(term) + which, return_inverse=True)
        docs = np.bincount(back, minlength=len(cell))
        counts = np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64)
        self.parts.append((term[cell % len(term)], cell // len(term), docs, counts))
        self.pending += len(cell)
        if self.pending > 2 * self.spill:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        term, group, docs, n = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in range(4))
        order = np.lexsort((group, term))
        term, group, docs, n = term[order], group[order], docs[order], n[order]
        opens = np.ones(len(term), dtype=bool)
        opens[1:] = (term[1:] != term[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(opens)
        if len(at):
            docs, n = np.add.reduceat(docs, at), np.add.reduceat(n, at)
        self.parts = [(term[at], group[at], docs, n)]
        self.pending = len(at)
        return self.parts[0]

    def full(self) -> bool:
        return self.pending > self.spill and len(self.merge()[0]) > self.spill

    def batch(self) -> pa.RecordBatch:
        """A row per language and term: documents, and the sources with their counts."""
        term, group, docs, n = self.merge()
        langs, sources = (np.array([g[i] for g in self.groups] or [""], dtype=object) for i in range(2))
        spoken, lang = np.unique(langs.astype(str), return_inverse=True)
        order = np.lexsort((lang[group], term))
        term, group, docs, n = term[order], group[order], docs[order], n[order]
        opens = np.ones(len(term), dtype=bool)
        opens[1:] = (term[1:] != term[:-1]) | (lang[group][1:] != lang[group][:-1])
        at = np.flatnonzero(opens)
        ends = pa.array(np.append(at, len(term)).astype(np.int32))
        df = np.add.reduceat(docs, at) if len(at) else docs
        return pa.RecordBatch.from_arrays(
            [
                pa.array(spoken[lang[group[at]]].tolist(), pa.string()),
                pa.array([self.names[h] for h in term[at].tolist()], pa.string()),
                pa.array(df, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(sources[group].tolist(), pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())),
            ],
            ["lang", "term", "df", "sources", "counts"],
        )


STRIPE_SCHEMA = "lang string, term string, df long, sources array<string>, counts array<long>"


def given(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """Stripes of tasks, not yet merged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes(spill)
        for batch in batches:
            for part in tx.slices(batch):
                held.add(tx.column(part, "text"), *(tx.column(part, c).to_pylist() for c in ("lang", "source")))
                if held.full():
                    yield held.batch()
                    held = Stripes(spill)
        yield held.batch()

    return given(docs).mapInArrow(work, STRIPE_SCHEMA)


def merged(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, source, n) of the terms in enough documents of their language."""
    # The stripe's document count goes with its first cell, so cells can be summed each by itself.
    cells = parts.select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "cell"))
    summed = cells.groupBy("lang", "term", F.col("cell.sources").alias("source")).agg(
        F.sum("cell.counts").alias("n"), F.sum(F.when(F.col("place") == 0, F.col("df")).otherwise(0)).alias("df")
    )
    whole = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return whole.filter(F.col("df") >= least).select("lang", "term", "cells")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * terms)), in decimals that can't overflow."""
    above = (count + SMOOTH).cast("decimal(25,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    return (F.call_function("div", above, (total + SMOOTH * terms).cast("decimal(25,0)")) + 1).cast("long")


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spoken(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per language: kept terms, occurrences of them, and its sources in order with theirs."""
    counted = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    groups = given(docs).select("lang", "source").distinct().join(counted, ["lang", "source"], "left")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    each = F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
    langs = groups.groupBy("lang").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), each.alias("groups")).join(terms, "lang", "left")
    return langs.withColumn("terms", F.coalesce("terms", F.lit(0)))


def with_shares(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """The stripes with shares: of the language, of each of its sources that has the term, and of all its sources at a count of 0."""
    joined = kept.join(langs, "lang")
    n = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    names = F.col("groups")["source"]

    def placed(c: Column) -> Column:
        place = F.array_position(names, c["source"])
        return F.struct(
            c["source"].alias("source"), (place - 1).cast("int").alias("code"), share(c["n"], F.element_at("groups", place.cast("int"))["n"], F.col("terms")).alias("p")
        )

    return joined.select(
        "lang", "term", F.transform("cells", placed).alias("cells"),
        share(n, F.col("total"), F.col("terms")).alias("q"),
        F.transform("groups", lambda g: share(F.lit(0), g["n"], F.col("terms"))).alias("absent"),
    )


def differences(shares: DataFrame, dense: int = DENSE) -> DataFrame:
    """(lang, a, b, value): sums over a task's stripes of the differences of all pairs of sources, a < b by number."""

    def add(total: np.ndarray, absent: np.ndarray, lengths: np.ndarray, codes: np.ndarray, p: np.ndarray) -> None:
        step = max(1, dense // len(absent))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for a in range(0, len(lengths), step):
            b = min(a + step, len(lengths))
            rows = np.tile(absent, (b - a, 1))
            rows[np.repeat(np.arange(b - a), lengths[a:b]), codes[ends[a] : ends[b]]] = p[ends[a] : ends[b]]
            for k in range(len(absent) - 1):
                total[k, k + 1 :] += np.abs(rows[:, k + 1 :] - rows[:, k : k + 1]).sum(axis=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(tx.column(batch, "lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                mine = batch.filter(pa.array(langs == lang))
                absent = np.array(tx.column(mine, "absent")[0].as_py(), dtype=np.int64)
                lists = [tx.column(mine, c) for c in ("codes", "p")]
                lengths = np.diff(lists[0].offsets.to_numpy())
                total = totals.setdefault(lang, np.zeros((len(absent), len(absent)), dtype=np.int64))
                add(total, absent, lengths, *(c.flatten().to_numpy() for c in lists))
        for lang, total in totals.items():
            a, b = np.triu_indices(len(total), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["lang", "a", "b", "value"])

    rows = shares.select("lang", F.col("cells")["code"].alias("codes"), F.col("cells")["p"].alias("p"), "absent")
    return rows.mapInArrow(work, "lang string, a int, b int, value long")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, spill: int = SPILL, dense: int = DENSE) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance from the other sources of its
    language, and the terms it has more of than the language."""
    kept = written(merged(stripes(docs, spill), least), "stripes")
    langs = written(spoken(docs, kept), "languages")
    shares = written(with_shares(kept, langs), "shares")

    over = shares.select("lang", "term", "q", F.explode("cells").alias("c")).filter(F.col("c.p") > F.col("q"))
    over = over.select("lang", F.col("c.source").alias("source"), F.col("term").alias("item"), (F.col("c.p") - F.col("q")).alias("value"))
    terms = ranked(over, "term").filter(F.col("rank") <= top)

    summed = differences(shares, dense).groupBy(F.col("lang").alias("_lang"), F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.sum("value").alias("value"))
    names = F.col("groups")["source"]
    pairs = langs.select("lang", names.alias("names"), F.posexplode(names).alias("a", "source"))
    pairs = pairs.select("lang", "a", "source", F.posexplode("names").alias("b", "item")).filter("a != b")
    found = (F.col("lang") == F.col("_lang")) & (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b"))
    far = pairs.join(summed, found, "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return terms.union(ranked(far, "pair"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT lang, source, term, k.n AS all_n, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM e),
p AS (SELECT s.lang, source, term, n, 1 + (1000000000 * (n + 5)) // (s.total + 5 * v) AS p, 1 + (1000000000 * (all_n + 5)) // (v.total + 5 * v) AS q
      FROM s JOIN v USING (lang)),
far AS (SELECT g.lang, g.source, o.source AS item, coalesce(f.value, 0) AS value
        FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
        LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL) f
          ON f.lang = g.lang AND f.x = g.source AND f.y = o.source),
over AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
both_parts AS (SELECT 'pair' AS part, * FROM far UNION ALL SELECT 'term', * FROM over),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def query(spark, sf_dir: str) -> DataFrame:
    """All groups of the documents against their languages and one another."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))

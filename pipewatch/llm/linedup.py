"""Drop lines that an earlier document has, by a sharded minimal perfect hash.

A line is known by the hash of its key: the line stripped of white space and
lower-cased. All distinct hashes are cut into shards of bounded size. A shard is one row: a
minimal perfect hash over its lines, and arrays in slot order with a
32-bit fingerprint, the number of documents (up to 255) and, for lines of
several documents, the smallest doc_id. Documents send their hashes to the shards, where
each is looked up in the arrays as it streams by; only hits, the lines a document has
to drop, come back. Lines are neither joined with lines nor gathered by line.

A line in very many documents would send all its probes to one shard. There can be
few such lines (``HOT``), so their doc_ids travel to the documents instead.

Defined results: a null or empty text is one empty line, and a null text stays null; rows
that repeat a doc_id are one document; rows without doc_id are one document, which
comes after all others; a line repeated inside the document that keeps it stays every time; a text all of whose lines
go is empty; an empty table gives no rows. Lines are told apart by 64-bit hashes. A
text is held in one task, whole. Columns the operator adds start with ``line_`` and replace
any of that name.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import perfect
from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Code points a key must have for its lines to be dropped.
LEAST = 10
#: Distinct lines a shard holds, about; its arrays take up to 14 bytes a line.
SHARD = 1 << 16
#: Lines whose holders travel to the documents: those of a share of 1/HOT of all probes, so HOT at most.
HOT = 10_000
#: Below this number of probes a line never counts as hot.
HOT_LEAST = 1024
#: Stands for a missing doc_id: after all others.
LAST = (1 << 63) - 1
#: Counts are kept up to here.
MANY = 255


def lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of every line: row, start, end, start and end of its key, code points of the key; then the bytes."""
    data, offsets = tx.buffers(texts)
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:]
    solid = np.flatnonzero(~tx.SPACE[data])
    first, after = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = first < after
    key_start, key_end = starts.copy(), starts.copy()
    key_start[some], key_end[some] = solid[first[some]], solid[after[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return rows, starts, ends, key_start, key_end, points[key_end] - points[key_start], data


def keyed(texts: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """Rows, starts and ends of all lines, whether a line can be dropped, and its 63-bit hash."""
    rows, starts, ends, key_start, key_end, points, data = lines(texts)
    able = points >= least
    lowered = tx.LOWER[data].tobytes()
    h = np.zeros(len(rows), dtype=np.int64)
    digest = b"".join(
        hashlib.blake2b(lowered[a:b], digest_size=8).digest() for a, b in zip(key_start[able].tolist(), key_end[able].tolist())
    )
    h[able] = (np.frombuffer(digest, "<u8") >> np.uint64(1)).astype(np.int64)
    return rows, starts, ends, able, h


def probes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, h): each line of a row that could be dropped, once a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                rows, _, _, able, h = keyed(tx.column(part, "text"), least)
                docs_of = tx.column(part, "doc").to_numpy(zero_copy_only=False)
                pairs = np.unique(np.stack([docs_of[rows[able]], h[able]], axis=1), axis=0) if able.any() else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "h"])

    return docs.select(document().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc long, h long")


def document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (tx.mix(h.view(np.uint64) * tx.M2 + tx.M3) >> np.uint64(32)).astype("<u4")


INDEX_SCHEMA = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, owners binary"


def index(keys: DataFrame) -> DataFrame:
    """One row per shard from (shard, h, n, owner), one row per distinct line."""

    def build(group: pa.Table) -> pa.Table:
        h, n, owner = (group.column(c).to_numpy() for c in ("h", "n", "owner"))
        sizes, packed = perfect.build(h.view(np.uint64))
        slot = perfect.Slots(sizes, packed).of(h.view(np.uint64))
        prints, counts, owners = np.zeros(len(h), "<u4"), np.zeros(len(h), np.uint8), np.zeros(len(h), "<i8")
        prints[slot], counts[slot], owners[slot] = fingerprints(h), np.minimum(n, MANY), owner
        cells = [sizes.astype("<i8"), packed, prints, counts, owners[counts > 1]]
        return pa.table([pa.array([group.column("shard")[0].as_py()]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=pa_names(INDEX_SCHEMA))

    return keys.groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def pa_names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class Shard:
    """A shard's arrays, ready to be probed."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, owners: bytes):
        self.slots = perfect.Slots(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, np.uint8))
        self.prints = np.frombuffer(prints, "<u4")
        self.counts = np.frombuffer(counts, np.uint8)
        # Lines of one document have no owner stored; the empty place at the end is never looked at.
        self.place = np.cumsum(self.counts > 1) - 1
        self.owners = np.append(np.frombuffer(owners, "<i8"), LAST)

    def owner(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest document that has the line, and whether several have it."""
        slot = self.slots.of(h.view(np.uint64))
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(h[known])
        known[known] = self.counts[slot[known]] > 1
        out = np.full(len(h), LAST, dtype=np.int64)
        out[known] = self.owners[self.place[slot[known]]]
        return out, known


def probe(cold: DataFrame, shards: DataFrame) -> DataFrame:
    """(doc, h): the probes (shard, doc, h) of lines that a smaller document has as well."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for batch in batches:
            # Within a task rows come shard by shard, the shard's arrays first.
            shard = tx.column(batch, "shard").to_numpy()
            for a, b in runs(shard):
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, arrays = shard[a], None
                opens = np.flatnonzero(tx.column(part, "sizes").is_valid().to_numpy(zero_copy_only=False))
                if len(opens):
                    arrays = Shard(*(tx.column(part, c)[int(opens[0])].as_py() for c in pa_names(INDEX_SCHEMA)[1:]))
                    part = part.slice(int(opens[0]) + 1)
                doc, h = (tx.column(part, c).to_numpy(zero_copy_only=False) for c in ("doc", "h"))
                if not len(h):
                    continue
                if arrays is None:
                    raise RuntimeError(f"probes of shard {now} came before its arrays")
                doc, h = doc.astype(np.int64), h.astype(np.int64)
                owner, shared = arrays.owner(h)
                goes = shared & (doc != owner)
                yield pa.RecordBatch.from_arrays([pa.array(doc[goes]), pa.array(h[goes])], ["doc", "h"])

    blank = [F.lit(None).cast("binary").alias(c) for c in pa_names(INDEX_SCHEMA)[1:]]
    stream = shards.select("shard", *pa_names(INDEX_SCHEMA)[1:], F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("h")).union(
        cold.select("shard", *blank, "doc", "h")
    )
    return stream.repartition("shard").sortWithinPartitions("shard", F.col("doc").asc_nulls_first()).mapInArrow(work, "doc long, h long")


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_drop(docs: DataFrame, least: int = LEAST, shard: int = SHARD, hot: int = HOT, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc, h): the lines each document has to drop."""
    asked = written(probes(docs, least), "lines")
    total = asked.count()
    shards = max(1, -(-total // shard))
    keys = written(
        asked.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("owner"))
        .select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "n", "owner"),
        "line-keys",
    )
    often = max(hot_least, total // hot)
    # At most ``hot`` rows of two numbers: their counts add up to ``total`` at most.
    frequent = F.broadcast(keys.filter(F.col("n") >= often).select(F.col("h").alias("_h"), "owner"))
    resolved = asked.join(frequent, F.col("h") == F.col("_h"), "left")
    near = resolved.filter("_h IS NOT NULL AND doc != owner").select("doc", "h")
    cold = resolved.filter("_h IS NULL").select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "doc", "h")
    arrays = written(index(keys.filter(F.col("n") < often)), "line-index")
    return near.union(probe(cold, arrays))


def dedup(docs: DataFrame, least: int = LEAST, **sizes: int) -> DataFrame:
    """The rows of ``docs`` without the lines that a smaller doc_id has; adds line_total and line_dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("line_")])
    gone = to_drop(docs, least, **sizes).groupBy(F.col("doc").alias("line_of")).agg(F.collect_set("h").alias("line_gone"))
    joined = docs.withColumn("line_doc", document()).join(gone, F.col("line_doc") == F.col("line_of"), "left")
    kind = docs.schema["text"].dataType
    total = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1

    @F.pandas_udf("text string, dropped long")
    def without(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in columns:
            left = [(t, 0) if t is None or g is None or not len(g) else cut(t, g, least) for t, g in zip(texts, gone)]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in left], dtype=object), "dropped": np.array([n for _, n in left], np.int64)})

    done = joined.withColumns(
        {"line_total": F.coalesce(total, F.lit(1)).cast("long"), "line_kept": without(F.col("text").cast("string"), "line_gone")}
    )
    names = [F.col("line_kept.text").cast(kind).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return done.select(*names, "line_total", F.col("line_kept.dropped").alias("line_dropped"))


def cut(text: str, gone: np.ndarray, least: int) -> tuple[str, int]:
    """The text without the lines whose hashes are given, and how many those were."""
    _, starts, ends, able, h = keyed(pa.array([text], pa.large_string()), least)
    stays = ~(able & np.isin(h, gone))
    data = text.encode()
    kept = b"\n".join(data[a:b] for a, b in zip(starts[stays].tolist(), ends[stays].tolist()))
    return kept.decode(), int((~stays).sum())


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
o AS (SELECT k, min(doc) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING min(doc) < max(doc)),
m AS (SELECT k.*, coalesce(o.owner <> k.doc, false) AS gone FROM k LEFT JOIN o ON o.k = k.k),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN t USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines an earlier one has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return dedup(docs).select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), digest.alias("kept_sha256"))

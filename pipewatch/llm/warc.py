"""WARC archives as a table of chunks.

A payload goes through as rows (record, chunk number) of bounded size. Each
chunk carries the digest of the payload up to its end, so a reader checks as
it goes and neither side ever holds a payload it has not yet hashed. A chunk is
written as one WARC record; those after a payload's first are continuation
records with segment numbers, as the format has it for oversized records.

Spark's text writer makes the files, one row a record and the blank lines that end
a record as its separator, so archives may lie in any store Spark writes to. They
are gzipped and hence read in order, by one task each; the reader finds record
borders by Content-Length alone, whatever blank lines payloads hold.

Defined results: a null payload is empty; a null id orders before all others, and
revisits name no null id; rows that repeat the largest id of a payload are all
responses; a null or unprintable target address is left out or escaped; an empty
table gives no archive and reads back empty. Columns besides id, url and payload are
not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BREAK = "\r\n\r\n"
#: Characters of a chunk, at most.
CHUNK = 1 << 18
#: Payloads below this many bytes are always written out.
LEAST = 1000
#: Rows a payload's many copies are spread over when they look up their response.
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_responses(pages: DataFrame, page_id: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to): refers_to is set on revisits.

    Digests are joined without payloads. A payload shared by a third of the pages
    is one row on one side, copied to SALTS, and spread over them on the other.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    largest = (
        rows.filter(F.col("bytes") >= least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _first IS NOT NULL")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    narrow = rows.select("page_id", "digest", "bytes").filter(F.col("bytes") >= least).distinct()
    salted = narrow.withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = (
        salted.join(largest, (F.col("digest") == F.col("_digest")) & (F.col("_s") == F.col("_salt")))
        .filter(~F.col("page_id").eqNullSafe(F.col("_first")))
        .select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), F.col("_first").alias("refers_to"))
    )
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").drop("_id", "_d")


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha1(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(record, chunk_no, chunk_count, chunk, running, ...): a row per chunk, in order within its task.

    ``running`` is the SHA-1 of the payload up to the chunk's end. A revisit has one empty chunk.
    """
    schema = "record string, chunk_no int, chunk_count int, chunk string, running string, page_id long, url string, bytes long, digest string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "payload"):
                out, held = [], 0
                for row in part.to_pylist():
                    text = "" if row["refers_to"] is not None else row["payload"]
                    count = max(1, -(-len(text) // size))
                    so_far = hashlib.sha1()
                    same = [row[x] for x in ("page_id", "url", "bytes", "digest", "refers_to")]
                    name = record_id(row["page_id"], row["digest"])
                    for number in range(count):
                        chunk = text[number * size : (number + 1) * size]
                        so_far.update(chunk.encode())
                        out.append((name, number, count, chunk, so_far.hexdigest(), *same))
                        held += len(chunk)
                        if held > 4 * size:
                            yield rows_batch(out)
                            out, held = [], 0
                yield rows_batch(out)

    kinds = {"chunk_no": pa.int32(), "chunk_count": pa.int32(), "page_id": pa.int64(), "bytes": pa.int64(), "refers_to": pa.int64()}

    def rows_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)], names)

    return rows.select("page_id", "url", "payload", "bytes", "digest", "refers_to").mapInArrow(work, schema)


def header(row: dict, length: int) -> str:
    """The WARC header of a chunk's record."""
    revisit = row["refers_to"] is not None
    first = row["chunk_no"] == 0
    lines = ["WARC/1.1", f"WARC-Type: {('revisit' if revisit else 'response') if first else 'continuation'}"]
    own = row["record"] if first else record_id(row["chunk_no"], row["record"])
    lines += [f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if row["url"]:
        plain = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), row["url"])
        lines.append(f"WARC-Target-URI: {plain}")
    if first:
        lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Length: {row['bytes']}"]
        if row["page_id"] is not None:
            lines.append(f"X-Page-ID: {row['page_id']}")
    else:
        lines.append(f"WARC-Segment-Origin-ID: {row['record']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    if row["chunk_count"] > 1:
        lines.append(f"WARC-Segment-Number: {row['chunk_no'] + 1}")
        if row["chunk_no"] == row["chunk_count"] - 1:
            lines.append(f"WARC-Segment-Total-Length: {row['bytes']}")
    lines += [f"X-Running-Digest: sha1:{row['running']}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return "\r\n".join(lines)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", size: int = CHUNK) -> None:
    """Archives of all pages below ``path``, a record per page."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out.append(header(row, len(row["chunk"].encode())) + BREAK + row["chunk"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    records = chunk_rows(with_responses(pages, page_id, url, payload), size).mapInArrow(lines, "value string")
    # A page's records stay in one file, in order: a file is never begun anew for its length.
    records.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


FIELD = re.compile(r"^([A-Za-z-]+): (.*)$", re.M)


class Records:
    """Splits a stream of bytes into records, a piece of payload at a time."""

    def __init__(self) -> None:
        self.head, self.fields, self.left = b"", None, 0

    def feed(self, data: bytes) -> Iterator[tuple[str, object]]:
        """("start", fields), ("data", bytes) and ("end", fields) events."""
        while data or (self.fields is not None and not self.left):
            if self.fields is None:
                self.head = (self.head + data).lstrip(b"\r\n") if not self.head else self.head + data
                data = b""
                at = self.head.find(BREAK.encode())
                if at < 0:
                    return
                self.fields = dict(FIELD.findall(self.head[:at].decode().replace("\r\n", "\n")))
                data, self.head = self.head[at + 4 :], b""
                self.left = int(self.fields["Content-Length"])
                yield "start", self.fields
            piece, data = data[: self.left], data[self.left :]
            self.left -= len(piece)
            if piece:
                yield "data", piece
            if not self.left:
                yield "end", self.fields
                self.fields = None
            elif not data:
                return


READ = "record string, chunk_no int, chunk_bytes long, verified boolean, type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, last boolean, chunk binary"


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per chunk of the archives; ``verified`` if its running digest is right.

    ``payload_bytes`` and ``payload_digest`` are of the payload up to the chunk's end;
    of a revisit, those it states. Without ``payloads``, chunks are hashed and left out.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, state = None, Records(), {}
        out: list[tuple] = []

        def taken(kind: str, value) -> None:
            if kind == "start":
                if value["WARC-Type"] != "continuation":
                    state.update(name=value["WARC-Record-ID"], number=0, sha=hashlib.sha1(), bytes=0, first=value)
                elif value.get("WARC-Segment-Origin-ID") == state.get("name"):
                    state["number"] += 1
                else:
                    raise ValueError(f"segment without its origin: {value['WARC-Record-ID']}")
                state["chunk"], state["chunk_bytes"] = [], 0
            elif kind == "data":
                state["sha"].update(value)
                state["bytes"] += len(value)
                state["chunk_bytes"] += len(value)
                if payloads:
                    state["chunk"].append(value)
            else:
                first, now = state["first"], state["sha"].hexdigest()
                revisit = first["WARC-Type"] == "revisit"
                number = lambda key: int(first[key]) if key in first else None
                last = "WARC-Segment-Number" not in value or "WARC-Segment-Total-Length" in value
                good = value["X-Running-Digest"] == f"sha1:{now}"
                if last and not revisit:
                    good = good and first["WARC-Payload-Digest"] == f"sha1:{now}" and number("X-Payload-Length") == state["bytes"]
                out.append((
                    state["name"], state["number"], state["chunk_bytes"], good, first["WARC-Type"], number("X-Page-ID"), first.get("WARC-Target-URI"),
                    number("X-Payload-Length") if revisit else state["bytes"], first["WARC-Payload-Digest"][5:] if revisit else now,
                    number("X-Refers-To-Page-ID"), last, b"".join(state["chunk"]) if payloads else None,
                ))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            out.clear()
            return done

        for batch in batches:
            files, values = tx.column(batch, "file"), tx.column(batch, "value")
            for i in range(batch.num_rows):
                name = files[i].as_py()
                if name != file:
                    file, parser = name, Records()
                for kind, value in parser.feed(values[i].as_py().encode() + BREAK.encode()):
                    taken(kind, value)
            yield flush()

    lines = spark.read.option("lineSep", BREAK).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(work, READ)


def records(chunks: DataFrame) -> DataFrame:
    """The whole records: of each its last chunk's figures. No chunk is shuffled, as a record's are in one file."""
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "verified")


def query(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back."""
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return records(read_chunks(spark, path, payloads=False))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to, TRUE AS verified
FROM m
"""

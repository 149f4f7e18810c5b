"""Harmonic packing of token sequences.

Piece lengths fall into reciprocal-capacity classes: a piece of class k is at most
capacity/k long, and a sequence of that class takes k pieces. So a
task fills sequences of each class by counting, without seeing other tasks.

A document is cut into whole sequences, then halves, quarters and so on down to
a sixteenth, which fill their class's sequences exactly; only its tail of
fewer tokens is packed with slack. What a task cannot fill is handed on:
rounds of fewer and fewer tasks fill the rest, each of them a bounded number of
pieces, and the last one puts the few that remain of all classes together.

Defined results: a null or empty text is one token, the end mark 0; rows that
repeat a doc_id are packed each for itself; an empty table gives no piece.
Only ``doc_id`` and ``text`` are read. A text is held in one task, whole.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import bpe
from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
#: Down to this part of the capacity, pieces are cut to fit exactly.
PARTS = 16
#: Classes of tails, as pieces to a sequence.
TAILS = (16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024)
#: Tasks whose rest one task of the next round takes.
FAN_IN = 32

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{name} long" for name in FIELDS)


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces in order."""
    out = [capacity] * (tokens // capacity)
    rest, part = tokens % capacity, capacity // 2
    while part >= capacity // PARTS and rest:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] if rest else out


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """Pieces of such a length to a sequence."""
    exact = capacity // length
    if exact < PARTS:
        return exact
    return max((k for k in TAILS if length * k <= capacity), default=exact)


class Filler:
    """Fills sequences class by class; numbers are unique by round and task."""

    def __init__(self, number: int, capacity: int):
        self.capacity = capacity
        self.next = (number << 56) | (TaskContext.get().partitionId() << 32)
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def put(self, piece: tuple) -> None:
        k = class_of(piece[2], self.capacity)
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self.close(pieces)
            self.open[k] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece[:5], self.next, offset))
            offset += piece[2]
        self.next += 1

    def together(self) -> None:
        """The rest of all classes, longest first, each into the first sequence with room."""
        rest = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: (-p[2], p[0] or 0, p[1]))
        self.open = {}
        bins: list[tuple[list[tuple], int]] = []
        for piece in rest:
            for i, (pieces, free) in enumerate(bins):
                if piece[2] <= free:
                    pieces.append(piece)
                    bins[i] = (pieces, free - piece[2])
                    break
            else:
                bins.append(([piece], self.capacity - piece[2]))
        for pieces, _ in bins:
            self.close(pieces)

    def flush(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        columns = list(zip(*done)) if done else [[] for _ in FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FIELDS))

    def rest(self) -> pa.RecordBatch:
        self.done = [(*p[:5], None, None) for pieces in self.open.values() for p in pieces]
        return self.flush()


def tokenized(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[list[tuple]]:
    """Pieces of the documents, a list per slice."""
    for batch in batches:
        for part in tx.slices(batch):
            pieces = []
            for doc, text in zip(tx.column(part, "doc_id").to_pylist(), tx.column(part, "text").to_pylist()):
                ids = np.append(bpe.ids_of(text, vocabulary), np.uint32(0)).astype("<u4", copy=False)
                own, start = memoryview(ids.tobytes()), 0
                for length in cut(len(ids), capacity):
                    pieces.append((doc, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), len(ids)))
                    start += length
            yield pieces


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(0, capacity)
        for pieces in tokenized(batches, capacity, vocabulary):
            for piece in pieces:
                filler.put(piece)
            yield filler.flush()
        yield filler.rest()

    def again(number: int, last: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filler = Filler(number, capacity)
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    filler.put(row)
                yield filler.flush()
            if last:
                filler.together()
                yield filler.flush()
            else:
                yield filler.rest()

        return work

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "pieces")
        df.write.parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rounds = [written(narrow.mapInArrow(first, SCHEMA))]
    tasks = max(1, narrow.rdd.getNumPartitions())
    last = False
    while not last:
        tasks = -(-tasks // FAN_IN)
        last = tasks == 1
        rest = rounds[-1].filter("sequence_id IS NULL").coalesce(tasks)
        rounds.append(written(rest.mapInArrow(again(len(rounds), last), SCHEMA)))
    out = rounds[0]
    for other in rounds[1:]:
        out = out.unionByName(other)
    return out.filter("sequence_id IS NOT NULL")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

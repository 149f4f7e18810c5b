"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The most
frequent words fill HEAD classes of SLOTS words; all other words, seen or not,
belong to TAIL classes by their last bytes. Features of the history are hashed
n-grams and skips. A softmax over classes, and one over the words of a head
class, add the weights of the active features; in a tail class a word has its
smoothed share of the class.

Weights start from broadcast values; every task runs over its share of the training
texts and returns its summed updates in blocks, which are added up by block,
weighted by how often each feature was seen. Each training text serves in one round. Scoring
works on sparse batches of feature numbers in numpy.

Counts are of the whole training part. The KNOWN most frequent words, a bound, are
looked up in the task; rarer ones are joined. Words are told apart by a 64-bit
hash. Defined results: a null or empty text is its end mark; a row without doc_id is
learned from; rows that repeat are scored and counted each for itself; without training
texts classes are equally likely and every word is unseen. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD, SLOTS, TAIL = 32, 32, 32
CLASSES = HEAD + TAIL
#: Rows of the class weights per feature, and of the word weights.
ROWS, WORD_ROWS = 4096, 8192
FEATURES = 4
#: Words whose counts are sent to every task, at most: 12 bytes each.
KNOWN = 1 << 19
BATCH = 4096
#: Logits up to here are raised without their row's largest taken off; sums of a row from FAINT on are exact enough.
STEEP, FAINT = 60.0, 1e-20
#: Gradients of a row that are added one after the other for all rows at once; the rest row by row.
REPEATS = 16
ROUNDS = 2
RATE = 0.25
BLOCK_ROWS = 512
END = np.uint64(0x5EED0E0D)
BEFORE = np.uint64(0x5EED0B05)
FOLDS, HELD_OUT = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, tail classes and rows of all tokens, end marks included; tokens per row."""
    data, offsets = tx.buffers(texts)
    data = tx.LOWER[data]
    starts, ends, rows = tx.segments(~tx.SPACE[data], offsets)
    n = len(offsets) - 1
    n_words = np.bincount(rows, minlength=n)
    out = np.full(len(starts) + n, END, dtype=np.uint64)
    tail = np.zeros(len(out), dtype=np.int64)
    at = np.arange(len(starts)) + rows
    out[at] = tx.hashes(data, starts, ends)
    suffix = tx.hashes(data, np.maximum(starts, ends - 2), ends, seed=9)
    tail[at] = (suffix % np.uint64(TAIL)).astype(np.int64)
    row = np.repeat(np.arange(n), n_words + 1)
    return out, tail, row, n_words + 1


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, tail, c): counts of all tokens, added up in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> list:
            h, t, c = (np.concatenate(x) for x in zip(*held))
            u, first, which = np.unique(h, return_index=True, return_inverse=True)
            return [(u, t[first], np.bincount(which, weights=c).astype(np.int64))]

        for batch in batches:
            for part in tx.slices(batch):
                h, t, _, _ = tokens(tx.column(part, "text"))
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, t[first], c))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    held = merged()
                    if len(held[0][0]) > 500_000:
                        yield rows_of(held[0])
                        held = []
        if held:
            yield rows_of(merged()[0])

    def rows_of(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["h", "tail", "c"])

    return docs.select("text").mapInArrow(work, "h long, tail long, c long").groupBy("h").agg(F.any_value("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows of the counts; all of it bounded."""

    total: int
    types: int
    known: np.ndarray  # sorted hashes
    known_log: np.ndarray  # log10(c + 1)
    known_class: np.ndarray
    known_slot: np.ndarray
    class_log: np.ndarray  # prior of classes
    slot_log: np.ndarray  # [HEAD, SLOTS] prior of words
    tail_size: np.ndarray  # tokens + types + 1 of each tail class


def vocabulary(counts: DataFrame, bound: int = KNOWN) -> Vocabulary:
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The smallest count at which no more than ``bound`` words are as frequent.
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("types"))
    upto = F.sum("types").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    least = by_count.withColumn("_upto", upto).filter(F.col("_upto") <= bound).agg(F.min("c")).first()[0]
    rows = counts.filter(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    c, tail = rows["c"].to_numpy(), rows["tail"].to_numpy()
    order = np.lexsort((h, -c))
    klass, slot = HEAD + tail, np.zeros(len(h), dtype=np.int64)
    top = order[: HEAD * SLOTS]
    klass = klass.copy()
    klass[top], slot[top] = np.arange(len(top)) // SLOTS, np.arange(len(top)) % SLOTS
    slot_log = np.full((HEAD, SLOTS), -1e9, dtype=np.float32)
    slot_log[klass[top], slot[top]] = np.log(c[top])
    head_tokens = np.bincount(klass[top], weights=c[top], minlength=CLASSES)
    in_tail = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_tail, v_tail = np.zeros(TAIL), np.zeros(TAIL)
    for r in in_tail:
        n_tail[r["tail"]], v_tail[r["tail"]] = r["n"], r["v"]
    n_tail -= np.bincount(tail[top], weights=c[top], minlength=TAIL)
    v_tail -= np.bincount(tail[top], minlength=TAIL)
    mass = head_tokens.copy()
    mass[HEAD:] = n_tail
    by_hash = np.argsort(h)
    return Vocabulary(
        int(totals["n"]), int(totals["v"]), h[by_hash], np.log10(c[by_hash] + 1.0), klass[by_hash], slot[by_hash],
        np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)).astype(np.float32), slot_log, n_tail + v_tail + 1,
    )


@dataclass
class Weights:
    classes: np.ndarray
    words: np.ndarray


def blank() -> Weights:
    return Weights(np.zeros((FEATURES * ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, SLOTS), np.float32))


class Known:
    """The known words of a vocabulary, found by the first bits of their hashes."""

    def __init__(self, v: Vocabulary):
        self.sorted = np.append(v.known, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, len(v.known).bit_length())
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((v.known >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        # A class and a slot of the word after the last one, which none is at.
        self.klass = np.append(v.known_class, 0).astype(np.int16)
        self.slot = np.append(v.known_slot, 0).astype(np.int16)

    def look_up(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the known words (-1 if rarer), class and slot of each token."""
        at = self.begin.take((h >> self.shift).astype(np.int32)).astype(np.int64)
        found = self.sorted.take(at)
        below = np.flatnonzero(found < h)
        while len(below):
            at[below] += 1
            found[below] = self.sorted.take(at[below])
            below = below[found[below] < h[below]]
        hit = (found == h) & (at < len(self.sorted) - 1)
        return np.where(hit, at, -1), np.where(hit, self.klass.take(at), HEAD + tail), np.where(hit, self.slot.take(at), 0).astype(np.int64)


def look_up(v: Vocabulary, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Known.look_up`` for a few tokens."""
    return Known(v).look_up(h, tail)


def features(h: np.ndarray, klass: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class weights [tokens, FEATURES] and of the word weights [tokens, 2]; those of a feature lie together."""

    def back(values: np.ndarray, steps: int, fill) -> np.ndarray:
        out = np.full(len(values), fill, dtype=values.dtype)
        if len(values) > steps:
            same = row[steps:] == row[:-steps]
            out[steps:][same] = values[:-steps][same]
        return out

    one, two = back(h, 1, BEFORE), back(h, 2, BEFORE)
    near = [back(klass, k, CLASSES) for k in (1, 2, 3)]
    shape = ((near[0] * 97 + near[1]) * 97 + near[2]).astype(np.uint64)
    seen = [tx.mix(one), tx.mix(one * tx.M1 + two), tx.mix(two + tx.M2), tx.mix(shape * tx.M1)]
    # Both sizes are powers of two.
    rows = np.stack([(s & np.uint64(ROWS - 1)).astype(np.int64) + k * ROWS for k, s in enumerate(seen)]).T
    mine = klass.astype(np.uint64) * tx.M2
    words = np.stack([(tx.mix(s + mine) & np.uint64(WORD_ROWS - 1)).astype(np.int64) for s in (seen[0], seen[3])]).T
    return rows, words


def raised(z: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums over rows of the exponentials of ``z``, which go to ``out``; ``z`` loses the largest of each row if that is needed."""
    if z.max() < STEEP:
        total = np.einsum("ij->i", np.exp(z, out=out))
        if total.min() > FAINT:
            return total
    z -= z.max(axis=1, keepdims=True)
    return np.einsum("ij->i", np.exp(z, out=out))


def softmax(z: np.ndarray) -> np.ndarray:
    out = np.empty_like(z)
    total = raised(z, out)
    out /= total[:, None]
    return out


class Softmax:
    """Softmax over the summed weights of each token's features, in arrays that are used again."""

    def __init__(self, width: int):
        self.z, self.work = np.empty((2, BATCH, width), np.float32)

    def of(self, table: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials, and the sums of these, by token; kept until the next call."""
        z, e = self.z[: len(rows)], self.work[: len(rows)]
        table.take(rows[:, 0], axis=0, out=z, mode="clip")
        for r in rows.T[1:]:
            z += table.take(r, axis=0, out=e, mode="clip")
        z += prior
        return z, e, raised(z, e)

    def errors(self, table: np.ndarray, rows: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Probabilities, less 1 at the right place."""
        _, p, total = self.of(table, rows, prior)
        p *= (1 / total)[:, None]
        p[np.arange(len(right)), right] -= 1
        return p

    def logs(self, table: np.ndarray, rows: np.ndarray, prior: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log10 of the right place's probability, from 1e-30 up."""
        z, _, total = self.of(table, rows, prior)
        log = (z[np.arange(len(right)), right].astype(np.float64) - np.log(total.astype(np.float64))) / np.log(10)
        return np.maximum(log, -30.0)


def added_up(values: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values[order]`` from ``first``, whose sizes fall."""
    out = values.take(order.take(first), axis=0)
    for k in range(1, REPEATS):
        n = len(size) - np.searchsorted(size[::-1], k, side="right")
        if not n:
            return out
        out[:n] += values.take(order.take(first[:n] + k), axis=0)
    for i in range(len(size) - np.searchsorted(size[::-1], REPEATS, side="right")):
        out[i] += values.take(order[first[i] + REPEATS : first[i] + size[i]], axis=0).sum(axis=0)
    return out


class Trainer:
    """Adagrad by row over the batches of a task; counts how often it saw each row."""

    def __init__(self, v: Vocabulary, w: Weights):
        self.v, self.known = v, Known(v)
        self.class_softmax, self.word_softmax = Softmax(CLASSES), Softmax(SLOTS)
        self.start = w
        self.w = Weights(w.classes.copy(), w.words.copy())
        self.power = [np.full(len(x), 1.0, np.float32) for x in (w.classes, w.words)]
        self.seen = [np.zeros(len(x), np.float32) for x in (w.classes, w.words)]

    def update(self, which: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        table = (self.w.classes, self.w.words)[which]
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        ordered = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(first, len(rows)))
        falling = np.argsort(-size, kind="stable")
        first, size = first[falling], size[falling]
        total, at = added_up(gradient, order, first, size), ordered.take(first)
        power = self.power[which][at] + np.einsum("ij,ij->i", total, total) / table.shape[1]
        self.power[which][at] = power
        total *= (RATE / np.sqrt(power))[:, None]
        table[at] -= total
        self.seen[which][at] += size

    def learn(self, rows: np.ndarray, words: np.ndarray, klass: np.ndarray, slot: np.ndarray) -> None:
        for a in range(0, len(klass), BATCH):
            r, k = rows[a : a + BATCH], klass[a : a + BATCH]
            p = self.class_softmax.errors(self.w.classes, r, self.v.class_log, k)
            for f in range(FEATURES):
                self.update(0, r[:, f], p)
            inner = np.flatnonzero(k < HEAD)
            if len(inner):
                x, s = words[a : a + BATCH].T.take(inner, axis=1).T, slot[a : a + BATCH][inner]
                p = self.word_softmax.errors(self.w.words, x, self.v.slot_log.take(k[inner], axis=0), s)
                for f in (0, 1):
                    self.update(1, x[:, f], p)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Per block of rows: times seen, and updates times times seen."""
        for which, (now, was) in enumerate(((self.w.classes, self.start.classes), (self.w.words, self.start.words))):
            for a in range(0, len(now), BLOCK_ROWS):
                n = self.seen[which][a : a + BLOCK_ROWS]
                if n.any():
                    delta = (now[a : a + BLOCK_ROWS] - was[a : a + BLOCK_ROWS]) * n[:, None]
                    yield which << 20 | a, np.column_stack([n, delta]).astype("<f4").tobytes()


def train_round(docs: DataFrame, v: Vocabulary, w: Weights) -> Weights:
    """One pass over ``docs`` in all tasks, their updates added up by block."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vars(v), vars(w)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Vocabulary(**sent.value[0]), Weights(**sent.value[1]))
        for batch in batches:
            for part in tx.slices(batch):
                h, tail, row, _ = tokens(tx.column(part, "text"))
                _, klass, slot = trainer.known.look_up(h, tail)
                trainer.learn(*features(h, klass, row), klass, slot)
        for block, values in trainer.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([values], pa.binary())], ["block", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the task's blocks; as many as the model has, whatever comes in."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(values.as_buffer(), "<f4").astype(np.float64)
                sums[block] = sums[block] + new if block in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], ["block", "values"])

    schema = "block long, values binary"
    updates = docs.select("text").mapInArrow(work, schema).repartition("block").mapInArrow(add, schema)
    out = Weights(w.classes.copy(), w.words.copy())
    for row in updates.collect():
        which, a = row["block"] >> 20, row["block"] & 0xFFFFF
        table = (out.classes, out.words)[which]
        values = np.frombuffer(row["values"], "<f4").reshape(-1, 1 + table.shape[1])
        table[a : a + len(values)] += values[:, 1:] / np.maximum(values[:, :1], 1)
    sent.unpersist()
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: Weights
    counts: DataFrame


def fit(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> Model:
    """Counts and weights from the texts that are not held out."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"))
    path = scratch_path(spark, "token-counts")
    count_tokens(training).write.parquet(path)
    counts = spark.read.parquet(path)
    v, w = vocabulary(counts, known), blank()
    for number in range(rounds):
        share = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(rounds)), F.lit(0)) == number
        w = train_round(training.filter(share), v, w)
    return Model(v, w, counts)


class Scorer:
    """Probabilities of tokens under a fitted model."""

    def __init__(self, v: Vocabulary, w: Weights):
        self.v, self.w, self.known = v, w, Known(v)
        self.class_softmax, self.word_softmax = Softmax(CLASSES), Softmax(SLOTS)

    def log_probabilities(self, h: np.ndarray, tail: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each token but for the log10(c + 1) of words not known; place in the known words."""
        v, w = self.v, self.w
        at, klass, slot = self.known.look_up(h, tail)
        rows, words = features(h, klass, row)
        out = np.empty(len(h))
        for a in range(0, len(h), BATCH):
            r, k = rows[a : a + BATCH], klass[a : a + BATCH]
            got = self.class_softmax.logs(w.classes, r, v.class_log, k)
            inner = np.flatnonzero(k < HEAD)
            if len(inner):
                x = words[a : a + BATCH].T.take(inner, axis=1).T
                got[inner] += self.word_softmax.logs(w.words, x, v.slot_log.take(k[inner], axis=0), slot[a : a + BATCH][inner])
            outer = np.flatnonzero(k >= HEAD)
            place = at[a : a + BATCH][outer]
            own = np.where(place >= 0, v.known_log[place] if len(v.known) else 0.0, 0.0)
            got[outer] += own - np.log10(v.tail_size[k[outer] - HEAD])
            out[a : a + BATCH] = got
        return out, at


def log_probabilities(v: Vocabulary, w: Weights, h: np.ndarray, tail: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Scorer.log_probabilities`` for a few tokens."""
    return Scorer(v, w).log_probabilities(h, tail, row)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    v = model.vocabulary
    sent = spark.sparkContext.broadcast((vars(v), vars(model.weights)))
    level = float(np.log10(v.total + v.types + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Vocabulary(**sent.value[0]), Weights(**sent.value[1]))
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in tx.slices(batch):
                h, tail, row, n = tokens(tx.column(part, "text"))
                logs, at = scorer.log_probabilities(h, tail, row)
                rare = at < 0
                own = np.where(rare, 0.0, v.known_log[at] if len(v.known) else 0.0)
                sums = lambda x: np.bincount(row, weights=x, minlength=len(n))
                order = np.lexsort((h[rare], row[rare]))
                rh, rr = h[rare][order], row[rare][order]
                new = np.ones(len(rh), dtype=bool)
                new[1:] = (rh[1:] != rh[:-1]) | (rr[1:] != rr[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rh)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rr[first], minlength=len(n)))]).astype(np.int32)
                rare_list = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(rh[first].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(n))), tx.column(part, "doc_id"), tx.column(part, "held_out"), pa.array(n.astype(np.int64)), pa.array(sums(~rare).astype(np.int64)), pa.array(sums(own)), pa.array(sums(logs)), rare_list],
                    ["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"],
                )
                key += len(n)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<struct<h:long,times:int>>"
    path = scratch_path(spark, "scored")
    given.mapInArrow(work, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.times").alias("times"))
    logs = F.col("times") * F.log10(F.col("c") + 1)
    found = rare.join(model.counts.select("h", "c"), "h").groupBy("key").agg(F.sum("times").alias("_n"), F.sum(logs).alias("_s"))
    more = F.coalesce("_s", F.lit(0.0))
    return rows.drop("rare").join(found, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_n", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * level).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs))

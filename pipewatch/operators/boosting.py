"""Gradient-boosted trees for two classes (Friedman 2001, log loss) grown level by level on all rows, by histograms.

Features are cut into at most 32 bins once, and the binned rows are kept by Spark in chunks, beside each row's margin and
pseudo-residual. A level is one job: tasks count (node, feature, bin) over their chunks, the counts are added up, and the driver
takes the split that lessens the residuals' variance most among each node's own draw of features. A round's first job
also moves the margins on by the tree before. Rows are drawn for a round by a hash of the row, and residuals are added up as whole
multiples of 1 / ``UNIT``, so the same rows give the same trees, however they are partitioned.
Rows that agree in every column share their draws.

A task holds one chunk at a time; the driver holds the trees and one level's counts of each partition, and there are at
most as many partitions as cores.
"""

from __future__ import annotations

import gc
import math
import operator
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.operators.forest import BINS, binned, clean, feature_cuts, mixed, node_features, salt
from pipewatch.sources.scratch import scratch_path

# Executors get the few functions below with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a chunk, few enough to stay in the processor's cache.
CHUNK = 1 << 16
#: Least rows a task is started for.
LEAST = 1 << 14
#: Residuals, at most 4, are added up in steps of 1 / UNIT: 2 ** 31 rows in whole numbers of a double.
UNIT = 1 << 20
#: The residual of a row that is not drawn.
LEFT_OUT = -(1 << 31)
#: Rounds after which margins are worked out anew from all trees, so that no row depends on more steps than these.
RESTART = 25
#: Levels a tree may have; the counts of a level travel as one.
DEEPEST = 10


@dataclass
class BoostedTrees:
    """Grown trees.

    ``splits[t, node]`` is feature * 256 + bin: rows of a larger bin go to node 2 * node + 1, others to 2 * node,
    from node 1 on. A leaf sends all rows left, down to the last level, where ``steps`` has what the tree adds to the margin.
    """

    splits: np.ndarray
    steps: np.ndarray
    cuts: list[np.ndarray]
    features: list[str]


def settle() -> None:
    """Once in a worker: it looks for garbage after every task, which over all loaded modules takes longer than most tasks here."""
    if gc.get_freeze_count() == 0:
        gc.freeze()


def walk(splits: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after ``levels`` levels; ``bins`` is (feature, row)."""
    flat, n = bins.ravel(), bins.shape[1]
    row = np.arange(n, dtype=np.int32)
    node = np.ones(n, dtype=np.int32)
    for _ in range(levels):
        split = splits.take(node)
        node = 2 * node + (flat.take(row + (split >> 8) * n) > (split & 255))
    return node


def margin_steps(splits: np.ndarray, steps: np.ndarray, bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The margins after all these trees, one after the other."""
    width = steps.shape[1]
    for one, step in zip(splits, steps):
        margin = margin + step.take(walk(one, bins, width.bit_length() - 1) - width)
    return margin


def residuals(label: np.ndarray, hashes: np.ndarray, margin: np.ndarray, first: bool, sample: float, key: np.uint64) -> np.ndarray:
    """What a round's tree is fitted to, in steps of 1 / UNIT: classes as -1 and 1, then the log loss's falling gradient."""
    sign = 2.0 * label - 1.0
    target = sign if first else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
    out = np.rint(target * UNIT).astype(np.int32)
    if sample < 1:
        out[(mixed(hashes ^ key) >> np.uint64(32)) >= np.uint64(sample * (1 << 32))] = LEFT_OUT
    return out


def level_counts(bins: np.ndarray, residual: np.ndarray, splits: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """(rows or residuals, open node, feature, bin) over a chunk; two features are counted at a time."""
    width, n = bins.shape
    place = np.full(2 << level, len(nodes), dtype=np.int64)
    place[nodes] = np.arange(len(nodes))
    slot = place.take(walk(splits, bins, level))
    # Rows not drawn and rows of closed nodes share one place after the open ones.
    slot[residual == LEFT_OUT] = len(nodes)
    slot *= BINS * BINS
    weight = residual.astype(np.float64)
    size = (len(nodes) + 1) * BINS * BINS
    out = np.empty((2, len(nodes), width, BINS))
    cell = np.empty(n, dtype=np.int64)
    for j in range(0, width, 2):
        pair = bins[j] * np.uint16(BINS)
        if j + 1 < width:
            pair += bins[j + 1]
        np.add(slot, pair, out=cell)
        for k, counted in enumerate((np.bincount(cell, minlength=size), np.bincount(cell, weights=weight, minlength=size))):
            both = counted.reshape(-1, BINS, BINS)[: len(nodes)]
            out[k, :, j] = both.sum(axis=2)
            if j + 1 < width:
                out[k, :, j + 1] = both.sum(axis=1)
    return out


def best_splits(counts: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, (rows, residuals) left, the same right) of each node."""
    line = np.arange(len(drawn))
    below = counts[:, line[:, None], drawn].cumsum(axis=3)
    whole = below[..., -1:]
    left, right = below[..., :-1], whole - below[..., :-1]

    def fitted(part: np.ndarray) -> np.ndarray:
        """What the part's mean takes off its sum of squares."""
        return part[1] ** 2 / np.maximum(part[0], 1.0)

    gain = fitted(left) + fitted(right) - fitted(whole)
    gain[(left[0] == 0) | (right[0] == 0)] = -1.0
    gain = gain.reshape(len(drawn), -1)
    best = gain.argmax(axis=1)
    j, cut = best // (BINS - 1), best % (BINS - 1)
    # A residual is at most 4: less than this is rounding.
    least = 1e-12 * np.maximum(whole[0, :, 0, 0], 1.0) * UNIT * UNIT
    feature = np.where(gain[line, best] > least, drawn[line, j], -1)
    return feature, cut, left[:, line, j, cut].T, right[:, line, j, cut].T


def packed(rows: DataFrame, cuts: list[np.ndarray], parts: int) -> RDD:
    """The rows of (_label, _hash, features), binned: chunks of (bins by feature, label, hash)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            bins, label, hashes = (np.concatenate([h[i] for h in held], axis=-1).tobytes() for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (bins, label, hashes)], ["bins", "label", "hashes"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = binned(np.column_stack(columns[2:]), cuts)
            held.append((np.ascontiguousarray(bins.T), columns[0].astype(np.uint8), columns[1].astype(np.int64).view(np.uint64)))
            size += len(bins)
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
        if size:
            yield chunk()

    def arrays(r) -> tuple[np.ndarray, ...]:
        label = np.frombuffer(r["label"], dtype=np.uint8)
        return np.frombuffer(r["bins"], dtype=np.uint8).reshape(-1, len(label)), label, np.frombuffer(r["hashes"], dtype=np.uint64)

    chunks = rows.repartition(parts).mapInArrow(pack, "bins binary, label binary, hashes binary")
    return chunks.rdd.map(arrays)


class GBTClassifier:
    """Boosted trees with the settings of MLlib's estimator of that name that are used here, and their meaning there."""

    def __init__(self, featuresCol: list[str], labelCol: str, maxIter: int, maxDepth: int, stepSize: float,
                 subsamplingRate: float, featureSubsetStrategy: str, seed: int):
        if not 1 <= maxDepth <= DEEPEST:
            raise ValueError(f"1 to {DEEPEST} levels, not {maxDepth}")
        self.features, self.label, self.rounds, self.depth = list(featuresCol), labelCol, maxIter, maxDepth
        self.rate, self.sample, self.share, self.seed = stepSize, subsamplingRate, float(featureSubsetStrategy), seed

    def fit(self, train: DataFrame) -> BoostedTrees:
        """All rounds on all rows of ``train``, whose label is 0 or 1."""
        spark, label = train.sparkSession, F.col(self.label)
        known = F.when(label.isin(0, 1), label.cast("int")).otherwise(F.raise_error(F.lit(f"{self.label} is not 0 or 1")))
        path = scratch_path(spark, "rows")
        train.select(
            known.cast("int").alias("_label"), F.xxhash64(*train.columns).alias("_hash"),
            *[clean(f).alias(f) for f in self.features],
        ).write.parquet(path)
        rows = spark.read.parquet(path)
        n = rows.count()
        if n == 0:
            raise ValueError("no rows to train on")
        cuts = feature_cuts(rows, self.features)
        parts = min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST))
        chunks = packed(rows, cuts, parts).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        # A leaf sends its rows left: no bin is above 255.
        splits = np.full((self.rounds, 1 << self.depth), 255, dtype=np.int32)
        steps = np.zeros((self.rounds, 1 << self.depth))
        state = None
        for tree in range(self.rounds):
            before, state = state, self.moved(chunks, state, splits, steps, tree)
            self.grow(state, splits[tree], steps[tree], tree, before)
        state.unpersist()
        chunks.unpersist()
        return BoostedTrees(splits, steps, cuts, self.features)

    def moved(self, chunks: RDD, state: RDD | None, splits: np.ndarray, steps: np.ndarray, tree: int) -> RDD:
        """Chunks of (bins, label, hash, margin, residual) for the round of ``tree``."""
        anew = tree % RESTART == 0
        since = slice(0 if anew else tree - 1, tree)
        splits, steps, sample, key = splits[since].copy(), steps[since].copy(), self.sample, salt(self.seed, tree)

        def move(chunk: tuple) -> tuple:
            settle()
            bins, label, hashes = chunk[:3]
            margin = margin_steps(splits, steps, bins, np.zeros(len(label)) if anew else chunk[3])
            return bins, label, hashes, margin, residuals(label, hashes, margin, tree == 0, sample, key)

        return (chunks if anew else state).map(move).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def grow(self, state: RDD, splits: np.ndarray, steps: np.ndarray, tree: int, before: RDD | None) -> None:
        """One tree, into ``splits`` and ``steps``; ``before`` is given up once ``state`` is there."""
        width, rate = len(self.features), 1.0 if tree == 0 else self.rate
        value, opened = np.zeros(2 << self.depth), np.ones(1, dtype=np.int64)
        for level in range(self.depth):
            counts = level_job(state, splits.copy(), opened, level)
            if before is not None:
                before.unpersist()
                before = None
            drawn = node_features(self.seed, tree, opened, width, max(1, math.ceil(self.share * width)))
            follow = []
            for node, feature, cut, lower, upper in zip(opened.tolist(), *best_splits(counts, drawn)):
                if level == 0:
                    value[1] = rate * mean(counts[:, 0, 0].sum(axis=1))
                if feature < 0:
                    continue
                splits[node] = feature * 256 + cut
                for child, part in ((2 * node, lower), (2 * node + 1, upper)):
                    value[child] = rate * mean(part)
                    follow.append(child)
            opened = np.array(follow, dtype=np.int64)
            if not follow:
                break
        # The value of a leaf above the last level goes down with its rows.
        for level in range(self.depth):
            above = np.arange(1 << level, 2 << level)
            value[2 * above] = np.where(splits[above] == 255, value[above], value[2 * above])
        steps[:] = value[1 << self.depth :]


def mean(part: np.ndarray) -> float:
    """Of the residuals of (rows, residuals)."""
    return part[1] / max(part[0], 1.0) / UNIT


def level_job(state: RDD, splits: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """The counts of a level over all rows."""

    def count(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        settle()
        total = None
        for bins, _, _, _, residual in part:
            found = level_counts(bins, residual, splits, nodes, level)
            total = found if total is None else total + found
        if total is not None:
            yield total

    return state.mapPartitions(count).reduce(operator.add)


def boosted_scores(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """df plus ``score``, the probability of class 1."""
    # trees * 2 ** depth numbers, less than 1 MB at the defaults.
    shared = df.sparkSession.sparkContext.broadcast((model.splits, model.steps, model.cuts))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        splits, steps, cuts = shared.value
        for batch in batches:
            bins = np.ascontiguousarray(binned(batch.to_numpy(dtype=float), cuts).T)
            margin = margin_steps(splits, steps, bins, np.zeros(len(batch)))
            yield pd.Series(1.0 / (1.0 + np.exp(-2.0 * margin)))

    return df.withColumn("score", score(F.struct(*[clean(f).alias(f) for f in model.features])))

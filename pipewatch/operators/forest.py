"""Random forest (Breiman 2001) grown level by level on all rows, by histograms.

Features are cut into at most 32 bins, and the binned rows are written once in chunks. A level is one job: tasks count
(node, feature, bin, class) over their chunks for each tree, the counts are added up, and the best split by weighted Gini impurity
is taken of each node's own draw of features. Rows meet each tree as often as a Poisson draw from a hash of the
row says, so nothing is stored per row and tree, and counts are whole numbers: the same rows give the same
forest, however they are partitioned. Rows that agree in every column share their draws.

A task holds the chunks of one file split, a fold of the counts one block of nodes; the driver holds the forest, ``trees * 2 ** depth`` nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.sources.scratch import scratch_path

# Executors get the few functions below with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature.
BINS = 32
#: Rows of a chunk.
CHUNK = 1 << 18
#: Rows a tree is walked over at a time, few enough to stay in the processor's cache.
SLICE = 1 << 16
#: Nodes whose counts travel together.
BLOCK = 64
#: Quantiles of a feature that its cuts are chosen from.
QUANTILES = 1024
#: Levels a forest may have; a level's nodes are numbered in full.
DEEPEST = 14


@dataclass
class RandomForest:
    """A grown forest.

    ``splits[t, node]`` is feature * 256 + bin: rows of a larger bin go to node 2 * node + 1, others to 2 * node,
    from node 1 on. A leaf sends all rows left, down to the last level, where ``scores`` has the share of class 1.
    """

    splits: np.ndarray
    scores: np.ndarray
    cuts: list[np.ndarray]
    features: list[str]


def clean(feature: str) -> Column:
    value = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    return F.when(F.isnan(value), F.raise_error(F.lit(f"NaN in {feature}"))).otherwise(value)


def choose_cuts(values: np.ndarray) -> np.ndarray:
    """Ascending cuts between the quantiles of a feature: all, if few; else of about equal shares."""
    levels, weight = np.unique(values, return_counts=True)
    middles = levels[:-1] + (levels[1:] - levels[:-1]) / 2
    if len(middles) < BINS:
        return middles
    share = np.cumsum(weight)[:-1] / weight.sum()
    take = np.searchsorted(share, np.arange(1, BINS) / BINS).clip(max=len(middles) - 1)
    return middles[np.unique(take)]


def feature_cuts(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    steps = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    found = rows.agg(*[F.percentile_approx(f, steps, QUANTILES * 10).alias(f) for f in features]).first()
    return [choose_cuts(np.array(found[f] or [0.0])) for f in features]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value, one byte; a value at a cut lies below it."""
    out = np.empty(values.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, values[:, j], side="left")
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(*parts: int) -> np.uint64:
    out = np.zeros(1, dtype=np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p + 1))
    return out[0]


def poisson_table() -> np.ndarray:
    """Repeats for each 16-bit draw, at a mean of one."""
    below = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(below, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def repeats(rows: np.ndarray, seed: int, tree: int, table: np.ndarray) -> np.ndarray:
    """How often each row, given by its hash, is drawn for a tree."""
    return table.take((mixed(rows ^ salt(seed, tree)) >> np.uint64(48)).astype(np.int32))


def node_features(seed: int, tree: int, nodes: np.ndarray, n_features: int, n_taken: int) -> np.ndarray:
    """Each node's draw of features."""
    key = nodes.astype(np.uint64)[:, None] * np.uint64(n_features) + np.arange(n_features, dtype=np.uint64)
    return np.argsort(mixed(key ^ salt(seed, tree, 7)), axis=1, kind="stable")[:, :n_taken]


def walk(splits: np.ndarray, bins: np.ndarray, width: int, at: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row, whose first bin lies at ``at`` of ``bins``, after ``levels`` levels."""
    node = np.ones(len(at), dtype=np.int32)
    for _ in range(levels):
        split = splits.take(node)
        node = 2 * node + (bins.take(at + (split >> 8)) > (split & 255))
    return node


def level_counts(rows: list[tuple], splits: np.ndarray, nodes: np.ndarray, drawn: np.ndarray, level: int, width: int,
                 classes: int, sample: tuple[int, int] | None) -> np.ndarray:
    """(node, drawn feature, bin, class) counts of a tree's open nodes over chunks of rows."""
    taken, table = drawn.shape[1], poisson_table()
    place = np.full(1 << (level + 1), -1, dtype=np.int32)
    place[nodes] = np.arange(len(nodes))
    total = np.zeros((taken, len(nodes) * BINS * classes))
    columns = np.ascontiguousarray(drawn.T.astype(np.int32))
    for bins, label, hashes in rows:
        for start in range(0, len(label), SLICE):
            part = slice(start, start + SLICE)
            times = repeats(hashes[part], *sample, table) if sample else np.ones(len(label[part]), dtype=np.uint8)
            row = np.flatnonzero(times)
            at = ((row + start) * width).astype(np.int32)
            slot = place.take(walk(splits, bins, width, at, level))
            here = np.flatnonzero(slot >= 0)
            if len(here) == 0:
                continue
            row, at, slot = row[here], at[here], slot[here]
            y, weight = label[part][row].astype(np.int64), times[row].astype(np.float64)
            for j in range(taken):
                value = bins.take(at + columns[j].take(slot))
                total[j] += np.bincount((slot * np.int64(BINS) + value) * classes + y, weights=weight, minlength=total.shape[1])
    return total.reshape(taken, len(nodes), BINS, classes).transpose(1, 0, 2, 3)


def best_splits(counts: np.ndarray, drawn: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, counts left, counts right) of each node; ``counts`` is (node, drawn feature, bin, class)."""
    below = counts.cumsum(axis=2)
    whole = below[:, :1, -1:, :]
    left, right = below[:, :, :-1, :], whole - below[:, :, :-1, :]

    def spread(c: np.ndarray) -> np.ndarray:
        """Weight times Gini impurity."""
        w = c * weights
        n = w.sum(axis=-1)
        return n - (w * w).sum(axis=-1) / np.where(n > 0, n, 1.0)

    gain = spread(whole) - spread(left) - spread(right)
    gain[(left.sum(axis=-1) == 0) | (right.sum(axis=-1) == 0)] = -1.0
    gain = gain.reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    line = np.arange(len(counts))
    j, cut = best // (BINS - 1), best % (BINS - 1)
    size = np.maximum((whole[:, 0, 0, :] * weights).sum(axis=-1), 1e-300)
    feature = np.where(gain[line, best] > 1e-12 * size, drawn[line, j], -1)
    return feature, cut, left[line, j, cut], right[line, j, cut]


CHUNK_SCHEMA = "band int, bins binary, label binary, hashes binary"
PART_SCHEMA = "tree int, block int, counts binary"
SPLIT_SCHEMA = "tree int, node int, feature int, bin int, lower array<double>, upper array<double>"


def written_chunks(rows: DataFrame, cuts: list[np.ndarray], n: int, bands: int) -> DataFrame:
    """The rows of (_label, _hash, features), binned, a chunk of them a row, once for each band of trees."""
    width = len(cuts)
    n_chunks = max(1, math.ceil(n / CHUNK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            whole = [np.concatenate([h[i] for h in held]).tobytes() for i in range(3)]
            columns = [pa.array(range(bands), pa.int32()), *[pa.array([w] * bands, pa.binary()) for w in whole]]
            return pa.RecordBatch.from_arrays(columns, ["band", "bins", "label", "hashes"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            values = np.column_stack(columns[2:]) if width else np.zeros((len(columns[0]), 0))
            held.append((binned(values, cuts), columns[0].astype(np.uint8), columns[1].astype(np.int64)))
            size += len(columns[0])
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
        if size:
            yield chunk()

    path = scratch_path(rows.sparkSession, "binned")
    packed = rows.repartition(n_chunks).mapInArrow(pack, CHUNK_SCHEMA)
    packed.repartition(n_chunks * bands).write.parquet(path)
    return rows.sparkSession.read.schema(CHUNK_SCHEMA).parquet(path)


def grow_level(chunks: DataFrame, splits: np.ndarray, opened: list[np.ndarray], level: int, width: int, taken: int,
               weights: np.ndarray, seed: int, bands: int) -> list:
    """The best split of each open node, as rows of ``SPLIT_SCHEMA``."""
    context = chunks.sparkSession.sparkContext
    shared = context.broadcast((splits, opened))
    n_trees, classes = len(opened), len(weights)

    def drawn_for(tree: int, nodes: np.ndarray) -> np.ndarray:
        return node_features(seed, tree, nodes, width, taken)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, opened = shared.value
        kinds = {"bins": np.uint8, "label": np.uint8, "hashes": np.uint64}
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for i, band in enumerate(batch.column("band").to_pylist()):
                rows = tuple(np.frombuffer(batch.column(k)[i].as_buffer(), dtype=t) for k, t in kinds.items())
                held.setdefault(band, []).append(rows)
        for band, rows in held.items():
            for tree in range(band, n_trees, bands):
                nodes = opened[tree]
                if len(nodes) == 0:
                    continue
                drawn = drawn_for(tree, nodes)
                sample = (seed, tree) if n_trees > 1 else None
                found = level_counts(rows, splits[tree], nodes, drawn, level, width, classes, sample)
                found = found.astype(np.uint32).reshape(len(nodes), -1)
                cells = [found[i : i + BLOCK].tobytes() for i in range(0, len(nodes), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.binary())],
                    ["tree", "block", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.value[1]
        key, total = None, None

        def finished() -> pa.RecordBatch:
            tree, block = key
            nodes = opened[tree][block * BLOCK : (block + 1) * BLOCK]
            drawn = drawn_for(tree, nodes)
            feature, cut, lower, upper = best_splits(total.reshape(len(nodes), taken, BINS, classes), drawn, weights)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes.astype(np.int32)), pa.array(feature.astype(np.int32)),
                    pa.array(cut.astype(np.int32)), pa.array(lower.tolist(), pa.list_(pa.float64())), pa.array(upper.tolist(), pa.list_(pa.float64())),
                ],
                ["tree", "node", "feature", "bin", "lower", "upper"],
            )

        for batch in batches:
            trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
            for i, now in enumerate(zip(trees, blocks)):
                counts = np.frombuffer(batch.column("counts")[i].as_buffer(), dtype=np.uint32)
                if now != key:
                    if key is not None:
                        yield finished()
                    key, total = now, np.zeros(len(counts))
                total += counts
        if key is not None:
            yield finished()

    dealt = chunks.mapInArrow(count, PART_SCHEMA).repartition("tree", "block").sortWithinPartitions("tree", "block")
    found = dealt.mapInArrow(add, SPLIT_SCHEMA).collect()
    shared.unpersist()
    return found


def fit_forest(train: DataFrame, features: list[str], label: str, weights: dict[int, float], n_trees: int, depth: int,
               seed: int) -> RandomForest:
    """Grow a forest on the rows of the classes in ``weights``, 0 and up, each with the weight of its class."""
    if depth > DEEPEST:
        raise ValueError(f"at most {DEEPEST} levels, not {depth}")
    label_of = F.col(label).cast("int").alias("_label")
    rows = train.filter(F.col(label).isNotNull()).select(
        label_of, F.xxhash64(*train.columns).alias("_hash"), *[clean(f).alias(f) for f in features]
    )
    spark, width = train.sparkSession, len(features)
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, classes = sum(sizes.values()), max([1, *sizes]) + 1
    if not sizes or min(sizes) < 0:
        raise ValueError("classes are numbered from 0, and there must be rows")
    weight = np.array([float(weights.get(c, 1.0)) for c in range(classes)])
    prior = np.array([sizes.get(c, 0) for c in range(classes)]) * weight
    cuts = feature_cuts(rows, features)
    taken = width if n_trees == 1 else math.ceil(math.sqrt(width))
    # Few chunks are dealt to several tasks, each with a share of the trees.
    bands = max(1, min(16, n_trees, math.ceil(2 * spark.sparkContext.defaultParallelism * CHUNK / n)))
    chunks = written_chunks(rows, cuts, n, bands)

    def share_of(counts: list[float]) -> float:
        """Of class 1; of all rows for a tree that drew none."""
        weighted = [c * w for c, w in zip(counts, weight.tolist())]
        return weighted[1] / sum(weighted) if sum(weighted) > 0 else share

    # A leaf sends its rows left: no bin is above 255.
    splits = np.full((n_trees, 1 << depth), 255, dtype=np.int32)
    share = prior[1] / prior.sum()
    scores = np.full((n_trees, 2 << depth), share)
    opened = [np.ones(1, dtype=np.int64) for _ in range(n_trees)]
    for level in range(depth):
        if not any(len(o) for o in opened):
            break
        follow: list[list[int]] = [[] for _ in range(n_trees)]
        for r in grow_level(chunks, splits, opened, level, width, taken, weight, seed, bands):
            tree, node = r["tree"], r["node"]
            if level == 0:
                scores[tree, 1] = share_of(list(map(sum, zip(r["lower"], r["upper"]))))
            if r["feature"] < 0:
                continue
            splits[tree, node] = r["feature"] * 256 + r["bin"]
            for child, found in ((2 * node, r["lower"]), (2 * node + 1, r["upper"])):
                scores[tree, child] = share_of(found)
                if sum(c > 0 for c in found) > 1:
                    follow[tree].append(child)
        opened = [np.array(sorted(f), dtype=np.int64) for f in follow]
    # The score of a leaf above the last level goes down with its rows.
    for level in range(depth):
        above = np.arange(1 << level, 2 << level)
        leaf = splits[:, above] == 255
        scores[:, 2 * above] = np.where(leaf, scores[:, above], scores[:, 2 * above])
    return RandomForest(splits, scores[:, 1 << depth :].copy(), cuts, features)


def forest_scores(df: DataFrame, forest: RandomForest) -> DataFrame:
    """df plus ``score``, the mean share of class 1 over the trees."""
    # trees * 2 ** depth numbers, a few MB at the defaults.
    shared = df.sparkSession.sparkContext.broadcast((forest.splits, forest.scores, forest.cuts))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        splits, scores, cuts = shared.value
        levels = splits.shape[1].bit_length() - 1
        for batch in batches:
            width = len(cuts)
            bins = binned(batch.to_numpy(dtype=float), cuts).ravel()
            at = np.arange(len(batch), dtype=np.int32) * width
            total = np.zeros(len(batch))
            for t in range(len(splits)):
                total += scores[t].take(walk(splits[t], bins, width, at, levels) - (1 << levels))
            yield pd.Series(total / len(splits))

    return df.withColumn("score", score(F.struct(*[clean(f).alias(f) for f in forest.features])))

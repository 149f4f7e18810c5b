"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

One more coordinate, sqrt(M^2 - |x|^2), gives every vector the length M of the longest
one; a query gets 0 there. The nearest vectors by Euclidean distance are then
those of largest inner product, so the triangle inequality may prune. A subtree
is left out if the distance to its ring of the vantage point, times the relaxing
factor, exceeds the k-th distance found so far. Factor one is exact search; larger
factors prune more and may miss neighbours.

Equal vectors are one entry of the index with as many ids as can ever be
returned, so copies cost nothing and lose nothing. Every distinct query visits every
shard in blocks; a shard's tree and one block are all a task holds.

Defined results: rows whose vector or id is null, or whose vector is zero, empty or has null or
non-finite components, take no part; vectors are compared with those of their
own length; a row that repeats an id and a vector counts once; of equal inner products
the smaller ids are kept, in every leaf, tree and merge. Other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct vectors of a shard, about.
SHARD = 16_384
LEAF = 1024
#: Queries searched together.
BLOCK = 256
#: Factor of the registered query; 1 is exact. tests/llm measures its recall.
RELAX = 1.5


@dataclass
class Node:
    """A leaf's members, or a vantage point with two children and their rings of distances."""

    members: np.ndarray | None = None
    point: int = -1
    children: tuple = ()
    rings: tuple = ()


def build(points: np.ndarray, leaf: int = LEAF, seed: int = 3) -> Node:
    """Halves by distance from a drawn vantage point; ranks split ties, so equal distances do not pile up."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(members=np.sort(rows))
        at = int(rng.integers(len(rows)))
        point = int(rows[at])
        rest = np.delete(rows, at)
        d = distances(points[rest], points[point][None, :])[:, 0]
        half = len(rest) // 2
        order = np.argpartition(d, half)
        near, far = order[:half], order[half:]
        rings = tuple((float(d[x].min()), float(d[x].max())) for x in (near, far))
        return Node(point=point, children=(grow(rest[near]), grow(rest[far])), rings=rings)

    return grow(np.arange(len(points)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


class Search:
    """The k of largest inner product of a block of queries in one tree, smaller rows first among equals.

    The last coordinate is 0 in queries, so the inner product is that of the vectors as given.
    """

    def __init__(self, points: np.ndarray, root: Node, k: int, relax: float):
        self.points, self.root, self.k, self.relax = points, root, min(k, len(points)), relax
        self.longest = float((points * points).sum(1).max())

    def offer(self, q: np.ndarray, members: np.ndarray) -> None:
        """Merge ``members``, in increasing order, into the best so far of the queries ``q``.

        Most queries gain nothing from most leaves; what ties with the bound may have a smaller row.
        """
        cost = -(self.queries[q] @ self.points[members].T)
        gains = cost.min(axis=1) <= self.bound[q]
        if not gains.any():
            return
        q, cost = q[gains], cost[gains]
        if cost.shape[1] > self.k:
            near = np.argpartition(cost, self.k - 1, axis=1)[:, : self.k]
            last = np.take_along_axis(cost, near, 1).max(axis=1)
            tied = (cost <= last[:, None]).sum(axis=1) > self.k
            near[tied] = np.argsort(cost[tied], axis=1, kind="stable")[:, : self.k]
            cost, members = np.take_along_axis(cost, near, 1), members[near]
        every = np.concatenate([self.best[q], cost], axis=1)
        ids = np.concatenate([self.ids[q], np.broadcast_to(members, cost.shape)], axis=1)
        take = np.lexsort((ids, every), axis=1)[:, : self.k]
        self.best[q], self.ids[q] = np.take_along_axis(every, take, 1), np.take_along_axis(ids, take, 1)
        self.bound[q] = self.best[q, -1]

    def __call__(self, queries: np.ndarray) -> np.ndarray:
        """Rows of the k points per query, the nearest first."""
        n = len(queries)
        self.queries, self.lengths = queries, (queries * queries).sum(1)
        self.best, self.ids = np.full((n, self.k), np.inf), np.full((n, self.k), -1, dtype=np.int64)
        self.bound = np.full(n, np.inf)
        self.visit(self.root, np.arange(n))
        return self.ids

    def visit(self, node: Node, q: np.ndarray) -> None:
        if node.members is not None:
            self.offer(q, node.members)
            return
        d = distances(self.queries[q], self.points[node.point][None, :])[:, 0]
        self.offer(q, np.array([node.point]))
        # Each query enters the nearer ring first, so its bound is tight before the other.
        gap = np.stack([np.maximum(np.maximum(low - d, d - high), 0) for low, high in node.rings])
        middle = np.stack([np.abs(d - (low + high) / 2) for low, high in node.rings])
        first = ((gap[1] < gap[0]) | ((gap[1] == gap[0]) & (middle[1] < middle[0]))).astype(int)
        for turn in (0, 1):
            for side in (0, 1):
                mine = (first == side) != bool(turn)
                # All points have one length, so the bound's distance follows from its inner product.
                # A rounding error must not prune what ties with it.
                both = self.lengths[q] + self.longest
                open_ = mine & ((gap[side] * self.relax) ** 2 <= both + 2 * self.bound[q] + 1e-7 * both)
                if open_.any():
                    self.visit(node.children[side], q[open_])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec, dim): the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    ).withColumn("dim", F.size("vec"))


def search(vectors: DataFrame, queries: DataFrame, k: int, relax: float = RELAX, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector).distinct()
    # k + 1 ids of a vector are enough for any query, one of the copies included.
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("dim", "vec").orderBy("id")))
    entries = ranked.filter(F.col("_place") <= k + 1).groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    path = scratch_path(spark, "entries")
    entries.withColumn("e", F.xxhash64("vec")).write.parquet(path)
    entries = spark.read.parquet(path)
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    sizes = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"))
    # One narrow row per length of vector.
    sizes = sizes.withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    asked = usable(queries, vec_id, vector)
    distinct = asked.groupBy("dim", "vec").agg(F.min("id").alias("q"))

    empty = F.array().cast("array<long>")
    placed = entries.join(F.broadcast(sizes), "dim").select(
        "dim", F.pmod(F.col("e"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("e").alias("q"), "vec", "ids", "longest"
    )
    sent = distinct.join(F.broadcast(sizes), "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "q", "vec", empty.alias("ids"), "longest"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, the index before the queries."""
        now, tree = None, None
        points: list[np.ndarray] = []
        ids: list[list[int]] = []
        block: list[tuple[int, np.ndarray]] = []

        def answered() -> pa.RecordBatch:
            out_q, out_v, out_s = [], [], []
            if block and points:
                nonlocal tree
                raw = np.stack(points)
                if tree is None:
                    # Rows in the order of their smallest ids, which decides between equals.
                    order = sorted(range(len(ids)), key=lambda r: ids[r][0])
                    raw, ids[:] = raw[order], [ids[r] for r in order]
                    points[:] = list(raw)
                    longest = math.sqrt(float((raw * raw).sum(1).max()))
                    extra = np.sqrt(np.maximum(longest**2 - (raw * raw).sum(1), 0))
                    lifted = np.column_stack([raw, extra])
                    tree = (lifted, build(lifted, leaf))
                asked_ = np.column_stack([np.stack([v for _, v in block]), np.zeros(len(block))])
                found = Search(tree[0], tree[1], k + 1, relax)(asked_)
                for (q, v), near in zip(block, found):
                    for row in near[near >= 0]:
                        score = float(np.dot(raw[row], v))
                        for one in ids[row]:
                            out_q.append(q)
                            out_v.append(one)
                            out_s.append(score)
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["q", "vec_id", "score"])

        for batch in batches:
            dim, part, kind, q = (tx.column(batch, x).to_pylist() for x in ("dim", "shard", "kind", "q"))
            vec, own = tx.column(batch, "vec"), tx.column(batch, "ids").to_pylist()
            flat, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            for r in range(batch.num_rows):
                if (dim[r], part[r]) != now:
                    if block:
                        yield answered()
                    now, tree, points, ids = (dim[r], part[r]), None, [], []
                value = flat[at[r] : at[r + 1]].copy()
                if kind[r] == 0:
                    points.append(value)
                    ids.append(own[r])
                else:
                    block.append((q[r], value))
                    if len(block) == BLOCK:
                        yield answered()
        if block:
            yield answered()

    both = placed.drop("longest").unionByName(sent.drop("longest"))
    near = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "q").mapInArrow(work, "q long, vec_id long, score double")
    # Each query row drops itself, then ranks what its vector found.
    ids = asked.select(F.col("id").alias("query_id"), "vec").distinct().join(distinct.select("q", "vec"), "vec").select("query_id", "q")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ids.join(top, "q").filter("query_id != vec_id").withColumn("rank", F.row_number().over(each))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row whose id is divisible by 20, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)

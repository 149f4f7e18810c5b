"""Isolation forest (Liu, Ting, Zhou 2008): trees grown and rows scored on executors.

Each tree sees at most 256 rows, so a group handed to a task has a fixed size
whatever the table holds. The grown forest is a fixed number of small arrays.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.functions.expr import uniform
from pipewatch.sources.scratch import checkpointed

# Executors get the few functions below with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER = 0.5772156649015329
#: Rows drawn into the pool for each row that the trees take.
POOL = 2


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    safe = np.where(big, n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(big, long, out)


def grow(rows: np.ndarray, seed: int) -> dict[str, list]:
    """One tree as parallel arrays; a leaf has feature -1 and its depth plus expected rest."""
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(len(rows), 2))))
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "path": []}

    def add(part: np.ndarray, depth: int) -> int:
        node = len(tree["feature"])
        for key, blank in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            tree[key].append(blank)
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            tree["path"][node] = depth + float(average_path(len(part)))
            return node
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        if goes_left.all() or not goes_left.any():
            tree["path"][node] = depth + float(average_path(len(part)))
            return node
        tree["feature"][node], tree["cut"][node] = feature, cut
        tree["left"][node] = add(part[goes_left], depth + 1)
        tree["right"][node] = add(part[~goes_left], depth + 1)
        return node

    add(rows, 0)
    return tree


TREE_SCHEMA = (
    "tree long, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
)


@dataclass
class IsolationForest:
    """A grown forest: its trees, the subsample size and the feature order."""

    trees: list[dict[str, np.ndarray]]
    sample: int
    features: list[str]


def path_scores(trees: list[dict[str, np.ndarray]], sample: int, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path); near 1 is easy to isolate."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for t in trees:
        node = np.zeros(len(rows), dtype=np.int64)
        active = t["feature"][node] >= 0
        while active.any():
            at = node[active]
            go_left = rows[index[active], t["feature"][at]] <= t["cut"][at]
            node[active] = np.where(go_left, t["left"][at], t["right"][at])
            active = t["feature"][node] >= 0
        total += t["path"][node]
    return np.power(2.0, -total / (len(trees) * max(float(average_path(sample)), 1e-9)))


def draw_samples(train: DataFrame, features: list[str], order: list[Column], n_trees: int, sample: int,
                 n: int, seed: int) -> DataFrame:
    """(tree, _draw, features): about twice ``sample`` rows for every tree, each set a uniform draw.

    A pool of about ``POOL * n_trees * sample`` rows is drawn first, by hash, so the rows
    that meet the trees are bounded whatever the table holds; then every tree draws from the pool. Rows are
    counted by a hash of all they hold: c copies put floor(c * p) of them in the pool, and one more
    with the chance that is left, so copies need no order among themselves and never meet in a task.
    Of n rows up to twice ``sample`` every tree gets all.
    """
    rows = train.select(F.xxhash64(*order, *features).alias("_h"), *[F.col(f).cast("double").alias(f) for f in features])
    share = min(1.0, POOL * n_trees * sample / max(n, 1))
    expected = F.col("_c") * F.lit(share)
    chosen = (
        rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_k", (F.floor(expected) + (uniform(f"{seed}:pool", "_h") < expected - F.floor(expected)).cast("long")))
        .filter("_k > 0").select("_h", "_k")
    )
    # As many rows as the pool has at most: a few MB at the defaults, whatever n is.
    chosen = checkpointed(chosen)
    size = chosen.agg(F.sum("_k")).first()[0] or 0
    first = rows.join(F.broadcast(chosen), "_h").groupBy("_h", "_k").agg(F.first(F.struct(*features)).alias("_row"))
    pool = first.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    limit = 2.0 * sample / max(size, 1)

    def draw(tree: Column) -> Column:
        """From [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, "_h", "_i"), 11) / F.lit(float(1 << 53))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < limit)
    drawn = pool.select("_h", "_i", "_row", F.explode(trees).alias("_t"))
    return drawn.select(F.col("_t").cast("long").alias("tree"), draw(F.col("_t")).alias("_draw"), "_row.*")


def fit_isolation_forest(
    train: DataFrame, features: list[str], order: list[Column], n_trees: int = 300,
    max_sample: int = 256, seed: int = 42,
) -> IsolationForest:
    """Grow the trees, each from its own rows drawn without replacement.

    ``order`` tells rows apart, together with the features. A tree takes the rows of its draw with the least hashes;
    that fewer than ``max_sample`` come, of a table that has them, is a matter of 11 standard deviations.
    """
    n = train.count()
    sample = min(max_sample, n)

    def one_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["_draw", *features])[features].to_numpy(dtype=float)[:sample]
        return pd.DataFrame([{"tree": key[0], **grow(ordered, seed + int(key[0]))}])

    drawn = draw_samples(train, features, order, n_trees, sample, n, seed)
    grown = drawn.groupBy("tree").applyInPandas(one_tree, TREE_SCHEMA).orderBy("tree").collect()
    trees = [
        {
            "feature": np.asarray(t["feature"], dtype=np.int64),
            "cut": np.asarray(t["cut"]),
            "left": np.asarray(t["left"], dtype=np.int64),
            "right": np.asarray(t["right"], dtype=np.int64),
            "path": np.asarray(t["path"]),
        }
        for t in grown
    ]
    return IsolationForest(trees, sample, features)


def raw_anomaly(df: DataFrame, forest: IsolationForest, name: str = "raw_score") -> DataFrame:
    """Raw anomaly score per row, in Arrow batches."""
    # At most n_trees * 2 * max_sample nodes, a few MB at the defaults.
    shared = df.sparkSession.sparkContext.broadcast((forest.trees, forest.sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees, sample = shared.value
        for batch in batches:
            yield pd.Series(path_scores(trees, sample, batch.to_numpy(dtype=float)))

    columns = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in forest.features]
    return df.withColumn(name, score(F.struct(*columns)))


def scaled_scores(df: DataFrame, forest: IsolationForest, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores min-max scaled over the frame, or over each group of ``by``.

    The scope decides the numbers: a suite scales over validation and test
    together, scoring over each request batch. Raw scores are kept, so the
    forest walks each row once.
    """
    raw = checkpointed(raw_anomaly(df, forest))
    limits = raw.groupBy(*by).agg(F.min("raw_score").alias("_low"), F.max("raw_score").alias("_high"))
    if by:
        joined = raw.join(limits, list(by))
    else:
        joined = raw.withColumns(
            {"_low": limits.select("_low").scalar(), "_high": limits.select("_high").scalar()}
        )
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-9))
    return joined.withColumn("score", (F.col("raw_score") - F.col("_low")) / width).drop(
        "raw_score", "_low", "_high"
    )

"""The random forest against splits found by hand, and against itself on other partitions."""

import numpy as np
from pyspark.sql import functions as F

from pipewatch.operators import forest as fo
from pipewatch.operators import models as mm


def frame(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = [
        (i, float(a), float(b), None if i % 50 == 0 else float(c), int(a + rng.normal() / 4 > 0.6 and b > 2))
        for i, (a, b, c) in enumerate(zip(rng.random(n), rng.integers(0, 6, n), rng.normal(size=n)))
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def test_partitions_and_chunks_do_not_change_the_forest(spark, monkeypatch):
    df = frame(spark)
    one = mm.fit_random_forest(df.coalesce(1), ["a", "b", "c"], "y", 7, 5)
    monkeypatch.setattr(fo, "CHUNK", 50)
    many = mm.fit_random_forest(df.repartition(9), ["a", "b", "c"], "y", 7, 5)
    assert (one.splits == many.splits).all() and (one.scores == many.scores).all()
    assert (one.splits[0] != one.splits[1]).any()


def best_gini(values, y, weight):
    """The least weighted impurity that one cut of ``values`` leaves."""
    def spread(part):
        w = np.array([weight[0] * (part == 0).sum(), weight[1] * (part == 1).sum()])
        return w.sum() - (w * w).sum() / w.sum() if w.sum() else 0.0

    return min(spread(y[values <= c]) + spread(y[values > c]) for c in np.unique(values)[:-1])


def test_one_tree_takes_the_best_cut_of_all_rows(spark):
    df = frame(spark)
    rows = df.fillna(0.0).toPandas()
    forest = mm.fit_random_forest(df, ["b"], "y", 1, 1)
    y, weight = rows.y.to_numpy(), len(rows) / (2 * np.bincount(rows.y))
    cut = forest.cuts[0][forest.splits[0, 1] & 255]
    assert list(forest.cuts[0]) == [0.5, 1.5, 2.5, 3.5, 4.5]
    w = [[weight[k] * ((rows.b > cut) == side)[y == k].sum() for k in (0, 1)] for side in (False, True)]
    assert np.isclose(sum(sum(s) - (s[0] ** 2 + s[1] ** 2) / sum(s) for s in w), best_gini(rows.b.to_numpy(), y, weight))
    scored = {r.b: r.score for r in mm.score_with(forest, df, ["b"]).select("b", "score").collect()}
    assert np.isclose(scored[0.0], w[0][1] / sum(w[0])) and np.isclose(scored[5.0], w[1][1] / sum(w[1]))


def test_deep_tree_tells_all_rows_apart(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 5 % 2).cast("int").alias("y"))
    forest = mm.fit_random_forest(df, ["x"], "y", 1, 10)
    got = mm.score_with(forest, df, ["x"]).select("y", "score").collect()
    assert all(r.score == r.y for r in got)


def test_draws_have_mean_one(spark):
    hashes = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = fo.repeats(hashes, 42, 5, fo.poisson_table())
    assert abs(drawn.mean() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert not (drawn == fo.repeats(hashes, 42, 6, fo.poisson_table())).all()


def test_rows_without_a_class_do_not_train(spark):
    df = frame(spark, 200)
    more = df.unionByName(df.limit(20).withColumn("y", F.lit(None).cast("int")))
    a, b = (mm.fit_random_forest(d, ["a", "b"], "y", 3, 3, balanced=False) for d in (df, more))
    assert (a.splits == b.splits).all() and (a.scores == b.scores).all()

"""Rows drawn for the trees: bounded, uniform, alike on every partitioning, copies in proportion."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pipewatch.operators import isolation as iso


def frame(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("ts"), (F.col("id") % 1000).alias("event_ts"), (F.col("id") * 0.5).alias("x")
    )


def drawn(df, n, trees=20, sample=16):
    return iso.draw_samples(df, ["x"], [F.col("ts")], trees, sample, n, 42)


def test_draws_are_bounded_and_reach_everywhere(spark):
    n = 20_000
    rows = drawn(frame(spark, n), n).collect()
    assert len(rows) < 3 * 20 * 16
    per_tree = [[r.x for r in rows if r.tree == t] for t in range(20)]
    assert all(len(x) >= 16 and len(set(x)) == len(x) for x in per_tree)
    places = [2 * r.x / n for r in rows]
    assert abs(sum(places) / len(places) - 0.5) < 0.06
    assert min(places) < 0.05 and max(places) > 0.95


def test_partitioning_does_not_matter(spark):
    a, b = (rows_of(drawn(frame(spark, 5000, p), 5000)) for p in (1, 7))
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 16, 30])
def test_few_rows_reach_every_tree(spark, n):
    rows = drawn(frame(spark, n), n, sample=min(16, n)).collect()
    assert len(rows) == 20 * n


def test_copies_keep_their_share(spark):
    hot = spark.range(10_000).select(F.lit(7).cast("long").alias("ts"), F.lit(-1.0).alias("x"))
    rows = hot.union(frame(spark, 20_000).select("ts", "x"))
    got = drawn(rows, 30_000, trees=50).collect()
    share = sum(r.x == -1.0 for r in got) / len(got)
    assert abs(share - 1 / 3) < 0.06


def test_forest_of_no_rows_and_of_outliers(spark):
    empty = iso.fit_isolation_forest(frame(spark, 10).filter("x < 0"), ["x"], [F.col("ts")], n_trees=3)
    assert empty.trees == [] and empty.sample == 0
    rows = frame(spark, 3000).unionByName(spark.createDataFrame([(9999, 0, 1e6)], "ts long, event_ts long, x double"))
    forest = iso.fit_isolation_forest(rows, ["x"], [F.col("ts")], n_trees=100, max_sample=256)
    top = iso.raw_anomaly(rows, forest).orderBy(F.desc("raw_score")).first()
    assert len(forest.trees) == 100 and top.x in (1e6, 0.0, 0.5, 1499.5)

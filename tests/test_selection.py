"""Cuts by counting against sorting everything."""

import random

import pytest
from pyspark.sql import functions as F

from pipewatch.operators import selection as se
from pipewatch.operators import splits as sp


def rows_of_order(n=900, seed=2):
    rng = random.Random(seed)
    hot = [(5, "h", i) for i in range(n // 3)]
    rest = [(rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "é"]), 10_000 + i) for i in range(n - len(hot))]
    rng.shuffle(rest)
    return hot + rest


KEY = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("few, limits", [(10_000, 64), (20, 4), (1, 1), (3, 64)])
def test_cuts_are_at_their_ranks(spark, few, limits):
    rows = rows_of_order()
    df = spark.createDataFrame(rows, "a int, b string, id long").repartition(5)
    ranks = [0, 1, 450, 899, 900, 2000]
    found = se.cuts(df, [F.col("a"), F.col("b"), F.col("id")], ranks, few=few, limits=limits)
    ordered = sorted(rows, key=KEY)
    for rank, cut in zip(ranks, found):
        assert sorted((tuple(r) for r in df.filter(cut.before).collect()), key=KEY) == ordered[:rank]


def test_a_cut_inside_equal_keys(spark):
    rows = rows_of_order()
    df = spark.createDataFrame(rows, "a int, b string, id long")
    for rank in (100, 500):
        (cut,) = se.cuts(df, [F.col("a")], [rank], few=10, limits=3)
        got = [tuple(r) for r in df.filter(cut.before).collect()]
        assert len(got) == rank
        assert sorted(KEY(r[:1]) for r in got) == sorted(KEY(r[:1]) for r in rows)[:rank]
    alike = spark.createDataFrame([(1,)] * 50, "a int")
    (cut,) = se.cuts(alike, [F.col("a")], [20], few=10)
    assert alike.filter(cut.before).count() == 0


def test_labelling_moves_no_rows(spark):
    df = spark.createDataFrame(rows_of_order(), "a int, b string, id long").withColumn("wide", F.lit("x" * 100))
    out, _ = sp.temporal_split(df, [F.col("a"), F.col("b"), F.col("id")])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 540, "val": 180, "test": 180}


def test_plain_split_of_few_rows(spark):
    for n in (0, 1, 2, 7):
        df = spark.range(n)
        got = [r["split"] for r in sp.plain_temporal_split(df, [F.col("id")]).orderBy("id").collect()]
        assert got == ["train" if i < int(n * 0.6) else "val" if i < int(n * 0.8) else "test" for i in range(n)]

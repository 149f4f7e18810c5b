"""Total-order primitives and series windows against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows_of
from pipewatch.operators import ordered as o
from pipewatch.operators import series as se


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(500), "v": rng.integers(0, 40, 500), "g": rng.integers(0, 3, 500)})
    # One value and one group hold much more than a third of the rows.
    pdf.loc[pdf.id % 5 < 2, "v"] = 7
    pdf.loc[pdf.id % 7 < 4, "g"] = 1
    return pdf, spark.createDataFrame(pdf)


def test_rank_is_the_sorted_position(numbers, split_hot_keys):
    pdf, df = numbers
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    got = o.with_rank(df, [F.col("v"), F.col("id")]).toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(500))
    assert list(got["id"]) == list(want["id"])


def test_running_sums(numbers, split_hot_keys):
    pdf, df = numbers
    got = o.running_sums(df, [F.col("v").desc(), F.col("id")], {"total": "id"}).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    want["total"] = want["id"].cumsum()
    merged = got.merge(want[["id", "total"]], on="id")
    assert (merged.total_x == merged.total_y).all()


def test_lower_quantile_per_group(numbers, split_hot_keys):
    pdf, df = numbers
    got = {r["g"]: (r["p50"], r["p95"]) for r in o.lower_quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, ("g",)).collect()}
    for g, part in pdf.groupby("g"):
        s = sorted(part.v)
        assert got[g] == (s[int(0.5 * (len(s) - 1))], s[int(0.95 * (len(s) - 1))])


def test_lower_quantile_of_ten_values(spark):
    df = spark.range(10).withColumn("v", F.col("id").cast("double"))
    assert o.lower_quantiles(df, "v", {"p95": 0.95}).first()["p95"] == 8.0


def test_lower_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert o.lower_quantiles(df, "v", {"p95": 0.95}).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_next_event(spark, width):
    flags = [int(x) for x in np.random.default_rng(3).integers(0, 6, 120) == 0]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "rank long, e int")
    got = o.next_event_ranks(df, "rank", {"nxt": F.col("e") == 1, "any": F.lit(True)}, width=width)
    for r in got.collect():
        later = [i for i in range(r["rank"], 120) if flags[i]]
        assert r["nxt"] == (later[0] if later else None)
        assert r["any"] == r["rank"]


def readings(spark):
    rng = np.random.default_rng(5)
    key = np.where(rng.random(400) < 0.5, "hot", rng.choice(["a", "b", "c", None], 400))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(400), "v": rng.integers(0, 99, 400)})
    return spark.createDataFrame(pdf, "k string, t long, v long")


def features(rows, w):
    return rows.withColumns(
        {
            "back": F.lag("v", 2).over(w),
            "ahead": F.lead("v", 3).over(w),
            "mean": F.avg("v").over(w.rowsBetween(-5, 0)),
        }
    )


def test_hot_series_equal_plain_windows(spark, split_hot_keys):
    df = readings(spark)
    order = [F.col("t").asc()]
    split = rows_of(se.over_series(df, "k", order, features, lookback=5, lookahead=3))
    assert split == rows_of(features(df, Window.partitionBy("k").orderBy(*order)))


def test_hot_running_max_equals_plain(spark, split_hot_keys):
    df = readings(spark)
    split = rows_of(se.running_max(df, "k", [F.col("t").asc()], "v", "top"))
    upto = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert split == rows_of(df.withColumn("top", F.max("v").over(upto)))


def test_running_max_deals_rows_out_once(spark, split_hot_keys):
    """A key's maximum reaches its later chunks without joining the rows with it."""
    rows = [("hot" if i % 4 else None, i, (i * 37) % 101 if i % 3 else None, f"x{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, v int, other string")
    out = se.running_max(df, "k", [F.col("t").asc()], "v", "top")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and out.columns == ["k", "t", "v", "other", "top"]
    best, want = {}, []
    for k, t, v, other in rows:
        best[k] = max([x for x in (best.get(k), v) if x is not None], default=None)
        want.append((k, t, v, other, best[k]))
    assert rows_of(out) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))

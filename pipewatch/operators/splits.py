"""Train, validation and test splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.functions.expr import uniform
from pipewatch.operators.selection import Cut, cuts

TRAIN, VAL, TEST = "train", "val", "test"


def _by_cuts(train_end: Cut, val_end: Cut) -> Column:
    return F.when(train_end.before, TRAIN).when(val_end.before, VAL).otherwise(TEST)


def cut_points(n: int, train_frac: float, val_frac: float) -> tuple[int, int]:
    """First validation row and first test row among n ordered rows."""
    train_end = max(2, int(n * train_frac))
    val_end = max(train_end + 1, int(n * (train_frac + val_frac)))
    return train_end, min(val_end, n - 1)


def temporal_split(
    df: DataFrame,
    order: list[Column],
    train_frac: float = 0.6,
    val_frac: float = 0.2,
    real_holdout: bool = False,
    source: str = "_source_type",
) -> tuple[DataFrame, str]:
    """A ``split`` column by place in time, and the policy that applied.

    With ``real_holdout`` only real rows are cut and synthetic rows all train;
    with fewer than five real rows the cut falls back to all rows. Rows stay where they are:
    they are labelled by comparing them with two cut keys.
    """
    policy = "temporal_all"
    if real_holdout:
        real = F.coalesce(F.col(source), F.lit("real")) == "real"
        n_real = df.filter(real).count()
        if n_real >= 5:
            train_end, val_end = cut_points(n_real, train_frac, val_frac)
            if train_end < val_end < n_real:
                label = _by_cuts(*cuts(df.filter(real), order, [train_end, val_end], n_real))
                return df.withColumn("split", F.when(real, label).otherwise(TRAIN)), "real_only_holdout"
        policy = "temporal_all_fallback"
    n = df.count()
    if n < 5:
        raise ValueError("a temporal split needs at least 5 rows")
    train_end, val_end = cut_points(n, train_frac, val_frac)
    if not train_end < val_end < n:
        raise ValueError("the temporal split leaves validation or test empty")
    return df.withColumn("split", _by_cuts(*cuts(df, order, [train_end, val_end], n))), policy


def plain_temporal_split(
    df: DataFrame, order: list[Column], train_frac: float = 0.6, val_frac: float = 0.2
) -> DataFrame:
    """Cuts at ``int(n * fraction)``, without minimum sizes."""
    n = df.count()
    ends = [int(n * train_frac), int(n * (train_frac + val_frac))]
    return df.withColumn("split", _by_cuts(*cuts(df, order, ends, n)))


def stratified_split(
    df: DataFrame, label: str, row_id: list[str], seed: int = 42, test_size: float | None = None
) -> DataFrame:
    """A reproducible random ``split``: 20 % test, 40 % below 20 rows.

    Classes keep their share when every class can have a test row; otherwise
    the draw ignores them.
    """
    by_class = {
        r[label]: r["n"]
        for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    }
    n = sum(by_class.values())
    share = test_size if test_size is not None else (0.4 if n < 20 else 0.2)
    n_test = math.ceil(n * share)
    can_stratify = len(by_class) > 1 and min(by_class.values()) >= 2 and n_test >= len(by_class)
    draw = uniform(seed, *row_id)
    ids = [F.col(c) for c in row_id]
    # A class's test rows are those with the smallest draws, up to its quota.
    if not can_stratify:
        (end,) = cuts(df, [draw, *ids], [n_test], n)
        is_test = end.before
    else:
        whole = {c: m * n_test // n for c, m in by_class.items()}
        left = n_test - sum(whole.values())
        by_remainder = sorted(by_class, key=lambda c: (-(by_class[c] * n_test % n), c))
        is_test = F.lit(False)
        for c, m in by_class.items():
            mine = F.col(label).eqNullSafe(F.lit(c))
            (end,) = cuts(df.filter(mine), [draw, *ids], [whole[c] + (c in by_remainder[:left])], m)
            is_test = is_test | (mine & end.before)
    return df.withColumn("split", F.when(is_test, TEST).otherwise(TRAIN))


def split_profile(df: DataFrame, label: str, source: str = "_source_type") -> DataFrame:
    """Rows, real and synthetic rows and real leaks per split."""
    real = F.col(source) == "real"
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(real).alias("real_rows"),
        F.count_if(~real).alias("synthetic_rows"),
        F.count_if(real & (F.col(label) == 1)).alias("real_leaks"),
    )


# Least amounts of real data for a release.
MINIMUMS = {"real_train_rows": 200, "real_val_rows": 30, "real_test_rows": 100, "real_test_leaks": 10}


def data_sufficiency(
    df: DataFrame, label: str, source: str = "_source_type", minimums: dict[str, int] = MINIMUMS
) -> DataFrame:
    """One row per requirement: minimum, actual, gap and whether it is met, plus the overall flag."""
    real = F.col(source) == "real"
    actual = df.agg(
        F.count_if(real & (F.col("split") == TRAIN)).alias("real_train_rows"),
        F.count_if(real & (F.col("split") == VAL)).alias("real_val_rows"),
        F.count_if(real & (F.col("split") == TEST)).alias("real_test_rows"),
        F.count_if(real & (F.col("split") == TEST) & (F.col(label) == 1)).alias("real_test_leaks"),
    )
    ready = F.lit(True)
    for name, least in minimums.items():
        ready = ready & (F.col(name) >= least)
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("requirement"),
                F.lit(least).cast("long").alias("minimum"),
                F.col(name).alias("actual"),
                F.greatest(F.lit(least) - F.col(name), F.lit(0)).alias("gap"),
                (F.col(name) >= least).alias("ok"),
            )
            for name, least in minimums.items()
        ]
    )
    return actual.select(ready.alias("ready"), F.explode(lines).alias("line")).select(
        "line.*", "ready"
    )

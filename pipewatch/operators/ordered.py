"""Exact results over a total order of all rows, without a one-task window.

The rows are range-partitioned on the full order key and written once to the
shared folder. Every output file is one chunk of the order; a row's place is
its file number plus its row index in the file, so the result stays the same
however often later stages are retried. Ties on the leading key spread over
several chunks because the key includes a tie-break.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.sources.scratch import scratch_path

CHUNK = "_chunk"
POS = "_pos"


def ordered_chunks(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df plus its chunk number and its position inside the chunk.

    A task's number is written with its rows, and it writes one file whatever
    the session says of file lengths; so chunks are numbered in the order of
    their ranges, and a row's index in its file is its place in the chunk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(CHUNK, F.spark_partition_id())
    ranged.write.option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    return rows.select(*df.columns, F.col(CHUNK).cast("long").alias(CHUNK), F.col("_metadata.row_index").alias(POS))


def prefix_by_chunk(per_chunk: DataFrame, sums: list[str]) -> DataFrame:
    """Sum of all earlier chunks. One row per written file, so one task will do."""
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        CHUNK, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums]
    )


def with_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Zero-based position of every row in the total order given by the keys."""
    chunks = ordered_chunks(df, keys)
    sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n"))
    return (
        chunks.join(F.broadcast(prefix_by_chunk(sizes, ["n"])), CHUNK)
        .withColumn(name, F.col("_before_n") + F.col(POS))
        .drop(CHUNK, POS, "_before_n")
    )


def running_sums(df: DataFrame, keys: list[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums over the total order: {output name: summed column}."""
    chunks = ordered_chunks(df, keys)
    per_chunk = chunks.groupBy(CHUNK).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    before = prefix_by_chunk(per_chunk, list(sums))
    here = Window.partitionBy(CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.select("*", *[F.sum(c).over(here).alias(o) for o, c in sums.items()])
    return (
        local.join(F.broadcast(before), CHUNK)
        .withColumns({o: F.col(o) + F.col(f"_before_{o}") for o in sums})
        .drop(CHUNK, POS, *[f"_before_{o}" for o in sums])
    )


def values_at_ranks(
    df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: tuple[str, ...] = ()
) -> DataFrame:
    """Per group of ``by``: the sorted non-NULL value at each zero-based rank.

    ``ranks`` maps an output name to a function from the group's row count to a
    rank. Values are counted first, so a value shared by many rows is one row
    of the order, and one order over (group, value) serves groups of any size.
    """
    groups_by = list(by) or ["_all"]
    counted = df.filter(F.col(value).isNotNull())
    if not by:
        counted = counted.withColumn("_all", F.lit(1))
    counted = counted.groupBy(*groups_by, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    order = [F.col(c) for c in (*groups_by, "_value")]
    upto = running_sums(counted, order, {"_upto": "_n"})
    first = F.col("_upto") - F.col("_n")
    groups = upto.groupBy(*groups_by).agg(F.min(first).alias("_start"), F.sum("_n").alias("_total"))

    def pick(rank: Column) -> Column:
        place = F.col("_start") + rank
        return F.max(F.when((place >= first) & (place < F.col("_upto")), F.col("_value")))

    # Without groups the right side is one row; rows need not move for it.
    picked = upto.join(groups if by else F.broadcast(groups), groups_by).groupBy(*groups_by)
    out = picked.agg(
        F.max("_total").alias("n"),
        *[pick(rank(F.col("_total"))).alias(name) for name, rank in ranks.items()],
    )
    return out if by else out.drop("_all")


def lower_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: tuple[str, ...] = ()
) -> DataFrame:
    """Lower nearest rank: the value at ``floor(q * (n - 1))`` of the sorted values."""

    def at(q: float) -> Callable[[Column], Column]:
        return lambda n: F.floor(F.lit(q) * (n - 1))

    return values_at_ranks(df, value, {name: at(q) for name, q in quantiles.items()}, by)


def next_event_ranks(
    df: DataFrame, rank: str, events: dict[str, Column], width: int | None = None
) -> DataFrame:
    """Per row and kind of event, the rank of the first event at or after it.

    ``events`` maps an output column to the condition that makes a row such an
    event; NULL means none follows. Rows are cut into blocks of ``width``
    ranks, all kinds are found in one pass over a block, and only the first
    events of blocks cross their borders. The default width grows with the
    square root of the table, so neither a block nor the list of blocks
    becomes large.
    """
    if width is None:
        width = max(100_000, math.isqrt(df.count()))
    found = {name: f"_event{i}" for i, name in enumerate(events)}
    rows = df.withColumn("_block", F.floor(F.col(rank) / F.lit(width))).withColumns(
        {found[name]: F.when(condition, F.col(rank)) for name, condition in events.items()}
    )
    # Walked backwards, so each row adds to the frame of the row after it.
    onward = (
        Window.partitionBy("_block")
        .orderBy(F.col(rank).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    near = rows.withColumns({name: F.min(c).over(onward) for name, c in found.items()})
    firsts = rows.groupBy("_block").agg(*[F.min(c).alias(c) for c in found.values()])
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = firsts.select(
        "_block", *[F.min(c).over(later).alias(f"{c}_later") for c in found.values()]
    )
    return (
        near.join(far, "_block", "left")
        .withColumns({name: F.coalesce(name, f"{c}_later") for name, c in found.items()})
        .drop("_block", *found.values(), *[f"{c}_later" for c in found.values()])
    )

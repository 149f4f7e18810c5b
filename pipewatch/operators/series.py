"""Window features per sensor that survive one sensor holding much of the data.

The rows are written in (sensor, time) order and worked on chunk by chunk; each
chunk gets copies of the few neighbouring rows its frames reach into, so no
task ever sees a whole hot sensor. Tables of all sizes take this one way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pipewatch.operators.ordered import CHUNK, POS, ordered_chunks


def over_series(
    df: DataFrame,
    key: str,
    order: list[Column],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Apply ``compute(rows, window)`` per series of ``key`` in ``order``.

    The frames of ``compute`` may reach ``lookback`` rows back and ``lookahead``
    rows ahead.
    """
    chunks = ordered_chunks(df, [F.col(key), *order])
    sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    # Empty ranges leave gaps in the numbers; neighbours are counted on a dense number, one row per file.
    dense = sizes.select(CHUNK, "_n", F.row_number().over(Window.orderBy(CHUNK)).alias("_seq"))
    placed = chunks.join(F.broadcast(dense), CHUNK)
    # Every chunk has a row, so the last k rows before a chunk lie in at most k chunks.
    back = F.when(
        F.col(POS) >= F.col("_n") - lookback, F.sequence(F.lit(0), F.lit(lookback))
    ).otherwise(F.array(F.lit(0)))
    ahead = F.when(
        F.col(POS) < lookahead, F.sequence(F.lit(-lookahead), F.lit(0))
    ).otherwise(F.array(F.lit(0)))
    copies = placed.withColumn("_shift", F.explode(F.array_union(back, ahead)))
    copies = copies.withColumn("_home", F.col("_seq") + F.col("_shift"))
    window = Window.partitionBy("_home", key).orderBy(*order)
    done = compute(copies.drop(CHUNK, POS, "_n", "_seq"), window)
    return done.filter(F.col("_shift") == 0).drop("_shift", "_home")


def running_max(df: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Largest ``value`` seen so far per series, the current row included."""

    def so_far(rows: DataFrame, by: list[str], ordering: list[Column]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*ordering)
        return rows.withColumn(
            name, F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        )

    chunks = ordered_chunks(df, [F.col(key), *order])
    # One row per key and file it lies in; a key's files are few beside its rows.
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.groupBy(key, CHUNK)
        .agg(F.max(value).alias("_top"))
        .select(
            F.col(key).alias("_key"),
            F.col(CHUNK).alias("_at"),
            F.max("_top").over(before).alias("_carry"),
        )
        .filter(F.col("_carry").isNotNull())
    )
    # The value a chunk starts with is a row ahead of its first, so rows are dealt out once and joined with nothing.
    blank = {f.name: F.lit(None).cast(f.dataType) for f in chunks.schema if f.name not in (key, CHUNK, POS, value)}
    ahead = carried.select(
        F.col("_key").alias(key), F.col("_at").alias(CHUNK), F.lit(-1).cast(chunks.schema[POS].dataType).alias(POS),
        F.col("_carry").alias(value), *[c.alias(n) for n, c in blank.items()],
    )
    return so_far(chunks.unionByName(ahead), [CHUNK, key], [F.col(POS)]).filter(F.col(POS) >= 0).drop(CHUNK, POS)

"""Exact cuts of a total order at given ranks, by counting ranges instead of sorting.

Rows are never moved: one pass draws range limits by hash, one pass counts how many rows lie
below each limit, and the range that holds a rank is cut again until it has few rows. Those few are the
only ones put in order. A cut is a key, so rows are told apart by comparing with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range that are put in order, and limits counted in one pass.
FEW, LIMITS = 100_000, 16


@dataclass(frozen=True)
class Cut:
    """A place in the order: the key of the row there, and among rows of that very key a hash."""

    key: Column
    limit: Column | None
    row_hash: Column | None = None
    hash_limit: int | None = None

    @property
    def before(self) -> Column:
        """Whether a row comes before the place."""
        if self.limit is None:
            return F.lit(True)
        below = self.key < self.limit
        if self.hash_limit is None:
            return below
        return below | ((self.key == self.limit) & (self.row_hash < F.lit(self.hash_limit)))


def _literal(kind, values) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, values)])


def _at(rows: DataFrame, n: int, rank: int, few: int, limits: int) -> tuple[tuple, int, int]:
    """The key (column ``k``) at a rank among n rows, the rows below it, and the rows that share it."""
    kind = rows.schema["k"].dataType
    low = high = None
    below, inside, salt = 0, n, 0
    while True:
        part = rows
        if low is not None:
            part = part.filter(F.col("k") >= _literal(kind, low))
        if high is not None:
            part = part.filter(F.col("k") < _literal(kind, high))
        if inside <= few:
            found = tuple(part.orderBy("k").offset(rank - below).limit(1).first()["k"])
            here = _literal(kind, found)
            near = part.agg(F.count_if(F.col("k") < here).alias("under"), F.count_if(F.col("k") == here).alias("same")).first()
            return found, below + near["under"], near["same"]
        ends = part.agg(F.min("k").alias("a"), F.max("k").alias("b")).first()
        smallest, largest = tuple(ends["a"]), tuple(ends["b"])
        if smallest == largest:
            return smallest, below, inside
        # Keys drawn by hash, so a key of many rows is one of them at most once.
        share = max(1, inside // (4 * limits))
        drawn = part.select("k").filter(F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(share)) == 0).distinct()
        places = [tuple(r["k"]) for r in drawn.orderBy("k").limit(16 * limits).collect()]
        steps = [p for p in dict.fromkeys([*places[:: max(1, len(places) // limits)], largest]) if p != smallest]
        counts = part.agg(*[F.count_if(F.col("k") < _literal(kind, p)).alias(f"c{i}") for i, p in enumerate(steps)]).first()
        # Limits ascend, and so do the rows below them. The largest key leaves at least itself above.
        under = [(counts[i], p) for i, p in enumerate(steps) if below + counts[i] <= rank]
        over = [(counts[i], p) for i, p in enumerate(steps) if below + counts[i] > rank]
        start, low = under[-1] if under else (0, smallest)
        end, high = over[0] if over else (inside, high)
        below, inside, salt = below + start, end - start, salt + 1


def cuts(df: DataFrame, order: list[Column], ranks: list[int], n: int | None = None, few: int = FEW, limits: int = LIMITS) -> list[Cut]:
    """The cut before the row at each zero-based rank of the order (ascending, nulls first).

    Rows that agree in the whole key are taken in order of a hash of all columns, so a cut inside
    them is exact too; rows that are wholly alike stay on one side of it. A rank at the end or
    beyond has all rows before it.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    n = df.count() if n is None else n
    out = []
    for rank in ranks:
        if rank >= n:
            out.append(Cut(key, None))
            continue
        slim = df.select(key.alias("k"))
        found, below, same = _at(slim, n, rank, few, limits)
        limit = _literal(slim.schema["k"].dataType, found)
        if below == rank:
            out.append(Cut(key, limit))
            continue
        row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        tied = df.filter(key == limit).select(F.struct(row_hash.alias("h")).alias("k"))
        (place,), _, _ = _at(tied, same, rank - below, few, limits)
        out.append(Cut(key, limit, row_hash, place))
    return out

"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den, and ``empty`` when the denominator is zero or NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def uniform(seed, *ids: Column | str) -> Column:
    """A reproducible draw from [0, 1) per row, independent of partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *ids: Column | str) -> Column:
    """A reproducible standard normal draw (Box-Muller over two uniforms)."""
    u1 = F.lit(1.0) - uniform(f"{seed}a", *ids)
    u2 = uniform(f"{seed}b", *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounded on the binary value, ties to even."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, on epoch seconds of both."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def rounded(df, digits: int = 6):
    """Round every double column, for stable output: scaled, rounded to a whole, scaled back."""
    scale = F.lit(float(10**digits))
    return df.select(
        *[
            (F.round(F.col(f"`{n}`") * scale) / scale).alias(n)
            if t in ("double", "float")
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row frame as scalars."""
    return {name: one_row.select(name).scalar() for name in one_row.columns}


def row_scalars(one_row: DataFrame) -> dict[str, Column]:
    """The same as fields of one subquery; not for plans that are joined to themselves later on."""
    row = one_row.select(F.struct(*one_row.columns).alias("row")).scalar()
    return {name: row[name] for name in one_row.columns}

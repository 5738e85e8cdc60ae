"""Null-safe arithmetic and ranking on Columns. No NaN ever enters: what has no value is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def number(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)


def growth(new: Column, old: Column) -> Column:
    """Change against the size of the old value, so that a loss that shrinks counts as growth."""
    return F.when(old != 0, (new - old) / F.abs(old))


def cagr(new: Column, old: Column, years: int) -> Column:
    return F.when((new > 0) & (old > 0), F.pow(new / old, F.lit(1.0 / years)) - 1)


def truthy(c: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(c, F.lit(0.0))


def yes(c: Column) -> Column:
    """A predicate whose null means no."""
    return F.coalesce(c, F.lit(False))


def mean_of(*cols: Column) -> Column:
    """Mean of those that are not null; null if none is."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def labels(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts of those conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(yes(c), t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def average_rank(value: str | Column, by: list[str], order: Column | None = None) -> Column:
    """Rank of a non-null value among its partition's, in per cent, ties sharing their average. Null rows must be partitioned out."""
    order = order if order is not None else (F.col(value) if isinstance(value, str) else value)
    tied = Window.partitionBy(*by, order)
    return (F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(tied) - 1) / 2.0) / F.count(F.lit(1)).over(Window.partitionBy(*by)) * 100.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in df.schema.fields])

"""One meaning of missing for all operators: SQL NULL or NaN; infinities are never valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str) -> Column:
    """NULL or NaN; never NULL itself."""
    return col(c).isNull() | F.coalesce(F.isnan(col(c).cast("double")), F.lit(False))


def nan_to_null(c: Column | str) -> Column:
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def is_infinite(c: Column | str) -> Column:
    return F.coalesce(F.abs(col(c).cast("double")) == float("inf"), F.lit(False))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double; NULL where b is zero or an operand is missing."""
    return F.try_divide(nan_to_null(a), nan_to_null(b))


def close(a: Column | str, b: Column | str, *, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    """|a - b| <= atol + rtol |b|; a missing value is close to nothing, though Spark takes NaN for equal to itself."""
    return ~is_missing(a) & ~is_missing(b) & F.coalesce(F.abs(col(a) - col(b)) <= atol + rtol * F.abs(col(b)), F.lit(False))


def same(a: Column | str, b: Column | str) -> Column:
    """Exact equality that takes NaN and NULL positions as equal."""
    return col(a).eqNullSafe(col(b))

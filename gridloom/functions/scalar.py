"""Scalar functions as column expressions: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.missing import col


def snap_down(v: Column | str, step: float) -> Column:
    """The multiple of ``step`` at or under v."""
    return F.floor(col(v) / F.lit(float(step))) * F.lit(float(step))


def snap_up(v: Column | str, step: float) -> Column:
    return F.ceil(col(v) / F.lit(float(step))) * F.lit(float(step))


def half_even(v: Column | str) -> Column:
    """Nearest integer, ties to even (``round`` would take ties away from zero)."""
    return F.rint(col(v)).cast("long")


def floor_div(a: Column | str, b: Column | str | int) -> Column:
    """Floor division of integers; SQL's ``div`` truncates toward zero."""
    d = F.lit(b) if isinstance(b, int) else col(b)
    return ((col(a) - F.pmod(col(a), d)) / d).cast("long")


def aligned(v: Column | str, step: float, *, tol: float = 1e-9) -> Column:
    """Whether v lies on the lattice of ``step``."""
    r = F.pmod(col(v).cast("double"), F.lit(float(step)))
    return (r <= tol) | (r >= step - tol)


def padded_id(prefix: str, n: Column | str, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(col(n).cast("string")) >= width, col(n).cast("string")).otherwise(F.lpad(col(n).cast("string"), width, "0")))


def normalised_name(c: Column | str) -> Column:
    """Lower case with runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")


def year_of(c: Column | str) -> Column:
    """Year of a date or of text that may be one; NULL where it does not parse."""
    return F.year(F.try_to_timestamp(col(c).cast("string")))


def bin_right(x: Column | str, edges: list[float]) -> Column:
    """How many ascending edges are at or under x: bins closed on the left."""
    return sum((F.when(col(x) >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))


def colour(hex_code: Column | str) -> list[Column]:
    """Red, green and blue of ``#rrggbb``."""
    return [F.conv(F.substring(F.ltrim(col(hex_code), F.lit("#")), 1 + 2 * k, 2), 16, 10).cast("int").alias(n) for k, n in enumerate(("red", "green", "blue"))]


def host(url: Column | str) -> Column:
    return F.try_parse_url(col(url), F.lit("HOST"))


def has_query(url: Column | str) -> Column:
    return F.try_parse_url(col(url), F.lit("QUERY")).isNotNull()


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; missing stays missing."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def class_counts(classes: Column | str) -> Column:
    """Sorted array of (value, count) of an array's non-null elements."""
    present = F.filter(col(classes), lambda c: c.isNotNull())
    return F.transform(F.array_sort(F.array_distinct(present)), lambda v: F.struct(v.alias("value"), F.size(F.filter(present, lambda c: c == v)).alias("n")))


def is_subset(a: Column | str, b: Column | str) -> Column:
    """Whether every element of the first array is in the second; an empty one is."""
    return F.size(F.array_except(col(a), col(b))) == 0


def set_difference(a: Column | str, b: Column | str) -> Column:
    """Sorted distinct elements of the first array that the second lacks."""
    return F.array_sort(F.array_except(col(a), col(b)))


def set_union(a: Column | str, b: Column | str) -> Column:
    """Sorted distinct elements of both arrays."""
    return F.array_sort(F.array_union(col(a), col(b)))


def map_values(x: Column | str, pairs: dict, default: object = None) -> Column:
    """The value a small dictionary has for x, or ``default``."""
    flat = [F.lit(v) for kv in pairs.items() for v in kv]
    return F.coalesce(F.create_map(*flat)[col(x)], F.lit(default)) if pairs else F.lit(default)

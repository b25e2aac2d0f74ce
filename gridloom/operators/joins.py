"""Joins with proven cardinality."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.contracts import check_key, check_same_keys, require
from gridloom.missing import is_missing
from gridloom.session import cut


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", same_keys: bool = False) -> DataFrame:
    """Join after a proof that the key is unique and non-null on both sides (and, if asked, that the key sets are equal)."""
    check_key(left, key)
    check_key(right, key)
    if same_keys:
        check_same_keys(left, right, key)
    return left.join(right, key, how)


def join_features(tables: Sequence[DataFrame], key: str, *, how: str = "inner", prove: bool = False) -> DataFrame:
    """Chain of equi-joins on one key: the shuffles of all sides are on the key, so later joins reuse the partitioning.

    With ``prove`` the query fails on a key that comes out more than once, as it does if any table holds it twice; rows are counted where the joins put
    them, without another shuffle or another pass over the tables.
    """
    seen: set[str] = set()
    for t in tables:
        clash = seen & (set(t.columns) - {key})
        require(not clash, f"columns {sorted(clash)} occur in several tables")
        seen |= set(t.columns)
    out = reduce(lambda a, b: a.join(b, key, how), tables)
    if not prove:
        return out
    message = F.concat(F.lit(f"{key} occurs more than once: "), F.col(key).cast("string"))
    counted = out.withColumn("_times", F.count("*").over(Window.partitionBy(key)))
    return counted.where(F.when(F.col("_times") > 1, F.raise_error(message)).otherwise(F.lit(True))).drop("_times")


def left_with_indicator(left: DataFrame, right: DataFrame, key: str, *, indicator: str = "matched") -> DataFrame:
    """Left join with a boolean that tells matched rows from others."""
    return left.join(right.withColumn(indicator, F.lit(True)), key, "left").withColumn(indicator, F.coalesce(indicator, F.lit(False)))


def compare_columns(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose columns differ between two versions of a table, null-safe, with both values."""
    a = left.select(key, *[F.col(c).alias(f"{c}_left") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"{c}_right") for c in columns])
    differs = [~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")) for c in columns]
    return a.join(b, key).where(reduce(lambda x, y: x | y, differs))


def align_counts(df: DataFrame, population: str, names: Sequence[str], value: str) -> DataFrame:
    """Counts of each value in each population, zero where absent: one pass instead of a full outer join."""
    return df.groupBy(value).agg(*[F.count_if(F.col(population) == n).alias(f"{n}_count") for n in names])


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, *, name: str | None = None, default: object = None) -> DataFrame:
    """``df`` with ``value`` of the one row of ``mapping`` that has the row's ``key``, or ``default``; rows are neither lost nor doubled.

    The side is broadcast only where Spark knows its size; a doubled key of the mapping is an error.
    """
    name = name or value
    check_key(mapping, key)
    found = df.drop(*({name} - {key})).join(mapping.select(key, F.col(value).alias(name)), key, "left")
    return found if default is None else found.withColumn(name, F.coalesce(name, F.lit(default)))


def align_to(df: DataFrame, keys: DataFrame, key: str, *, order: str) -> DataFrame:
    """The rows of ``df`` for the keys of ``keys`` with their ``order`` column, to be sorted by; raises unless each key has one row."""
    check_key(keys, key)
    wanted = keys.select(key, order)
    check_key(df.join(wanted.select(key), key, "left_semi"), key)
    lacking = wanted.join(df.select(key), key, "left_anti").count()
    require(lacking == 0, f"{lacking} keys of {key} have no row")
    return wanted.join(df.drop(*({order} - {key})), key)


def _nearest_within(points: DataFrame, candidates: DataFrame, side: float) -> DataFrame:
    """pid and (d2, id) of the best candidate in the 3 x 3 squares around each point: the nearest of all if it is no farther than ``side``."""
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    steps = F.sequence(F.lit(-1), F.lit(1))
    p = points.select("pid", "px", "py", square("px").alias("i"), square("py").alias("j"))
    c = candidates.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    c = c.select("cid", "cx", "cy", (square("cx") + F.col("di")).alias("i"), (square("cy") + F.col("dj")).alias("j"))
    d2 = (F.col("px") - F.col("cx")) ** 2 + (F.col("py") - F.col("cy")) ** 2
    return p.join(c, ["i", "j"]).groupBy("pid").agg(F.min(F.struct(d2.alias("d2"), F.col("cid").alias("id"))).alias("b"))


def nearest(points: DataFrame, candidates: DataFrame, *, cell: float, point_id: str, candidate_id: str) -> DataFrame:
    """The nearest candidate (x, y) of every point (x, y), ties to the smaller id; both null for a point without coordinates, or without candidates.

    Null and NaN coordinates are missing: such points find nothing and such candidates are not found. Infinite ones are an error.

    Points are keyed by their square of side ``cell`` and candidates by the squares around theirs: an equi-join, with no pair of far squares. A hit is
    the nearest of all if it is no farther than a square's side; what is left is searched again with squares of twice the side, until a square holds all.
    """
    p = points.select(F.col(point_id).alias("pid"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    placed = lambda x, y: ~is_missing(x) & ~is_missing(y)
    c = candidates.where(placed("x", "y")).select(F.col(candidate_id).alias("cid"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"))
    todo, side, found = p.where(placed("px", "py")).distinct(), float(cell), []
    ends = [f(x) for x in ("px", "py") for f in (F.min, F.max)]
    low_x, high_x, low_y, high_y = todo.unionByName(c.select(F.lit(None).alias("pid"), F.col("cx").alias("px"), F.col("cy").alias("py"))).agg(*ends).first()
    span = 0.0 if low_x is None or low_y is None else max(high_x - low_x, high_y - low_y)
    require(math.isfinite(span), "a coordinate is infinite")
    while True:
        best = cut(_nearest_within(todo, c, side))
        settled = best if side > span else best.where(F.col("b.d2") <= side * side)
        found.append(settled)
        if side > span:
            break
        todo = cut(todo.join(settled.select("pid"), "pid", "left_anti"))
        if todo.isEmpty():
            break
        side *= 2
    b = reduce(DataFrame.unionByName, found)
    out = p.select("pid").distinct().join(b, "pid", "left")
    return out.select(F.col("pid").alias(point_id), F.col("b.id").alias(candidate_id), F.col("b.d2").alias("distance_squared"))


def box_join(left: DataFrame, right: DataFrame, *, size: float, buffer: float = 0.0) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1; r_x0 ... on the right) that touch once the left one is grown by ``buffer``.

    Both sides are keyed by the squares of side ``size`` they reach into; a pair is kept in its first shared square, so it comes once.
    """
    squares = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    x0, y0, x1, y1 = F.col("x0") - buffer, F.col("y0") - buffer, F.col("x1") + buffer, F.col("y1") + buffer
    a = left.withColumn("_i", F.explode(squares(x0, x1))).withColumn("_j", F.explode(squares(y0, y1)))
    b = right.withColumn("_i", F.explode(squares(F.col("r_x0"), F.col("r_x1")))).withColumn("_j", F.explode(squares(F.col("r_y0"), F.col("r_y1"))))
    touch = (x0 <= F.col("r_x1")) & (F.col("r_x0") <= x1) & (y0 <= F.col("r_y1")) & (F.col("r_y0") <= y1)
    first: Column = (F.col("_i") == F.floor(F.greatest(x0, F.col("r_x0")) / size)) & (F.col("_j") == F.floor(F.greatest(y0, F.col("r_y0")) / size))
    # the squares are many times what Spark takes the boxes for, so neither side may be broadcast on that estimate
    return a.join(b.hint("merge"), ["_i", "_j"]).where(touch & first).drop("_i", "_j")

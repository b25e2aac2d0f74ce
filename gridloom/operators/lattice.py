"""Regular lattices: snapping, grid generation, numbering, windows and batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.contracts import require
from gridloom.functions.scalar import half_even, padded_id


@dataclass(frozen=True)
class Extent:
    """Bounds in metres and a square cell size; rows count from the north, columns from the west."""

    x0: float
    y0: float
    x1: float
    y1: float
    cell: float

    def snapped(self) -> Extent:
        """Grown outward to whole cells."""
        c = self.cell
        return Extent(math.floor(self.x0 / c) * c, math.floor(self.y0 / c) * c, math.ceil(self.x1 / c) * c, math.ceil(self.y1 / c) * c, c)

    def with_halo(self, cells: int = 1) -> Extent:
        h = cells * self.cell
        return Extent(self.x0 - h, self.y0 - h, self.x1 + h, self.y1 + h, self.cell)

    @property
    def shape(self) -> tuple[int, int]:
        return round((self.y1 - self.y0) / self.cell), round((self.x1 - self.x0) / self.cell)


def integration_step(native: float, cell: int) -> int:
    """The largest whole number of metres that divides the cell and is not over the native resolution."""
    return max(n for n in range(1, int(native) + 1) if cell % n == 0)


def candidate_cells(spark: SparkSession, extent: Extent) -> DataFrame:
    """All cells of the snapped extent: row and column of the lattice (from the south-west), bounds and centre."""
    e = extent.snapped()
    rows, cols = e.shape
    # rows are spread over tasks; each makes its own columns
    grid = spark.range(rows).withColumnRenamed("id", "south_row").withColumn("west_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)).cast("array<long>")))
    x, y = F.lit(e.x0) + F.col("west_col") * e.cell, F.lit(e.y0) + F.col("south_row") * e.cell
    half = e.cell / 2
    return grid.select("south_row", "west_col", x.alias("x0"), y.alias("y0"), (x + e.cell).alias("x1"), (y + e.cell).alias("y1"), (x + half).alias("x"), (y + half).alias("y"))


def number_cells(cells: DataFrame, *, row: str = "south_row", col: str = "west_col", prefix: str = "cell_") -> DataFrame:
    """cell_id from 1, south to north and west to east.

    Counts by row come first and their running sum is the offset of each row, so no task sorts the whole grid.
    """
    per = cells.groupBy(row).agg(F.count("*").alias("_n"))
    before = per.select(F.col(row).alias("_row"), (F.sum("_n").over(Window.orderBy(row)) - F.col("_n")).alias("_before"))
    n = F.row_number().over(Window.partitionBy(row).orderBy(col)) + F.col("_before")
    return cells.join(before, F.col(row) == F.col("_row")).withColumn("number", n.cast("long")).withColumn("cell_id", padded_id(prefix, F.col("number"))).drop("_row", "_before")


def lattice_index(df: DataFrame, extent: Extent, *, x: str = "x", y: str = "y") -> DataFrame:
    """row_index (from the north) and column_index of centres, by half-even rounding."""
    half = extent.cell / 2
    r = half_even((F.lit(extent.y1) - half - F.col(y)) / extent.cell)
    c = half_even((F.col(x) - F.lit(extent.x0) - half) / extent.cell)
    return df.withColumn("row_index", r.cast("int")).withColumn("column_index", c.cast("int"))


def batch_plan(cells: DataFrame, size: int, *, row: str = "row_index", col: str = "column_index") -> DataFrame:
    """Occupied batches of size x size cells: batch_id, bounds of the window in cells, and cells in it."""
    br, bc = F.floor(F.col(row) / size), F.floor(F.col(col) / size)
    per = cells.groupBy(br.cast("long").alias("batch_row"), bc.cast("long").alias("batch_col")).agg(F.count("*").alias("cells"))
    return per.select(F.format_string("r%03d_c%03d", "batch_row", "batch_col").alias("batch_id"), "batch_row", "batch_col", (F.col("batch_row") * size).alias("row_start"), (F.col("batch_col") * size).alias("col_start"), "cells")


def processing_extent(cells: DataFrame, *, cell: float, block: int = 1) -> Extent:
    """The extent of square cells (x0, y0, x1, y1), grown outward to whole blocks of block x block cells from (0, 0); one aggregation.

    Raises unless there are cells, every cell is finite, has the side given and stands on the lattice, and no two share a place.
    """
    c, places = float(cell), [F.floor(F.col("x0") / cell), F.floor(F.col("y0") / cell)]
    at = cells.select("x0", "y0", "x1", "y1", *[p.alias(n) for p, n in zip(places, ("i", "j"), strict=True)])
    bad = lambda cond: F.count_if(~F.coalesce(cond, F.lit(False)))
    finite = F.greatest(*[F.abs(F.col(n).cast("double")) for n in ("x0", "y0", "x1", "y1")]) < 1e300
    sided = (F.col("x1") - F.col("x0") == c) & (F.col("y1") - F.col("y0") == c)
    aligned = (F.col("x0") == F.col("i") * c) & (F.col("y0") == F.col("j") * c)
    per = at.groupBy("i", "j").agg(F.count("*").alias("n"), *[bad(x).alias(n) for x, n in ((finite, "infinite"), (sided, "side"), (aligned, "off"))], F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    r = per.agg(F.sum("n").alias("n"), F.count("*").alias("places"), *[F.sum(n).alias(n) for n in ("infinite", "side", "off")], F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    require(bool(r["n"]), "there are no cells")
    require(not r["infinite"] and not r["side"] and not r["off"], f"{r['infinite']} cells without finite bounds, {r['side']} of another side, {r['off']} off the lattice")
    require(r["n"] == r["places"], f"{r['n'] - r['places']} cells share a place with another")
    e = Extent(float(r["x0"]), float(r["y0"]), float(r["x1"]), float(r["y1"]), c * block).snapped()
    return Extent(e.x0, e.y0, e.x1, e.y1, c)


def native_windows(batches: DataFrame, *, origin: tuple[float, float], pixel: float, halo: int = 1, most_rows: int, most_cols: int) -> DataFrame:
    """``batches`` (with the bounds x0, y0, x1, y1 of each) and its window on a native raster as columns: row_off, col_off, height, width, and wx0, wy0, wx1, wy1.

    Bounds grow outward to whole native pixels from ``origin`` (the north-west corner) and ``halo`` more. A window over a service's limits fails the query that reads it.
    """
    x, y = origin
    c0, c1 = F.floor((F.col("x0") - x) / pixel) - halo, F.ceil((F.col("x1") - x) / pixel) + halo
    r0, r1 = F.floor((F.lit(y) - F.col("y1")) / pixel) - halo, F.ceil((F.lit(y) - F.col("y0")) / pixel) + halo
    w = batches.withColumns({"row_off": r0.cast("long"), "col_off": c0.cast("long"), "height": (r1 - r0).cast("long"), "width": (c1 - c0).cast("long")})
    message = F.concat(F.lit("a window of "), F.col("height").cast("string"), F.lit(" x "), F.col("width").cast("string"), F.lit(" pixels is over the limit"))
    w = w.where(F.when((F.col("height") > most_rows) | (F.col("width") > most_cols), F.raise_error(message)).otherwise(F.lit(True)))
    edges = {"wx0": x + F.col("col_off") * pixel, "wy0": y - (F.col("row_off") + F.col("height")) * pixel, "wx1": x + (F.col("col_off") + F.col("width")) * pixel, "wy1": y - F.col("row_off") * pixel}
    return w.withColumns({k: v.cast("double") for k, v in edges.items()})

"""The engine's concepts over stored tables: parts are cells, line items are raster samples, some parts carry a fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import padded_id

#: Cells to a row of the grid, side of a cell, side of a block in cells.
WIDTH, SIDE, BLOCK = 50, 1000, 10
#: Share of a cell from which it is positive; between 0 and it a cell is ambiguous.
POSITIVE_FROM = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, key, row, col, bounds and centre of each cell."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(padded_id("cell_", k + 1).alias("cell_id"), k.alias("key"), F.expr(f"p_partkey div {WIDTH}").alias("row"), (k % WIDTH).alias("col"))
    x0, y0 = F.col("col") * SIDE, F.col("row") * SIDE
    return part.select("*", x0.alias("x0"), y0.alias("y0"), (x0 + SIDE).alias("x1"), (y0 + SIDE).alias("y1"), (x0 + SIDE / 2).alias("x"), (y0 + SIDE / 2).alias("y"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of fires."""
    p = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'")
    x0 = F.col("p_partkey") % WIDTH * SIDE + (F.col("p_size") * 37) % SIDE
    y0 = F.expr(f"p_partkey div {WIDTH}") * SIDE + (F.col("p_size") * 53) % SIDE
    return p.select(F.col("p_partkey").alias("fire_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 300 + F.col("p_size") * 40).alias("x1"), (y0 + 200 + F.col("p_size") * 30).alias("y1"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster samples of the cells: value with gaps, second band (prices in whole cents: their sums are exact in any order), class with NoData, item and tie-breakers."""
    v = F.when(F.col("l_suppkey") % 23 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    c = F.when(F.col("l_suppkey") % 11 == 0, F.lit(-9999)).otherwise((F.col("l_suppkey") % 7).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), v.alias("value"), F.rint(F.col("l_extendedprice") * 100).alias("band2"), c.alias("class"), F.col("l_linenumber").alias("item"), F.col("l_orderkey").alias("ord"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with burned_fraction, target (ambiguous ones left out), block and a score with ties."""
    from gridloom.operators.geometry import burned_fraction
    from gridloom.operators.spatial import assign_blocks

    c = cells(spark, sf_dir)
    burned = burned_fraction(c.select("cell_id", "x0", "y0", "x1", "y1"), fires(spark, sf_dir), size=4.0 * SIDE)
    target = F.when(F.col("burned_fraction") == 0, 0).when(F.col("burned_fraction") >= POSITIVE_FROM, 1)
    rows = c.join(burned, "cell_id").withColumn("target", target).where("target IS NOT NULL")
    score = ((F.col("col") * 7 + F.col("key") * 13) % 101 / 100.0).cast("double")
    return assign_blocks(rows, anchor=(0.0, 0.0), size=float(BLOCK * SIDE)).withColumn("p", score)


def features(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Terrain, precipitation and vegetation tables, one row a cell; some terrain values are missing."""
    from gridloom.operators.raster import plurality, zonal

    s = samples(spark, sf_dir)
    ids = cells(spark, sf_dir).select("key", "cell_id")
    gap = F.when(F.col("key") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value_mean"))
    terrain = zonal(s, ["key"], ["value"]).select("key", gap.alias("elevation_mean"), F.col("value_std").alias("elevation_std"))
    rain = zonal(s, ["key"], ["band2"], skip_missing=False).select("key", F.col("band2_mean").alias("annual_precip_mean"))
    plants = plurality(s, ["key"], "class", nodata=-9999).select("key", F.col("dominant_class").alias("evt_dominant_class"), F.col("dominant_fraction").alias("evt_dominant_fraction"))
    return [t.join(ids, "key").drop("key") for t in (terrain, rain, plants)]


def modelling(spark: SparkSession, sf_dir: str, *, prove: bool = False) -> DataFrame:
    """The modelling dataset: features of labelled cells with target, block and score; with ``prove`` a cell that any table holds twice is an error."""
    from gridloom.operators.joins import join_features

    base = labelled(spark, sf_dir).select("cell_id", "burned_fraction", "target", "spatial_block_id", "block_row", "block_col", "p")
    return join_features([base, *features(spark, sf_dir)], "cell_id", prove=prove)


def point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0, y0, x1, y1):
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires as polygons of two parts: a rectangle with a hole in its middle third, and a smaller one 150 m east of it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = F.expr("(x1 - x0) div 3"), F.expr("(y1 - y0) div 3")
    rings = F.array(box_ring(x1 + 150, y0, x1 + 150 + w, y0 + h), box_ring(x0 + w, y0 + h, x0 + 2 * w, y0 + 2 * h), box_ring(x0, y0, x1, y1))
    return fires(spark, sf_dir).select("fire_id", rings.alias("rings"))

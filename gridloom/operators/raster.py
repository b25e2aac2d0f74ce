"""Rasters in long form (row, col, value): mosaics, neighbourhoods, zones, classes and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.contracts import require
from gridloom.missing import is_missing, nan_to_null
from gridloom.operators.stats import quantiles


def mosaic_first_valid(samples: DataFrame, *, order: list[str], value: str = "value", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """For each pixel the first non-missing value in the order of the items: earlier items win, later ones fill gaps.

    One aggregation with partial minima; no sort of a pixel's items.
    """
    first = F.min(F.when(~is_missing(value), F.struct(*order, F.col(value).alias("_v"))))
    return samples.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col("_f._v").alias(value))


def neighbourhood(raster: DataFrame, *, value: str = "value", row: str = "row", col: str = "col", tile: int = 512) -> DataFrame:
    """Each pixel's 3 x 3 values as columns v_<dr>_<dc> (m, z, p for -1, 0, 1); NULL beyond the edge.

    Pixels are copied to the up to four tiles they border (a copy of under 1% at this tile size), and all nine values meet
    in windows inside a tile, whatever the width of the raster.
    """
    names = {-1: "m", 0: "z", 1: "p"}
    here_r, here_c = F.floor(F.col(row) / tile), F.floor(F.col(col) / tile)
    around = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / tile), F.floor(F.col(c) / tile), F.floor((F.col(c) + 1) / tile)))
    halo = raster.select(row, col, F.col(value).cast("double").alias("_v")).withColumn("_tr", F.explode(around(row))).withColumn("_tc", F.explode(around(col)))
    w = Window.partitionBy("_tr", "_tc", row).orderBy(col)
    near = lambda c, off: F.when(F.lag(col, -off).over(w) == F.col(col) + off, F.lag(c, -off).over(w)) if off else F.col(c)
    triple = halo.withColumn("_t", F.struct(near("_v", -1).alias("m"), F.col("_v").alias("z"), near("_v", 1).alias("p")))
    v = Window.partitionBy("_tr", "_tc", col).orderBy(row)
    up = lambda off: F.when(F.lag(row, -off).over(v) == F.col(row) + off, F.lag("_t", -off).over(v)) if off else F.col("_t")
    rows = triple.withColumn("_up", up(-1)).withColumn("_down", up(1)).where((F.col("_tr") == here_r) & (F.col("_tc") == here_c))
    cell = lambda s, n: F.col(f"{s}.{n}")
    cols = [cell({-1: "_up", 0: "_t", 1: "_down"}[dr], names[dc]).alias(f"v_{names[dr]}_{names[dc]}") for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    return rows.select(row, col, *cols)


def slope_aspect(raster: DataFrame, *, cell: float, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Slope in degrees and aspect in compass degrees by Horn's weights; rows count southward.

    Pixels with a missing neighbour have neither; flat pixels have slope 0 and no aspect.
    """
    n = neighbourhood(raster.withColumn(value, nan_to_null(value)), value=value, row=row, col=col)
    v = lambda a, b: F.col(f"v_{a}_{b}")
    dx = ((v("m", "p") + 2 * v("z", "p") + v("p", "p")) - (v("m", "m") + 2 * v("z", "m") + v("p", "m"))) / (8 * cell)
    dy = ((v("p", "m") + 2 * v("p", "z") + v("p", "p")) - (v("m", "m") + 2 * v("m", "z") + v("m", "p"))) / (8 * cell)
    whole = ~F.col("v_z_z").isNull()
    flat = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    angle = F.degrees(F.atan2(F.col("_dy"), -F.col("_dx")))
    compass = F.when(angle < 0, 90 - angle).when(angle > 90, 450 - angle).otherwise(90 - angle)
    out = n.where(whole).withColumn("_dx", dx).withColumn("_dy", dy)
    return out.select(row, col, F.degrees(F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2))).alias("slope"), F.when(~flat, compass).alias("aspect"))


def circular_aspect(df: DataFrame, zone: list[str], *, aspect: str = "aspect") -> DataFrame:
    """aspect_sin_mean, aspect_cos_mean and aspect_strength of the zones; missing aspects don't count."""
    a = F.radians(nan_to_null(aspect))
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return df.groupBy(*zone).agg(s.alias("aspect_sin_mean"), c.alias("aspect_cos_mean")).withColumn("aspect_strength", F.hypot("aspect_sin_mean", "aspect_cos_mean"))


def zonal(samples: DataFrame, zone: list[str], values: list[str], *, skip_missing: bool = True, expected: int | None = None) -> DataFrame:
    """count, <v>_mean and <v>_std (population) for each zone, in double.

    ``skip_missing=False`` makes a zone with a missing sample missing. With ``expected``, ``complete`` tells whether it has that many samples.
    """
    parts: list[Column] = [F.count("*").alias("count")]
    for v in values:
        x = nan_to_null(v)
        any_missing = F.max(is_missing(v).cast("int")) == 1
        for name, f in (("mean", F.avg(x)), ("std", F.stddev_pop(x))):
            parts.append((f if skip_missing else F.when(~any_missing, f)).alias(f"{v}_{name}"))
    out = samples.groupBy(*zone).agg(*parts)
    return out if expected is None else out.withColumn("complete", F.col("count") == expected)


def coarsen(raster: DataFrame, k: int, *, value: str = "value", row: str = "row", col: str = "col", skip_missing: bool = True) -> DataFrame:
    """Blocks of k x k pixels."""
    keyed = raster.withColumn("block_row", F.floor(F.col(row) / k).cast("long")).withColumn("block_col", F.floor(F.col(col) / k).cast("long"))
    return zonal(keyed, ["block_row", "block_col"], [value], skip_missing=skip_missing, expected=k * k)


def plurality(samples: DataFrame, zone: list[str], value: str, *, nodata: int | None = None) -> DataFrame:
    """Dominant class, its share of the valid samples, coverage, tie flag and tied classes; ties go to the smallest code.

    Two aggregations: by zone and class, then by zone over its few classes. A zone without valid samples has a null class and share.
    """
    valid = F.col(value).isNotNull() if nodata is None else F.col(value).isNotNull() & (F.col(value) != nodata)
    per = samples.groupBy(*zone, F.when(valid, F.col(value)).alias("_class")).agg(F.count("*").alias("_n"))
    has = F.col("_class").isNotNull()
    won = F.max(F.when(has, F.col("_n")))
    counts = F.collect_list(F.when(has, F.struct(F.col("_n").alias("n"), F.col("_class").alias("c"))))
    out = per.groupBy(*zone).agg(
        F.sum("_n").alias("total_positions"), F.coalesce(F.sum(F.when(has, F.col("_n"))), F.lit(0)).alias("valid_sample_count"),
        F.coalesce(won, F.lit(0)).alias("winning_sample_count"), F.count("_class").alias("number_of_classes"), counts.alias("_counts"),
    )
    tied = F.array_sort(F.transform(F.filter("_counts", lambda s: s["n"] == F.col("winning_sample_count")), lambda s: s["c"]))
    out = out.withColumn("tied_classes", tied)
    share = F.try_divide(F.col("winning_sample_count").cast("double"), F.col("valid_sample_count").cast("double"))
    return out.select(
        *zone, F.when(F.size("tied_classes") > 0, F.element_at("tied_classes", 1)).alias("dominant_class"), share.alias("dominant_fraction"), "total_positions", "valid_sample_count",
        (F.col("total_positions") - F.col("valid_sample_count")).alias("nodata_sample_count"), "winning_sample_count", "number_of_classes",
        (F.col("valid_sample_count").cast("double") / F.col("total_positions")).alias("valid_fraction"), (F.size("tied_classes") > 1).alias("plurality_tie"), "tied_classes",
    )


def coverage_report(table: DataFrame, *, key: str, most_frequent: int = 10) -> DataFrame:
    """The coverage of a plurality table before any gate, as rows (metric, item, value): counts of zones by support, ties, missing values and invalid shares, the least, median
    and most valid samples, quartiles of the share, and the most frequent classes (item is the class; equal counts by the smaller one). Quantiles are exact and interpolated.
    """
    from gridloom.missing import is_missing
    from gridloom.operators.stats import quantiles

    valid, total, share = F.col("valid_sample_count"), F.col("total_positions"), F.col("dominant_fraction")
    d = lambda c: c.cast("double")
    counts = {
        "zones": F.count("*"), "full_coverage": F.count_if(valid == total), "partial_coverage": F.count_if((valid > 0) & (valid < total)), "zero_valid": F.count_if(valid == 0),
        "nodata_positions": F.sum("nodata_sample_count"), "unique_winner": F.count_if((valid > 0) & ~F.col("plurality_tie")), "exact_tie": F.count_if(F.col("plurality_tie")),
        "exact_tie_percent": F.avg(d(F.col("plurality_tie").cast("int"))) * 100, "valid_samples_min": F.min(valid), "valid_samples_max": F.max(valid),
        "share_min": F.min(share), "share_mean": F.avg(share), "share_max": F.max(share), "invalid_shares": F.count_if(is_missing(share) | (share <= 0) | (share > 1)),
        **{f"missing_{c}": F.count_if(is_missing(c) if dict(table.dtypes)[c] in ("double", "float") else F.col(c).isNull()) for c in (key, "dominant_class", "dominant_fraction")},
    }
    one = table.agg(*[d(v).alias(k) for k, v in counts.items()]).unpivot([], list(counts), "metric", "value")
    per_class = table.where("dominant_class IS NOT NULL").groupBy("dominant_class").agg(F.count("*").alias("n"))
    kinds = per_class.agg(d(F.count("*")).alias("value")).select(F.lit("dominant_classes").alias("metric"), "value")
    keys = table.groupBy(key).agg(F.count("*").alias("n")).agg(d(F.count(key)).alias("unique_keys"), d(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).alias("duplicate_keys")).unpivot([], ["unique_keys", "duplicate_keys"], "metric", "value")
    whole, quarters = table.withColumn("_all", F.lit(1)), {"share_25": 0.25, "share_50": 0.5, "share_75": 0.75}
    middle = quantiles(whole, ["_all"], "valid_sample_count", {"valid_samples_median": 0.5}).unpivot([], ["valid_samples_median"], "metric", "value")
    shares = quantiles(whole, ["_all"], "dominant_fraction", quarters).unpivot([], list(quarters), "metric", "value")
    top = per_class.orderBy(F.desc("n"), "dominant_class").limit(most_frequent).select(F.lit("class_count").alias("metric"), F.col("dominant_class").cast("string").alias("item"), d(F.col("n")).alias("value"))
    rest = one.unionByName(kinds).unionByName(keys).unionByName(middle).unionByName(shares)
    return rest.select("metric", F.lit(None).cast("string").alias("item"), "value").unionByName(top)


def resample_nearest(points: DataFrame, raster: DataFrame, *, x0: float, y0: float, cell: float, value: str = "value") -> DataFrame:
    """``points`` (x, y) with the value of the pixel they fall in; rows count southward from y0, columns eastward from x0. No new codes arise."""
    keyed = points.withColumn("_r", F.floor((F.lit(y0) - F.col("y")) / cell).cast("long")).withColumn("_c", F.floor((F.col("x") - x0) / cell).cast("long"))
    pixels = raster.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), value)
    return keyed.join(pixels, ["_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(points: DataFrame, raster: DataFrame, key: str, *, x0: float, y0: float, cell: float, value: str = "value") -> DataFrame:
    """key and the bilinear value at each point, from the four surrounding pixel centres; NULL if one is missing.

    Each point asks for its four pixels by key, so the raster is joined once and never searched.
    """
    u, v = (F.col("x") - x0) / cell - 0.5, (F.lit(y0) - F.col("y")) / cell - 0.5
    base = points.select(key, u.alias("_u"), v.alias("_v")).withColumn("_c0", F.floor("_u").cast("long")).withColumn("_r0", F.floor("_v").cast("long"))
    fu, fv = F.col("_u") - F.col("_c0"), F.col("_v") - F.col("_r0")
    corner = lambda dr, dc, w: F.struct((F.col("_r0") + dr).alias("r"), (F.col("_c0") + dc).alias("c"), w.alias("w"))
    four = base.select(key, F.explode(F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)), corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv))).alias("q"))
    asked = four.select(key, F.col("q.r").alias("_r"), F.col("q.c").alias("_c"), F.col("q.w").alias("_w")).where("_w > 0")
    pixels = raster.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), nan_to_null(value).alias("_x"))
    got = asked.join(pixels, ["_r", "_c"], "left").groupBy(key).agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.count_if(F.col("_x").isNull()).alias("_gaps"))
    return got.select(key, F.when(F.col("_gaps") == 0, F.col("_s")).alias(value))


def overlap_differences(items: DataFrame, *, item: str = "item", value: str = "value") -> DataFrame:
    """For each pair of items, how their values differ where both are valid: pixels, mean, largest and zero differences."""
    ok = items.where(~is_missing(value))
    a, b = ok.select("row", "col", F.col(item).alias("item_a"), F.col(value).alias("_a")), ok.select("row", "col", F.col(item).alias("item_b"), F.col(value).alias("_b"))
    d = F.col("_a") - F.col("_b")
    return a.join(b, ["row", "col"]).where("item_a < item_b").groupBy("item_a", "item_b").agg(
        F.count("*").alias("pixels"), F.avg(d).alias("mean_difference"), F.max(F.abs(d)).alias("largest_difference"), F.count_if(d == 0).alias("equal_pixels")
    )


def column_jumps(raster: DataFrame, *, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Mean absolute step into each column from its western neighbour, and the 99th percentile of all steps."""
    w = Window.partitionBy(row).orderBy(col)
    step = F.when(F.lag(col).over(w) == F.col(col) - 1, F.abs(F.col(value) - F.lag(value).over(w)))
    steps = raster.select(col, step.alias("_s")).where("_s IS NOT NULL")
    limit = quantiles(steps.select(F.lit(0).alias("_all"), "_s"), ["_all"], "_s", {"p99": 0.99}).drop("_all")
    per = steps.groupBy(col).agg(F.avg("_s").alias("mean_jump"), F.count("*").alias("steps"))
    return per.join(F.broadcast(limit)).withColumn("over_p99", F.col("mean_jump") > F.col("p99"))


def rasterise(cells: DataFrame, *, x0: float, y1: float, cell: float, value: str) -> DataFrame:
    """row, col, value of square cells by their centres (x, y); raises if two cells share a pixel."""
    from gridloom.contracts import check_key

    out = cells.select(F.floor((F.lit(y1) - F.col("y")) / cell).cast("int").alias("row"), F.floor((F.col("x") - x0) / cell).cast("int").alias("col"), value)
    check_key(out, ["row", "col"])
    return out


def stack_items(items: Sequence[DataFrame], *, value: str = "value") -> DataFrame:
    """Rasters of several items on one lattice as one long table (item, row, col, value), in the order given: the earlier an item, the lower its number."""
    require(len(items) > 0, "nothing to stack")
    return reduce(DataFrame.unionByName, [r.select(F.lit(i).alias("item"), "row", "col", value) for i, r in enumerate(items)])


def partial_support(zones: DataFrame, native: DataFrame, *, key: str, side: int, step: float, origin: tuple[float, float], pixel: float, nodata: int, value: str = "value") -> DataFrame:
    """key, source_nodata, unsupported and agrees of each zone that is covered in part, told from the native raster alone.

    ``zones`` has the key, x0 and y1 (its north-west corner), total_positions, valid_sample_count and nodata_sample_count. Its side x side sample centres, ``step`` apart,
    are looked up by index in ``native`` (row, col from ``origin``, NoData pixels included): a position without a pixel is unsupported, one with NoData a gap of the source.
    """
    partial = zones.where("valid_sample_count < total_positions").select(key, "x0", "y1", "nodata_sample_count")
    spots = F.sequence(F.lit(0), F.lit(side - 1))
    at = partial.withColumn("_i", F.explode(spots)).withColumn("_j", F.explode(spots))
    row = F.floor((F.lit(origin[1]) - F.col("y1") + (F.col("_i") + 0.5) * step) / pixel).cast("long")
    col = F.floor((F.col("x0") + (F.col("_j") + 0.5) * step - origin[0]) / pixel).cast("long")
    pixels = native.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias("_v"), F.lit(1).alias("_there"))
    met = at.withColumn("_r", row).withColumn("_c", col).join(pixels, ["_r", "_c"], "left")
    per = met.groupBy(key).agg(F.count_if(F.col("_v") == nodata).alias("source_nodata"), F.count_if(F.col("_there").isNull()).alias("unsupported"), F.max("nodata_sample_count").alias("_n"))
    return per.select(key, "source_nodata", "unsupported", ((F.col("unsupported") == 0) & (F.col("source_nodata") == F.col("_n"))).alias("agrees"))


def check_support(report: DataFrame) -> None:
    """Raises if a zone lacks native pixels or its gaps are not the source's."""
    r = report.agg(F.count_if(F.col("unsupported") > 0).alias("unsupported"), F.count_if(~F.col("agrees")).alias("differ")).first()
    require(not r["unsupported"] and not r["differ"], f"{r['unsupported']} zones without support, {r['differ']} whose gaps are not the source's")

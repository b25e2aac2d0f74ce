"""Planar geometry as column expressions; general polygons by Arrow batches.

Boxes are columns x0, y0, x1, y1. Polygons are arrays of rings in any order, a ring being a closed array of struct<x, y>: a ring in an odd number of others is
a hole, all others are shells, so a polygon may have several parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Albers equal-area conic on GRS80 for the conterminous United States: latitudes of the standard parallels and the origin, longitude of the origin.
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0, "a": 6378137.0, "f": 1 / 298.257222101}
RING = "array<struct<x:double,y:double>>"


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))


def box_overlap(a: str = "", b: str = "r_") -> Column:
    """Area two boxes share; 0 if the right one is absent, as after a left join."""
    c = F.col
    area = box_area(F.greatest(c(f"{a}x0"), c(f"{b}x0")), F.greatest(c(f"{a}y0"), c(f"{b}y0")), F.least(c(f"{a}x1"), c(f"{b}x1")), F.least(c(f"{a}y1"), c(f"{b}y1")))
    return F.when(c(f"{b}x0").isNull(), 0.0).otherwise(area.cast("double"))


def buffer_box(df: DataFrame, by: float) -> DataFrame:
    """Boxes grown on all sides, with square corners."""
    return df.withColumns({"x0": F.col("x0") - by, "y0": F.col("y0") - by, "x1": F.col("x1") + by, "y1": F.col("y1") + by})


def covered_area(pairs: DataFrame, key: str) -> DataFrame:
    """Exact area of each cell that the union of its boxes covers (boxes already cut to the cell; columns x0, y0, x1, y1).

    The edges of a cell's boxes cut it into slabs; a slab of x and a slab of y make a rectangle that is either in a box or not, and is
    counted once however many boxes hold it.
    """
    axis = lambda lo, hi, n: (
        pairs.select(key, F.explode(F.array(lo, hi)).alias(n)).distinct().withColumn(f"{n}_next", F.lead(n).over(Window.partitionBy(key).orderBy(n))).where(f"{n}_next IS NOT NULL")
    )
    xs, ys = axis("x0", "x1", "ax"), axis("y0", "y1", "ay")
    wide = pairs.select(key, "x0", "y0", "x1", "y1").join(xs, key).where("x0 <= ax AND ax_next <= x1")
    rectangles = wide.select(key, "ax", "ax_next", "y0", "y1").distinct().join(ys, key).where("y0 <= ay AND ay_next <= y1").select(key, "ax", "ax_next", "ay", "ay_next").distinct()
    return rectangles.groupBy(key).agg(F.sum((F.col("ax_next") - F.col("ax")) * (F.col("ay_next") - F.col("ay"))).cast("double").alias("covered_area"))


def coverage_gap(cells: DataFrame, boxes: DataFrame, key: str, *, size: float) -> DataFrame:
    """Area of each cell that no box covers."""
    from gridloom.operators.joins import box_join

    pairs = cut_pairs(box_join(cells, boxes, size=size))
    area = box_area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return cells.select(key, area.cast("double").alias("area")).join(covered_area(pairs, key), key, "left").select(key, (F.col("area") - F.coalesce("covered_area", F.lit(0.0))).alias("gap_area"))


def cut_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of a box join with x0 ... y1 set to what both boxes share; pairs that share no area go."""
    cut = {"x0": F.greatest("x0", "r_x0"), "y0": F.greatest("y0", "r_y0"), "x1": F.least("x1", "r_x1"), "y1": F.least("y1", "r_y1")}
    return pairs.withColumns(cut).where("x0 < x1 AND y0 < y1")


def burned_fraction(cells: DataFrame, fires: DataFrame, *, key: str = "cell_id", size: float = 1000.0) -> DataFrame:
    """key, burned_area_m2 and burned_fraction of every cell: the union of the fires in it, so repeated burning counts once."""
    from gridloom.operators.joins import box_join

    boxes = fires.select(*[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    burned = covered_area(cut_pairs(box_join(cells, boxes, size=size)), key)
    area = box_area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("double")
    out = cells.select(key, area.alias("_area")).join(burned, key, "left").withColumn("burned_area_m2", F.coalesce("covered_area", F.lit(0.0)))
    # only rounding may exceed the cell
    return out.select(key, "burned_area_m2", F.least(F.col("burned_area_m2") / F.col("_area"), F.lit(1.0)).alias("burned_fraction"))


def _pairs(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring (positive counter-clockwise)."""
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the east meets the ring an odd number of times."""

    def crosses(e: Column) -> Column:
        side = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return ((e["ay"] > y) != (e["by"] > y)) & F.when(e["by"] > e["ay"], side > 0).otherwise(side < 0)

    return F.aggregate(_pairs(ring), F.lit(False), lambda odd, e: odd != crosses(e))


def inner_point(ring: Column) -> Column:
    """struct<x, y> of a point strictly inside a ring that does not meet itself, between its two lowest heights; NULL for a flat ring."""
    ys = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    y = (F.get(ys, 0) + F.get(ys, 1)) / 2
    spans = F.filter(_pairs(ring), lambda e: (e["ay"] > y) != (e["by"] > y))
    xs = F.array_sort(F.transform(spans, lambda e: e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])))
    return F.when(F.size(ys) > 1, F.struct(((F.get(xs, 0) + F.get(xs, 1)) / 2).alias("x"), y.alias("y")))


def is_hole(ring: Column, rings: Column) -> Column:
    """Whether an odd number of the larger rings hold a point inside the ring; rings may touch each other."""
    point, size = inner_point(ring), F.abs(ring_area(ring))
    return F.size(F.filter(rings, lambda q: (F.abs(ring_area(q)) > size) & ring_holds(q, point["x"], point["y"]))) % 2 == 1


def polygon_area(rings: Column) -> Column:
    """Area of all parts without their holes."""
    signed = F.transform(rings, lambda r: F.abs(ring_area(r)) * F.when(is_hole(r, rings), -1.0).otherwise(1.0))
    return F.aggregate(signed, F.lit(0.0), lambda s, a: s + a)


def polygon_bounds(rings: Column) -> Column:
    """struct<x0, y0, x1, y1> over all rings."""
    return ring_bounds(F.flatten(rings))


def footprint(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A valid polygon, or the ring of its box where there is none."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))
    return F.when(rings.isNotNull() & valid_polygon(rings), rings).otherwise(box)


def geometry_changes(left: DataFrame, right: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """Keys whose binary geometries differ; null equals null."""
    a, b = left.select(key, F.sha2(geometry, 256).alias("_a")), right.select(key, F.sha2(geometry, 256).alias("_b"))
    return a.join(b, key).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def coordinate_slice(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes that meet a box, edges included: plain comparisons, so they reach the scan."""
    return df.where(f"x0 <= {x1} AND x1 >= {x0} AND y0 <= {y1} AND y1 >= {y0}")


def ring_centroid(ring: Column) -> Column:
    """struct<x, y> of a ring's centroid; NULL without area."""
    part = lambda f: F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + f(e) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))
    a = ring_area(ring)
    return F.struct(F.try_divide(part(lambda e: e["ax"] + e["bx"]), 6 * a).alias("x"), F.try_divide(part(lambda e: e["ay"] + e["by"]), 6 * a).alias("y"))


def ring_bounds(ring: Column) -> Column:
    f = lambda g, k: g(F.transform(ring, lambda p: p[k]))
    return F.struct(f(F.array_min, "x").alias("x0"), f(F.array_min, "y").alias("y0"), f(F.array_max, "x").alias("x1"), f(F.array_max, "y").alias("y1"))


def valid_polygon(rings: Column) -> Column:
    """Non-empty, rings closed with four points at least, finite coordinates and non-zero area; nothing is repaired."""
    fine = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, lambda p: F.abs(p["x"]).between(0, 1e300) & F.abs(p["y"]).between(0, 1e300))
    ok = F.forall(rings, lambda r: fine(r) & (ring_area(r) != 0))
    return F.coalesce((F.size(rings) > 0) & ok, F.lit(False))


def points_within(points: DataFrame, edges: DataFrame, *, key: str, band: float) -> DataFrame:
    """Points (key, x, y) strictly inside a polygon given as edges (ax, ay, bx, by): the boundary is outside.

    A ray to the east meets an odd number of edges. Edges are keyed by the bands of y they cross, so a point meets only edges of its band.
    """
    bands = F.sequence(F.floor(F.least("ay", "by") / band).cast("long"), F.floor(F.greatest("ay", "by") / band).cast("long"))
    e = edges.select("ax", "ay", "bx", "by", F.explode(bands).alias("_band"))
    p = points.select(key, "x", "y", F.floor(F.col("y") / band).cast("long").alias("_band"))
    cross = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    east = F.when(F.col("by") > F.col("ay"), cross > 0).otherwise(cross < 0)
    on = (cross == 0) & F.col("x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & F.col("y").between(F.least("ay", "by"), F.greatest("ay", "by"))
    hits = p.join(e, "_band").groupBy(key).agg(F.count_if(spans & east).alias("n"), F.max(on.cast("int")).alias("edge"))
    return points.join(hits.where("n % 2 = 1 AND edge = 0").select(key), key, "left_semi")


def edges_of(rings: Column) -> Column:
    """Array of the edges of all rings, to be exploded."""
    return F.flatten(F.transform(rings, _pairs))


def outline(cells: DataFrame) -> DataFrame:
    """Boundary edges of a union of lattice squares: those that one square alone has."""
    c = F.col
    side = lambda ax, ay, bx, by: F.struct(c(ax).alias("ax"), c(ay).alias("ay"), c(bx).alias("bx"), c(by).alias("by"))
    sides = cells.select(F.explode(F.array(side("x0", "y0", "x1", "y0"), side("x0", "y1", "x1", "y1"), side("x0", "y0", "x0", "y1"), side("x1", "y0", "x1", "y1"))).alias("e"))
    return sides.groupBy("e.ax", "e.ay", "e.bx", "e.by").count().where("count = 1").drop("count")


def albers(lon: Column, lat: Column, p: dict[str, float] = ALBERS) -> tuple[Column, Column]:
    """Easting and northing of geographic coordinates (ellipsoidal Albers, no datum shift)."""
    e2 = 2 * p["f"] - p["f"] ** 2
    e = math.sqrt(e2)
    q0 = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m0 = lambda r: math.cos(r) / math.sqrt(1 - e2 * math.sin(r) ** 2)
    r1, r2, r0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m0(r1) ** 2 - m0(r2) ** 2) / (q0(math.sin(r2)) - q0(math.sin(r1)))
    c = m0(r1) ** 2 + n * q0(math.sin(r1))
    rho0 = p["a"] * math.sqrt(c - n * q0(math.sin(r0))) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = p["a"] * F.sqrt(c - n * q) / n, F.lit(n) * F.radians(lon - p["lon0"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to a box, side by side; the box is convex, so each cut keeps a single ring."""
    points = ring[:-1]
    for axis, limit, keep_low in ((0, box[0], False), (1, box[1], False), (0, box[2], True), (1, box[3], True)):
        if not len(points):
            break
        inside = points[:, axis] <= limit if keep_low else points[:, axis] >= limit
        out = []
        for i in range(len(points)):
            a, b = points[i - 1], points[i]
            if inside[i] != inside[i - 1]:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                p = a + t * (b - a)
                p[axis] = limit  # the product may miss it by its last bits
                out.append(p)
            if inside[i]:
                out.append(b)
        points = np.array(out) if out else np.empty((0, 2))
    return np.vstack([points, points[:1]]) if len(points) else points


def union_area(polygons: list[list[np.ndarray]]) -> float:
    """Area of the union of polygons (lists of rings) by vertical slabs between all vertices and crossings of edges.

    Inside a slab no edges cross, so each polygon is a stack of trapezoids between its edges two by two; their union is found at the slab's middle.
    """
    parts = [(np.hstack([r[:-1], r[1:]]), k) for k, p in enumerate(polygons) for r in p if len(r) > 1]
    if not parts:
        return 0.0
    edges, owner = np.vstack([e for e, _ in parts]), np.repeat([k for _, k in parts], [len(e) for e, _ in parts])
    upright = edges[:, 0] == edges[:, 2]
    edges, owner = edges[~upright], owner[~upright]
    if not len(edges):
        return 0.0
    ax, ay, bx, by = edges.T
    dx, dy = bx - ax, by - ay
    cuts = [ax, bx]
    for lo in range(0, len(edges), 256):
        i = slice(lo, lo + 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            den = dx[i, None] * dy - dy[i, None] * dx
            t = ((ax - ax[i, None]) * dy - (ay - ay[i, None]) * dx) / den
            u = ((ax - ax[i, None]) * dy[i, None] - (ay - ay[i, None]) * dx[i, None]) / den
            met = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        cuts.append((ax[i, None] + t * dx[i, None])[met])
    xs, total = np.unique(np.concatenate(cuts)), 0.0
    left, right = np.minimum(ax, bx), np.maximum(ax, bx)
    for lo, hi in zip(xs, xs[1:], strict=False):
        mid = (lo + hi) / 2
        if not lo < mid < hi:  # a slab between neighbouring doubles has no middle, and no area
            continue
        on = np.flatnonzero((left < mid) & (mid < right))
        y = ay[on] + (mid - ax[on]) / dx[on] * dy[on]
        order = np.lexsort([y, owner[on]])
        spans = y[order].reshape(-1, 2)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        if len(spans):
            top = np.maximum.accumulate(spans[:, 1])
            before = np.concatenate([[-np.inf], top[:-1]])
            total += float((hi - lo) * np.maximum(0.0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum())
    return total


def polygon_cover(cells: DataFrame, polygons: DataFrame, *, key: str, size: float) -> DataFrame:
    """Area of each cell that the union of general polygons (column rings: parts and holes) covers.

    Cells and polygons meet by their boxes. Each pair is cut to its cell before anything is gathered, so a cell's task holds what lies in the cell and no whole
    rings; the cut parts are united in Arrow batches.
    """
    from gridloom.operators.joins import box_join

    right = polygons.select("rings", polygon_bounds(F.col("rings")).alias("_b")).select("rings", *[F.col(f"_b.{c}").alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = box_join(cells.select(key, "x0", "y0", "x1", "y1"), right, size=size)
    kind = cells.schema[key].dataType.simpleString()

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for k, x0, y0, x1, y1, rings in zip(g[key], g["x0"], g["y0"], g["x1"], g["y1"], g["rings"], strict=True):
                cut_rings = [clip_ring(np.array([(q["x"], q["y"]) for q in r]), (x0, y0, x1, y1)) for r in rings]
                inside = [r.ravel().tolist() for r in cut_rings if len(r)]
                if inside:
                    rows.append((k, inside))
            yield pd.DataFrame(rows, columns=[key, "part"])

    def area(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            rows = [(k, union_area([[np.array(r).reshape(-1, 2) for r in p] for p in parts])) for k, parts in zip(g[key], g["parts"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "covered_area"])

    parts = pairs.select(key, "x0", "y0", "x1", "y1", "rings").mapInPandas(clip, f"`{key}` {kind}, part array<array<double>>")
    return parts.groupBy(key).agg(F.collect_list("part").alias("parts")).mapInPandas(area, f"`{key}` {kind}, covered_area double")


def burned_by_polygons(cells: DataFrame, fires: DataFrame, *, key: str = "cell_id", size: float = 1000.0) -> DataFrame:
    """As ``burned_fraction`` for fires given as polygons with parts and holes (column rings)."""
    area = box_area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("double")
    burned = polygon_cover(cells, fires.where("rings IS NOT NULL"), key=key, size=size)
    out = cells.select(key, area.alias("_area")).join(burned.hint("merge"), key, "left").withColumn("burned_area_m2", F.coalesce("covered_area", F.lit(0.0)))
    return out.select(key, "burned_area_m2", F.least(F.col("burned_area_m2") / F.col("_area"), F.lit(1.0)).alias("burned_fraction"))


def albers_inverse(x: Column, y: Column, p: dict[str, float] = ALBERS, *, rounds: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude of projected coordinates: the inverse of ``albers``, its latitude by a fixed number of Newton steps."""
    e2 = 2 * p["f"] - p["f"] ** 2
    e = math.sqrt(e2)
    q0 = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m0 = lambda r: math.cos(r) / math.sqrt(1 - e2 * math.sin(r) ** 2)
    r1, r2, r0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m0(r1) ** 2 - m0(r2) ** 2) / (q0(math.sin(r2)) - q0(math.sin(r1)))
    c = m0(r1) ** 2 + n * q0(math.sin(r1))
    rho0 = p["a"] * math.sqrt(c - n * q0(math.sin(r0))) / n
    rho, theta = F.hypot(x, F.lit(rho0) - y), F.atan2(x, F.lit(rho0) - y)
    q = (F.lit(c) - (rho * n / p["a"]) ** 2) / n
    # one struct carries the latitude through the steps, so the expression stays short

    def step(lat: Column, _: Column) -> Column:
        s = F.sin(lat)
        w = 1 - e2 * s * s
        return lat + w * w / (2 * F.cos(lat)) * (q / (1 - e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.asin(q / 2), step)
    return F.degrees(theta / n) + p["lon0"], F.degrees(lat)


def geocentric(lon: Column, lat: Column, height: Column, *, a: float, f: float) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z in metres of degrees and an ellipsoidal height."""
    e2 = 2 * f - f * f
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi)


def geodetic(x: Column, y: Column, z: Column, *, a: float, f: float, rounds: int = 4) -> tuple[Column, Column, Column]:
    """Longitude, latitude and ellipsoidal height of earth-centred coordinates: the reduced latitude by a fixed number of steps, each a thousandfold nearer."""
    e2, b = 2 * f - f * f, a * (1 - f)
    p = F.hypot(x, y)

    def step(beta: Column, _: Column) -> Column:
        lat = F.atan2(z + e2 / (1 - e2) * b * F.sin(beta) ** 3, p - e2 * a * F.cos(beta) ** 3)
        return F.atan2((1 - f) * F.sin(lat), F.cos(lat))

    beta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z * a, p * b), step)
    lat = F.atan2(z + e2 / (1 - e2) * b * F.sin(beta) ** 3, p - e2 * a * F.cos(beta) ** 3)
    n = a / F.sqrt(1 - e2 * F.sin(lat) ** 2)
    # near the poles the distance from the axis tells nothing, near the equator that from its plane
    height = F.when(F.abs(F.cos(lat)) > 0.5, p / F.cos(lat) - n).otherwise(z / F.sin(lat) - n * (1 - e2))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def seven_parameters(x: Column, y: Column, z: Column, p: dict[str, float], *, back: bool = False) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in another datum: shifts tx, ty, tz (metres), rotations rx, ry, rz (arc seconds, of positions) and a scale ds (parts per million).

    The rotation is the exact one, so ``back`` undoes it but for rounding.
    """
    rx, ry, rz = (math.radians(p.get(k, 0.0) / 3600) for k in ("rx", "ry", "rz"))
    turn = lambda i, j, t: np.array([[math.cos(t) if r == c and r in (i, j) else -math.sin(t) if (r, c) == (i, j) else math.sin(t) if (r, c) == (j, i) else float(r == c) for c in range(3)] for r in range(3)])
    m, scale, shift = turn(0, 1, rz) @ turn(2, 0, ry) @ turn(1, 2, rx), 1 + p.get("ds", 0.0) * 1e-6, [p.get(k, 0.0) for k in ("tx", "ty", "tz")]
    of = lambda rows, v: tuple(sum((float(c) * q for c, q in zip(row[1:], v[1:], strict=True)), float(row[0]) * v[0]) for row in rows)
    if back:
        return of(m.T, tuple((v - t) / scale for v, t in zip((x, y, z), shift, strict=True)))
    return tuple(v * scale + t for v, t in zip(of(m, (x, y, z)), shift, strict=True))


def shift_datum(df: DataFrame, *, source: tuple[float, float], target: tuple[float, float], parameters: dict[str, float], lon: str = "lon", lat: str = "lat", height: str | None = None, back: bool = False) -> DataFrame:
    """``df`` with lon and lat (and the height, else 0) moved from the ellipsoid ``source`` (axis, flattening) to ``target`` by seven parameters; ``back`` goes from target to source.

    Expressions only. Null and NaN coordinates stay missing.
    """
    (a0, f0), (a1, f1) = (target, source) if back else (source, target)
    h = F.col(height).cast("double") if height else F.lit(0.0)
    # the coordinates become columns step by step, so that no expression holds another many times over
    names = ("_gx", "_gy", "_gz")
    out = df.withColumns(dict(zip(names, geocentric(F.col(lon).cast("double"), F.col(lat).cast("double"), h, a=a0, f=f0), strict=True)))
    out = out.withColumns(dict(zip(names, seven_parameters(*map(F.col, names), parameters, back=back), strict=True)))
    moved = geodetic(*map(F.col, names), a=a1, f=f1)
    return out.withColumns({lon: moved[0], lat: moved[1], **({height: moved[2]} if height else {})}).drop(*names)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres for display."""
    a = ALBERS["a"]
    return F.radians(lon) * a, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * a


def mask_outside(pixels: DataFrame, edges: DataFrame, *, key: str, value: str, band: float) -> DataFrame:
    """``pixels`` (key, x, y, value) with the value null where the centre is not strictly inside the polygon given as edges."""
    inside = points_within(pixels.select(key, "x", "y"), edges, key=key, band=band).select(key, F.lit(True).alias("_in"))
    return pixels.join(inside, key, "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")

"""Simplification of polygon coverages: shared boundaries are simplified once, so neighbours stay neighbours.

The edges of all polygons are cut into arcs where a third polygon or the outside begins. Each arc loses points in the order of the triangles they make with
their neighbours, the smallest first, as long as no other point of the coverage lies in the triangle; the rings are put together from their arcs again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.polygons import PIECES
from gridloom.session import cut

Point = tuple[float, float]
_OWNERS = "array<struct<key:string,ring_no:int,start:int,forward:boolean>>"
_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARC_SCHEMA = pa.schema([
    ("arc", pa.string()), ("points", pa.list_(_XY)), ("owners", pa.list_(pa.struct([("key", pa.string()), ("ring_no", pa.int32()), ("start", pa.int32()), ("forward", pa.bool_())]))), ("loop", pa.bool_()), ("ends", pa.string()),
])
_PART_SCHEMA = pa.schema([("key", pa.string()), ("ring_no", pa.int32()), ("start", pa.int32()), ("points", pa.list_(_XY))])
_ARCS = f"arc string, points array<struct<x:double,y:double>>, owners {_OWNERS}, loop boolean, ends string"


def chain(edges: list[tuple[Point, Point]], nodes: set[Point]) -> list[list[Point]]:
    """The edges as paths between ``nodes``; what has no node is a closed path from its least point. Each path runs from the lesser end or towards the lesser neighbour."""
    beside: dict[Point, list[Point]] = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    left = {frozenset(e) for e in edges}
    out = []

    def walk(a: Point, b: Point) -> list[Point]:
        path = [a, b]
        left.discard(frozenset((a, b)))
        while path[-1] not in nodes:
            after = [p for p in beside[path[-1]] if frozenset((path[-1], p)) in left]
            if not after:
                break
            left.discard(frozenset((path[-1], after[0])))
            path.append(after[0])
        return path

    for a in sorted(beside):
        if a in nodes:
            for b in sorted(beside[a]):
                if frozenset((a, b)) in left:
                    out.append(walk(a, b))
    for a in sorted(beside):
        for b in sorted(beside[a]):
            if frozenset((a, b)) in left:
                out.append(walk(a, b))
    return [p if (p[0], p[1]) <= (p[-1], p[-2]) else p[::-1] for p in out]


def _area2(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def simplify(path: list[Point], tolerance: float, near: np.ndarray, known: set[tuple[int, int]], size: float, *, least: int) -> list[Point]:
    """``path`` without the points whose triangle with their neighbours is at most ``tolerance`` squared, smallest first, ends and ``least`` points in all kept.

    A point stays while another point (of the path or of ``near``) lies in its triangle, or the triangle leaves the ``known`` squares, in which ``near`` is complete.
    """
    n = len(path)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    own = np.array(path)
    held = np.ones(n, bool)
    most, count = 2 * tolerance * tolerance, n
    size2 = lambda i: abs(_area2(path[before[i]], path[i], path[after[i]]))
    heap = [(size2(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    stamp = {i: a for a, i in heap}

    def free(a: Point, v: Point, b: Point) -> bool:
        x0, x1, y0, y1 = min(a[0], v[0], b[0]), max(a[0], v[0], b[0]), min(a[1], v[1], b[1]), max(a[1], v[1], b[1])
        i0, i1, j0, j1 = (math.floor(t / size) for t in (x0, x1, y0, y1))
        if (i1 - i0 + 1) * (j1 - j0 + 1) > 4 * len(known) or any((i, j) not in known for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)):
            return False
        for points in (near, own[held]):
            p = points[(points[:, 0] >= x0) & (points[:, 0] <= x1) & (points[:, 1] >= y0) & (points[:, 1] <= y1)]
            for q in map(tuple, p.tolist()):
                if q in (a, v, b):
                    continue
                s = (_area2(a, v, q), _area2(v, b, q), _area2(b, a, q))
                if min(s) >= 0 or max(s) <= 0:
                    return False
        return True

    while heap and count > least:
        size_now, i = heapq.heappop(heap)
        if size_now > most:
            break
        if not alive[i] or stamp[i] != size_now:
            continue
        a, b = before[i], after[i]
        if not free(path[a], path[i], path[b]):
            continue  # looked at again once a neighbour has gone
        alive[i] = held[i] = False
        count -= 1
        after[a], before[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                stamp[k] = size2(k)
                heapq.heappush(heap, (stamp[k], k))
    return [p for p, ok in zip(path, alive, strict=True) if ok]


def _squares(path: list[Point], size: float) -> set[tuple[int, int]]:
    """The squares that a path passes, and those next to them."""
    seen = set()
    for (px, py), (qx, qy) in zip(path, path[1:], strict=False):
        x0, x1, y0, y1 = min(px, qx), max(px, qx), min(py, qy), max(py, qy)
        for j in range(math.floor(y0 / size), math.floor(y1 / size) + 1):
            at = [px + (min(max(y, y0), y1) - py) / (qy - py) * (qx - px) for y in (j * size, (j + 1) * size)] if y1 > y0 else [x0, x1]
            for i in range(math.floor(min(at) / size) - 1, math.floor(max(at) / size) + 2):
                seen |= {(i, j - 1), (i, j), (i, j + 1)}
    return seen


def _arcs(rows: list[dict]) -> list[dict]:
    """The arcs between two polygons, or of one with the outside, from their edges."""
    edges, nodes, owned = [], set(), {}
    for r in rows:
        a, b = (r["ax"], r["ay"]), (r["bx"], r["by"])
        edges.append((a, b))
        nodes |= {p for p, is_node in ((a, r["a_node"]), (b, r["b_node"])) if is_node}
        owned[frozenset((a, b))] = r["owners"]
    out = []
    for path in chain(edges, nodes):
        loop = path[0] == path[-1]
        sides = list(zip(path, path[1:], strict=False))
        owners = []
        for k in range(len(owned[frozenset(sides[0])])):
            who = [owned[frozenset(s)][k] for s in sides]
            # an edge is stored from its lesser point; forward tells whether the ring runs that way
            forward = (sides[0][0] < sides[0][1]) == who[0]["forward"]
            owners.append({"key": who[0]["key"], "ring_no": who[0]["ring_no"], "start": (who[0] if forward else who[-1])["idx"], "forward": forward})
        name = f"{path[0]}{path[1]}{path[-1]}{rows[0]['pair']}"
        ends = "" if loop else str(sorted((path[0], path[-1])))
        out.append({"arc": name, "points": [{"x": x, "y": y} for x, y in path], "owners": owners, "loop": loop, "ends": ends})
    return out


def _pairs_to_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arcs of edges that come sorted by pair; one pair is held at a time."""
    held: list[dict] = []
    for b in batches:
        out = []
        for row in b.to_pylist():
            if held and held[0]["pair"] != row["pair"]:
                out += _arcs(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=_ARC_SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist(_arcs(held), schema=_ARC_SCHEMA)


def coverage_arcs(polygons: DataFrame, *, key: str) -> DataFrame:
    """arc, points, owners, loop, ends of a coverage: each boundary between two polygons, or between one and the outside, once.

    Neighbours must share the points of their common boundary. An edge of more than two rings is an error.
    """
    ring = polygons.where("rings IS NOT NULL").select(F.col(key).cast("string").alias("key"), F.posexplode("rings").alias("ring_no", "ring"))
    n = F.size("ring")
    sides = F.zip_with(F.slice("ring", F.lit(1), n - 1), F.slice("ring", F.lit(2), n - 1), lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))
    side = ring.select("key", "ring_no", F.posexplode(sides).alias("idx", "s")).select("key", "ring_no", "idx", "s.*").where("px <> qx OR py <> qy")
    forward = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    edge = side.select("key", "ring_no", "idx", forward.alias("forward"), pick("px", "qx").alias("ax"), pick("py", "qy").alias("ay"), pick("qx", "px").alias("bx"), pick("qy", "py").alias("by"))
    per = edge.groupBy("ax", "ay", "bx", "by").agg(F.sort_array(F.collect_list(F.struct("key", "ring_no", "idx", "forward"))).alias("owners"))
    message = F.concat(F.lit("an edge belongs to "), F.size("owners").cast("string"), F.lit(" rings: the coverage overlaps"))
    per = per.where(F.when(F.size("owners") > 2, F.raise_error(message)).otherwise(F.lit(True)))
    per = cut(per.withColumn("pair", F.array_join(F.transform("owners", lambda o: F.concat_ws("#", o["key"], o["ring_no"].cast("string"))), "|")))
    end = lambda c: per.select(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"), "pair")
    node = end("a").unionByName(end("b")).groupBy("x", "y").agg(((F.count("*") != 2) | (F.min("pair") != F.max("pair"))).alias("node"))
    of = lambda c: node.select(F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("node").alias(f"{c}_node"))
    # edges, points and arcs are many times what Spark takes the polygons for: no join here may broadcast a side on that estimate
    return per.join(of("a").hint("merge"), ["ax", "ay"]).join(of("b").hint("merge"), ["bx", "by"]).repartition("pair").sortWithinPartitions("pair").mapInArrow(_pairs_to_arcs, _ARCS)


def simplify_coverage(polygons: DataFrame, *, key: str, tolerance: float, size: float | None = None) -> DataFrame:
    """key and rings of each polygon of a coverage (column rings), its boundaries simplified by ``tolerance`` (the square root of the largest triangle that goes), shared ones alike.

    Points where three polygons, or two and the outside, meet stay, so no gap or overlap arises, and every inner edge is still one of two polygons. No ring loses its
    inside, and no boundary crosses another. ``size`` is the side of the squares in which points that stand in the way are looked for (8 tolerances or two mean edges,
    whichever is more, if it is not given); a task holds one boundary between two polygons and the points in the squares it passes or next to them. Null polygons stay null.
    """
    arcs = cut(coverage_arcs(polygons, key=key))
    if size is None:
        steps = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
        mean = arcs.select(F.explode(steps).alias("s")).agg(F.avg("s")).first()[0]
        size = max(8 * tolerance, 2 * (mean or 0.0))
    beside = arcs.groupBy("ends").agg(F.count("*").alias("alike"))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            names, at = [], []
            for arc, points in zip(*(c.to_pylist() for c in g.columns), strict=True):
                seen = _squares([(p["x"], p["y"]) for p in points], size)
                names += [arc] * len(seen)
                at += seen
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i for i, _ in at], pa.int64()), pa.array([j for _, j in at], pa.int64())], names=["arc", "i", "j"])

    reach = arcs.where("size(points) > 2").select("arc", "points").mapInArrow(squares, "arc string, i long, j long")
    point = arcs.select(F.explode("points").alias("p")).select("p.x", "p.y").distinct()
    placed = point.select("x", "y", F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j"))
    known = reach.join(placed.groupBy("i", "j").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")).hint("merge"), ["i", "j"], "left").groupBy("arc").agg(F.collect_list(F.struct("i", "j", "xs", "ys")).alias("around"))
    ready = arcs.join(beside.hint("merge"), "ends").join(known.hint("merge"), "arc", "left").select("points", "owners", "loop", "alike", "around")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            rows = []
            for points, owners, loop, alike, around in zip(*(c.to_pylist() for c in g.columns), strict=True):
                path = [(p["x"], p["y"]) for p in points]
                if around:
                    own = set(path)
                    near = np.array([q for s in around if s["xs"] for q in zip(s["xs"], s["ys"], strict=True) if q not in own]).reshape(-1, 2)
                    # arcs with the same two ends would fall together without a point of their own
                    path = simplify(path, tolerance, near, {(s["i"], s["j"]) for s in around}, size, least=4 if loop else 3 if alike > 1 else 2)
                for o in owners:
                    rows.append({"key": o["key"], "ring_no": o["ring_no"], "start": o["start"], "points": [{"x": x, "y": y} for x, y in (path if o["forward"] else path[::-1])]})
            yield pa.RecordBatch.from_pylist(rows, schema=_PART_SCHEMA)

    parts = ready.mapInArrow(thin, "key string, ring_no int, start int, points array<struct<x:double,y:double>>")
    ring = parts.groupBy("key", "ring_no").agg(F.sort_array(F.collect_list(F.struct("start", "points"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: F.slice(p["points"], F.lit(1), F.size(p["points"]) - 1)))
    ring = ring.select("key", "ring_no", joined.alias("open")).select("key", "ring_no", F.concat("open", F.slice("open", 1, 1)).alias("ring"))
    whole = ring.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))), lambda r: r["ring"]).cast(PIECES).alias("_rings"))
    whole = whole.select(F.col("key").alias("_key"), "_rings")
    out = polygons.select(key, "rings").join(whole.hint("merge"), F.col(key).cast("string") == F.col("_key"), "left")
    return out.select(key, F.when(F.col("rings").isNotNull(), F.coalesce("_rings", "rings")).alias("rings"))

"""Predicates and overlays of general polygons: an exact intersection join, validity with reasons, and differences as geometry.

Polygons are arrays of rings as in ``geometry``. Sets are closed: what only touches, meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import clip_ring, edges_of, polygon_bounds
from gridloom.operators.joins import box_join

PIECES = "array<array<struct<x:double,y:double>>>"


def _edge_squares(polygons: DataFrame, key: str, side: str, size: float) -> DataFrame:
    """key, edge and the squares (i, j) of side ``size`` that each edge passes: row by row, only the columns it crosses there, and one on either side of rounding."""
    e = polygons.select(F.col(key).alias(f"{side}_key"), F.explode(edges_of(F.col("rings"))).alias(side))
    ax, ay, bx, by = (F.col(f"{side}.{c}") for c in ("ax", "ay", "bx", "by"))
    rows = F.sequence(F.floor(F.least(ay, by) / size).cast("long"), F.floor(F.greatest(ay, by) / size).cast("long"))
    e = e.withColumn("j", F.explode(rows))
    at = lambda y: F.when(ay == by, None).otherwise(ax + (F.greatest(F.least(y, F.greatest(ay, by)), F.least(ay, by)) - ay) / (by - ay) * (bx - ax))
    low, high = at(F.col("j") * size), at((F.col("j") + 1) * size)
    slack = size * 1e-9
    left = F.coalesce(F.least(low, high), F.least(ax, bx)) - slack
    right = F.coalesce(F.greatest(low, high), F.greatest(ax, bx)) + slack
    return e.withColumn("i", F.explode(F.sequence(F.floor(left / size).cast("long"), F.floor(right / size).cast("long"))))


def segments_meet(p: str, q: str) -> Column:
    """Whether two closed segments (struct columns of ax, ay, bx, by) have a point in common."""
    a, b = (lambda c: F.col(f"{p}.{c}")), (lambda c: F.col(f"{q}.{c}"))
    turn = lambda ox, oy, ex, ey, x, y: (ex - ox) * (y - oy) - (ey - oy) * (x - ox)
    of_a = lambda x, y: F.signum(turn(a("ax"), a("ay"), a("bx"), a("by"), x, y))
    of_b = lambda x, y: F.signum(turn(b("ax"), b("ay"), b("bx"), b("by"), x, y))
    over = lambda lo, hi: (F.least(a(lo), a(hi)) <= F.greatest(b(lo), b(hi))) & (F.least(b(lo), b(hi)) <= F.greatest(a(lo), a(hi)))
    straddles = (of_a(b("ax"), b("ay")) * of_a(b("bx"), b("by")) <= 0) & (of_b(a("ax"), a("ay")) * of_b(a("bx"), a("by")) <= 0)
    return over("ax", "bx") & over("ay", "by") & straddles


def _held(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str, size: float) -> DataFrame:
    """inner_key, outer_key of pairs in which a ring of the inner polygon starts strictly inside the outer one: an odd number of its edges lies to the east."""
    starts = inner.select(F.col(inner_key).alias("in_key"), F.posexplode("rings").alias("ring_no", "ring")).select("in_key", "ring_no", F.col("ring")[0]["x"].alias("px"), F.col("ring")[0]["y"].alias("py"))
    points = starts.select("*", *[F.col(c).alias(n) for c, n in (("px", "x0"), ("py", "y0"), ("px", "x1"), ("py", "y1"))])
    boxes = outer.select(F.col(outer_key).alias("out_key"), polygon_bounds(F.col("rings")).alias("b")).select("out_key", *[F.col(f"b.{c}").alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    band = lambda y: F.floor(y / size).cast("long")
    near = box_join(points, boxes, size=size).select("in_key", "ring_no", "px", "py", "out_key", band(F.col("py")).alias("band"))
    e = outer.select(F.col(outer_key).alias("out_key"), F.explode(edges_of(F.col("rings"))).alias("e")).select("out_key", "e.*")
    e = e.withColumn("band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))))
    cross = (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("px") - F.col("ax"))
    east = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & F.when(F.col("by") > F.col("ay"), cross > 0).otherwise(cross < 0)
    odd = near.join(e.hint("merge"), ["out_key", "band"]).groupBy("in_key", "ring_no", "out_key").agg(F.count_if(east).alias("n")).where("n % 2 = 1")
    return odd.select(F.col("in_key").alias(inner_key), F.col("out_key").alias(outer_key)).distinct()


def polygon_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, size: float) -> DataFrame:
    """left_key, right_key (different names) of all pairs of polygons (column rings) that have a point in common, each pair once.

    Edges of both sides are keyed by the squares of side ``size`` that they pass, and meet only in shared squares. Pairs without such a contact have one polygon's
    parts wholly inside or outside the other: a point of each ring is looked up among the edges of the other's band of the same height. A polygon in a hole of the
    other does not meet it. Null and empty polygons meet nothing; a key names one polygon of its side. Comparisons are those of doubles.
    """
    own = lambda df, key: df.where("rings IS NOT NULL AND size(rings) > 0").select(key, F.filter("rings", lambda r: F.size(r) > 1).alias("rings")).where("size(rings) > 0")
    a, b = own(left, left_key), own(right, right_key)
    p, q = _edge_squares(a, left_key, "p", size), _edge_squares(b, right_key, "q", size)
    # the edges are many times what Spark takes the polygons for, so neither side may be broadcast on that estimate
    touching = p.join(q.hint("merge"), ["i", "j"]).where(segments_meet("p", "q")).select(F.col("p_key").alias(left_key), F.col("q_key").alias(right_key)).distinct()
    inside, around = _held(a, left_key, b, right_key, size), _held(b, right_key, a, left_key, size).select(left_key, right_key)
    return touching.unionByName(inside).unionByName(around).distinct()


def turns(o: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The exact sign of the turn from o to e to p, row by row: doubles where they can tell, fractions where they cannot."""
    l, r = (e[:, 0] - o[:, 0]) * (p[:, 1] - o[:, 1]), (e[:, 1] - o[:, 1]) * (p[:, 0] - o[:, 0])
    d = l - r
    out = np.sign(d).astype(np.int64)
    for k in np.flatnonzero(np.abs(d) <= 4e-16 * (np.abs(l) + np.abs(r)) * 2).tolist():
        (ox, oy), (ex, ey), (px, py) = ([Fraction(float(v)) for v in x[k]] for x in (o, e, p))
        exact = (ex - ox) * (py - oy) - (ey - oy) * (px - ox)
        out[k] = (exact > 0) - (exact < 0)
    return out


def crossings(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges (ax, ay, bx, by) whose boxes meet, found by a sweep from west to east over the edges' western ends."""
    x0, x1 = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    y0, y1 = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    order = np.argsort(x0, kind="stable")
    last = np.searchsorted(x0[order], x1[order], side="right")
    for at, i in enumerate(order.tolist()):
        met = order[at + 1 : last[at]]
        met = met[(y0[met] <= y1[i]) & (y1[met] >= y0[i])]
        if met.size:
            yield np.full(met.size, i), met


def _holds(ring: np.ndarray, x: float, y: float) -> int:
    """1 if a point is inside a ring, 0 on it, -1 outside; exact."""
    a, b = ring[:-1], ring[1:]
    p = np.broadcast_to(np.array([x, y]), a.shape)
    side = turns(a, b, p)
    on = (side == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
    if on.any():
        return 0
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    east = np.where(b[:, 1] > a[:, 1], side > 0, side < 0)
    return 1 if (spans & east).sum() % 2 else -1


def _inside(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether a ring lies inside another that it does not cross, told by the first of its points that is not on the other; all on it counts as inside."""
    for points in (ring[:-1], (ring[:-1] + ring[1:]) / 2):
        for x, y in points.tolist():
            if side := _holds(other, x, y):
                return side > 0
    return True


def problems(rings: list[np.ndarray], *, shell_first: bool = False) -> list[tuple[str, float, float]]:
    """What is wrong with a polygon, and where: of each kind the first place.

    Kinds: ``empty``, ``not finite``, ``open ring``, ``too few points``, ``no area``, ``self-intersection`` (a ring crosses or overlaps itself), ``ring touches itself``,
    ``rings cross`` (or share a line), ``interior in pieces`` (holes touch so that they cut it); and where the first ring is the shell and the
    others its holes (``shell_first``), ``hole outside shell`` and ``nested holes``. Without it rings in an even number of others are shells, so no hole is outside.
    """
    nan = math.nan
    if not rings or any(len(r) == 0 for r in rings):
        return [("empty", nan, nan)]
    found: dict[str, tuple[str, float, float]] = {}
    say = lambda kind, p: found.setdefault(kind, (kind, float(p[0]), float(p[1])))
    for r in rings:
        if not np.isfinite(r).all():
            say("not finite", r[0])
        elif (r[0] != r[-1]).any():
            say("open ring", r[0])
    if found:
        return list(found.values())
    rings = [r[np.concatenate([[True], (r[1:] != r[:-1]).any(1)])] for r in rings]  # repeated points say nothing
    for r in rings:
        if len(r) < 4:
            say("too few points", r[0])
    if found:
        return list(found.values())
    edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    of = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    first = np.cumsum([0] + [len(r) - 1 for r in rings])
    joints: dict[tuple[float, float], set[int]] = {}
    for i, j in crossings(edges):
        a0, a1, b0, b1 = edges[i][:, :2], edges[i][:, 2:], edges[j][:, :2], edges[j][:, 2:]
        s, t, u, v = turns(a0, a1, b0), turns(a0, a1, b1), turns(b0, b1, a0), turns(b0, b1, a1)
        meet = (s * t <= 0) & (u * v <= 0)
        for k in np.flatnonzero(meet).tolist():
            m, n = int(i[k]), int(j[k])
            same = of[m] == of[n]
            count = first[of[m] + 1] - first[of[m]]
            next_to = same and (abs(m - n) == 1 or abs(m - n) == count - 1)
            if s[k] == t[k] == 0:  # on one line
                axis = 0 if edges[m, 0] != edges[m, 2] else 1
                low = max(min(edges[m, axis], edges[m, axis + 2]), min(edges[n, axis], edges[n, axis + 2]))
                high = min(max(edges[m, axis], edges[m, axis + 2]), max(edges[n, axis], edges[n, axis + 2]))
                if high > low:
                    say("self-intersection" if same else "rings cross", edges[m, :2] if edges[m, axis] == low else edges[m, 2:])
                    continue
            if next_to:
                continue
            if s[k] * t[k] < 0 and u[k] * v[k] < 0:
                d = (a1[k] - a0[k])[0] * (b1[k] - b0[k])[1] - (a1[k] - a0[k])[1] * (b1[k] - b0[k])[0]
                w = ((b0[k] - a0[k])[0] * (b1[k] - b0[k])[1] - (b0[k] - a0[k])[1] * (b1[k] - b0[k])[0]) / d
                say("self-intersection" if same else "rings cross", a0[k] + w * (a1[k] - a0[k]))
                continue
            point = b0[k] if s[k] == 0 else b1[k] if t[k] == 0 else a0[k] if u[k] == 0 else a1[k]
            joints.setdefault((float(point[0]), float(point[1])), set()).update((m, n))
    for p, met in joints.items():
        _at_joint(p, met, edges, of, say)
    for r in rings:
        if not found and abs(_area(r)) == 0.0:
            say("no area", r[0])
    if found:
        return list(found.values())
    if shell_first:
        for k, r in enumerate(rings[1:], 1):
            if abs(_area(r)) > abs(_area(rings[0])) or not _inside(r, rings[0]):
                say("hole outside shell", r[0])
            if any(k != m and abs(_area(r)) < abs(_area(q)) and _inside(r, q) for m, q in enumerate(rings[1:], 1)):
                say("nested holes", r[0])
    # rings and the points where they touch: a way around means a part that is cut off
    name: dict = {}

    def root(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for p, met in joints.items():
        for ring in {int(of[e]) for e in met}:
            x, y = root(("at", p)), root(ring)
            if x == y and shell_first:
                say("interior in pieces", p)
            name[x] = y
    return list(found.values())


def _area(ring: np.ndarray) -> float:
    x, y = (ring[:, 0] - ring[0, 0]), (ring[:, 1] - ring[0, 1])
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _at_joint(p: tuple[float, float], met: set[int], edges: np.ndarray, of: np.ndarray, say) -> None:
    """Tell a touch at ``p`` from a crossing: around the point the ends of one passage of a ring must not lie on different sides of another's."""
    passages: list[tuple[int, float, float]] = []
    by_ring: dict[int, list[int]] = {}
    for e in met:
        by_ring.setdefault(int(of[e]), []).append(e)
    for ring, own in by_ring.items():
        into, out_of, through = [], [], []
        for e in own:
            a, b = tuple(edges[e, :2]), tuple(edges[e, 2:])
            (into if b == p else out_of if a == p else through).append(e)
        angle = lambda x, y: math.atan2(y - p[1], x - p[0])  # noqa: B023, E731
        for e in through:
            passages.append((ring, angle(*edges[e, :2]), angle(*edges[e, 2:])))
        # the ring's edges follow each other, so the edge after one that comes in goes out
        start, count = int(np.flatnonzero(of == ring)[0]), int((of == ring).sum())
        for e in {*into, *[start + (x - start - 1) % count for x in out_of]}:
            nxt = start + (e - start + 1) % count
            passages.append((ring, angle(*edges[e, :2]), angle(*edges[nxt, 2:])))
    full = 2 * math.pi
    for x in range(len(passages)):
        for y in range(x):
            (r, a, b), (q, c, d) = passages[x], passages[y]
            span = (b - a) % full
            if (0 < (c - a) % full < span) != (0 < (d - a) % full < span):
                say("self-intersection" if r == q else "rings cross", p)
            elif r == q:
                say("ring touches itself", p)


def validity(polygons: DataFrame, *, key: str, shell_first: bool = False) -> DataFrame:
    """key, problem, x, y: a row for each kind of problem of each polygon (column rings), as ``problems`` tells them; valid polygons have none, a null one is ``missing``."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, rings in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rings is None:
                    rows.append((k, "missing", math.nan, math.nan))
                    continue
                arrays = [np.array([(math.nan if p is None or p["x"] is None else p["x"], math.nan if p is None or p["y"] is None else p["y"]) for p in r or []], float).reshape(-1, 2) for r in rings]
                rows += [(k, *p) for p in problems(arrays, shell_first=shell_first)]
            table = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(table[0], b.schema.field(0).type), pa.array(table[1], pa.string()), pa.array(table[2], pa.float64()), pa.array(table[3], pa.float64())], names=[key, "problem", "x", "y"])

    return polygons.select(key, "rings").mapInArrow(run, f"`{key}` {kind}, problem string, x double, y double")


def _spans(order: np.ndarray, owner: np.ndarray, minuend: int) -> list[tuple[int, int]]:
    """In one slab with its edges from south to north: pairs of edges between which the minuend is and none of the others."""
    out, inside, low = [], set(), None
    for e in order.tolist():
        was = minuend in inside and len(inside) == 1
        inside ^= {int(owner[e])}
        now = minuend in inside and len(inside) == 1
        if now and not was:
            low = e
        elif was and not now:
            out.append((low, e))
    return out


def difference_pieces(minuend: list[np.ndarray], others: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The minuend without the others (each even-odd over its rings) as disjoint closed rings, each a trapezoid or triangle, by vertical slabs between all vertices and crossings.

    Pieces between the same two edges in neighbouring slabs are one.
    """
    parts = [(np.hstack([r[:-1], r[1:]]), k) for k, p in enumerate([minuend, *others]) for r in p if len(r) > 1]
    edges, owner = np.vstack([e for e, _ in parts]), np.repeat([k for _, k in parts], [len(e) for e, _ in parts])
    upright = edges[:, 0] == edges[:, 2]
    edges, owner = edges[~upright], owner[~upright]
    if not len(edges):
        return []
    ax, ay, bx, by = edges.T
    dx, dy = bx - ax, by - ay
    cuts = [ax, bx]
    for i, j in crossings(edges):
        with np.errstate(divide="ignore", invalid="ignore"):
            den = dx[i] * dy[j] - dy[i] * dx[j]
            t = ((ax[j] - ax[i]) * dy[j] - (ay[j] - ay[i]) * dx[j]) / den
            u = ((ax[j] - ax[i]) * dy[i] - (ay[j] - ay[i]) * dx[i]) / den
            met = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        cuts.append((ax[i] + t * dx[i])[met])
    xs = np.unique(np.concatenate(cuts))
    left, right = np.minimum(ax, bx), np.maximum(ax, bx)
    height = lambda e, x: float(ay[e] + (x - ax[e]) / dx[e] * dy[e])
    open_pieces: dict[tuple[int, int], float] = {}
    out = []

    def close(pair: tuple[int, int], x0: float, x1: float) -> None:
        low, high = pair
        ends = []
        for x in (x0, x1):
            y0, y1 = height(low, x), height(high, x)
            # edges that cross here agree but for rounding
            ends.append((y0, y1) if y1 - y0 > 1e-12 * max(1.0, abs(y0), abs(y1)) else ((y0 + y1) / 2,) * 2)
        ring = [(x0, ends[0][0]), (x1, ends[1][0]), (x1, ends[1][1]), (x0, ends[0][1])]
        ring = [p for k, p in enumerate(ring) if p != ring[k - 1]]
        if len(ring) > 2:
            out.append(np.array([*ring, ring[0]]))

    for lo, hi in zip(xs, xs[1:], strict=False):
        mid = (lo + hi) / 2
        if not lo < mid < hi:  # a slab between neighbouring doubles has no middle: what is open stays so
            continue
        on = np.flatnonzero((left < mid) & (mid < right))
        y = ay[on] + (mid - ax[on]) / dx[on] * dy[on]
        now = set(_spans(on[np.lexsort([owner[on], y])], owner, 0))
        for pair in [p for p in open_pieces if p not in now]:
            close(pair, open_pieces.pop(pair), float(lo))
        for pair in now:
            open_pieces.setdefault(pair, float(lo))
    for pair, x0 in open_pieces.items():
        close(pair, x0, float(xs[-1]))
    return out


def coverage_gaps(cells: DataFrame, polygons: DataFrame, *, key: str, size: float) -> DataFrame:
    """key, gap_area and pieces (disjoint rings) of what no polygon (column rings: parts and holes) covers of each cell (x0, y0, x1, y1); a covered cell has none.

    Cells and polygons meet by their boxes, and polygons are cut to the cell before anything is gathered, so a cell's task holds what lies in the cell.
    """
    own = polygons.where("rings IS NOT NULL AND size(rings) > 0")
    right = own.select("rings", polygon_bounds(F.col("rings")).alias("_b")).select("rings", *[F.col(f"_b.{c}").alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = cells.select(key, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kind = cells.schema[key].dataType.simpleString()

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for k, x0, y0, x1, y1, rings in zip(g[key], g["x0"], g["y0"], g["x1"], g["y1"], g["rings"], strict=True):
                cut_rings = [clip_ring(np.array([(q["x"], q["y"]) for q in r]), (x0, y0, x1, y1)) for r in rings]
                if inside := [r.ravel().tolist() for r in cut_rings if len(r)]:
                    rows.append((k, inside))
            yield pd.DataFrame(rows, columns=[key, "part"])

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for k, x0, y0, x1, y1, parts in zip(g[key], g["x0"], g["y0"], g["x1"], g["y1"], g["parts"], strict=True):
                box = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
                pieces = difference_pieces([box], [[np.array(r).reshape(-1, 2) for r in p] for p in (parts if parts is not None else [])])
                rows.append((k, float(sum(abs(_area(r)) for r in pieces)), [[{"x": x, "y": y} for x, y in r.tolist()] for r in pieces]))
            yield pd.DataFrame(rows, columns=[key, "gap_area", "pieces"])

    met = box_join(boxes, right, size=size).select(key, "x0", "y0", "x1", "y1", "rings").mapInPandas(clip, f"`{key}` {kind}, part array<array<double>>")
    held = boxes.join(met.groupBy(key).agg(F.collect_list("part").alias("parts")).hint("merge"), key, "left")
    return held.mapInPandas(gaps, f"`{key}` {kind}, gap_area double, pieces {PIECES}")

"""General polygons: intersection join, validity, differences, areas of rings that touch."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry, polygons


def ring(*p):
    return np.array([*p, p[0]], float)


def square(x, y, s):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def frame(spark, key, rows):
    data = [(k, None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in rows]
    return spark.createDataFrame(data, f"{key} int, rings array<array<struct<x:double,y:double>>>")


def kinds(rings, **options):
    return [p[0] for p in polygons.problems(rings, **options)]


def test_areas_where_parts_and_holes_touch(spark):
    rows = [(1, [square(0, 0, 1), square(1, 1, 1)]), (2, [square(0, 0, 4), square(3, 1, 1)]), (3, [square(3, 1, 1), square(0, 0, 4)]), (4, [square(0, 0, 9), square(1, 0, 4), square(2, 0, 1)]), (5, [square(0, 0, 1), square(1, 0, 1), square(2, 0, 1)])]
    got = {r["k"]: r["a"] for r in frame(spark, "k", rows).select("k", geometry.polygon_area(F.col("rings")).alias("a")).collect()}
    assert got == {1: 2.0, 2: 15.0, 3: 15.0, 4: 81.0 - 16 + 1, 5: 3.0}


def test_problems_are_told_apart():
    assert polygons.problems([ring((0, 0), (2, 2), (2, 0), (0, 2))]) == [("self-intersection", 1.0, 1.0)]
    assert kinds([ring((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4))]) == ["ring touches itself"]
    assert kinds([ring((0, 0), (2, 2), (4, 4), (4, 0), (2, 2), (0, 4))]) == ["self-intersection"]
    assert kinds([ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))]) == ["ring touches itself"]
    assert "self-intersection" in kinds([ring((0, 0), (4, 0), (6, 0), (4, 0), (4, 4))])
    for hole, want in (
        (square(1, 1, 1), []), (square(9, 1, 1), ["hole outside shell"]), (ring((0, 2), (1, 1), (1, 3)), []), (ring((0, 2), (2, 0), (4, 2), (2, 3)), ["interior in pieces"]),
        (square(3, 1, 1), ["rings cross"]), (square(3, 1, 3), ["rings cross"]), (square(0, 0, 4), ["rings cross"]),
    ):
        assert kinds([square(0, 0, 4), hole], shell_first=True) == want, hole
    assert kinds([square(0, 0, 9), square(1, 1, 5), square(2, 2, 1)], shell_first=True) == ["nested holes"]
    assert kinds([square(0, 0, 9), square(1, 1, 5), square(2, 2, 1)]) == [] == kinds([square(0, 0, 1), square(1, 1, 1)])
    assert kinds([ring((0, 0), (1, math.nan), (2, 2))]) == ["not finite"] and kinds([np.array([(0, 0), (1, 0), (1, 1.0)])]) == ["open ring"]
    assert kinds([]) == ["empty"] == kinds([np.empty((0, 2))]) and kinds([ring((0, 0), (1, 1))]) == ["too few points"]
    assert kinds([np.array([(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 0)], float)]) == []


def test_a_star_is_valid_until_two_points_are_swapped():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(5, 40)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        if max(b - a for a, b in itertools.pairwise([*angles, angles[0] + 2 * math.pi])) > 3:
            continue
        points = [(math.cos(a) * (r := rng.uniform(1, 5)), math.sin(a) * r) for a in angles]
        assert kinds([ring(*points)]) == []
        crossed = list(points)
        crossed[1], crossed[3] = crossed[3], crossed[1]
        def proper(p, q, r, s):
            turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            return turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0
        edges = list(zip(crossed, crossed[1:] + crossed[:1], strict=True))
        bad = any(proper(*a, *b) for a, b in itertools.combinations(edges, 2))
        assert (kinds([ring(*crossed)]) == ["self-intersection"]) == bad


def test_validity_of_rows(spark):
    rows = [(1, [square(0, 0, 4)]), (2, [ring((0, 0), (2, 2), (2, 0), (0, 2))]), (3, None), (4, []), (5, [square(0, 0, 4), square(9, 0, 1)])]
    got = sorted((r["k"], r["problem"]) for r in polygons.validity(frame(spark, "k", rows), key="k", shell_first=True).collect())
    assert got == [(2, "self-intersection"), (3, "missing"), (4, "empty"), (5, "hole outside shell")]
    assert polygons.validity(frame(spark, "k", rows).limit(0), key="k").count() == 0


def points_meet(a, b):
    """Pairwise brute force on lattice squares: each polygon as its closed lattice points and the open unit squares it covers."""
    return bool(a & b)


def lattice(rings, n=40):
    """Points of the half-unit lattice in the closed even-odd polygon of axis-parallel rings."""
    out = set()
    for i, j in itertools.product(range(2 * n), repeat=2):
        x, y = i / 2, j / 2
        on = any(min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for r in rings for a, b in itertools.pairwise(r))
        odd = sum(1 for r in rings for a, b in itertools.pairwise(r) if (a[1] > y) != (b[1] > y) and x < a[0]) % 2
        if on or odd:
            out.add((i, j))
    return out


def test_intersection_join_against_brute_force(spark):
    rng = random.Random(3)

    def some(n):
        rows = []
        for k in range(n):
            x, y, s = rng.randrange(0, 28), rng.randrange(0, 28), rng.randrange(1, 9)
            rings = [square(x, y, s)]
            if s > 3 and rng.random() < 0.7:
                rings.append(square(x + 1, y + 1, s - 2))
            if rng.random() < 0.3:
                rings.append(square(x + s, y + s, 1))  # a part that touches a corner
            rng.shuffle(rings)
            rows.append((k, rings))
        return rows

    left, right = some(40), some(40)
    left += [(100, [square(10, 10, 1)]), (101, None), (102, [])]
    right += [(200, [square(5, 5, 20), square(8, 8, 12)]), (201, [square(30, 30, 1)])]
    a, b = {k: lattice(r) for k, r in left if r}, {k: lattice(r) for k, r in right}
    want = sorted((k, m) for k in a for m in b if points_meet(a[k], b[m]))
    assert (100, 200) not in want and any(k == 100 for k, _ in want) is not None
    for size in (1.0, 3.7, 50.0):
        got = polygons.polygon_join(frame(spark, "a", left), frame(spark, "b", right), left_key="a", right_key="b", size=size).collect()
        assert sorted(map(tuple, got)) == want


def test_intersection_join_of_slanted_polygons(spark):
    rng = random.Random(9)
    some = lambda n: [(k, [ring(*[(rng.uniform(0, 10) + cx, rng.uniform(0, 10) + cy) for _ in range(3)])]) for k in range(n) for cx, cy in [(rng.uniform(0, 50), rng.uniform(0, 50))]]
    left, right = some(60), some(60)

    def meet(p, q):
        turn = lambda o, e, x: (e[0] - o[0]) * (x[1] - o[1]) - (e[1] - o[1]) * (x[0] - o[0])
        cross = any(turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0 for a, b in itertools.pairwise(p) for c, d in itertools.pairwise(q))
        return cross or polygons._holds(q, *p[0]) > 0 or polygons._holds(p, *q[0]) > 0

    want = sorted((k, m) for k, (p,) in left for m, (q,) in right if meet(p, q))
    got = polygons.polygon_join(frame(spark, "a", left), frame(spark, "b", right), left_key="a", right_key="b", size=4.0).collect()
    assert want and sorted(map(tuple, got)) == want


def test_differences_against_a_raster_and_the_union():
    rng = random.Random(1)
    for _ in range(120):
        others, covered = [], np.zeros((20, 20), bool)
        for _ in range(rng.randrange(0, 5)):
            x, y, s = rng.randrange(0, 18), rng.randrange(0, 18), rng.randrange(1, 10)
            held, rings = np.zeros((40, 40), bool), [square(x, y, s)]
            held[x : x + s, y : y + s] = True
            if s > 2:
                rings.append(square(x + 1, y + 1, s - 2))
                held[x + 1 : x + s - 1, y + 1 : y + s - 1] = False
            others.append(rings)
            covered |= held[:20, :20]
        pieces = polygons.difference_pieces([square(0, 0, 20), square(5, 5, 3)], others)
        free = ~covered
        free[5:8, 5:8] = False
        assert math.isclose(sum(abs(polygons._area(p)) for p in pieces), free.sum(), abs_tol=1e-9)
        triangles = [[ring(*[(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3)])] for _ in range(4)]
        pieces = polygons.difference_pieces([square(0, 0, 20)], triangles)
        assert math.isclose(sum(abs(polygons._area(p)) for p in pieces) + geometry.union_area(triangles), 400, abs_tol=1e-8)
        assert not any(kinds([p]) for p in pieces if abs(polygons._area(p)) > 1e-9)


def test_gaps_of_cells(spark):
    cells = spark.createDataFrame([(i, 10 * (i % 3), 10 * (i // 3), 10 * (i % 3) + 10, 10 * (i // 3) + 10) for i in range(9)], "cell int, x0 int, y0 int, x1 int, y1 int")
    fires = frame(spark, "f", [(1, [square(-5, -5, 15), square(2, 2, 4)]), (2, [square(0, 0, 3)]), (3, None), (4, [ring((20, 20), (30, 20), (30, 30))])])
    got = {r["cell"]: (r["gap_area"], r["pieces"]) for r in polygons.coverage_gaps(cells, fires, key="cell", size=10.0).collect()}
    assert {k: round(a, 9) for k, (a, _) in got.items()} == {0: 15.0, **dict.fromkeys(range(1, 8), 100.0), 8: 50.0}
    for area, pieces in got.values():
        rings = [np.array([(p["x"], p["y"]) for p in r]) for r in pieces]
        assert not any(kinds([r]) for r in rings) and math.isclose(sum(abs(polygons._area(r)) for r in rings), area)


def test_nearest_ends_without_coordinates(spark):
    from gridloom.contracts import ContractError
    from gridloom.operators.joins import nearest

    nan = math.nan
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 1.0), (3, 5.0, None), (4, nan, nan)], "p int, x double, y double")
    others = spark.createDataFrame([(7, 3.0, 4.0), (8, nan, 0.0), (9, None, 0.0)], "c int, x double, y double")
    got = {r["p"]: (r["c"], r["distance_squared"]) for r in nearest(points, others, cell=1.0, point_id="p", candidate_id="c").collect()}
    assert got == {1: (7, 25.0), 2: (None, None), 3: (None, None), 4: (None, None)}
    far = spark.createDataFrame([(7, math.inf, 0.0)], "c int, x double, y double")
    with pytest.raises(ContractError):
        nearest(points, far, cell=1.0, point_id="p", candidate_id="c")

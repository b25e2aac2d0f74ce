"""Coverages: shared boundaries simplified once."""

import itertools
import math
import random

import numpy as np
import pytest

from gridloom.operators import coverage, polygons


def wavy(rng, a, b, n, bend):
    """A path from a to b with n points between, off the line by up to ``bend``."""
    (ax, ay), (bx, by) = a, b
    return [(ax + (bx - ax) * k / (n + 1) + rng.uniform(-bend, bend), ay + (by - ay) * k / (n + 1) + rng.uniform(-bend, bend)) for k in range(1, n + 1)]


def grid(rng, rows, cols, n, bend, side=10.0):
    """Squares with wavy sides: neighbours share the points of their side."""
    node = lambda i, j: (j * side, i * side)
    across = {(i, j): wavy(rng, node(i, j), node(i, j + 1), n, bend) for i in range(rows + 1) for j in range(cols)}
    up = {(i, j): wavy(rng, node(i, j), node(i + 1, j), n, bend) for i in range(rows) for j in range(cols + 1)}
    out = {}
    for i, j in itertools.product(range(rows), range(cols)):
        ring = [node(i, j), *across[i, j], node(i, j + 1), *up[i, j + 1], node(i + 1, j + 1), *across[i + 1, j][::-1], node(i + 1, j), *up[i, j][::-1]]
        turn = rng.randrange(len(ring))
        ring = ring[turn:] + ring[:turn]
        if rng.random() < 0.5:
            ring = ring[::-1]
        out[f"p{i}_{j}"] = [[*ring, ring[0]]]
    return out


def frame(spark, shapes):
    return spark.createDataFrame([(k, r) for k, r in shapes.items()], "name string, rings array<array<struct<x:double,y:double>>>")


def simplified(spark, shapes, tolerance, **options):
    rows = coverage.simplify_coverage(frame(spark, shapes), key="name", tolerance=tolerance, **options).collect()
    return {r["name"]: None if r["rings"] is None else [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in rows}


def area(rings):
    return sum(polygons._area(np.array(r)) for r in rings)


def edges(rings):
    return [frozenset(e) for r in rings for e in itertools.pairwise(r)]


@pytest.mark.parametrize(("bend", "tolerance"), [(0.4, 1.0), (1.5, 3.0), (0.3, 100.0)])
def test_no_gaps_and_no_overlaps(spark, bend, tolerance):
    rng = random.Random(4)
    shapes = grid(rng, 4, 5, 12, bend)
    if bend > 1:  # keep the originals valid: waves that cross are not a coverage
        shapes = grid(rng, 4, 5, 5, 0.8)
    out = simplified(spark, shapes, tolerance)
    assert out.keys() == shapes.keys()
    before, after = sum(len(r[0]) for r in shapes.values()), sum(len(r[0]) for r in out.values())
    assert after < 0.6 * before
    counts = {}
    for rings in out.values():
        assert polygons.problems([np.array(r) for r in rings], shell_first=True) == []
        for e in edges(rings):
            counts[e] = counts.get(e, 0) + 1
    outline = [e for e, n in counts.items() if n == 1]
    assert set(counts.values()) == {1, 2}
    # the outline is one closed curve, and the areas add up to what it encloses
    ways = {}
    for e in outline:
        for p in e:
            ways.setdefault(p, []).append(e)
    assert all(len(w) == 2 for w in ways.values())
    start = min(ways)
    path, last = [start], None
    while True:
        e = next(x for x in ways[path[-1]] if x != last)
        last = e
        (following,) = e - {path[-1]}
        if following == start:
            break
        path.append(following)
    assert len(path) == len(ways)
    whole = abs(polygons._area(np.array([*path, start])))
    assert math.isclose(sum(abs(area(r)) for r in out.values()), whole, rel_tol=1e-9)
    assert abs(whole - abs(sum(abs(area(r)) for r in shapes.values()))) < tolerance**2 * 12 * 18
    # the places where three meet stay
    corners = {(10.0 * j, 10.0 * i) for i in range(5) for j in range(6)} - {(0.0, 0.0), (50.0, 0.0), (0.0, 40.0), (50.0, 40.0)}
    assert corners <= {p for r in out.values() for p in r[0]}


def test_islands_holes_and_parallel_arcs(spark):
    circle = lambda x, y, r, n=40: [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    close = lambda r: [*r, r[0]]
    inner = circle(0, 0, 2)
    lens = [(20.0, 0.0), *[(20.0 + k, 0.05 * math.sin(k)) for k in range(1, 10)], (30.0, 0.0)]
    above, below = [(25.0, 0.5)], [(25.0, -0.5)]
    shapes = {
        "disc": [close(inner)], "ring": [close(circle(0, 0, 9)), close(inner[::-1])], "alone": [close(circle(50, 50, 1))],
        "north": [close([*lens, *above])], "south": [close([*lens, *below])], "none": None,
    }
    out = simplified(spark, shapes, 50.0)
    assert out["none"] is None and len(out["alone"][0]) == 4
    assert set(edges(out["disc"])) == set(edges([out["ring"][1]])) and len(out["disc"][0]) == 4
    for name in ("disc", "ring", "north", "south", "alone"):
        assert polygons.problems([np.array(r) for r in out[name]], shell_first=True) == [] and abs(area(out[name])) > 0
    assert set(edges(out["north"])) & set(edges(out["south"]))


def test_what_is_no_coverage_is_an_error(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    with pytest.raises(Exception, match="overlaps"):
        simplified(spark, {"a": [square], "b": [square], "c": [square]}, 1.0)
    assert simplified(spark, {"a": [square]}, 0.01) == {"a": [square]} or edges(simplified(spark, {"a": [square]}, 0.01)["a"])
    assert coverage.simplify_coverage(frame(spark, {"a": [square]}).limit(0), key="name", tolerance=1.0).count() == 0


def test_points_in_the_way_stop_it():
    path = [(0.0, 0.0), (5.0, 3.0), (10.0, 0.0)]
    squares = {(i, j) for i in range(-1, 3) for j in range(-1, 3)}
    none = np.empty((0, 2))
    assert coverage.simplify(path, 10.0, none, squares, 10.0, least=2) == [path[0], path[2]]
    assert coverage.simplify(path, 10.0, np.array([(5.0, 1.0)]), squares, 10.0, least=2) == path
    assert coverage.simplify(path, 10.0, np.array([(5.0, 3.5), (5.0, -0.5)]), squares, 10.0, least=2) == [path[0], path[2]]
    assert coverage.simplify(path, 10.0, none, {(5, 5)}, 10.0, least=2) == path and coverage.simplify(path, 10.0, none, squares, 10.0, least=3) == path
    assert coverage.simplify(path, 3.0, none, squares, 10.0, least=2) == path  # a triangle of 15 is over 9

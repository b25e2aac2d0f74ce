"""What larger tables brought to light: rows beyond the thousandth batch, ties of sums, slabs without a middle, sides that are broadcast on a wrong estimate."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators import coverage, geometry, joins, lattice, polygons
from gridloom.plans import adapters, queries
from gridloom.sources import catalogue


def parts(keys, folder):
    frame = pd.DataFrame({"p_partkey": np.array(keys, "int64"), "p_size": np.full(len(keys), 9, "int32"), "p_brand": ["Brand#7" if k % 7 == 0 else "Brand#1" for k in keys]})
    frame.to_parquet(folder / "part.parquet", index=False)


def in_duckdb(name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(queries.oracle_sql()[name])


def test_batches_beyond_the_thousandth_row_are_named_as_in_sql(spark, tmp_path):
    parts([*range(0, 120), *range(1_250_000, 1_250_120)], tmp_path)
    for name in ("batch_plan", "native_windows"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = in_duckdb(name, tmp_path, ["part"])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
    plan = lattice.batch_plan(spark.createDataFrame([(25000, 0), (25003, 3), (2500, 0)], "row_index int, column_index int"), 2)
    assert {r["batch_id"] for r in plan.collect()} == {"r12500_c000", "r12501_c001", "r1250_c000"}  # the operator's ids are whole


def welford(values):
    mean = squares = 0.0
    for n, x in enumerate(values, 1):
        delta = x - mean
        mean += delta / n
        squares += delta * (delta - delta / n)
    return (squares / len(values)) ** 0.5


def test_a_deviation_at_the_bound_is_no_less(spark, tmp_path):
    # 10 values whose deviation is 14.5 exactly; in some orders doubles end below it
    base, rng = [1.0, 30.0] * 5, np.random.default_rng(0)
    orders = (rng.permutation([*base, *(v for v in (1.0, 30.0) for _ in range(4))]).tolist() for _ in range(20000))
    values = next(v for v in orders if welford(v) < 14.5)
    parts([0, 10], tmp_path)
    rows = [(k, v, i) for k in (0, 10) for i, v in enumerate(values)]
    pd.DataFrame({
        "l_partkey": np.array([r[0] for r in rows], "int64"), "l_suppkey": np.full(len(rows), 3, "int64"), "l_quantity": [r[1] for r in rows], "l_extendedprice": np.ones(len(rows)),
        "l_linenumber": np.array([r[2] for r in rows], "int32"), "l_orderkey": np.array([r[2] for r in rows], "int64"),
    }).to_parquet(tmp_path / "lineitem.parquet", index=False)
    assert adapters.modelling(spark, str(tmp_path)).where("elevation_std < 14.5").count() == 2  # as plain doubles say
    got = [tuple(r) for r in queries.queries()["class_changes"](spark, str(tmp_path)).select("evt_dominant_class", "training_count", "holdout_count", "status").collect()]
    assert got == [(3, 0, 1, "unseen")]


def test_clipped_rings_end_on_the_box():
    for x0, x1 in ((0, 1513), (37, 1927), (74, 1964)):
        ring = np.array([(x0, 0), (x1, 0), (x1, 500), (x0, 500), (x0, 0)], float)
        assert set(geometry.clip_ring(ring, (0, 0, 1000, 1000))[:, 0].tolist()) == {float(x0), 1000.0}


def test_slabs_between_neighbouring_doubles_have_no_area():
    beyond = float(np.nextafter(1000.0, 2000.0))
    ring = np.array([(0, 0), (beyond, 0), (1000, 500), (0, 500), (0, 0)], float)
    assert np.isclose(geometry.union_area([[ring]]), 500000.0)
    box = np.array([(0, 0), (2000, 0), (2000, 500), (0, 500), (0, 0)], float)
    assert np.isclose(sum(abs(polygons._area(r)) for r in polygons.difference_pieces([box], [[ring]])), 500000.0)


def test_exploded_sides_are_not_broadcast(spark):
    box = lambda k, r="": spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], f"{k} int, {r}x0 double, {r}y0 double, {r}x1 double, {r}y1 double")
    shape = lambda k: box(k).select(k, F.array(adapters.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).alias("rings"))
    items = shape("n").select(F.lit("i").alias("item_id"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 10.0), ("y1", 10.0))], "rings")
    frames = {
        "box_join": joins.box_join(box("a"), box("b", "r_"), size=4.0), "polygon_join": polygons.polygon_join(shape("a"), shape("b"), left_key="a", right_key="b", size=4.0),
        "cover": geometry.polygon_cover(box("a"), shape("b"), key="a", size=4.0), "burned": geometry.burned_by_polygons(box("cell_id"), shape("b"), size=4.0), "gaps": polygons.coverage_gaps(box("a"), shape("b"), key="a", size=4.0),
        "arcs": coverage.coverage_arcs(shape("a"), key="a"), "simplified": coverage.simplify_coverage(shape("a"), key="a", tolerance=1.0), "search": catalogue.search(items, shape("a"), area_id="a", size=4.0),
    }
    for name, frame in frames.items():
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString(), name
        assert frame.count() > 0, name

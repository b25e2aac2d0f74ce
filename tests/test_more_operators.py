"""Geometry of several parts, joins, contracts, models and sinks on small tables with known answers."""

import hashlib
import io
import json
import math
import random
import struct
import urllib.error
import zipfile

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom import contracts, missing, session
from gridloom.contracts import ContractError
from gridloom.functions import scalar
from gridloom.operators import geometry, joins, lattice, modeling, raster, stats
from gridloom.sources import download, files, geo, publish, reports


def square(x0, y0, x1, y1, turn=1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [{"x": float(x), "y": float(y)} for x, y in ring[::turn]]


RINGS = "array<array<struct<x:double,y:double>>>"


def test_parts_and_holes_in_any_order_and_turn(spark):
    cases = {
        1: ([square(0, 0, 1, 1), square(5, 5, 7, 7)], 5.0), 2: ([square(0, 0, 9, 9), square(1, 1, 2, 2), square(3, 3, 5, 5, -1)], 76.0),
        3: ([square(1, 1, 2, 2), square(20, 0, 21, 1, -1), square(0, 0, 9, 9)], 81.0), 4: ([square(0, 0, 9, 9), square(1, 1, 8, 8), square(2, 2, 3, 3)], 33.0),
    }
    df = spark.createDataFrame([(k, r) for k, (r, _) in cases.items()], f"id int, rings {RINGS}")
    got = {r["id"]: (r["a"], r["b"]["x1"]) for r in df.select("id", geometry.polygon_area(F.col("rings")).alias("a"), geometry.polygon_bounds(F.col("rings")).alias("b")).collect()}
    assert {k: a for k, (a, _) in got.items()} == {k: a for k, (_, a) in cases.items()} and got[1][1] == 7.0 and got[3][1] == 21.0


def test_cover_of_many_parts_against_a_raster(spark):
    rng = random.Random(1)
    polygons = []
    for _ in range(9):
        x, y = rng.randrange(0, 30), rng.randrange(0, 30)
        rings = [square(x, y, x + 12, y + 9), square(x + 3, y + 3, x + 6, y + 6, -1), square(x + 14, y + 2, x + 18, y + 5)]
        rng.shuffle(rings)
        polygons.append(rings)
    cells = [(i * 6 + j, i * 10.0, j * 10.0, i * 10.0 + 10, j * 10.0 + 10) for i in range(6) for j in range(6)]
    got = {r["k"]: r["covered_area"] for r in geometry.polygon_cover(spark.createDataFrame(cells, "k int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(p,) for p in polygons], f"rings {RINGS}"), key="k", size=20.0).collect()}
    burned = np.zeros((60, 60), bool)
    for rings in polygons:
        one = np.zeros((60, 60), bool)
        for r in rings:
            xs, ys = [int(p["x"]) for p in r], [int(p["y"]) for p in r]
            one[min(xs) : max(xs), min(ys) : max(ys)] ^= True
        burned |= one
    for k, x0, y0, _, _ in cells:
        assert math.isclose(got.get(k, 0.0), burned[int(x0) : int(x0) + 10, int(y0) : int(y0) + 10].sum(), abs_tol=1e-9)


def test_union_area_of_crossing_triangles():
    tri = lambda *p: [np.array([*p, p[0]], float)]
    assert math.isclose(geometry.union_area([tri((0, 0), (4, 0), (0, 4)), tri((0, 0), (4, 0), (4, 4))]), 12.0)
    assert geometry.union_area([]) == 0.0 and geometry.union_area([[np.array([[1.0, 0], [1, 5], [1, 0]])]]) == 0.0


def shapefile(parts_by_record, deleted):
    body = b""
    for n, parts in enumerate(parts_by_record, 1):
        points = [p for part in parts for p in part]
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        xs, ys = zip(*points, strict=True)
        content = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", n, len(content) // 2) + content
    shp = b"\0" * 100 + body
    dbf = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(parts_by_record), 32 + 32 + 1, 11) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    for n in range(len(parts_by_record)):
        dbf += (b"*" if n in deleted else b" ") + f"fire{n}".encode().ljust(10)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for ending, data in ((".shp", shp), (".dbf", dbf), (".shx", b"x")):
            z.writestr(f"layer{ending}", data)
    return buffer.getvalue()


def test_shapefile_with_parts_and_deleted_rows(spark, tmp_path):
    ring = lambda x, s: [(x, 0.0), (x, s), (x + s, s), (x + s, 0.0), (x, 0.0)]
    (tmp_path / "a.zip").write_bytes(shapefile([[ring(0.0, 1.0), ring(10.0, 2.0)], [ring(0.0, 9.0)], [ring(3.0, 3.0)]], {1}))
    df = geo.read_shapefiles(spark, f"file://{tmp_path}/a.zip", ["NAME"])
    assert {r["NAME"]: r["a"] for r in df.select("NAME", geometry.polygon_area(F.col("rings")).alias("a")).collect()} == {"fire0": 5.0, "fire2": 9.0}


def test_nearest_reaches_any_distance(spark):
    rng = random.Random(2)
    cand = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(30)] + [(99, 4000.0, -3000.0), (50, 0.5, -1.01), (51, 1.9, 1.9)]
    pts = [(i, rng.uniform(-300, 500), rng.uniform(-300, 500)) for i in range(60)] + [(100, 0.5, 0.5), (101, 9000.0, -9000.0), (102, None, 1.0)]
    out = joins.nearest(spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame(cand, "c int, x double, y double"), cell=1.0, point_id="p", candidate_id="c")
    got = {r["p"]: (r["c"], r["distance_squared"]) for r in out.collect()}
    assert got[102] == (None, None) and len(got) == len(pts)
    for p, x, y in pts[:-1]:
        d, c = min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b in cand)
        assert got[p][0] == c and math.isclose(got[p][1], d)
    none = joins.nearest(spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame([], "c int, x double, y double"), cell=1.0, point_id="p", candidate_id="c")
    assert none.where("c IS NULL").count() == len(pts)


def test_projection_there_and_back(spark):
    pts = [(-106.0, 34.0), (-103.2, 31.9), (-120.5, 47.25), (-80.0, 25.5)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = geometry.albers(F.col("lon"), F.col("lat"))
    lon, lat = geometry.albers_inverse(F.col("x"), F.col("y"))
    mx, my = geometry.web_mercator(F.col("lon"), F.col("lat"))
    for r in df.withColumn("x", x).withColumn("y", y).select("lon", "lat", lon.alias("a"), lat.alias("b"), mx.alias("mx"), my.alias("my")).collect():
        assert abs(r["a"] - r["lon"]) < 1e-9 and abs(r["b"] - r["lat"]) < 1e-9
        assert math.isclose(r["mx"], math.radians(r["lon"]) * 6378137.0) and math.isclose(r["my"], math.asinh(math.tan(math.radians(r["lat"]))) * 6378137.0)


def test_quantiles_are_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=1001), "b": np.repeat(rng.integers(0, 4, 50), 20).astype(float), "c": np.array([5.0]), None: rng.exponential(size=400) ** 6}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("d", None)]
    got = {r["g"]: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"p01": 0.01, "p50": 0.5, "p99": 0.99, "all": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99), ("all", 1.0)):
            assert math.isclose(got[g][name], np.quantile(x, q), rel_tol=1e-12)


def test_proof_of_join_keys(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    assert joins.join_features([a, b.where("b = 5")], "k", prove=True).count() == 1
    with pytest.raises(Exception, match="more than once"):
        joins.join_features([a, b], "k", prove=True).collect()
    assert joins.join_features([a, b.where("b = 5")], "k", how="left").where("b is null").count() == 1
    with pytest.raises(ContractError):
        joins.lookup(a, b, "k", "b")
    with pytest.raises(ContractError):
        joins.align_to(a, spark.createDataFrame([(1, 1), (7, 2)], "k int, place int"), "k", order="place")
    counts = {r["v"]: (r["x_count"], r["y_count"]) for r in joins.align_counts(spark.createDataFrame([("x", 1), ("y", 1), ("x", 2)], "p string, v int"), "p", ["x", "y"], "v").collect()}
    assert counts == {1: (1, 1), 2: (1, 0)}


def training(spark):
    rows = [(f"c{i}", f"b{i // 5}", i % 5, (i // 5) % 5, int(i % 3 == 0), float(i), i % 4) for i in range(100)]
    return spark.createDataFrame(rows, "cell_id string, spatial_block_id string, random_cv_fold int, spatial_cv_fold int, target int, x double, evt int")


def test_training_and_fold_contracts(spark):
    t = training(spark)
    random_folds = [(20, 7), (20, 7), (20, 6), (20, 7), (20, 7)]
    kw = dict(fold="random_cv_fold", expected_folds=random_folds, nominal=["evt"])
    contracts.check_training(t, ["x", "evt"], **kw)
    spatial = [(r["n"], r["p"]) for r in t.groupBy("spatial_cv_fold").agg(F.count("*").alias("n"), F.sum("target").alias("p")).orderBy("spatial_cv_fold").collect()]
    contracts.check_training(t, ["x", "evt"], fold="spatial_cv_fold", expected_folds=spatial, expected_blocks=[4] * 5)
    broken = {
        "columns": t.withColumn("more", F.lit(1)), "key": t.withColumn("cell_id", F.lit("c")), "target": t.withColumn("target", F.when(F.col("x") > 5, F.col("target"))),
        "random_cv_fold": t.withColumn("random_cv_fold", F.when(F.col("x") > 5, F.col("random_cv_fold"))), "domain": t.withColumn("x", F.when(F.col("x") > 5, F.col("x")).otherwise(float("inf"))),
    }
    for match, df in broken.items():
        with pytest.raises(ContractError, match=match):
            contracts.check_training(df, ["x", "evt"], **kw)
    with pytest.raises(ContractError, match="several folds"):
        contracts.check_whole_blocks(t, "random_cv_fold")
    with pytest.raises(ContractError, match="blocks"):
        contracts.check_whole_blocks(t, "spatial_cv_fold", expected=[1] * 5)
    with pytest.raises(ContractError, match="values"):
        modeling.run_saved_cv(t, lambda n: None, fold="random_cv_fold", n_folds=4)
    split = t.withColumn("split", F.when(F.col("spatial_block_id").isin("b1", "b2"), "final_test").otherwise("train"))
    split = split.withColumns({f: F.when(F.col("split") == "train", F.col(f)) for f in ("random_cv_fold", "spatial_cv_fold")})
    contracts.check_split(split)
    with pytest.raises(ContractError, match="null folds"):
        contracts.check_split(split.withColumn("random_cv_fold", F.coalesce("random_cv_fold", F.lit(0))))
    contracts.check_counts(t, {"all": (F.lit(True), 100), "positive": (F.col("target") == 1, 34)})
    with pytest.raises(ContractError, match="positive"):
        contracts.check_counts(t, {"positive": (F.col("target") == 1, 35)})
    labels = spark.createDataFrame([(0.0, 0), (0.3, 1), (0.1, 1), (0.5, 0), (None, 0)], "f double, t int")
    assert labels.agg(contracts.label_violations(labels, "f", "t")).first()[0] == 3
    contracts.check_disjoint(t.where("x < 5"), t.where("x > 5"), "cell_id")
    with pytest.raises(ContractError):
        contracts.check_disjoint(t, t, "cell_id")


def test_provenance_and_plurality_contracts(spark):
    saved = {"candidate": "D", "fit_count": 25, "roc_auc": 0.5413391}
    contracts.check_record(saved, {"candidate": "D", "fit_count": 25}, close_to={"roc_auc": (0.541339, 5e-7)})
    for expected, near in (({"candidate": "E"}, {}), ({"absent": 1}, {}), ({}, {"roc_auc": (0.6, 1e-3)}), ({}, {"absent": (1.0, 1.0)})):
        with pytest.raises(ContractError):
            contracts.check_record(saved, expected, close_to=near)
    samples = spark.createDataFrame([(z, c) for z, cs in {1: [4, 4, 7, -9999], 2: [-9999] * 4, 3: [7, 4, 7, 4]}.items() for c in cs], "zone int, c int")
    qa = raster.plurality(samples, ["zone"], "c", nodata=-9999)
    contracts.check_plurality(qa, samples.select("zone").distinct(), "zone", positions=4, codes=[4, 7])
    for change in ({"winning_sample_count": F.lit(1)}, {"plurality_tie": ~F.col("plurality_tie")}, {"dominant_class": F.lit(7)}, {"valid_fraction": F.lit(0.1)}):
        with pytest.raises(ContractError, match="plurality"):
            contracts.check_plurality(qa.withColumns(change), samples.select("zone").distinct(), "zone", positions=4, codes=[4, 7])
    with pytest.raises(ContractError):
        contracts.check_plurality(qa.where("zone < 3"), samples.select("zone").distinct(), "zone")
    report = spark.createDataFrame([(1, 3, 0, True), (2, 3, 1, False)], "zone int, source_nodata int, unsupported int, agrees boolean")
    raster.check_support(report.where("zone = 1"))
    with pytest.raises(ContractError, match="1 zones"):
        raster.check_support(report)


def test_logistic_regression_is_newtons(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(400, 2)) * [3, 0.5] + 1, None
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "cell_id int, a double, b double, target int")
    got = {r["cell_id"]: r["predicted_probability"] for r in modeling.predict(modeling.logistic_pipeline(400, continuous=["a", "b"]).fit(df), df, ["cell_id"]).collect()}
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((400, 1))])
    w, penalty = np.zeros(3), np.diag([1.0, 1.0, 0.0])  # half the squared weights, against the sum of the losses at C = 1
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    want = 1 / (1 + np.exp(-z @ w))
    assert max(abs(got[i] - want[i]) for i in range(400)) < 1e-5


def test_tuning_final_scores_and_experiment_records(spark):
    t = session.cut(training(spark))
    kw = dict(continuous=["x"], nominal=["evt"], trees=3)
    folds, chosen = modeling.tune_forest(t, fold="random_cv_fold", candidates=(("A", 3, 1), ("B", 2, 5)), **kw)
    assert folds.count() == 10 and chosen.where("selected").count() == 1
    assert modeling.CANDIDATES[1:3] == (("B", None, 5), ("C", None, 10))
    every = t.withColumn("cell_id", F.concat("cell_id", F.lit("x")))
    out = modeling.score_everything(t, every, lambda n: modeling.forest_pipeline(max_depth=3, **kw))
    assert out.count() == 100 and out.where("susceptibility_probability between 0 and 1").count() == 100
    records, per_fold = [], []
    for fold in ("random_cv_fold", "spatial_cv_fold"):
        oof, m = modeling.run_saved_cv(t, lambda n: modeling.logistic_pipeline(n, continuous=["x"]), fold=fold)
        per_fold.append(m)
        records.append(modeling.experiment_record(oof, m, model="logistic", predictors=["x"], input_sha256="ab"))
    table = {r["validation_strategy"]: r for r in modeling.compare_validation(*records, *per_fold, population={"rows": 100, "fold_count": 5}, need_hash=True).collect()}
    assert math.isclose(table["Spatial - Random"]["roc_auc"], table["Spatial CV"]["roc_auc"] - table["Random CV"]["roc_auc"])
    for bad in ({"model": "other"}, {"input_sha256": "cd"}, {"final_test_accessed": True}, {"roc_auc_fold_mean": 0.1}, {"rows": 99}):
        with pytest.raises(ContractError):
            modeling.compare_validation(records[0], records[1] | bad, *per_fold)
    with pytest.raises(ContractError):
        modeling.compare_validation(*records, *per_fold, population={"rows": 1})


def test_lattice_names_and_indices(spark):
    cells = lattice.number_cells(lattice.candidate_cells(spark, lattice.Extent(0, 0, 3, 2, 1.0)), prefix="zone_")
    assert sorted(r["cell_id"] for r in cells.collect())[0] == "zone_000001"
    at = {(r["south_row"], r["west_col"]): (r["row_index"], r["column_index"]) for r in lattice.lattice_index(cells, lattice.Extent(0, 0, 3, 2, 1.0)).collect()}
    assert at[0, 0] == (1, 0) and at[1, 2] == (0, 2)
    grown = geometry.buffer_box(cells, 0.5).agg(F.min("x0"), F.max("y1")).first()
    assert tuple(grown) == (-0.5, 2.5)
    drawn = raster.rasterise(cells, x0=0.0, y1=2.0, cell=1.0, value="number")
    assert drawn.where("row = 1 and col = 0").first()["number"] == 1
    with pytest.raises(ContractError):
        raster.rasterise(cells.unionByName(cells), x0=0.0, y1=2.0, cell=1.0, value="number")
    stacked = raster.stack_items([drawn.select("row", "col", F.lit(None).cast("long").alias("number")), drawn], value="number")
    assert raster.mosaic_first_valid(stacked, order=["item"], value="number").agg(F.sum("number")).first()[0] == 21


def test_small_expressions(spark):
    df = spark.createDataFrame([([3, 1, 3, None], 1.0, 0.0, float("nan"))], "c array<int>, a double, z double, n double")
    r = df.select(scalar.class_counts("c").alias("c"), missing.ratio("a", "z").alias("q"), missing.same("n", "n").alias("s"), missing.close("a", "n").alias("k"), *scalar.colour(F.lit("#ff8001"))).first()
    assert [(x["value"], x["n"]) for x in r["c"]] == [(1, 1), (3, 2)] and r["q"] is None and r["s"] and not r["k"] and (r["red"], r["green"], r["blue"]) == (255, 128, 1)
    edges = spark.createDataFrame([([square(0, 0, 2, 2)],)], f"rings {RINGS}").select(F.explode(geometry.edges_of(F.col("rings"))).alias("e"))
    assert edges.count() == 4
    assert session.build_session().conf.get("spark.sql.adaptive.enabled") == "true"


def test_files_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 0.5), (2, None, None)], "id int, name string, share double")
    files.write_csv(df, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), "id int, name string, share double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(tmp_path / "t"), "id date, name string, share double").collect()
    df.write.parquet(str(tmp_path / "p"))
    files.view(spark, str(tmp_path / "p"), "a_view")
    assert spark.sql("SELECT count(*) FROM a_view").first()[0] == 2
    text = reports.markdown(df.orderBy("id"), "Shares")
    assert text == "# Shares\n\n| id | name | share |\n|-|-|-|\n| 1 | a\\|b | 0.5 |\n| 2 |  |  |\n"
    shape = spark.createDataFrame([([square(0, 0, 1, 1)],)], f"rings {RINGS}").select(reports.geojson_polygon(F.col("rings")).alias("g")).first()["g"]
    assert json.loads(shape)["coordinates"][0][2] == [1.0, 1.0]
    assert [r["id"] for r in reports.legend(df.unionByName(df), "id", "name", "share").collect()] == [1, 2]
    assert publish.table_fingerprint(df).first()["digest"] == publish.table_fingerprint(df.repartition(3)).first()["digest"]
    items = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0, 10), ("a", 5.0, 5.0, 6.0, 6.0, 10), ("c", 0.5, 0.5, 2.0, 2.0, 1)], "item_id string, x0 double, y0 double, x1 double, y1 double, gsd int")
    assert [r["item_id"] for r in geo.catalogue_search(items, (0, 0, 5, 5), gsd=10).collect()] == ["a", "b"]
    assert [r["item_id"] for r in geo.catalogue_search(items, (0, 0, 1, 1), ids=["b", "c"], limit=1).collect()] == ["b"]


def test_geoparquet_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    rows = [(f"c{i}", bytearray(geo.wkb_polygon([ring])), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "cell_id string, geometry binary, p double").repartition(3)
    path = f"file://{tmp_path}/g"
    back = geo.write_geoparquet(df, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for f in (tmp_path / "g").glob("*.parquet"):
        meta = json.loads(pq.read_metadata(f).metadata[b"geo"])
        assert meta["columns"]["geometry"]["encoding"] == "WKB" and meta["columns"]["geometry"]["crs"]["id"]["code"] == 5070
    with pytest.raises(FileExistsError):
        geo.write_geoparquet(df, path)
    again = geo.write_geoparquet(df.limit(5), path, replace=True)
    assert again.count() == 5 and not list(tmp_path.glob("*_old*")) and geo.parse_wkb(bytes(again.first()["geometry"])) == [[ring]]


def test_publication_keeps_one_whole_table(spark, tmp_path):
    df = spark.range(5)
    path = f"file://{tmp_path}/t"
    publish.publish_table(df, path)
    assert publish.publish_table(spark.range(7), path, replace=True).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    publish.publish_all(spark, {f"file://{tmp_path}/u": df}, {"rows": 5}, f"file://{tmp_path}/summary.json")
    publish.write_json(spark, {"rows": 6}, f"file://{tmp_path}/summary.json")
    assert json.loads((tmp_path / "summary.json").read_text()) == {"rows": 6}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"x" * 3_000_000)
    line = "a.bin:" + hashlib.sha256(b"x" * 3_000_000).hexdigest()
    assert publish.fingerprint(spark, f"file://{tmp_path}/d") == hashlib.sha256(line.encode()).hexdigest()


def test_batches_are_validated_again(spark, tmp_path):
    plan = spark.createDataFrame([(i,) for i in range(4)], "batch_id int")
    path = f"file://{tmp_path}/b"
    publish.run_batches(spark, plan.where("batch_id < 2"), lambda p: p.withColumn("v", F.lit(1)), path, version="1")

    def strict(done):
        contracts.require(done.where("v <> 1").isEmpty(), "a finished batch is broken")

    assert publish.run_batches(spark, plan, lambda p: p.withColumn("v", F.lit(1)), path, version="1", validate=strict).count() == 4
    with pytest.raises(ContractError):
        publish.run_batches(spark, spark.createDataFrame([(9,)], "batch_id int"), lambda p: p.withColumn("v", F.lit(2)), path, version="1", validate=strict)


def test_requests(monkeypatch):
    calls, waits = [], []

    class Body(io.BytesIO):
        pass

    def opener(url):
        calls.append(url)
        if len(calls) == 1:
            raise TimeoutError
        if len(calls) == 2:
            raise urllib.error.HTTPError(url, 503, "", None, None)
        return Body(b'{"a": 1}')

    assert download.request_json("http://h/q", {"x": "1 2"}, opener=opener, sleep=waits.append) == {"a": 1}
    assert calls[0] == "http://h/q?x=1+2" and waits == [2, 4]
    with pytest.raises(ValueError):
        download.request_json("http://h/q", opener=lambda u: Body(b'{"error": {"code": 400}}'))
    p = download.image_request((-2500000.0, 3000000.0), 30.0, (-1000.0, 1000.0, 2000.0, 2500.0))
    x0, y0, x1, y1 = map(float, p["bbox"].split(","))
    assert x0 <= -1030 and x1 >= 2030 and (x0 + 2500000) % 30 == 0 and (3000000 - y1) % 30 == 0
    assert tuple(map(int, p["size"].split(","))) == (round((x1 - x0) / 30), round((y1 - y0) / 30))

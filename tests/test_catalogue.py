"""Catalogue items: parsing, ranges of lines, pushed filters, search by geometry."""

import json
import random

import pytest

from gridloom.sources import catalogue


def item(name, ring, *, gsd=10, **more):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return {
        "type": "Feature", "id": name, "collection": "dem", "geometry": {"type": "Polygon", "coordinates": [ring]}, "bbox": [min(xs), min(ys), max(xs), max(ys)],
        "properties": {"gsd": gsd, "datetime": "2020-01-01T00:00:00Z", "ü": None}, "assets": {"data": {"href": f"https://example.org/{name}.tif"}}, **more,
    }


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


TRIANGLE = [[0, 0], [10, 0], [0, 10], [0, 0]]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    items = [item(f"i{k:03d}", box(rng.uniform(0, 90), rng.uniform(0, 90), 5, 5), gsd=rng.choice([10, 30])) for k in range(200)]
    (tmp_path / "lines.ndjson").write_text("\n".join(map(json.dumps, items)) + "\n\n")
    (tmp_path / "one.json").write_text(json.dumps(item("tri", TRIANGLE)))
    (tmp_path / "more.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [item("multi", TRIANGLE, geometry={"type": "MultiPolygon", "coordinates": [[box(200, 0, 1, 1)], [box(300, 0, 9, 9), box(303, 3, 3, 3)]]}, bbox=[200, 0, 0, 309, 9, 50])]}))
    (tmp_path / "notes.txt").write_text("no item")
    return tmp_path, items


@pytest.mark.parametrize("split", [1, 100, 997, 1 << 20])
def test_every_line_is_read_once(spark, folder, split):
    path, items = folder
    rows = catalogue.read_items(spark, f"{path}/lines.ndjson", split=split if split > 50 else 4096).collect()
    assert sorted(r["item_id"] for r in rows) == [i["id"] for i in items]
    reader = catalogue.ItemReader({"path": f"{path}/lines.ndjson", "split": str(max(split, 37))})
    parts = reader.partitions()
    got = [i["id"] for p in parts for i in reader._items(p)]
    assert got == [i["id"] for i in items] and (split > 1000 or len(parts) > 50)


def test_folders_shapes_and_assets(spark, folder):
    path, _ = folder
    rows = {r["item_id"]: r for r in catalogue.read_items(spark, str(path)).collect()}
    assert len(rows) == 202
    assert [len(r) for r in rows["multi"]["rings"]] == [5, 5, 5] and (rows["multi"]["x0"], rows["multi"]["y1"]) == (200.0, 9.0)
    assert rows["tri"]["assets"] == {"data": "https://example.org/tri.tif"} and json.loads(rows["tri"]["properties"])["ü"] is None and rows["tri"]["gsd"] == 10.0


def test_items_without_bounds_or_footprint():
    bare = {"type": "Feature", "id": "x", "geometry": None}
    assert catalogue.parse_item(bare)["rings"] is None and catalogue.parse_item(bare)["x0"] is None
    boxed = catalogue.parse_item({**bare, "bbox": [1, 2, 3, 4]})
    assert [(p["x"], p["y"]) for p in boxed["rings"][0]] == [(1, 2), (3, 2), (3, 4), (1, 4), (1, 2)]
    shaped = catalogue.parse_item({**bare, "geometry": {"type": "Polygon", "coordinates": [TRIANGLE]}})
    assert (shaped["x0"], shaped["y0"], shaped["x1"], shaped["y1"]) == (0, 0, 10, 10)
    for bad in ({}, {"type": "Feature"}, {**bare, "type": "Point"}, {**bare, "bbox": [1, 2]}, {**bare, "geometry": {"type": "Point", "coordinates": [1, 2]}}):
        with pytest.raises(catalogue.ItemError):
            catalogue.parse_item(bad)


def test_filters_are_tested_while_reading(spark, folder):
    path, items = folder
    before = spark.conf.get(catalogue.PUSHDOWN)
    want = sorted(i["id"] for i in items if i["properties"]["gsd"] == 10 and i["bbox"][0] >= 30 and i["id"] < "i150")
    spark.conf.set(catalogue.PUSHDOWN, "true")
    try:
        df = catalogue.read_items(spark, f"{path}/lines.ndjson").where("gsd = 10 AND x0 >= 30 AND item_id < 'i150'")
        plan = df._jdf.queryExecution().executedPlan().toString()
        left = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
        assert "BatchScan catalogue" in plan and not any("10.0" in f or "30.0" in f or "i150" in f for f in left)  # the scan took them
        assert sorted(r["item_id"] for r in df.collect()) == want and want
        assert catalogue.read_items(spark, f"{path}/lines.ndjson").where("item_id IN ('i003', 'i004', 'none')").count() == 2
    finally:
        spark.conf.set(catalogue.PUSHDOWN, before)
    assert sorted(r["item_id"] for r in catalogue.read_items(spark, f"{path}/lines.ndjson").where("gsd = 10 AND x0 >= 30 AND item_id < 'i150'").collect()) == want


def test_search_leaves_out_what_only_the_box_meets(spark, folder):
    path, items = folder
    areas = spark.createDataFrame(
        [("t", [[(0.0, 0.0), (60.0, 0.0), (0.0, 60.0), (0.0, 0.0)]]), ("hole", [[(float(x), float(y)) for x, y in box(299, -1, 20, 20)], [(float(x), float(y)) for x, y in box(302, 2, 8, 8)]]), ("none", None)],
        "area string, rings array<array<struct<x:double,y:double>>>",
    )
    found = catalogue.search(catalogue.read_items(spark, str(path)), areas, area_id="area")
    got = {(r["area"], r["item_id"]) for r in found.collect()}
    want = {("t", i["id"]) for i in items if i["bbox"][0] + i["bbox"][1] <= 60} | {("t", "tri"), ("hole", "multi")}
    assert got == want and any(i["bbox"][0] <= 60 and i["bbox"][1] <= 60 and ("t", i["id"]) not in got for i in items)
    fine = catalogue.search(catalogue.read_items(spark, str(path)), areas, area_id="area", gsd=30.0, ids=[i["id"] for i in items[:100]])
    assert {r["item_id"] for r in fine.collect()} == {i["id"] for i in items[:100] if i["properties"]["gsd"] == 30 and i["bbox"][0] + i["bbox"][1] <= 60}
    assert catalogue.search(catalogue.read_items(spark, str(path)), areas.where("area = 'none'"), area_id="area").count() == 0

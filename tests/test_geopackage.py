"""GeoPackage layers read by pages against sqlite3."""

import random
import sqlite3
import struct

import numpy as np
import pytest

from gridloom.sources import geo, geopackage


def blob(rings, envelope=0):
    size = (0, 32, 48, 48, 64)[envelope]
    return b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", 5070) + b"\0" * size + geo.wkb_polygon(rings)


def ring(rng, n):
    return [(p := [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n)])[0], *p[1:], p[0]]


def package(path, rows, *, page=1024, encoding="UTF-8", extra=()):
    con = sqlite3.connect(path)
    con.execute(f"PRAGMA page_size = {page}")
    con.execute(f"PRAGMA encoding = '{encoding}'")
    con.execute('CREATE TABLE "Fire Layer" (fid INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT, acres REAL, year INTEGER, geom BLOB)')
    con.execute("CREATE TABLE other (a, b)")
    con.execute("CREATE INDEX by_name ON \"Fire Layer\" (name)")
    con.executemany('INSERT INTO "Fire Layer" VALUES (?, ?, ?, ?, ?)', rows)
    for statement in extra:
        con.execute(statement)
    con.commit()
    con.close()


def rows_of(rng, n):
    out = []
    for k in range(n):
        shape = [ring(rng, rng.choice([4, 30, 400]))] + ([ring(rng, 5)] if k % 5 == 0 else [])
        out.append((k * 3 + 1 if k % 7 else 1 << 40 | k, rng.choice(["ä" * rng.randrange(0, 300), "x", None, ""]), rng.choice([1.5, None, -3.25e9, 7.0]), rng.choice([0, 1, -1, 127, -129, 40000, 1 << 22, 1 << 40, -(1 << 60)]), None if k % 11 == 0 else blob(shape, k % 5)))
    return out


@pytest.mark.parametrize(("page", "encoding"), [(512, "UTF-8"), (1024, "UTF-16le"), (4096, "UTF-16be"), (65536, "UTF-8")])
def test_layers_equal_sqlite(spark, tmp_path, page, encoding):
    path, rng = f"{tmp_path}/a.gpkg", random.Random(page)
    rows = rows_of(rng, 700)
    package(path, rows, page=page, encoding=encoding, extra=['DELETE FROM "Fire Layer" WHERE fid % 10 = 3', 'UPDATE "Fire Layer" SET name = name || name WHERE fid % 4 = 0'])
    con = sqlite3.connect(path)
    want = con.execute('SELECT fid, name, acres, year, geom FROM "Fire Layer"').fetchall()
    con.close()
    df = geopackage.read_layer(spark, [path], "fire layer", ["fid", "name", "acres", "year"], pages=8)
    assert df.rdd.getNumPartitions() > 1
    got = {int(r["fid"]): r for r in df.collect()}
    assert len(got) == len(want)
    for fid, name, acres, year, data in want:
        r = got[fid]
        assert (r["name"], r["acres"], r["year"]) == (name, None if acres is None else str(acres), str(year))
        shape = None if data is None else geo.parse_wkb(data[8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7] :])[0]
        assert (r["rings"] is None) == (shape is None) and (shape is None or [[(p["x"], p["y"]) for p in q] for q in r["rings"]] == shape)
    assert geo.read_geopackage(spark, f"file://{path}", "Fire Layer", ["name"]).count() == len(want)


def test_added_columns_empty_layers_and_errors(spark, tmp_path):
    path = f"{tmp_path}/a.gpkg"
    package(path, [(1, "a", 1.0, 2, None)], extra=["ALTER TABLE \"Fire Layer\" ADD COLUMN kind TEXT DEFAULT 'wild'", "CREATE TABLE empty_one (id INTEGER PRIMARY KEY, geom BLOB)", "CREATE TABLE no_ids (k TEXT PRIMARY KEY, geom BLOB) WITHOUT ROWID", "INSERT INTO no_ids VALUES ('x', NULL)"])
    assert [tuple(r) for r in geopackage.read_layer(spark, [path], "Fire Layer", ["kind", "FID"]).collect()] == [("wild", "1", None)]
    assert geopackage.read_layer(spark, [path], "empty_one", ["id"]).count() == 0
    for layer in ("absent", "no_ids"):
        with pytest.raises(Exception, match=layer):
            geopackage.read_layer(spark, [path], layer, ["k"]).collect()
    with pytest.raises(geopackage.DatabaseError):
        geopackage.Database(lambda at, n: b"PK\x03\x04".ljust(n, b"\0"))
    (tmp_path / "a.gpkg-wal").write_bytes(b"x" * 100)
    with pytest.raises(geopackage.DatabaseError, match="write-ahead"):
        geopackage.LayerReader({"path": path, "layer": "empty_one"}).partitions()


def test_pages_read_follow_the_run(tmp_path):
    path, rng = f"{tmp_path}/a.gpkg", random.Random(2)
    package(path, rows_of(rng, 3000), page=4096)
    with open(path, "rb") as f:
        data, read = f.read(), []
    db = geopackage.Database(lambda at, n: (read.append(n), data[at : at + n])[1])
    root = db.table("Fire Layer")[0]
    read.clear()
    leaves = db.leaves(root)
    assert len(leaves) > 100 and sum(read) < 0.05 * len(data)  # interior pages only
    assert sum(1 for n in leaves for _ in db.rows(db.page(n), n)) == 3000


def test_empty_geometries_and_parts():
    one, two = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]
    multi = struct.pack("<BII", 1, 6, 2) + geo.wkb_polygon([one]) + geo.wkb_polygon([two])
    assert len(geopackage.geometry_rings(b"GP\0\1" + b"\0" * 4 + multi)) == 2
    assert geopackage.geometry_rings(None) == [None] == geopackage.geometry_rings(b"GP\0\x11" + b"\0" * 4 + geo.wkb_polygon([]))
    with pytest.raises(geopackage.DatabaseError):
        geopackage.geometry_rings(np.arange(40, dtype=np.uint8).tobytes())

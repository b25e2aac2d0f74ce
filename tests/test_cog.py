"""TIFF decoding and the windowed raster source."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.contracts import ContractError
from gridloom.sources import cog, geo, tiff


def levels(data):
    return tiff.images(lambda at, n: data[at : at + n])


def whole(image, band=0):
    return np.vstack([np.hstack([image.pixels(i, j, band) for j in range(image.across)]) for i in range(image.down)])


def test_every_layout_comes_back():
    rng = np.random.default_rng(1)
    for dtype, compression, predictor, large, tile, end, bands, apart in itertools.product(("u1", "i2", "f4", "f8"), (1, 5, 8, 50000), (1, 2, 3), (False, True), (16, None), "<>", (1, 2), (False, True)):
        if predictor == 3 and dtype[0] != "f":
            continue
        values = (rng.random((21, 37, bands)) * 200).astype(dtype)
        data = tiff.encode(values, origin=(100.0, 200.0, 10.0, 10.0), nodata=7, tile=tile, compression=compression, predictor=predictor, large=large, overviews=2, epsg=5070, end=end, apart=apart)
        found = levels(data)
        assert [(x.height, x.width) for x in found] == [(21, 37), (11, 19), (6, 10)] and found[0].epsg == 5070 and found[1].nodata == 7
        for k, x in enumerate(found):
            for band in range(bands):
                assert (whole(x, band) == values[:: 2**k, :: 2**k, band]).all()


def test_lzw_codes_are_the_formats():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example of the format's description
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data
    rng = np.random.default_rng(2)
    for n, k in itertools.product((0, 1, 2, 511, 5000, 60000), (1, 2, 256)):
        raw = rng.integers(0, k, n, dtype=np.uint8).tobytes()
        assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(bytes([0x80, 0x7F, 0xFF]))


def test_pack_bits():
    assert tiff.decompress(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa", tiff.PACKBITS, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"[:48]


def with_tag(data, tag, value):
    """A little-endian classic file whose first directory has another short value for a tag."""
    out = bytearray(data)
    at = struct.unpack_from("<I", out, 4)[0]
    for i in range(struct.unpack_from("<H", out, at)[0]):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<H", out, at + 2 + 12 * i + 8, value)
    return bytes(out)


def test_what_is_not_decoded_is_an_error():
    good = tiff.encode(np.ones((8, 8), "f4"), origin=(0, 0, 1, 1), tile=16)
    assert whole(levels(good)[0]).sum() == 64
    for tag, value in ((tiff.COMPRESSION, 7), (tiff.COMPRESSION, 34887), (tiff.PREDICTOR, 4), (tiff.BITS, 12), (tiff.SAMPLE_FORMAT, 6)):
        with pytest.raises(tiff.TiffError):
            levels(with_tag(good, tag, value))
    with pytest.raises(tiff.TiffError):
        levels(with_tag(tiff.encode(np.ones((8, 8), "i4"), origin=(0, 0, 1, 1)), tiff.PREDICTOR, 3))
    for bad in (b"", b"II*\0", b"II,\0" + good[4:], b"PK" + good[2:]):
        with pytest.raises(tiff.TiffError):
            levels(bad)
    cut = tiff.encode(np.ones((8, 8), "f4"), origin=(0, 0, 1, 1), tile=16, compression=tiff.PLAIN)[:-10]
    with pytest.raises(tiff.TiffError):
        whole(levels(cut)[0])


@pytest.fixture(scope="module")
def raster(tmp_path_factory):
    values = np.arange(300 * 400, dtype="f4").reshape(300, 400) / 8
    values[5, 7] = -9999
    folder = tmp_path_factory.mktemp("cog")
    for name, options in (("lzw", {"compression": tiff.LZW, "predictor": 3}), ("big", {"large": True, "compression": tiff.ZSTD, "predictor": 2})):
        (folder / f"{name}.tif").write_bytes(tiff.encode(values, origin=(1000.0, 9000.0, 10.0, 10.0), nodata=-9999, tile=32, overviews=2, **options))
    return values, folder


def test_windows_bounds_and_overviews(spark, raster):
    values, folder = raster
    for name in ("lzw", "big"):
        path = f"{folder}/{name}.tif"
        rows = cog.read_window(spark, path, window=(0, 40, 0, 70)).collect()
        assert len(rows) == 40 * 70 - 1 and all(r["value"] == values[r["row"], r["col"]] and r["x"] == 1005 + 10 * r["col"] and r["y"] == 8995 - 10 * r["row"] for r in rows)
        rows = cog.read_window(spark, [path], bounds=(1500.0, 7000.0, 1604.0, 7100.0)).collect()
        assert {(r["row"], r["col"]) for r in rows} == {(r, c) for r in range(190, 200) for c in range(50, 60)}
        rows = cog.read_window(spark, path, resolution=25.0).collect()
        assert len(rows) == 150 * 200 and all(r["value"] == values[2 * r["row"], 2 * r["col"]] for r in rows)
        assert cog.read_window(spark, path, window=(300, 400, 0, 10)).count() == 0 == cog.read_window(spark, path, bounds=(0.0, 0.0, 1.0, 1.0)).count()
    assert cog.read_window(spark, [f"{folder}/{n}.tif" for n in ("lzw", "big")]).count() == 2 * (300 * 400 - 1)
    assert geo.read_geotiff(spark, f"file://{folder}/*.tif", window=(0, 10, 0, 10)).count() == 2 * 99


def test_bytes_read_follow_the_window(raster, monkeypatch):
    _, folder = raster
    size, read = (folder / "big.tif").stat().st_size, []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    real = cog.open_file
    monkeypatch.setattr(cog, "open_file", lambda path: Counted(real(path)))
    counts = []
    for window in ("0,32,0,32", "0,64,0,64", "0,300,0,400"):
        reader = cog.CogReader({"path": f"{folder}/big.tif", "window": window, "tiles": "4"})
        parts = reader.partitions()
        read.clear()
        for p in parts:
            for _ in reader.read(p):
                pass
        counts.append((len(parts), sum(read) - len(parts) * tiff.HEAD))
    assert [c[0] for c in counts] == [1, 1, 33] and counts[0][1] < 4 * 32 * 32 and counts[1][1] < 5 * counts[0][1] and counts[2][1] <= size


def test_filters_narrow_the_scan(spark, raster):
    values, folder = raster
    before = spark.conf.get(cog.PUSHDOWN)
    spark.conf.set(cog.PUSHDOWN, "true")
    try:
        df = cog.read_window(spark, f"{folder}/lzw.tif").where("row >= 100 AND row < 110 AND x > 1500 AND x <= 1595 AND value > 0")
        plan = df._jdf.queryExecution().executedPlan().toString()
        left = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
        assert "BatchScan cog" in plan and any("value" in f for f in left) and not any("100" in f or "1595" in f for f in left)  # the scan took the others
        got = df.collect()
        assert df.rdd.getNumPartitions() == 1  # of 130 tiles two are left
        assert {(r["row"], r["col"]) for r in got} == {(r, c) for r in range(100, 110) for c in range(50, 60)}
        assert all(r["value"] == values[r["row"], r["col"]] for r in got)
        assert cog.read_window(spark, f"{folder}/lzw.tif").where("row = 299 AND col = 3").collect()[0]["value"] == values[299, 3]
        assert cog.read_window(spark, f"{folder}/lzw.tif").where("y > 1e9").count() == 0
    finally:
        spark.conf.set(cog.PUSHDOWN, before)
    assert cog.read_window(spark, f"{folder}/lzw.tif").where("row = 299 AND col = 3").count() == 1


def test_writing_describing_and_exports(spark, tmp_path):
    pixels = spark.range(70 * 50).select((F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).alias("col"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 11).alias("value"))
    files = cog.write_rasters(pixels, f"{tmp_path}/out", side=32, pixel=30.0, origin=(0.0, 6000.0), dtype="int16", tile=16, epsg=5070, overviews=1).collect()
    assert len(files) == 6 and sum(r["pixels"] for r in files) == 3000
    back = cog.read_window(spark, [r["path"] for r in files]).select(F.floor((6000 - F.col("y")) / 30).cast("int").alias("row"), F.floor(F.col("x") / 30).alias("col"), F.col("value").cast("long").alias("value"))
    assert back.exceptAll(pixels.where("value IS NOT NULL")).count() == 0 and back.count() == 3000
    (tmp_path / "broken.tif").write_bytes(b"no raster")
    paths = spark.createDataFrame([(r["path"],) for r in files] + [(f"{tmp_path}/broken.tif",)], "path string")
    told = cog.describe(spark, paths).collect()
    assert len(told) == 13 and [r["problem"] for r in told if r["problem"]] == ["not a TIFF"]
    assert {(r["level"], r["height"], r["dtype"], r["epsg"], r["nodata"]) for r in told if not r["problem"]} == {(0, 32, "int16", 5070, -9999.0), (1, 16, "int16", None, -9999.0)}
    box = (0.0, 6000.0 - 32 * 30, 32 * 30.0, 6000.0)
    export = spark.createDataFrame([("b1", f"{tmp_path}/out/r00000_c00000.tif", *box)], "batch_id string, path string, x0 double, y0 double, x1 double, y1 double")
    asked = {"epsg": 5070, "pixel": 30.0, "dtype": "int16", "nodata": -9999.0}
    rows = cog.read_exports(export, **asked, codes=range(11)).collect()
    assert len(rows) == 32 * 32 - sum((r * 50 + c) % 7 == 0 for r in range(32) for c in range(32)) and {r["batch_id"] for r in rows} == {"b1"}
    for change in ({"epsg": 4326}, {"pixel": 10.0}, {"dtype": "float32"}, {"nodata": 0.0}, {"codes": range(10)}):
        with pytest.raises(Exception, match="export b1"):
            cog.read_exports(export, **(asked | change)).collect()
    moved = export.withColumn("x0", F.col("x0") + 30)
    with pytest.raises(Exception, match="bounds"):
        cog.read_exports(moved, **asked).collect()


def test_extent_and_windows(spark):
    from gridloom.operators import lattice

    cells = spark.range(12).select((F.col("id") % 4 * 10 + 30).alias("x0"), (F.floor(F.col("id") / 4) * 10 - 20).alias("y0")).withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10})
    assert lattice.processing_extent(cells, cell=10) == lattice.Extent(30.0, -20.0, 70.0, 10.0, 10.0)
    assert lattice.processing_extent(cells, cell=10, block=4) == lattice.Extent(0.0, -40.0, 80.0, 40.0, 10.0)
    for bad in (cells.limit(0), cells.unionByName(cells.limit(1)), cells.withColumn("x1", F.col("x1") + 1), cells.withColumns({"x0": F.col("x0") + 1, "x1": F.col("x1") + 1}), cells.withColumn("y0", F.lit(None).cast("long"))):
        with pytest.raises(ContractError):
            lattice.processing_extent(bad, cell=10)
    w = lattice.native_windows(spark.createDataFrame([("a", 5.0, 40.0, 95.0, 100.0)], "batch_id string, x0 double, y0 double, x1 double, y1 double"), origin=(-10.0, 130.0), pixel=30.0, most_rows=9, most_cols=9)
    r = w.first()
    assert (r["row_off"], r["col_off"], r["height"], r["width"], r["wx0"], r["wy0"], r["wx1"], r["wy1"]) == (0, -1, 4, 6, -40.0, 10.0, 140.0, 130.0)
    with pytest.raises(Exception, match="over the limit"):
        lattice.native_windows(w.select("batch_id", "x0", "y0", "x1", "y1"), origin=(-10.0, 130.0), pixel=30.0, most_rows=3, most_cols=9).collect()

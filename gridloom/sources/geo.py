"""Geospatial files without native libraries: archives, shapefiles, GeoPackages and plain GeoTIFFs, as Python data sources and parsers.

Archives and packages come through Spark's own reader (``binaryFile``), rasters by byte ranges; a file is parsed where its bytes are.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.sources import cog

GEOMETRY = "array<array<struct<x:double,y:double>>>"


def check_archive(data: bytes, *, suffix: str, sidecars: tuple[str, ...] = (), text: dict[str, tuple[str, ...]] | None = None) -> str:
    """Name of the one member with ``suffix``; raises if a member is damaged, sidecars lack, or an info file lacks its phrases."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if bad := z.testzip():
            raise ValueError(f"damaged member {bad}")
        names = z.namelist()
        main = [n for n in names if n.lower().endswith(suffix)]
        if len(main) != 1:
            raise ValueError(f"{len(main)} members end with {suffix}")
        stem = main[0][: -len(suffix)]
        lacking = [s for s in sidecars if f"{stem}{s}" not in names]
        if lacking:
            raise ValueError(f"sidecars {lacking} are absent")
        for ending, phrases in (text or {}).items():
            found = [z.read(n).decode(errors="replace") for n in names if n.lower().endswith(ending)]
            if len(found) != 1 or any(p not in found[0] for p in phrases):
                raise ValueError(f"info file {ending} does not name {phrases}")
        return main[0]


def archive_report(spark: SparkSession, path: str, *, suffix: str, sidecars: tuple[str, ...] = ()) -> DataFrame:
    """path, member, problem of each archive below ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((p, check_archive(data, suffix=suffix, sidecars=sidecars), None))
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "member", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, problem string")


def parse_shapes(shp: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """Rings of each polygon record of a .shp file; null shapes are None."""
    out, at = [], 100
    while at < len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        if kind == 0:
            out.append(None)
        elif kind in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", shp, at + 52), points]
            xy = np.frombuffer(shp, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            out.append([[tuple(p) for p in xy[a:b].tolist()] for a, b in zip(starts, starts[1:], strict=False)])
        else:
            raise ValueError(f"shape type {kind} is no polygon")
        at += 8 + size
    return out


def parse_dbf(dbf: bytes) -> tuple[list[str], list[list[str | None] | None]]:
    """Column names and rows of a .dbf file, values as stripped text, blanks as None; a deleted row is None, as its shape is still in the .shp file."""
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * width, []
        if dbf[pos : pos + 1] == b"*":
            rows.append(None)
            continue
        pos += 1
        for _, size in fields:
            row.append(dbf[pos : pos + size].decode("latin-1").strip() or None)
            pos += size
        rows.append(row)
    return [f for f, _ in fields], rows


def read_shapefiles(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Attributes (text) and rings, of all parts, of the polygon shapefiles in the zip archives at ``path``; deleted rows go with their shapes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                main = check_archive(data, suffix=".shp", sidecars=(".dbf", ".shx"))
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    shapes, (names, rows) = parse_shapes(z.read(main)), parse_dbf(z.read(f"{main[:-4]}.dbf"))
                where = [names.index(c) for c in columns]
                rings = [None if s is None else [[{"x": x, "y": y} for x, y in r] for r in s] for s in shapes]
                yield pd.DataFrame([[*(r[i] for i in where), g] for r, g in zip(rows, rings, strict=True) if r is not None], columns=[*columns, "rings"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join([*(f"`{c}` string" for c in columns), f"rings {GEOMETRY}"]))


def parse_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons (lists of rings) of a WKB polygon or multipolygon."""

    def one(at: int) -> tuple[list, int]:
        end = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{end}I", data, at + 1)[0] % 1000
        count, at = struct.unpack_from(f"{end}I", data, at + 5)[0], at + 9
        if kind == 6:
            out = []
            for _ in range(count):
                p, at = one(at)
                out += p
            return out, at
        if kind != 3:
            raise ValueError(f"geometry type {kind} is no polygon")
        rings = []
        for _ in range(count):
            n = struct.unpack_from(f"{end}I", data, at)[0]
            xy = np.frombuffer(data, f"{end}f8", 2 * n, at + 4).reshape(-1, 2)
            rings.append([tuple(p) for p in xy.tolist()])
            at += 4 + 16 * n
        return [rings], at

    return one(0)[0]


def wkb_polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon's WKB, its shell first."""
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.array(r, "<f8").tobytes() for r in rings)


def with_wkb(df: DataFrame, *, rings: str = "rings", name: str = "geometry") -> DataFrame:
    """``df`` with a polygon's WKB in place of its rings, in Arrow batches; null stays null. The first ring is the shell."""
    others = [f for f in df.schema.fields if f.name != rings]
    src = df.select(*[f"`{f.name}`" for f in others], rings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes = b.column(b.num_columns - 1).to_pylist()
            made = [None if r is None else wkb_polygon([[(p["x"], p["y"]) for p in ring] for ring in r]) for r in shapes]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=[*(f.name for f in others), name])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{name}` binary"]))


def with_rings(df: DataFrame, *, geometry: str = "geometry", name: str = "rings") -> DataFrame:
    """``df`` with the rings of all parts in place of a WKB polygon or multipolygon; null stays null."""
    others = [f for f in df.schema.fields if f.name != geometry]
    src = df.select(*[f"`{f.name}`" for f in others], geometry)
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if w is None else [[{"x": x, "y": y} for x, y in ring] for part in parse_wkb(w) for ring in part] for w in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, kind)], names=[*(f.name for f in others), name])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{name}` {GEOMETRY}"]))


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], geometry: str = "geom") -> DataFrame:
    """Attributes (text) and rings of a layer's polygons in the packages at ``path``; only the asked columns are made. A multipolygon gives a row a polygon.

    Files are read by runs of pages, each by its own task, so a package may be of any size.
    """
    from gridloom.sources import geopackage

    paths = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return geopackage.read_layer(spark, sorted(paths), layer, columns, geometry=geometry)


def read_geotiff(spark: SparkSession, path: str, *, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """file, row, col, x, y (pixel centre), value of the valid pixels of the rasters at ``path``, within rows and columns [r0, r1) x [c0, c1) if given.

    For folders of many files: headers are read in tasks, too. Each strip or tile that meets the window is a row of its own, dealt to all tasks, and read by its byte
    range, so a file of any size is spread, and what lies outside the window is never read. ``sources.cog`` reads some named files with bounds in filters.
    """

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                with cog.open_file(p) as f:
                    image = cog.levels_of(f)[0]
                    i0, i1, j0, j1 = image.window(*(window or (0, image.height, 0, image.width)))
                    rows += [(p, i, j) for i in range(i0, i1) for j in range(j0, j1)]
            yield pd.DataFrame(rows, columns=["path", "i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, f = None, None
            for p, i, j in sorted(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if p != held:
                    if f is not None:
                        f.close()
                    held, f = p, cog.open_file(p)
                    image = cog.levels_of(f)[0]
                yield from cog.rows_of(image, p, i, j, window=window)
            if f is not None:
                f.close()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.format("binaryFile").load(path).select("path").mapInPandas(plan, "path string, i int, j int")
    return listed.repartition(tasks, "path", "i", "j").mapInArrow(run, cog.SCHEMA)


def geo_metadata(geometry: str, srid: int, name: str) -> bytes:
    """The footer entry that makes a Parquet file with a WKB column a GeoParquet file."""
    crs = {"type": "ProjectedCRS", "name": name, "id": {"authority": "EPSG", "code": srid}}
    return json.dumps({"version": "1.0.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"], "crs": crs}}}).encode()


def write_geoparquet(df: DataFrame, path: str, *, geometry: str = "geometry", srid: int = 5070, crs_name: str = "NAD83 / Conus Albers", replace: bool = False) -> DataFrame:
    """Write ``df``, whose binary column ``geometry`` is WKB, as GeoParquet files, one for each partition, and read them back.

    Tasks write to a staging folder by a rename each, so retries leave one file; the folder is put in place once all rows are there.
    """
    from gridloom.sources import publish

    spark = df.sparkSession
    if publish.exists(spark, path) and not replace:
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}"
    meta, schema = geo_metadata(geometry, srid, crs_name), to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        store, root = FileSystem.from_uri(stage if "://" in stage else os.path.abspath(stage))
        store.create_dir(root, recursive=True)
        name, part = f"{root}/part-{context.partitionId():06d}.parquet", f"{root}/.part-{context.partitionId():06d}.{context.taskAttemptId()}"
        with store.open_output_stream(part) as f, pq.ParquetWriter(f, schema.with_metadata({b"geo": meta}), compression="zstd") as w:
            for b in batches:
                w.write_batch(b.cast(schema).replace_schema_metadata({b"geo": meta}))
                n += b.num_rows
        try:
            store.move(part, name)
        except OSError:
            store.delete_file(name)
            store.move(part, name)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    try:
        written = df.mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
        back = spark.read.schema(df.schema).parquet(stage).count() if written else 0
        if back != written:
            raise OSError(f"{back} of {written} rows can be read back")
        publish.put_in_place(spark, stage, path)
    finally:
        publish.remove(spark, stage)
    return spark.read.parquet(path)


def geoparquet_report(spark: SparkSession, path: str) -> DataFrame:
    """path, geometry, encoding, types, srid, crs_name, version and problem of each Parquet file at ``path``, from footers alone; a file without the entry has a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "geometry", "encoding", "types", "srid", "crs_name", "version", "problem"]
        for b in batches:
            rows = []
            for p in b["path"]:
                with cog.open_file(p) as f:
                    meta = (pq.ParquetFile(f).schema_arrow.metadata or {}).get(b"geo")
                if meta is None:
                    rows.append((p, *[None] * 6, "no geo entry"))
                    continue
                geo = json.loads(meta)
                column = geo["primary_column"]
                about = geo["columns"][column]
                crs = about.get("crs") or {}
                srid = (crs.get("id") or {}).get("code")
                problem = None if about["encoding"] == "WKB" else f"encoding {about['encoding']} is not read"
                rows.append((p, column, about["encoding"], ",".join(sorted(about.get("geometry_types", []))), None if srid is None else int(srid), crs.get("name"), geo.get("version"), problem))
            yield pd.DataFrame(rows, columns=names).astype({"srid": "Int64"})

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return listed.mapInPandas(run, "path string, geometry string, encoding string, types string, srid long, crs_name string, version string, problem string")


def read_geoparquet(spark: SparkSession, path: str, *, srid: int | None = None) -> DataFrame:
    """The table of GeoParquet files at ``path`` with rings in place of the geometry; every file must name the same geometry column and reference system, and ``srid`` if given."""
    from gridloom.contracts import require

    kinds = geoparquet_report(spark, path).groupBy("geometry", "srid", "crs_name", "problem").agg({"path": "min"}).collect()
    require(len(kinds) == 1, f"files at {path} differ: {sorted((str(k['geometry']), str(k['srid']), str(k['problem'])) for k in kinds)}")
    require(kinds[0]["problem"] is None, f"files at {path}: {kinds[0]['problem']}")
    require(srid is None or kinds[0]["srid"] == srid, f"the reference system is {kinds[0]['srid']}, not {srid}")
    return with_rings(spark.read.parquet(path), geometry=kinds[0]["geometry"])


def catalogue_search(items: DataFrame, box: tuple[float, float, float, float], *, gsd: int | None = None, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Catalogue items whose footprint (columns x0 ... y1) meets a box, by resolution and id; ordered by item_id."""
    x0, y0, x1, y1 = box
    out = items.where(f"x0 <= {x1} AND x1 >= {x0} AND y0 <= {y1} AND y1 >= {y0}")
    out = out.where(f"gsd = {gsd}") if gsd is not None else out
    out = out.where(out["item_id"].isin(ids)) if ids is not None else out
    out = out.orderBy("item_id")
    return out.limit(limit) if limit is not None else out

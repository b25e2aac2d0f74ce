"""Windows of rasters as a Spark data source: partitions are runs of tiles, bounds in filters narrow the window, and only bytes of tiles that meet it are read.

``spark.read.format("cog")`` after ``register(spark)``, or ``read_window``. Options: ``path`` (or ``paths``, a JSON list), ``window`` (r0,r1,c0,c1 in pixels of
the level read), ``bounds`` (x0,y0,x1,y1), ``resolution`` (side of a pixel wanted: the coarsest overview no coarser than that is read), ``band`` (from 0) and
``tiles`` (of a partition); ``pushdown`` = true narrows the window by filters. Rows are file, row, col, x, y (a pixel's centre) and value; pixels that are NoData or not finite are left out.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.contracts import ContractError
from gridloom.sources import tiff

SCHEMA = "file string, row int, col int, x double, y double, value double"
#: Tiles of a partition, and headers that are read at a time while partitions are planned.
TILES, HEADERS = 16, 16
#: Lets Spark hand filters to Python data sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def store_of(path: str) -> tuple[FileSystem, str]:
    """The file system and inner path of a path or URI."""
    return FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1) if ":" in path else os.path.abspath(path))


def open_file(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)


def levels_of(f) -> list[tiff.Image]:
    """The raster and overviews of an open file."""
    return tiff.images(lambda at, n: f.read_at(n, at))


@dataclass
class TileRun(InputPartition):
    """Some tiles (block row, block column) of one level of one file."""

    path: str
    level: int
    tiles: list[tuple[int, int]]


@dataclass
class Bound:
    """A comparison of row, col, x or y with a number, as a filter asks for it."""

    column: str
    kind: type
    number: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return _COMPARE[self.kind](values, self.number)


def pixel_window(image: tiff.Image, bounds: Sequence[Bound], window: Sequence[int] | None, box: Sequence[float] | None) -> tuple[int, int, int, int]:
    """Rows and columns, half-open, outside of which no pixel can satisfy all bounds; exact for row and col, a pixel wide of the mark at most for x and y."""
    r0, r1, c0, c1 = (0, image.height, 0, image.width) if window is None else window
    x0, y0, sx, sy = image.origin
    low, high = {"row": r0, "col": c0, "x": -math.inf, "y": -math.inf}, {"row": r1 - 1, "col": c1 - 1, "x": math.inf, "y": math.inf}
    if box is not None:
        low["x"], low["y"], high["x"], high["y"] = box
    for b in bounds:
        if b.kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
            low[b.column] = max(low[b.column], b.number)
        if b.kind in (EqualTo, LessThan, LessThanOrEqual):
            high[b.column] = min(high[b.column], b.number)
    clip = lambda v, most: 0 if v <= 0 else most if v >= most else int(v)
    rows = max(math.ceil(low["row"]), clip((y0 - high["y"]) / sy - 0.5, image.height)), min(math.floor(high["row"]) + 1, clip((y0 - low["y"]) / sy + 1.5, image.height))
    cols = max(math.ceil(low["col"]), clip((low["x"] - x0) / sx - 0.5, image.width)), min(math.floor(high["col"]) + 1, clip((high["x"] - x0) / sx + 1.5, image.width))
    return *rows, *cols


class CogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        numbers = lambda name, kind: [kind(v) for v in options[name].split(",")] if options.get(name) else None
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.window, self.box = numbers("window", int), numbers("bounds", float)
        self.resolution = float(options["resolution"]) if options.get("resolution") else None
        self.band, self.tiles = int(options.get("band", 0)), int(options.get("tiles", TILES))
        self.bounds: list[Bound] = []

    def _runs(self, path: str) -> list[TileRun]:
        with open_file(path) as f:
            levels = levels_of(f)
            level = tiff.for_resolution(levels, self.resolution)
            image = levels[level]
            if not 0 <= self.band < image.bands:
                raise tiff.TiffError(f"{path} has no band {self.band}")
            i0, i1, j0, j1 = image.window(*pixel_window(image, self.bounds, self.window, self.box))
        met = [(i, j) for i in range(i0, i1) for j in range(j0, j1)]
        return [TileRun(path, level, met[k : k + self.tiles]) for k in range(0, len(met), self.tiles)]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(HEADERS) as pool:
            return [run for runs in pool.map(self._runs, self.paths) for run in runs]

    def read(self, partition: TileRun) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with open_file(partition.path) as f:
            image = levels_of(f)[partition.level]
            window = pixel_window(image, self.bounds, self.window, self.box)
            for i, j in partition.tiles:
                yield from rows_of(image, partition.path, i, j, band=self.band, window=window, box=self.box, bounds=self.bounds)


class BoundedCogReader(CogReader):
    """A reader that takes comparisons of row, col, x and y with numbers off Spark's hands; only sessions that push filters may have it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in ("row", "col", "x", "y") and isinstance(f.value, int | float) and not math.isnan(f.value):
                self.bounds.append(Bound(f.attribute[0], type(f), f.value))
            else:
                yield f


def rows_of(image: tiff.Image, path: str, i: int, j: int, *, band: int = 0, window: Sequence[int] | None = None, box: Sequence[float] | None = None, bounds: Sequence[Bound] = ()) -> Iterator[pa.RecordBatch]:
    """The valid pixels of one tile as one batch, if it has any."""
    value = image.pixels(i, j, band)
    rows, cols = i * image.block[0] + np.arange(value.shape[0]), j * image.block[1] + np.arange(value.shape[1])
    x0, y0, sx, sy = image.origin
    axis = {"row": rows, "col": cols, "x": x0 + (cols + 0.5) * sx, "y": y0 - (rows + 0.5) * sy}
    keep_rows, keep_cols = np.ones(rows.size, bool), np.ones(cols.size, bool)
    if window is not None:
        keep_rows, keep_cols = (rows >= window[0]) & (rows < window[1]), (cols >= window[2]) & (cols < window[3])
    if box is not None:
        keep_rows, keep_cols = keep_rows & (axis["y"] >= box[1]) & (axis["y"] <= box[3]), keep_cols & (axis["x"] >= box[0]) & (axis["x"] <= box[2])
    for b in bounds:
        kept = keep_rows if b.column in ("row", "y") else keep_cols
        kept &= b.holds(axis[b.column])
    value = value.astype(np.float64)
    keep = np.isfinite(value) & keep_rows[:, None] & keep_cols[None, :]
    if image.nodata is not None:
        keep &= value != image.nodata
    r, c = np.nonzero(keep)
    if r.size:
        columns = [pa.array([os.path.basename(path)] * r.size), pa.array(rows[r].astype(np.int32)), pa.array(cols[c].astype(np.int32)), pa.array(axis["x"][c]), pa.array(axis["y"][r]), pa.array(value[r, c])]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "col", "x", "y", "value"])


class CogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CogReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return (BoundedCogReader if options.get("pushdown") == "true" else CogReader)(options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; filters are pushed where the session's setting (on in ``build_session``) and the option ``pushdown`` say so."""
    spark.dataSource.register(CogSource)


def read_window(spark: SparkSession, paths: str | Sequence[str], *, window: tuple[int, int, int, int] | None = None, bounds: tuple[float, float, float, float] | None = None, resolution: float | None = None, band: int = 0, tiles: int = TILES) -> DataFrame:
    """The valid pixels of some rasters, within a window of pixels or bounds of coordinates if given; no window is the whole raster."""
    register(spark)
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "band": band, "tiles": tiles, "pushdown": spark.conf.get(PUSHDOWN, "false")}
    options |= {"window": ",".join(map(str, window))} if window else {}
    options |= {"bounds": ",".join(map(repr, bounds))} if bounds else {}
    options |= {"resolution": repr(resolution)} if resolution else {}
    return spark.read.format("cog").options(**options).load()


def describe(spark: SparkSession, paths: DataFrame, *, path: str = "path") -> DataFrame:
    """path, level, height, width, block_rows, block_cols, bands, dtype, nodata, epsg, x0, y1, pixel_x, pixel_y of each raster and overview of ``paths``, from headers alone; a file that cannot be decoded has a problem instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "level", "height", "width", "block_rows", "block_cols", "bands", "dtype", "nodata", "epsg", "x0", "y1", "pixel_x", "pixel_y", "problem"]
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with open_file(p) as f:
                        for k, x in enumerate(levels_of(f)):
                            rows.append((p, k, x.height, x.width, *x.block, x.bands, x.dtype.name, x.nodata, x.epsg, *x.origin, None))
                except (tiff.TiffError, OSError) as e:
                    rows.append((p, *[None] * 13, str(e)))
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[1:7] + ["epsg"], "Int64") | dict.fromkeys(["nodata", *names[10:14]], "float64"))

    schema = "path string, level long, height long, width long, block_rows long, block_cols long, bands long, dtype string, nodata double, epsg long, x0 double, y1 double, pixel_x double, pixel_y double, problem string"
    return paths.select(F.col(path).alias("path")).mapInPandas(run, schema)


def read_exports(exports: DataFrame, *, epsg: int, pixel: float, dtype: str, nodata: float | None, codes: Sequence[float] | None = None) -> DataFrame:
    """batch_id, row, col (from the window's north-west corner), x, y, value of the valid pixels of exported rasters, one row of ``exports`` each: batch_id, path, x0, y0, x1, y1.

    Each export must be what was asked for: one band of ``dtype`` in the system, pixel side, bounds and NoData given, and with no value outside ``codes``. Anything else is an error.
    """
    known = None if codes is None else np.unique(np.array(list(codes), np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path, *box in zip(*(b.column(c).to_pylist() for c in ("batch_id", "path", "x0", "y0", "x1", "y1")), strict=True):
                with open_file(path) as f:
                    image = levels_of(f)[0]
                    x, y, sx, sy = image.origin
                    found = {"epsg": image.epsg, "bands": image.bands, "dtype": image.dtype.name, "nodata": image.nodata, "pixel": (sx, sy), "bounds": [x, y - image.height * sy, x + image.width * sx, y]}
                    asked = {"epsg": epsg, "bands": 1, "dtype": dtype, "nodata": nodata, "pixel": (pixel, pixel), "bounds": box}
                    if wrong := {k: (found[k], v) for k, v in asked.items() if found[k] != v}:
                        raise ContractError(f"export {name}: {wrong}")
                    for i in range(image.down):
                        for j in range(image.across):
                            for out in rows_of(image, path, i, j):
                                if known is not None and (odd := np.setdiff1d(out.column("value").to_numpy(), known)).size:
                                    raise ContractError(f"export {name}: values {odd[:5].tolist()} are not known")
                                yield pa.RecordBatch.from_arrays([pa.array([name] * out.num_rows), *out.columns[1:]], names=["batch_id", "row", "col", "x", "y", "value"])

    return exports.select("batch_id", "path", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).mapInArrow(run, "batch_id string, row int, col int, x double, y double, value double")


def write_rasters(pixels: DataFrame, folder: str, *, side: int, pixel: float, origin: tuple[float, float], dtype: str = "float32", nodata: float = -9999.0, tile: int = 256, compression: int = tiff.DEFLATE,
                  predictor: int = tiff.NO_PREDICTOR, large: bool = False, overviews: int = 2, epsg: int | None = None) -> DataFrame:
    """Write pixels (row, col, value) as one raster for each ``side`` x ``side`` of them, absent and missing ones as NoData; name and rows of each.

    A task holds one raster, whatever the table's size. Each file is written aside and renamed, so that a retried task leaves one whole file. Of pixels given twice the largest value stays.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r, c = int(key[0]), int(key[1])
        values = np.full((side, side), nodata, np.dtype(dtype))
        g = group.dropna(subset=["value"]).sort_values("value")
        values[g["row"].to_numpy() - r * side, g["col"].to_numpy() - c * side] = g["value"].to_numpy()
        corner = (origin[0] + c * side * pixel, origin[1] - r * side * pixel, pixel, pixel)
        data = tiff.encode(values, origin=corner, nodata=nodata, tile=tile, compression=compression, predictor=predictor, large=large, overviews=overviews, epsg=epsg)
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        name, part = f"r{r:05d}_c{c:05d}.tif", f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{root}/{name}")
        return pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "pixels": [len(g)]})

    placed = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    return placed.groupBy(F.floor(F.col("row") / side).alias("r"), F.floor(F.col("col") / side).alias("c")).applyInPandas(run, "path string, pixels long")


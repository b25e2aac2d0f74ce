"""Catalogue items as a Spark data source, and their search by geometry.

``spark.read.format("catalogue")`` (options ``path`` or ``paths``, ``split``, ``lines``, ``pushdown``) after ``register(spark)``, or ``read_items``, reads GeoJSON items: a file of one item, of a FeatureCollection, or of an item a
line. Files of lines are read in byte ranges, each by its own task. Comparisons of item_id, collection, gsd and bounds are tested on the parsed item before a
row is made, where the session pushes filters.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from gridloom.operators.polygons import polygon_join
from gridloom.sources.cog import PUSHDOWN, store_of

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ITEM = pa.schema(
    [("item_id", pa.string()), ("collection", pa.string()), ("datetime", pa.string()), ("gsd", pa.float64()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]]
    + [("rings", pa.list_(pa.list_(_POINT))), ("assets", pa.map_(pa.string(), pa.string())), ("properties", pa.string())]
)
SCHEMA = "item_id string, collection string, datetime string, gsd double, x0 double, y0 double, x1 double, y1 double, rings array<array<struct<x:double,y:double>>>, assets map<string,string>, properties string"
#: Bytes of a range of a file of lines, and rows of a batch.
SPLIT, ROWS = 64 << 20, 1000
_PLAIN = ("item_id", "collection", "datetime", "gsd", "x0", "y0", "x1", "y1")
_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v),
}


class ItemError(ValueError):
    """What is no catalogue item."""


def _rings(geometry: dict | None) -> list | None:
    """The rings of a Polygon or MultiPolygon, of all parts; None without a geometry."""
    if geometry is None:
        return None
    if geometry.get("type") not in ("Polygon", "MultiPolygon"):
        raise ItemError(f"a footprint of type {geometry.get('type')} is no polygon")
    parts = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    return [[{"x": float(p[0]), "y": float(p[1])} for p in ring] for part in parts for ring in part]


def parse_item(item: dict) -> dict:
    """An item's row. Bounds come from its bbox (of two or three axes) or else its footprint; a footprint that is absent is the box, without either all are null."""
    if item.get("type") != "Feature" or not isinstance(item.get("id"), str):
        raise ItemError("an item is a Feature with an id")
    properties, rings, box = item.get("properties") or {}, _rings(item.get("geometry")), item.get("bbox")
    if box is not None and len(box) not in (4, 6):
        raise ItemError(f"item {item['id']} has a bbox of {len(box)} numbers")
    if box is not None:
        x0, y0, x1, y1 = box if len(box) == 4 else (box[0], box[1], box[3], box[4])
    elif rings:
        xs, ys = [p["x"] for r in rings for p in r], [p["y"] for r in rings for p in r]
        x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
    else:
        x0 = y0 = x1 = y1 = None
    if not rings and x0 is not None:
        rings = [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]
    gsd = properties.get("gsd")
    return {
        "item_id": item["id"], "collection": item.get("collection"), "datetime": properties.get("datetime"), "gsd": None if gsd is None else float(gsd),
        **{c: None if v is None else float(v) for c, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))},
        "rings": rings, "assets": [(k, v.get("href")) for k, v in (item.get("assets") or {}).items()], "properties": json.dumps(properties, sort_keys=True),
    }


@dataclass
class ItemRange(InputPartition):
    """Bytes [start, end) of a file; None for end is a file that is one document."""

    path: str
    start: int
    end: int | None


class ItemReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.split = json.loads(options["paths"]) if options.get("paths") else [options["path"]], int(options.get("split", SPLIT))
        self.lines = options.get("lines") == "true"
        self.tests: list[tuple[str, type, object]] = []

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            store, inner = store_of(path)
            info = store.get_file_info(inner)
            files = [info] if info.is_file else sorted((f for f in store.get_file_info(FileSelector(inner, recursive=True)) if f.is_file and f.base_name.endswith((".json", ".geojson", ".ndjson", ".jsonl"))), key=lambda f: f.path)
            prefix = path[: -len(inner)] if path.endswith(inner) else ""
            for f in files:
                name = prefix + f.path
                if self.lines or f.base_name.endswith((".ndjson", ".jsonl")):
                    out += [ItemRange(name, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
                else:
                    out.append(ItemRange(name, 0, None))
        return out

    def _items(self, part: ItemRange) -> Iterator[dict]:
        store, inner = store_of(part.path)
        with store.open_input_file(inner) as native, io.BufferedReader(native, 1 << 20) as f:
            if part.end is None:
                document = json.loads(f.read())
                yield from document.get("features", []) if document.get("type") == "FeatureCollection" else [document]
                return
            # a range has the lines that begin in it: the one its first byte is inside of belongs to the range before
            f.seek(max(0, part.start - 1))
            at = f.tell()
            if part.start:
                at += len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                if line.strip():
                    yield json.loads(line)

    def _kept(self, row: dict) -> bool:
        return all(row[c] is not None and _TESTS[kind](row[c], v) for c, kind, v in self.tests)

    def read(self, partition: ItemRange) -> Iterator[pa.RecordBatch]:
        rows = []
        for item in self._items(partition):
            row = parse_item(item)
            if self._kept(row):
                rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=ITEM)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ITEM)


class FilteredItemReader(ItemReader):
    """A reader that tests comparisons of plain columns itself; only sessions that push filters may have it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PLAIN and f.value is not None and not (isinstance(f.value, float) and math.isnan(f.value)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f


class ItemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ItemReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return (FilteredItemReader if options.get("pushdown") == "true" else ItemReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ItemSource)


def read_items(spark: SparkSession, paths: str | Sequence[str], *, split: int = SPLIT, lines: bool = False) -> DataFrame:
    """The items of files and folders: ids, bounds, footprints (rings), hrefs of assets by name, and all properties as JSON. What is no item is an error.

    Files called .ndjson or .jsonl, or all with ``lines``, have an item a line.
    """
    register(spark)
    return spark.read.format("catalogue").options(paths=json.dumps([paths] if isinstance(paths, str) else list(paths)), split=split, lines=str(lines).lower(), pushdown=spark.conf.get(PUSHDOWN, "false")).load()


def search(items: DataFrame, areas: DataFrame, *, area_id: str, gsd: float | None = None, ids: Sequence[str] | None = None, size: float | None = None) -> DataFrame:
    """area_id and the columns of ``items`` whose footprint meets each polygon of ``areas`` (area_id, rings), boundaries included, and not just its box.

    The areas' common box and the plain conditions reach the scan of the items. ``size`` is the side of the squares in which edges meet, a sixteenth of the common box
    if it is not given. An item comes once for each area it meets; items and areas without a footprint meet nothing. item_ids must be unique.
    """
    from gridloom.operators.geometry import polygon_bounds

    known = areas.where("rings IS NOT NULL AND size(rings) > 0")
    box = known.select(polygon_bounds(F.col("rings")).alias("b")).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1")).first()
    if box["x0"] is None:
        return known.select(area_id).join(items, F.lit(False))
    near = items.where((F.col("x0") <= box["x1"]) & (F.col("x1") >= box["x0"]) & (F.col("y0") <= box["y1"]) & (F.col("y1") >= box["y0"]))
    near = near.where(F.col("gsd") == float(gsd)) if gsd is not None else near
    near = near.where(F.col("item_id").isin(list(ids))) if ids is not None else near
    side = size or max(box["x1"] - box["x0"], box["y1"] - box["y0"]) / 16 or 1.0
    pairs = polygon_join(near.select("item_id", "rings"), known.select(area_id, "rings"), left_key="item_id", right_key=area_id, size=side)
    return pairs.join(near.hint("merge"), "item_id").select(area_id, *items.columns)

"""GeoPackage layers by pages: tables of an SQLite file are read where they lie, a task a run of leaf pages, so a file may be of any size.

``spark.read.format("geopackage")`` after ``register(spark)``, or ``read_layer``. Options: ``path`` (or ``paths``, a JSON list), ``layer``, ``columns`` (a JSON list),
``geometry`` (the column) and ``pages`` (of a partition). Only the main file is read: changes that still stand in a write-ahead log are an error.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.cog import store_of

# Fixed values of the file format: kinds of pages, bytes of integers by serial type, text encodings, bytes of a geometry's envelope by its code.
LEAF, INTERIOR = 0x0D, 0x05
_INTEGERS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8}
_ENCODINGS = {1: "utf-8", 2: "utf-16-le", 3: "utf-16-be"}
_ENVELOPES = (0, 32, 48, 48, 64)
#: Leaf pages of a partition, and rows of a batch.
PAGES, ROWS = 1024, 2000
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


class DatabaseError(ValueError):
    """A file that is no SQLite database, is damaged, or holds what is not read."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of one to nine bytes, and where it ends."""
    value = 0
    for i in range(8):
        byte = data[at + i]
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at + i + 1
    return value << 8 | data[at + 8], at + 9


class Database:
    """An SQLite file by byte ranges; ``read`` returns so many bytes from a place."""

    def __init__(self, read):
        self.read = read
        head = read(0, 100)
        if head[:16] != b"SQLite format 3\0":
            raise DatabaseError("not an SQLite database")
        size = struct.unpack_from(">H", head, 16)[0]
        self.size = 65536 if size == 1 else size
        self.usable = self.size - head[20]
        self.encoding = _ENCODINGS.get(struct.unpack_from(">I", head, 56)[0] or 1)
        if self.encoding is None:
            raise DatabaseError("the text encoding is unknown")

    def page(self, number: int) -> bytes:
        data = self.read((number - 1) * self.size, self.size)
        if number < 1 or len(data) < self.size:
            raise DatabaseError(f"page {number} is not there")
        return data

    def _cells(self, page: bytes, number: int) -> tuple[int, list[int], int]:
        """Kind, places of the cells, and the last child (of an interior page)."""
        at = 100 if number == 1 else 0
        kind, n = page[at], struct.unpack_from(">H", page, at + 3)[0]
        if kind not in (LEAF, INTERIOR):
            raise DatabaseError(f"page {number} is of kind {kind}, not of a table with row ids")
        first = at + (12 if kind == INTERIOR else 8)
        return kind, list(struct.unpack_from(f">{n}H", page, first)), struct.unpack_from(">I", page, at + 8)[0] if kind == INTERIOR else 0

    def leaves(self, root: int) -> list[int]:
        """Numbers of the leaf pages of a table, in the order of its rows: interior pages are read, leaves only until their level is known."""
        level, seen = [root], set()
        while True:
            page = self.page(level[0])
            if self._cells(page, level[0])[0] == LEAF:
                return level  # all leaves of a tree are on one level
            below = []
            for number in level:
                if number in seen:
                    raise DatabaseError(f"page {number} comes twice")
                seen.add(number)
                page = self.page(number)
                kind, places, last = self._cells(page, number)
                if kind != INTERIOR:
                    raise DatabaseError(f"page {number} is a leaf among interior pages")
                below += [struct.unpack_from(">I", page, p)[0] for p in places] + [last]
            level = below

    def _payload(self, page: bytes, at: int, size: int) -> bytes:
        """A record of ``size`` bytes that begins at a place of a page and may go on in overflow pages."""
        most = self.usable - 35
        if size <= most:
            return page[at : at + size]
        least = (self.usable - 12) * 32 // 255 - 23
        here = least + (size - least) % (self.usable - 4)
        here = here if here <= most else least
        parts, left, number = [page[at : at + here]], size - here, struct.unpack_from(">I", page, at + here)[0]
        while left > 0:
            more = self.page(number)
            parts.append(more[4 : 4 + min(left, self.usable - 4)])
            left -= len(parts[-1])
            number = struct.unpack_from(">I", more, 0)[0]
        return b"".join(parts)

    def _values(self, record: bytes, wanted: set[int] | None) -> list:
        """A record's values; those not wanted are None."""
        end, at = varint(record, 0)
        kinds = []
        while at < end:
            kind, at = varint(record, at)
            kinds.append(kind)
        out = []
        for k, kind in enumerate(kinds):
            size = _INTEGERS.get(kind, 8 if kind == 7 else (kind - 12) // 2 if kind >= 12 else 0)
            raw, at = record[at : at + size], at + size
            if wanted is not None and k not in wanted:
                out.append(None)
            elif kind in _INTEGERS:
                out.append(int.from_bytes(raw, "big", signed=True))
            elif kind == 7:
                out.append(struct.unpack(">d", raw)[0])
            elif kind in (8, 9):
                out.append(kind - 8)
            elif kind in (10, 11):
                raise DatabaseError("a value of a reserved kind")
            else:
                out.append(None if kind == 0 else raw.decode(self.encoding) if kind % 2 else raw)
        return out

    def rows(self, page: bytes, number: int, wanted: set[int] | None = None) -> Iterator[tuple[int, list]]:
        """Row id and values of the rows of a leaf page."""
        kind, places, _ = self._cells(page, number)
        if kind != LEAF:
            raise DatabaseError(f"page {number} is no leaf")
        for p in places:
            size, at = varint(page, p)
            rowid, at = varint(page, at)
            yield rowid - (1 << 64) if rowid >> 63 else rowid, self._values(self._payload(page, at, size), wanted)

    def table(self, name: str) -> tuple[int, list[str], int | None, list, list[bool]]:
        """Root page, columns, the column that stands for the row id if there is one, what a row that ends early has for each column, and which hold floating-point numbers."""
        for number in self.leaves(1):
            for _, (kind, own, _, root, sql) in self.rows(self.page(number), number):
                if kind == "table" and own.lower() == name.lower():
                    with_sql = sqlite3.connect(":memory:")
                    try:
                        with_sql.execute(sql)
                        info = with_sql.execute(f'PRAGMA table_info("{own}")').fetchall()
                        rowid = [c[0] for c in info if c[5] and c[2].upper() == "INTEGER"] if sum(bool(c[5]) for c in info) == 1 else []
                        defaults = [None if c[4] is None else with_sql.execute(f"SELECT {c[4]}").fetchone()[0] for c in info]
                        if with_sql.execute("SELECT wr FROM pragma_table_list WHERE name = ? AND schema = 'main'", (own,)).fetchone()[0]:
                            raise DatabaseError(f"table {name} has no row ids")
                        hidden = {c[1] for c in with_sql.execute(f'PRAGMA table_xinfo("{own}")') if c[6]}
                        if hidden:
                            raise DatabaseError(f"table {name} has generated columns {sorted(hidden)}")
                    finally:
                        with_sql.close()
                    return root, [c[1] for c in info], rowid[0] if rowid else None, defaults, [is_real(c[2]) for c in info]
        raise DatabaseError(f"there is no table {name}")


def is_real(declared: str) -> bool:
    """Whether a column of this declared type holds floating-point numbers, which a file stores as integers where it can."""
    kind = declared.upper()
    return not any(k in kind for k in ("INT", "CHAR", "CLOB", "TEXT", "BLOB")) and any(k in kind for k in ("REAL", "FLOA", "DOUB"))


def database(f) -> Database:
    return Database(lambda at, n: f.read_at(n, at))


def geometry_rings(blob: bytes | None) -> list:
    """The rings of each polygon of a GeoPackage geometry; one None for a null or empty one."""
    from gridloom.sources.geo import parse_wkb

    if not blob:
        return [None]
    if blob[:2] != b"GP" or blob[3] >> 1 & 7 > 4:
        raise DatabaseError("a geometry without the package's header")
    if blob[3] & 0x10:
        return [None]
    return [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in parse_wkb(blob[8 + _ENVELOPES[blob[3] >> 1 & 7] :])] or [None]


@dataclass
class PageRun(InputPartition):
    """Some leaf pages of a layer of one file."""

    path: str
    pages: list[int]


class LayerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.layer, self.columns, self.geometry = options["layer"], json.loads(options.get("columns", "[]")), options.get("geometry", "geom")
        self.pages = int(options.get("pages", PAGES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            store, inner = store_of(path)
            log = store.get_file_info(f"{inner}-wal")
            if log.is_file and log.size:
                raise DatabaseError(f"{path} has changes in a write-ahead log")
            with store.open_input_file(inner) as f:
                db = database(f)
                leaves = db.leaves(db.table(self.layer)[0])
            out += [PageRun(path, leaves[k : k + self.pages]) for k in range(0, len(leaves), self.pages)]
        return out

    def read(self, partition: PageRun) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in self.columns), ("rings", _RINGS)])
        store, inner = store_of(partition.path)
        with store.open_input_file(inner) as f:
            db = database(f)
            _, names, rowid, defaults, real = db.table(self.layer)
            lower = [n.lower() for n in names]
            where = [lower.index(c.lower()) for c in [*self.columns, self.geometry]]
            rows = []
            for number in partition.pages:
                for own, values in db.rows(db.page(number), number, set(where)):
                    picked = [own if k == rowid else values[k] if k < len(values) else defaults[k] for k in where]
                    picked = [float(v) if real[k] and isinstance(v, int) else v for k, v in zip(where, picked, strict=True)]
                    for rings in geometry_rings(picked[-1]):
                        rows.append({**{c: None if v is None else str(v) for c, v in zip(self.columns, picked, strict=False)}, "rings": rings})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self) -> str:
        return ", ".join([*(f"`{c}` string" for c in json.loads(self._options().get("columns", "[]"))), "rings array<array<struct<x:double,y:double>>>"])

    def reader(self, schema) -> LayerReader:
        return LayerReader(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayerSource)


def read_layer(spark: SparkSession, paths: Sequence[str], layer: str, columns: Sequence[str], *, geometry: str = "geom", pages: int = PAGES) -> DataFrame:
    """Attributes (text) and rings of a layer's polygons, a row each; a multipolygon gives a row a polygon, a null or empty geometry one with null rings. Only the asked columns are made."""
    register(spark)
    options = {"paths": json.dumps(list(paths)), "layer": layer, "columns": json.dumps(list(columns)), "geometry": geometry, "pages": pages}
    return spark.read.format("geopackage").options(**options).load()

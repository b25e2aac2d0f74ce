"""TIFF files by byte ranges: the directories of classic and large files, and how the bytes of a strip or tile become pixels.

Whatever is not understood (a compression, a predictor, a sample format) is an error, never pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

Read = Callable[[int, int], bytes]

# Fixed values of the format: sizes and struct letters of tag types, numbers of tags, compressions, predictors and sample formats.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 254, 256, 257, 258, 259, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
COMPRESSIONS = (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD)
NO_PREDICTOR, DIFFERENCE, FLOATING = 1, 2, 3
_FORMATS = {1: "u", 2: "i", 3: "f"}
#: Bytes that are read at once from a file's beginning: a cloud-optimised file has its directories there.
HEAD = 1 << 14


class TiffError(ValueError):
    """A file that is damaged or of a kind that is not decoded."""


def lzw_decode(data: bytes) -> bytes:
    """The bytes of LZW codes of 9 to 12 bits, most significant bit first, widths growing one code early."""
    out, table, width = [], [], 9
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    value = bits = 0
    last = None
    for byte in data:
        value, bits = (value << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = list(single), 9, None
            continue
        if not table:
            table = list(single)
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError(f"LZW code {code} is not defined yet")
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW codes as ``lzw_decode`` reads them."""
    table, width, value, bits, out = {bytes([i]): i for i in range(256)}, 9, 256, 9, bytearray()
    held = b""

    def put(code: int, w: int) -> None:
        nonlocal value, bits
        value, bits = value << w | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    put(0, 0)
    size = 258
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held], width)
        table[longer] = size
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
        if size >= 4094:
            put(256, width)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        held = data[i : i + 1]
    if held:
        put(table[held], width)
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def decompress(raw: bytes, kind: int, size: int) -> bytes:
    if kind == PLAIN:
        return raw
    if kind == LZW:
        return lzw_decode(raw)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if kind == PACKBITS:
        return _unpack_bits(raw)
    if kind == ZSTD:
        return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)
    raise TiffError(f"compression {kind} is not decoded")


def compress(raw: bytes, kind: int) -> bytes:
    if kind == PLAIN:
        return raw
    if kind == LZW:
        return lzw_encode(raw)
    if kind == DEFLATE:
        return zlib.compress(raw)
    if kind == ZSTD:
        return pa.compress(raw, codec="zstd", asbytes=True)
    raise TiffError(f"compression {kind} is not written")


def unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """Samples (rows, columns, bands) from what a predictor left of them."""
    if predictor == NO_PREDICTOR:
        return block
    if predictor == DIFFERENCE:
        whole = block.view(f"{block.dtype.byteorder}u{block.dtype.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("=")).astype(whole.dtype).view(block.dtype)
    rows, columns, bands = block.shape
    planes = np.cumsum(block.view(np.uint8).reshape(rows, -1, bands), axis=1, dtype=np.uint8)
    bytes_first = planes.reshape(rows, block.dtype.itemsize, columns * bands).transpose(0, 2, 1)
    return np.ascontiguousarray(bytes_first).view(block.dtype.newbyteorder(">")).reshape(block.shape)


def predict(block: np.ndarray, predictor: int) -> bytes:
    """The bytes of samples (rows, columns, bands) under a predictor."""
    if predictor == NO_PREDICTOR:
        return block.tobytes()
    if predictor == DIFFERENCE:
        whole = block.view(f"{block.dtype.byteorder}u{block.dtype.itemsize}")
        return np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1])).astype(whole.dtype).tobytes()
    rows, columns, bands = block.shape
    planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, columns * bands, -1).transpose(0, 2, 1).reshape(rows, -1, bands)
    return np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()


class Image:
    """One directory of a file: a raster of one or more bands in strips or tiles. Only ``pixels`` reads any."""

    def __init__(self, read: Read, end: str, tags: dict[int, list | str]):
        self.read, self.end, self.tags = read, end, tags
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        self.kind, self.predictor, self.apart = one(COMPRESSION, PLAIN), one(PREDICTOR, NO_PREDICTOR), one(PLANAR, 1) == 2 and one(SAMPLES, 1) > 1
        bits, forms = set(tags.get(BITS, [1])), set(tags.get(SAMPLE_FORMAT, [1]))
        if len(bits) != 1 or len(forms) != 1 or min(bits) not in (8, 16, 32, 64) or min(forms) not in _FORMATS or (min(forms) == 3 and min(bits) < 16):
            raise TiffError(f"samples of {sorted(bits)} bits in formats {sorted(forms)} are not decoded")
        if self.kind not in COMPRESSIONS:
            raise TiffError(f"compression {self.kind} is not decoded")
        if one(FILL_ORDER, 1) != 1:
            raise TiffError("bits in reverse order are not decoded")
        self.dtype = np.dtype(f"{end}{_FORMATS[min(forms)]}{min(bits) // 8}")
        if self.predictor not in (NO_PREDICTOR, DIFFERENCE, FLOATING) or (self.predictor == FLOATING and self.dtype.kind != "f"):
            raise TiffError(f"predictor {self.predictor} is not decoded for {self.dtype}")
        tiled = TILE_WIDTH in tags
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.offsets, self.sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
        self.tiled, self.reduced = tiled, bool(one(SUBFILE, 0) & 1)
        self.mask = bool(one(SUBFILE, 0) & 4)
        self.down, self.across = -(-self.height // self.block[0]), -(-self.width // self.block[1])
        if len(self.offsets) != self.down * self.across * (self.bands if self.apart else 1):
            raise TiffError(f"{len(self.offsets)} blocks do not make a raster of {self.height} x {self.width}")
        text = tags.get(NODATA)
        self.nodata = float(text) if text else None

    @property
    def origin(self) -> tuple[float, float, float, float]:
        """x and y of the north-west corner, width and height of a pixel."""
        if PIXEL_SCALE not in self.tags or TIE_POINT not in self.tags:
            raise TiffError("the raster has no scale or tie point")
        (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[PIXEL_SCALE], self.tags[TIE_POINT]
        return x - i * sx, y + j * sy, sx, sy

    @property
    def epsg(self) -> int | None:
        """The code of the projected or geographic reference system, if the file names one."""
        keys = self.tags.get(GEO_KEYS, [])
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        return found.get(3072, found.get(2048))

    def pixels(self, i: int, j: int, band: int = 0) -> np.ndarray:
        """The pixels of one band in block row ``i`` and block column ``j``; nothing else is read. A block without bytes is all NoData."""
        n = i * self.across + j + (band * self.down * self.across if self.apart else 0)
        rows = min(self.block[0], self.height - i * self.block[0])
        full = self.block[0] if self.tiled else rows
        held = 1 if self.apart else self.bands
        shape = (full, self.block[1], held)
        if self.sizes[n] == 0:
            if self.nodata is None:
                raise TiffError(f"block {n} has no bytes")
            block = np.full(shape, self.nodata, self.dtype)
        else:
            size = full * self.block[1] * held * self.dtype.itemsize
            raw = decompress(self.read(self.offsets[n], self.sizes[n]), self.kind, size)
            if len(raw) < size:
                raise TiffError(f"block {n} has {len(raw)} of {size} bytes")
            block = unpredict(np.frombuffer(raw, self.dtype, size // self.dtype.itemsize).reshape(shape), self.predictor)
        return block[:rows, : self.width - j * self.block[1], 0 if self.apart else band]

    def window(self, r0: int, r1: int, c0: int, c1: int) -> tuple[int, int, int, int]:
        """Block rows and columns, half-open, that meet rows [r0, r1) and columns [c0, c1)."""
        r0, r1, c0, c1 = max(r0, 0), min(r1, self.height), max(c0, 0), min(c1, self.width)
        if r0 >= r1 or c0 >= c1:
            return 0, 0, 0, 0
        return r0 // self.block[0], -(-r1 // self.block[0]), c0 // self.block[1], -(-c1 // self.block[1])


def images(read: Read) -> list[Image]:
    """The directories of a file without masks: the raster itself, then its overviews, largest first. Overviews take scale and NoData from the raster."""
    start = read(0, HEAD)
    near: Read = lambda at, n: start[at : at + n] if at + n <= len(start) else read(at, n)
    if start[:2] not in (b"II", b"MM") or len(start) < 8:
        raise TiffError("not a TIFF")
    end = "<" if start[:2] == b"II" else ">"
    magic = struct.unpack_from(f"{end}H", start, 2)[0]
    if magic not in (42, 43) or (magic == 43 and struct.unpack_from(f"{end}HH", start, 4) != (8, 0)):
        raise TiffError(f"not a TIFF: magic number {magic}")
    large = magic == 43
    count, entry, room, place = ("Q", 20, 8, "Q") if large else ("H", 12, 4, "I")
    at = struct.unpack_from(f"{end}{place}", start, 8 if large else 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        wide = struct.calcsize(f"{end}{count}")
        n_tags = struct.unpack(f"{end}{count}", near(at, wide))[0]
        entries, tags = near(at + wide, entry * n_tags + room), {}
        for i in range(n_tags):
            tag, kind, n = struct.unpack_from(f"{end}HH{place}", entries, entry * i)
            size, raw = _SIZES.get(kind, 1) * n, entries[entry * (i + 1) - room : entry * (i + 1)]
            raw = raw if size <= room else near(struct.unpack(f"{end}{place}", raw)[0], size)
            if kind == 2:
                tags[tag] = raw[:n].split(b"\0")[0].decode("latin-1").strip()
            elif kind in _LETTERS:
                tags[tag] = list(struct.unpack_from(f"{end}{n}{_LETTERS[kind]}", raw))
        out.append(tags)
        at = struct.unpack_from(f"{end}{place}", entries, entry * n_tags)[0]
    found = [Image(read, end, tags) for tags in out if not (tags.get(SUBFILE) or [0])[0] & 4]
    if not found:
        raise TiffError("the file holds no raster")
    full, overviews = found[0], sorted((x for x in found[1:] if x.reduced), key=lambda x: -x.width)
    for x in overviews:
        if PIXEL_SCALE not in x.tags and PIXEL_SCALE in full.tags:
            x0, y0, sx, sy = full.origin
            x.tags[PIXEL_SCALE], x.tags[TIE_POINT] = [sx * full.width / x.width, sy * full.height / x.height, 0.0], [0.0, 0.0, 0.0, x0, y0, 0.0]
        x.nodata = full.nodata if x.nodata is None else x.nodata
    return [full, *overviews]


def for_resolution(levels: list[Image], resolution: float | None) -> int:
    """Which of a raster and its overviews to read for pixels of a wanted side: the coarsest that is no coarser than that; the raster itself without a wish."""
    if resolution is None:
        return 0
    fine = [k for k, x in enumerate(levels) if max(x.origin[2:]) <= resolution * (1 + 1e-9)]
    return fine[-1] if fine else 0


def encode(values: np.ndarray, *, origin: tuple[float, float, float, float], nodata: float | None = None, tile: int | None = 256, compression: int = DEFLATE, predictor: int = NO_PREDICTOR,
           large: bool = False, overviews: int = 0, epsg: int | None = None, end: str = "<", apart: bool = False) -> bytes:
    """A file of ``values`` (rows, columns[, bands]): tiles of a side, or strips of 64 rows, with so many overviews of every second pixel. Directories come first, the smallest overview's pixels next."""
    levels = [values if values.ndim == 3 else values[:, :, None]]
    for _ in range(overviews):
        levels.append(levels[-1][::2, ::2])
    place, count, room, entry = ("Q", "Q", 8, 20) if large else ("I", "H", 4, 12)
    directories = []
    for k, level in enumerate(levels):
        level = np.ascontiguousarray(level.astype(level.dtype.newbyteorder(end)))
        h, w, bands = level.shape
        bh, bw = (tile, tile) if tile else (min(64, h), w)
        blocks = []
        for group in [level[:, :, b : b + 1] for b in range(bands)] if apart else [level]:
            for r in range(0, h, bh):
                for c in range(0, w, bw):
                    piece = group[r : r + bh, c : c + bw]
                    if tile:
                        piece = np.pad(piece, ((0, bh - piece.shape[0]), (0, bw - piece.shape[1]), (0, 0)), mode="edge")
                    blocks.append(compress(predict(np.ascontiguousarray(piece), predictor), compression))
        forms = {"u": 1, "i": 2, "f": 3}
        tags: dict[int, tuple[int, list]] = {
            SUBFILE: (4, [int(k > 0)]), WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [level.dtype.itemsize * 8] * bands), COMPRESSION: (3, [compression]), 262: (3, [1]), SAMPLES: (3, [bands]),
            PLANAR: (3, [2 if apart else 1]), PREDICTOR: (3, [predictor]), SAMPLE_FORMAT: (3, [forms[level.dtype.kind]] * bands),
        }
        sizes = [len(b) for b in blocks]
        if tile:
            tags |= {TILE_WIDTH: (3, [bw]), TILE_HEIGHT: (3, [bh]), TILE_OFFSETS: (16 if large else 4, [0] * len(blocks)), TILE_SIZES: (4, sizes)}
        else:
            tags |= {ROWS_PER_STRIP: (3, [bh]), STRIP_OFFSETS: (16 if large else 4, [0] * len(blocks)), STRIP_SIZES: (4, sizes)}
        if not k:
            x, y, sx, sy = origin
            tags |= {PIXEL_SCALE: (12, [sx, sy, 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, x, y, 0.0])}
            if epsg:
                tags[GEO_KEYS] = (3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg])
            if nodata is not None:
                tags[NODATA] = (2, list(f"{nodata:.17g}".encode() + b"\0"))
        directories.append((tags, blocks))
    pack = lambda kind, values: bytes(values) if kind == 2 else struct.pack(f"{end}{len(values)}{_LETTERS[kind]}", *values)
    head = 16 if large else 8
    spans, at = [], head
    for tags, _ in directories:
        extra = sum(len(x) + len(x) % 2 for x in (pack(*t) for t in tags.values()) if len(x) > room)
        spans.append((at, at + struct.calcsize(f"{end}{count}") + entry * len(tags) + room))
        at = spans[-1][1] + extra
    starts: dict[int, list[int]] = {}
    for k in range(len(directories) - 1, -1, -1):
        starts[k] = []
        for b in directories[k][1]:
            starts[k].append(at)
            at += len(b)
    out = bytearray(b"II" if end == "<" else b"MM")
    out += struct.pack(f"{end}HHHQ", 43, 8, 0, spans[0][0]) if large else struct.pack(f"{end}HI", 42, spans[0][0])
    for k, (tags, _) in enumerate(directories):
        tags[TILE_OFFSETS if tile else STRIP_OFFSETS] = (16 if large else 4, starts[k])
        extra_at, extra = spans[k][1], bytearray()
        out += struct.pack(f"{end}{count}", len(tags))
        for tag in sorted(tags):
            kind, content = tags[tag]
            raw = pack(kind, content)
            out += struct.pack(f"{end}HH{place}", tag, kind, len(content))
            if len(raw) <= room:
                out += raw.ljust(room, b"\0")
            else:
                out += struct.pack(f"{end}{place}", extra_at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        out += struct.pack(f"{end}{place}", spans[k + 1][0] if k + 1 < len(spans) else 0) + extra
    for k in range(len(directories) - 1, -1, -1):
        out += b"".join(directories[k][1])
    return bytes(out)

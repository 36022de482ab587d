"""TIFF grids as a partitioned source of Spark: ``spark.read.format("tiff_cells")``.

A file's directory is read by byte range; its strips or tiles are dealt to partitions in runs of about ``run_bytes`` decoded bytes, and a task
reads the ranges of its own blocks alone. So one large file is read by as many tasks as it is large, whatever its size, and no task holds more than a block. Bands,
a window of rows and columns, and (with the option ``push``) comparisons of ``r``, ``c`` and ``band`` with constants choose the blocks that are read.

What is read: TIFF and BigTIFF in either byte order, strips or tiles, bands interleaved or in planes, uncompressed, LZW, deflate or PackBits, predictors
1 to 3, samples of 8 to 64 bits, georeferenced by scale and tie point or by a matrix, north up.

Options: ``paths`` (JSON list; else the path given to ``load``, one file), ``bands`` (comma-joined, from 1; default 1), ``window`` (first row, end row, first column,
end column), ``origin`` (x0, y0 of the grid that ``r`` and ``c`` count on; default each file's own), ``nodata`` (besides the file's), ``run_bytes``,
``push`` (filters of the query reach the reader; Spark allows it where ``spark.sql.python.filterPushdown.enabled`` is set).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .grids import GridInfo

# fixed values: numbers of TIFF and GeoTIFF tags, sizes and letters of its types
TAGS = {"cols": 256, "rows": 257, "bits": 258, "compression": 259, "offsets": 273, "samples": 277, "per_strip": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_w": 322, "tile_h": 323, "tile_offsets": 324, "tile_counts": 325, "format": 339, "scale": 33550, "tie": 33922, "matrix": 34264, "keys": 34735, "metadata": 42112, "nodata": 42113}
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
HEAD_BYTES = 1 << 16


class RasterError(ValueError):
    pass


# --- bytes --------------------------------------------------------------------------------------


class Held:
    """Ranges of bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class Stored:
    """Ranges of a file in any store that Arrow's file systems reach; the head is read once."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = store_of(path)
        self.file = self.fs.open_input_file(self.path)
        self.head = self.file.read_at(HEAD_BYTES, 0)

    def read(self, at: int, size: int) -> bytes:
        return self.head[at : at + size] if at + size <= len(self.head) else self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()


def store_of(path: str):
    """(Arrow file system, path in it) of a URI as Spark writes it, or of a local path."""
    from pyarrow import fs
    from urllib.parse import unquote

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def unlzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, first bit first, 256 clears the table, 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, before = list(single), [], b""
    held = bits = 0
    width, grow_at = 9, 511
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, before, width, grow_at = list(single), b"", 9, 511
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif before and code == len(table):
            word = before + before[:1]
        else:
            raise RasterError("a block's LZW codes are damaged")
        out.append(word)
        if before:
            table.append(before + word[:1])
            if len(table) >= grow_at and width < 12:
                width += 1
                grow_at = (1 << width) - 1
        before = word
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, k = [], 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out.append(data[k + 1 : k + 2 + n])
            k += 2 + n
        elif n > 128:
            out.append(data[k + 1 : k + 2] * (257 - n))
            k += 2
        else:
            k += 1
    return b"".join(out)


UNPACK = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}


# --- files ----------------------------------------------------------------------------------------


class Tiff:
    """The directory of a file, and its blocks. ``source``: bytes, or an object with ``read(at, size)``."""

    def __init__(self, source) -> None:
        self.source = Held(bytes(source)) if isinstance(source, (bytes, bytearray, memoryview)) else source
        self.tag = self._directory()
        one = lambda name, default=None: default if not self.tag[name] else self.tag[name][0]
        self.rows, self.cols, self.samples = one("rows"), one("cols"), one("samples", 1)
        self.compression, self.predictor, self.planar = one("compression", NONE), one("predictor", 1), one("planar", 1)
        if self.compression not in UNPACK:
            raise RasterError(f"compression {self.compression} is not read")
        if len(set(self.tag["bits"] or ())) > 1 or len(set(self.tag["format"] or ())) > 1:
            raise RasterError("bands of several kinds in one file")
        letter = {1: "u", 2: "i", 3: "f"}.get(one("format", 1))
        if letter is None or one("bits", 8) not in (8, 16, 32, 64):
            raise RasterError("samples of a kind that is not read")
        self.kind = np.dtype(f"{self.order}{letter}{one('bits', 8) // 8}")
        self.tiled = self.tag["tile_offsets"] is not None
        self.offsets, self.counts = (self.tag["tile_offsets"], self.tag["tile_counts"]) if self.tiled else (self.tag["offsets"], self.tag["counts"])
        self.block_h, self.block_w = (one("tile_h"), one("tile_w")) if self.tiled else (min(one("per_strip", self.rows), self.rows), self.cols)
        self.across, self.down = -(-self.cols // self.block_w), -(-self.rows // self.block_h)
        self._georeference()
        self.tags = dict(re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', self.tag["metadata"] or ""))
        self.nodata = float(self.tag["nodata"]) if self.tag["nodata"] not in (None, "") else None
        keys = self.tag["keys"] or ()
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        self.epsg = codes.get(3072) or codes.get(2048)
        self.projected = 3072 in codes

    def _directory(self) -> dict:
        head = self.source.read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        number = struct.unpack(self.order + "H", head[2:4])[0] if self.order and len(head) >= 8 else 0
        if number == 42:
            at, count, entry, inline = struct.unpack(self.order + "I", head[4:8])[0], "H", "HHI", 4
        elif number == 43 and len(head) == 16:
            at, count, entry, inline = struct.unpack(self.order + "Q", head[8:16])[0], "Q", "HHQ", 8
        else:
            raise RasterError("not a TIFF file")
        skip, long = struct.calcsize(self.order + count), struct.calcsize(self.order + entry)
        (n,) = struct.unpack(self.order + count, self.source.read(at, skip))
        listing, found = self.source.read(at + skip, n * (long + inline)), {}
        for k in range(n):
            place = k * (long + inline)
            tag, kind, many = struct.unpack_from(self.order + entry, listing, place)
            if kind not in KINDS:
                continue
            size, letter = KINDS[kind]
            body = listing[place + long : place + long + inline]
            if size * many > inline:
                body = self.source.read(struct.unpack(self.order + ("I" if inline == 4 else "Q"), body)[0], size * many)
            found[tag] = body[:many].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(f"{self.order}{many}{letter}", body[: size * many])
        return {name: found.get(tag) for name, tag in TAGS.items()}

    def _georeference(self) -> None:
        if self.tag["matrix"]:
            m = self.tag["matrix"]
            cw, rx, x0, ry, ch, y0 = m[0], m[1], m[3], m[4], m[5], m[7]
        elif self.tag["scale"] and self.tag["tie"]:
            (sx, sy), t = self.tag["scale"][:2], self.tag["tie"]
            cw, ch, rx, ry, x0, y0 = sx, -sy, 0.0, 0.0, t[3] - t[0] * sx, t[4] + t[1] * sy
        else:
            raise RasterError("the file has no georeference")
        if abs(rx) > 1e-9 or abs(ry) > 1e-9:
            raise RasterError("the grid is rotated or skewed; a north-up grid is needed")
        if cw <= 0 or ch >= 0:
            raise RasterError("the grid does not run from west to east and from north to south")
        self.info = GridInfo(self.rows, self.cols, x0, y0, cw, -ch)

    @property
    def block_bytes(self) -> int:
        """Of a decoded block."""
        return self.block_h * self.block_w * self.kind.itemsize * (self.samples if self.planar == 1 else 1)

    def within(self, window: tuple[int, int, int, int] | None = None) -> list[int]:
        """Numbers of the blocks (of one plane) that touch the rows and columns of ``window`` (first, end; first, end)."""
        r0, r1, c0, c1 = window or (0, self.rows, 0, self.cols)
        r0, r1, c0, c1 = max(r0, 0), min(r1, self.rows), max(c0, 0), min(c1, self.cols)
        if r0 >= r1 or c0 >= c1:
            return []
        return [i * self.across + j for i in range(r0 // self.block_h, (r1 - 1) // self.block_h + 1) for j in range(c0 // self.block_w, (c1 - 1) // self.block_w + 1)]

    def block(self, k: int, bands: tuple[int, ...] = (1,)) -> tuple[int, int, list[np.ndarray]]:
        """(first row, first column, a band's values each) of block ``k``."""
        if any(b < 1 or b > self.samples for b in bands):
            raise RasterError(f"the file has {self.samples} bands")
        r, c = k // self.across * self.block_h, k % self.across * self.block_w
        height = self.block_h if self.tiled else min(self.block_h, self.rows - r)
        cut = lambda a: a[: self.rows - r, : self.cols - c]
        if self.planar == 2:
            own = [self._values(self._raw(k + (b - 1) * self.across * self.down), height, self.block_w) for b in bands]
        else:
            whole = self._values(self._raw(k), height, self.block_w)
            own = [whole if self.samples == 1 else whole[:, :, b - 1] for b in bands]
        return r, c, [cut(a) for a in own]

    def _raw(self, k: int) -> bytes:
        size = self.counts[k]
        raw = self.source.read(self.offsets[k], size)
        if len(raw) < size:
            raise RasterError("the file ends within a block")
        return UNPACK[self.compression](raw)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, values of the first band) of each strip or tile."""
        for k in range(self.across * self.down):
            r, c, own = self.block(k)
            yield r, c, own[0]

    def _values(self, raw: bytes, h: int, w: int) -> np.ndarray:
        """h x w values, or h x w x samples where bands are interleaved."""
        size, s = self.kind.itemsize, self.samples if self.planar == 1 else 1
        if self.predictor == 3:  # bytes of like significance side by side, differences along the row
            b = np.frombuffer(raw, np.uint8, h * w * s * size).reshape(h, w * size, s)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(h, size, w * s).transpose(0, 2, 1)
            a = np.ascontiguousarray(b).view(f">f{size}")[:, :, 0].reshape(h, w, s)
        else:
            a = np.frombuffer(raw, self.kind, h * w * s).reshape(h, w, s)
            if self.predictor == 2:
                whole = a.view(f"{self.order}u{size}").astype(f"u{size}")
                a = np.cumsum(whole, axis=1, dtype=whole.dtype).view(self.kind.newbyteorder("="))
        return a[:, :, 0] if s == 1 else a


def valid(a: np.ndarray, nodata: Iterable[float | None]) -> np.ndarray:
    """Which values are finite and none of ``nodata`` (compared as the file's own numbers)."""
    ok = np.isfinite(a)
    for bad in nodata:
        if bad is not None:
            ok &= (a != np.array(bad).astype(a.dtype)) if a.dtype.kind == "f" else (a.astype(float) != bad)
    return ok


# --- the source -------------------------------------------------------------------------------------


@dataclass
class Run(InputPartition):
    """Consecutive blocks of a file."""

    path: str
    first: int
    blocks: list[int]
    at: tuple[int, int] = (0, 0)
    window: tuple[int, int, int, int] | None = None
    bands: tuple[int, ...] = (1,)


@dataclass
class Chosen:
    """What of the files is asked for; rows and columns count on the grid of ``origin``."""

    bands: tuple[int, ...] = (1,)
    window: list[int] = field(default_factory=lambda: [-(1 << 40), 1 << 40, -(1 << 40), 1 << 40])

    def narrow(self, column: str, least: int | None, end: int | None) -> None:
        k = 0 if column == "r" else 2
        if least is not None:
            self.window[k] = max(self.window[k], least)
        if end is not None:
            self.window[k + 1] = min(self.window[k + 1], end)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.chosen = Chosen(tuple(int(b) for b in options.get("bands", "1").split(",")))
        if "window" in options:
            r0, r1, c0, c1 = (int(x) for x in options["window"].split(","))
            self.chosen.narrow("r", r0, r1)
            self.chosen.narrow("c", c0, c1)
        self.origin = tuple(float(x) for x in options["origin"].split(",")) if "origin" in options else None
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.run_bytes = int(options.get("run_bytes", 32 << 20))

    def _runs(self, path: str) -> list[Run]:
        source = Stored(path)
        try:
            t = Tiff(source)
            dr, dc = placed(t.info, *self.origin) if self.origin else (0, 0)
            r0, r1, c0, c1 = self.chosen.window
            window = (max(r0 - dr, 0), min(r1 - dr, t.rows), max(c0 - dc, 0), min(c1 - dc, t.cols))
            own, each = t.within(window), max(1, self.run_bytes // max(t.block_bytes * len(self.chosen.bands), 1))
            return [Run(path, k, own[k : k + each], (dr, dc), window, self.chosen.bands) for k in range(0, len(own), each)]
        finally:
            source.close()

    def partitions(self) -> list[Run]:
        if not self.chosen.bands:
            return [Run(self.paths[0], 0, [])]
        with ThreadPoolExecutor(16) as pool:
            return [r for runs in pool.map(self._runs, self.paths) for r in runs] or [Run(self.paths[0], 0, [])]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.blocks:
            return
        source = Stored(run.path)
        try:
            t = Tiff(source)
            r0, r1, c0, c1 = run.window
            for k in run.blocks:
                r, c, values = t.block(k, run.bands)
                for band, a in zip(run.bands, values, strict=True):
                    ok = valid(a, (t.nodata, self.nodata))
                    ok[: max(0, r0 - r)] = ok[max(0, r1 - r) :] = False
                    ok[:, : max(0, c0 - c)] = ok[:, max(0, c1 - c) :] = False
                    i, j = np.nonzero(ok)
                    if len(i):
                        n = len(i)
                        yield pa.RecordBatch.from_arrays([pa.array([run.path]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, band, np.int32)), pa.array((i + (r + run.at[0])).astype(np.int32)), pa.array((j + (c + run.at[1])).astype(np.int32)), pa.array(a[i, j].astype(float))], ["path", "band", "r", "c", "z"])
        finally:
            source.close()


class PushedReader(TiffReader):
    """A reader that filters of the query reach."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of r, c and band choose blocks; Spark applies all filters again."""
        for f in filters:
            name, x = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name in ("r", "c") and isinstance(x, int):
                least, end = {GreaterThan: (x + 1, None), GreaterThanOrEqual: (x, None), LessThan: (None, x), LessThanOrEqual: (None, x + 1), EqualTo: (x, x + 1)}.get(type(f), (None, None))
                self.chosen.narrow(name, least, end)
            if name == "band" and isinstance(f, EqualTo):
                self.chosen.bands = tuple(b for b in self.chosen.bands if b == x)
            yield f


class TiffCells(DataSource):
    """(path, band, r, c, z) of the valid cells of TIFF files."""

    @classmethod
    def name(cls) -> str:
        return "tiff_cells"

    def schema(self) -> str:
        return "path string, band int, r int, c int, z double"

    def reader(self, schema) -> TiffReader:
        options = dict(self.options)
        return (PushedReader if options.get("push", "").lower() == "true" else TiffReader)(options)


def placed(info: GridInfo, x0: float, y0: float) -> tuple[int, int]:
    """Row and column, on the grid whose corner is (x0, y0), of a file's first cell; an error if its cells lie across those."""
    r, c = (y0 - info.y0) / info.ch, (info.x0 - x0) / info.cw
    if abs(r - round(r)) > 1e-6 or abs(c - round(c)) > 1e-6:
        raise RasterError("the files are not on one grid")
    return round(r), round(c)

"""Slides as a data source: one row a tile with its pixels, read by a decoder that the user may supply.

A decoder is a class with open(path) -> object of properties, width, height (both of level 0, the finest) and
read(level, col, row, tile, overlap) -> height, width and bytes of RGB rows, where a level has half the size of the one before. It is named as
"module:Class" so that tasks can import it; image libraries are not required by this package. Raw and Tiff read parts of files on any file system that pyarrow knows, Auto picks one of them.
"""

from __future__ import annotations

import importlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system

TILES = "path string, level int, col int, row int, height int, width int, pixels binary"


def load_decoder(name: str):
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


def area(level: int, col: int, row: int, tile: int, overlap: int, height: int, width: int) -> tuple[int, int, int, int]:
    """Rows and columns, in pixels of the level, that a tile and its margin have of a slide of this height and width at level 0."""
    high, wide = height >> level, width >> level
    return max(0, row * tile - overlap), min(row * tile + tile + overlap, high), max(0, col * tile - overlap), min(col * tile + tile + overlap, wide)


def halved(part: np.ndarray, times: int) -> np.ndarray:
    """Means of 2 ** times pixels a side, rounded down."""
    if not times:
        return part
    n = 1 << times
    return part.reshape(part.shape[0] // n, n, part.shape[1] // n, n, 3).mean((1, 3)).astype(np.uint8)


class Raw:
    """The simplest slides: numpy .npy files of (height, width, 3) bytes; only the asked-for pixels are read. Level n
    holds means of 2 ** n pixels a side, rounded down. Properties come from a JSON file beside it, PATH.json; without one it has 0.5 microns a pixel."""

    def open(self, path: str):
        self.files, self.path = file_system(path)
        with self.files.open_input_file(self.path) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            self.start = f.tell()
        if fortran or kind != np.uint8 or len(shape) != 3 or shape[2] != 3:
            raise ValueError(f"not rows of RGB bytes: {shape} {kind}")
        self.height, self.width = shape[:2]
        self.properties = {"openslide.mpp-x": "0.5"}
        if self.files.get_file_info(f"{self.path}.json").type == pyarrow.fs.FileType.File:
            with self.files.open_input_file(f"{self.path}.json") as f:
                self.properties = {k: str(v) for k, v in json.loads(f.read()).items()}
        return self

    def read(self, level: int, col: int, row: int, tile: int, overlap: int) -> tuple[int, int, bytes]:
        """Height, width and bytes; at the slide's edges the part is smaller."""
        y0, y1, x0, x1 = (v << level for v in area(level, col, row, tile, overlap, self.height, self.width))
        if y1 <= y0 or x1 <= x0:
            return 0, 0, b""
        with self.files.open_input_file(self.path) as f:
            if 2 * (x1 - x0) > self.width:
                f.seek(self.start + y0 * self.width * 3)
                part = _whole(f.read((y1 - y0) * self.width * 3), (y1 - y0, self.width, 3))[:, x0:x1]
            else:  # a window costs its own pixels, not those beside it
                part = np.empty((y1 - y0, x1 - x0, 3), np.uint8)
                for y in range(y0, y1):
                    f.seek(self.start + (y * self.width + x0) * 3)
                    part[y - y0] = _whole(f.read((x1 - x0) * 3), (x1 - x0, 3))
        part = halved(part, level)
        return part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes()


def _whole(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    if len(data) != np.prod(shape):
        raise ValueError(f"file ends early: {len(data)} of {np.prod(shape)} bytes")
    return np.frombuffer(data, np.uint8).reshape(shape)


def _runs(data: bytes) -> bytes:
    """Bytes from runs: a count, then that many and one literal bytes, or one to be repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


# Fixed values of the format: tags, and sizes of the value types.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, SAMPLES = 256, 257, 258, 259, 270, 277
X_RESOLUTION, PLANES, UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, SUB, TABLES = 282, 284, 296, 317, 322, 323, 324, 325, 330, 347
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
UNITS = {1: "pixel", 2: "inch", 3: "cm"}

#: From a tile's bytes and the level's tables to the bytes of its pixels, by the number of the compression. A decoder for JPEG (7) needs an image library: add it here.
Codec = Callable[[bytes, bytes], bytes]
CODECS: dict[int, Codec] = {1: lambda b, _: b, 8: lambda b, _: zlib.decompress(b), 32946: lambda b, _: zlib.decompress(b), 32773: lambda b, _: _runs(b)}


class Level:
    """One image of a TIFF file: its sizes, and where the lists of its tiles' offsets and sizes lie."""

    def __init__(self, tags: dict, number: Callable[[int, int], int], down: int = 0):
        self.tags, self.down = tags, down
        self.width, self.height, self.tile_w, self.tile_h = (number(t, 0) for t in (WIDTH, HEIGHT, TILE_WIDTH, TILE_HEIGHT))
        self.compression, self.predictor, self.samples = number(COMPRESSION, 1), number(PREDICTOR, 1), number(SAMPLES, 1)
        self.usable = bool(self.tile_w and self.tile_h and self.samples in (3, 4) and number(PLANES, 1) == 1 and number(BITS, 8) == 8 and OFFSETS in tags)
        self.across = -(-self.width // self.tile_w) if self.usable else 0


class Tiff:
    """Tiled TIFF and BigTIFF files with several levels (the images of the file, or those below the first, whose sides are its sides over a power of two).

    A window reads the entries of its own tiles in the lists of offsets and sizes and then those tiles, of the coarsest stored level that is at least as fine as the one asked for; the rest is
    halved. `bytes_read` counts what was read. Without compression, deflate and runs need no library; others need an entry in CODECS.
    """

    def open(self, path: str):
        files, path = file_system(path)
        self.file, self.bytes_read = files.open_input_file(path), 0
        magic = self._at(0, 16)
        if magic[:2] not in (b"II", b"MM"):
            raise ValueError("no TIFF file")
        self.order = "<" if magic[:2] == b"II" else ">"
        kind, = struct.unpack(self.order + "H", magic[2:4])
        if kind not in (42, 43):
            raise ValueError("no TIFF file")
        self.big = kind == 43
        first, = struct.unpack(self.order + ("Q" if self.big else "I"), magic[8:16] if self.big else magic[4:8])
        images = list(self._images(first))
        for tags in list(images):
            if SUB in tags:
                for at in self._values(tags, SUB):
                    images += self._images(at)
        levels = [x for x in (Level(t, lambda tag, other, t=t: int((self._values(t, tag) or [other])[0])) for t in images) if x.usable]
        if not levels:
            raise ValueError("no tiled RGB image of 8 bits in it")
        main = max(levels, key=lambda x: x.width * x.height)
        self.levels = []
        for x in levels:
            down = np.log2(main.width / x.width)
            x.down = int(round(down))
            near = abs(x.width - main.width / 2**x.down) <= 1 and abs(x.height - main.height / 2**x.down) <= 1
            if near and x.down not in [y.down for y in self.levels]:
                self.levels.append(x)
        self.levels.sort(key=lambda x: x.down)
        self.width, self.height = main.width, main.height
        self.properties = self._properties(main.tags)
        return self

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.bytes_read += len(data)
        if len(data) < size:
            raise ValueError(f"file ends early: {len(data)} of {size} bytes at {at}")
        return data

    def _images(self, at: int) -> Iterator[dict[int, tuple[int, int, bytes]]]:
        """Tags of each image in the chain: type, number of values, and the entry's own bytes."""
        count, size, word, seen = ("Q", 20, 8, set()) if self.big else ("H", 12, 4, set())
        while at and at not in seen:
            seen.add(at)
            n, = struct.unpack(self.order + count, self._at(at, struct.calcsize(count)))
            if n > 4096:
                raise ValueError("a directory that cannot be")
            start = at + struct.calcsize(count)
            data = self._at(start, n * size + word)
            tags = {}
            for i in range(n):
                tag, kind, values = struct.unpack(self.order + ("HHQ" if self.big else "HHI"), data[i * size : i * size + size - word])
                tags[tag] = (kind, values, data[i * size + size - word : (i + 1) * size])
            yield tags
            at, = struct.unpack(self.order + ("Q" if self.big else "I"), data[n * size :])

    def _part(self, tags: dict, tag: int, first: int, last: int) -> bytes:
        """The bytes of some values of a tag; long lists lie elsewhere and are read for these alone."""
        kind, n, own = tags[tag]
        size = SIZES[kind]
        if n * size <= len(own):
            return own[first * size : last * size]
        at, = struct.unpack(self.order + ("Q" if self.big else "I"), own)
        return self._at(at + first * size, (last - first) * size)

    def _values(self, tags: dict, tag: int, first: int = 0, last: int | None = None) -> list:
        if tag not in tags:
            return []
        kind, n, _ = tags[tag]
        data = self._part(tags, tag, first, n if last is None else last)
        if kind == 2:
            return [data.split(b"\0")[0].decode("utf-8", "replace")]
        if kind in (5, 10):
            pairs = np.frombuffer(data, self.order + ("u4" if kind == 5 else "i4")).reshape(-1, 2)
            return [a / b if b else 0.0 for a, b in pairs.tolist()]
        code = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}[kind]
        return np.frombuffer(data, self.order + code).tolist()

    def _properties(self, tags: dict) -> dict[str, str]:
        out = {}
        about = (self._values(tags, DESCRIPTION) or [""])[0]
        found = re.search(r"\bMPP *= *([0-9.]+)", about)
        if found:
            out["openslide.mpp-x"] = found[1]
        across = self._values(tags, X_RESOLUTION)
        if across:
            out["tiff.XResolution"] = repr(across[0])
            out["tiff.ResolutionUnit"] = UNITS.get((self._values(tags, UNIT) or [2])[0], "pixel")
        return out

    def _tiles(self, level: Level, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """Pixels of a part of a stored level."""
        out = np.zeros((y1 - y0, x1 - x0, 3), np.uint8)
        tables = b""
        if TABLES in level.tags:
            tables = self._part(level.tags, TABLES, 0, level.tags[TABLES][1])
        first, last = x0 // level.tile_w, -(-x1 // level.tile_w)
        for r in range(y0 // level.tile_h, -(-y1 // level.tile_h)):
            where = [r * level.across + c for c in (first, last)]
            offsets, counts = self._values(level.tags, OFFSETS, *where), self._values(level.tags, COUNTS, *where)
            for c, at, n in zip(range(first, last), offsets, counts, strict=True):
                if not n:
                    continue  # a tile that is not stored is empty
                if level.compression not in CODECS:
                    raise ValueError(f"no codec for compression {level.compression}")
                px = _whole(CODECS[level.compression](self._at(at, n), tables), (level.tile_h, level.tile_w, level.samples))
                if level.predictor == 2:
                    px = np.cumsum(px, axis=1, dtype=np.uint8)
                top, left = max(y0, r * level.tile_h), max(x0, c * level.tile_w)
                low, right = min(y1, (r + 1) * level.tile_h), min(x1, (c + 1) * level.tile_w)
                out[top - y0 : low - y0, left - x0 : right - x0] = px[top - r * level.tile_h : low - r * level.tile_h, left - c * level.tile_w : right - c * level.tile_w, :3]
        return out

    def read(self, level: int, col: int, row: int, tile: int, overlap: int) -> tuple[int, int, bytes]:
        """Height, width and bytes; at the slide's edges the part is smaller."""
        y0, y1, x0, x1 = area(level, col, row, tile, overlap, self.height, self.width)
        if y1 <= y0 or x1 <= x0:
            return 0, 0, b""
        stored = max((x for x in self.levels if x.down <= level), key=lambda x: x.down)
        times = level - stored.down
        a, b, c, d = (v << times for v in (y0, y1, x0, x1))
        inside = self._tiles(stored, a, min(b, stored.height), c, min(d, stored.width))
        # a stored level may be a pixel short of what halving its sides gives
        part = halved(np.pad(inside, ((0, b - a - inside.shape[0]), (0, d - c - inside.shape[1]), (0, 0)), mode="edge"), times)
        return part.shape[0], part.shape[1], np.ascontiguousarray(part).tobytes()


class Auto:
    """Raw or Tiff, as the first bytes of the file say."""

    def open(self, path: str):
        files, at = file_system(path)
        with files.open_input_file(at) as f:
            magic = f.read(4)
        if magic[:2] in (b"II", b"MM"):
            return Tiff().open(path)
        if magic == b"\x93NUM":
            return Raw().open(path)
        raise ValueError(f"neither a TIFF nor an .npy file: {magic!r}")


def window(slide, level: int, col: int, row: int, core: int, overlap: int) -> np.ndarray:
    """The pixels of a window, (core + 2 overlap) a side, whose core starts at col * core, row * core of its level; what lies beyond the slide is 0."""
    h, w, data = slide.read(level, col, row, core, overlap)
    side = core + 2 * overlap
    out = np.zeros((side, side, 3), np.uint8)
    top, left = max(0, overlap - row * core), max(0, overlap - col * core)
    if h and w:
        out[top : top + h, left : left + w] = np.frombuffer(data, np.uint8).reshape(h, w, 3)
    return out


class Share(InputPartition):
    """The part-th of some shares of a slide's rows."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class SlideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.tile, self.overlap, self.level = (int(options.get(k, v)) for k, v in (("tile", 224), ("overlap", 0), ("level", 0)))

    def partitions(self) -> list[InputPartition]:
        """Shares of every slide. No slide is opened here: a task opens its own and takes its share of the rows of tiles."""
        parts = int(self.options.get("parts", 8))
        return [Share(path, k, parts) for path in self.options["path"].split(",") for k in range(parts)]

    def read(self, partition: Share) -> Iterator[tuple]:
        slide = load_decoder(self.options.get("decoder", "tilewright.sources.slides:Auto")).open(partition.path)
        rows = -(-(slide.height >> self.level) // self.tile)
        for row in range(rows * partition.part // partition.parts, rows * (partition.part + 1) // partition.parts):
            for col in range(-(-(slide.width >> self.level) // self.tile)):
                h, w, data = slide.read(self.level, col, row, self.tile, self.overlap)
                yield partition.path, self.level, col, row, h, w, data


class SlideSource(DataSource):
    """spark.dataSource.register(SlideSource); spark.read.format("slides").options(decoder=..., tile=..., overlap=..., level=...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return SlideReader(self.options)

"""Single-band GeoTIFF without a native library, and a Spark source for it.

Reads strips and tiles, none and deflate compression, horizontal predictor,
integers and floats of both byte orders, affine or tie-point georeferencing,
the EPSG code and the GDAL nodata text. Anything else is refused by name.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Sizes of the field types of the format, and names of its tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIES, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
CELLS_SCHEMA = "raster_id string, row_index int, column_index int, cell_value double"


@dataclass(frozen=True)
class Header:
    """What a GeoTIFF says about itself."""

    width: int
    height: int
    band_count: int
    dtype: str
    crs: str | None
    transform: tuple[float, float, float, float, float, float]
    nodata: float | None
    order: str
    compression: int
    predictor: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def read_header(path: str | Path) -> Header:
    with open(path, "rb") as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
            raise ValueError(f"{Path(path).name} is no TIFF (or a BigTIFF)")
        f.seek(struct.unpack(order + "I", start[4:])[0])
        tags: dict[int, tuple | str] = {}
        for _ in range(struct.unpack(order + "H", f.read(2))[0]):
            tag, kind, n = struct.unpack(order + "HHI", f.read(8))
            raw, size = f.read(4), SIZES.get(kind, 0) * n
            if size > 4:
                here = f.tell()
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size)
                f.seek(here)
            if kind == 2:
                tags[tag] = raw[:n].split(b"\0")[0].decode("ascii", "replace")
            elif kind in CODES:
                tags[tag] = struct.unpack(f"{order}{n}{CODES[kind]}", raw[: size or 0])
    one = lambda t, d: tags.get(t, (d,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(BANDS, 1)
    kind = {1: "uint", 2: "int", 3: "float"}.get(one(FORMAT, 1))
    dtype = f"{kind}{one(BITS, 1)}"
    if kind is None or one(BITS, 1) not in (8, 16, 32, 64) or dtype == "float8":
        raise ValueError(f"sample type {dtype} is not supported")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(COMPRESSION, 1)} is not supported")
    if one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(PREDICTOR, 1)} is not supported")
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIES in tags:
        s, t = tags[SCALE], tags[TIES]
        transform = (s[0], 0.0, t[3] - t[0] * s[0], 0.0, -s[1], t[4] + t[1] * s[1])
    else:
        raise ValueError("the raster is not georeferenced")
    crs, keys = None, tags.get(GEO_KEYS, ())
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (2048, 3072) and keys[i + 1] == 0 and keys[i + 3] != 32767:
            crs = f"EPSG:{keys[i + 3]}"
    nodata = None
    if NODATA in tags and str(tags[NODATA]).strip():
        nodata = float(str(tags[NODATA]))
    tiled = TILES in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    return Header(width, height, bands, dtype, crs, transform, nodata, order, one(COMPRESSION, 1), one(PREDICTOR, 1), block, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES])


def read_block(path: str | Path, h: Header, i: int) -> tuple[int, int, np.ndarray]:
    """First row, first column and the samples (as double) of block ``i``."""
    across = math.ceil(h.width / h.block[1])
    row, col = i // across * h.block[0], i % across * h.block[1]
    with open(path, "rb") as f:
        f.seek(h.offsets[i])
        raw = f.read(h.counts[i])
    if h.compression != 1:
        raw = zlib.decompress(raw)
    dtype = np.dtype(h.dtype).newbyteorder(h.order)
    rows = min(h.block[0], len(raw) // (dtype.itemsize * h.block[1]))
    data = np.frombuffer(raw, dtype, rows * h.block[1]).reshape(rows, h.block[1])
    if h.predictor == 2:
        if h.dtype.startswith("float"):
            raise ValueError("a horizontal predictor on floats is not supported")
        data = np.cumsum(data, axis=1, dtype=np.dtype(h.dtype))
    return row, col, data[: h.height - row, : h.width - col].astype(float)


def meta_row(path: str | Path, raster_id: str | None = None) -> dict:
    """The row of ``raster_meta`` for a file."""
    h = read_header(path)
    return {"raster_id": raster_id or Path(path).stem, "crs": h.crs, "width": h.width, "height": h.height, **dict(zip("abcdef", h.transform, strict=True)), "nodata": h.nodata, "dtype": h.dtype, "band_count": h.band_count}


class _Block(InputPartition):
    def __init__(self, path: str, raster_id: str, number: int) -> None:
        self.path, self.raster_id, self.number = path, raster_id, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.raster_id = options["path"], options.get("rasterId", Path(options["path"]).stem)

    def partitions(self) -> list[InputPartition]:
        return [_Block(self.path, self.raster_id, i) for i in range(len(read_header(self.path).offsets))]

    def read(self, partition: _Block) -> Iterator[tuple]:
        h = read_header(partition.path)
        if h.band_count != 1:
            raise ValueError(f"{Path(partition.path).name} has {h.band_count} bands")
        row, col, data = read_block(partition.path, h, partition.number)
        valid = np.isfinite(data) & (data != h.nodata if h.nodata is not None else True)
        for r, c in zip(*np.nonzero(valid), strict=True):
            yield partition.raster_id, int(row + r), int(col + c), float(data[r, c])


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").option("rasterId", ...).load(path)``: the
    cells with data, one partition for each strip or tile."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def write_geotiff(path: str | Path, data: np.ndarray, transform: tuple[float, ...], epsg: int = 4326, nodata: float | None = None, tile: int | None = None, deflate: bool = False) -> None:
    """A small single-band file, for tests and exports."""
    data = np.asarray(data)
    height, width = data.shape
    blocks = []
    if tile:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                part = np.zeros((tile, tile), data.dtype)
                cut = data[r : r + tile, c : c + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                blocks.append(part.tobytes())
    else:
        blocks.append(np.ascontiguousarray(data).tobytes())
    if deflate:
        blocks = [zlib.compress(b) for b in blocks]
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    a, b, c, d, e, f = transform
    fields: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (data.dtype.itemsize * 8,)), (COMPRESSION, "H", (8 if deflate else 1,)), (262, "H", (1,)), (BANDS, "H", (1,)),
        (FORMAT, "H", (kind,)), (TRANSFORM, "d", (a, b, 0.0, c, d, e, 0.0, f, 0, 0, 0, 0, 0, 0, 0, 1.0)), (GEO_KEYS, "H", (1, 1, 0, 1, 2048, 0, 1, epsg)),
    ]
    fields += [(TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,))] if tile else [(ROWS, "I", (height,))]
    names = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
    fields += [(names[0], "I", tuple([0] * len(blocks))), (names[1], "I", tuple(len(x) for x in blocks))]
    if nodata is not None:
        fields.append((NODATA, "s", (f"{nodata:g}".encode() + b"\0",)))
    fields.sort(key=lambda x: x[0])
    at = 8 + 2 + 12 * len(fields) + 4
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}

    def packed(kind: str, values: tuple) -> bytes:
        return values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)

    sizes = [len(packed(k, v)) for _, k, v in fields]
    data_at = at + sum(s for s in sizes if s > 4)
    offsets, here = [], data_at
    for x in blocks:
        offsets.append(here)
        here += len(x)
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, k, v in fields:
        v = tuple(offsets) if tag == names[0] else v
        raw = packed(k, v)
        n = len(raw) if k == "s" else len(v)
        if len(raw) > 4:
            head += struct.pack("<HHII", tag, codes[k], n, at + len(extra))
            extra += raw
        else:
            head += struct.pack("<HHI", tag, codes[k], n) + raw.ljust(4, b"\0")
    Path(path).write_bytes(head + struct.pack("<I", 0) + extra + b"".join(blocks))

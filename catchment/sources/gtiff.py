"""GeoTIFF in and out: files are read by Spark's binaryFile source and decoded in the tasks; tiles are encoded as one small file each.

Supported: classic and BigTIFF files of either byte order; strips or tiles; one or several bands, chunky or planar; whole numbers and
floats; no compression, LZW or deflate; predictors 1 to 3; a mask and overviews as further images; north-up grids. A file
with anything else raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta

NODATA = -9999.0
# fixed values: TIFF field types and their sizes, TIFF and GeoTIFF tags
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_NODATA = 33550, 33922, 34735, 42113
NONE, LZW, DEFLATE = 1, 5, 8
_CLEAR, _END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; the width grows one code early."""
    table: list[bytes] = []
    out, width, last = [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    def begin() -> None:
        nonlocal table, width
        put(_CLEAR)
        table, width = {bytes([i]): i for i in range(256)}, 9

    begin()
    now, size = b"", 258
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = size
        size += 1
        if size >= 1 << width:
            width += 1
        if size >= 4095:
            width = min(width, 12)
            begin()
            size = 258
        now = data[i : i + 1]
    if now:
        put(table[now])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """A block of rows x columns, little-endian."""
    if predictor == 2:
        whole = block.view(f"<u{block.itemsize}").copy()
        whole[:, 1:] -= block.view(whole.dtype)[:, :-1]
        raw = whole.tobytes()
    elif predictor == 3:
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(*block.shape, -1).transpose(0, 2, 1).reshape(len(block), -1)
        raw = np.diff(planes, axis=1, prepend=np.zeros((len(block), 1), np.uint8)).astype(np.uint8).tobytes()
    else:
        raw = block.tobytes()
    return zlib.compress(raw) if compression == DEFLATE else lzw_encode(raw) if compression == LZW else raw


def _unpacked(data: bytes, compression: int, predictor: int, dtype: np.dtype, rows: int, cols: int, bands: int) -> np.ndarray:
    """rows x cols x bands of a block."""
    raw = zlib.decompress(data) if compression in (DEFLATE, 32946) else lzw_decode(data) if compression == LZW else data
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * bands * dtype.itemsize).reshape(rows, -1, bands), axis=1, dtype=np.uint8)
        order = planes.reshape(rows, dtype.itemsize, cols * bands).transpose(0, 2, 1)
        return np.ascontiguousarray(order).view(dtype.newbyteorder(">")).reshape(rows, cols, bands)
    block = np.frombuffer(raw, dtype, rows * cols * bands).reshape(rows, cols, bands)
    if predictor == 2:
        whole = dtype.newbyteorder("=").str.replace("f", "u").replace("i", "u")
        return np.cumsum(block.astype(dtype.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(dtype.newbyteorder("="))
    return block


def encode(values: np.ndarray, meta: GridMeta, nodata: float = NODATA, compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, mask: bool = False, overviews: tuple[int, ...] = ()) -> bytes:
    """A float32 GeoTIFF of one band.

    NaN becomes the sentinel; with ``mask`` it also goes into a mask image. ``tile``: edge of square tiles, otherwise
    strips. ``overviews``: factors of further images of averages over valid cells.
    """
    meta.require_north_up()
    epsg = int(meta.crs.rpartition(":")[2])
    geo = [
        (PIXEL_SCALE, 12, [meta.a, -meta.e, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, meta.c, meta.f, 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]), (GDAL_NODATA, 2, [f"{nodata:g}".encode() + b"\0"]),
    ]
    images = [(values, 0, 32, predictor)]
    for k in overviews:
        h, w = -(-values.shape[0] // k), -(-values.shape[1] // k)
        wide = np.full((h * k, w * k), np.nan)
        wide[: values.shape[0], : values.shape[1]] = values
        cells = wide.reshape(h, k, w, k)
        n = (~np.isnan(cells)).sum((1, 3))
        images.append((np.where(n > 0, np.nansum(cells, (1, 3)) / np.maximum(n, 1), np.nan), 1, 32, predictor))
    if mask:
        images += [((~np.isnan(v)) * 255, kind | 4, 8, 1) for v, kind, _, _ in list(images)]
    out, last = b"II*\0\0\0\0\0", 4
    for i, (v, kind, bits, pred) in enumerate(images):
        h, w = v.shape
        data = np.where(np.isnan(v), nodata, v).astype("<f4") if bits == 32 else v.astype(np.uint8)
        rows, cols = (tile, tile) if tile else (h, w)
        blocks = []
        for r in range(0, h, rows):
            for c in range(0, w, cols):
                block = data[r : r + rows, c : c + cols]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])), mode="edge")
                blocks.append(_packed(np.ascontiguousarray(block), compression, pred))
        at = len(out) + np.cumsum([0, *map(len, blocks)])
        out += b"".join(blocks)
        out += b"\0" * (len(out) % 2)
        place = [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, at[:-1].tolist()), (TILE_BYTES, 4, [len(b) for b in blocks])] if tile else [(OFFSETS, 4, at[:-1].tolist()), (STRIP_ROWS, 4, [h]), (STRIP_BYTES, 4, [len(b) for b in blocks])]
        tags = [(SUBFILE, 4, [kind]), (WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [bits]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [4 if kind & 4 else 1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [pred]), (FORMAT, 3, [3 if bits == 32 else 1])]
        tags = sorted(tags + place + (geo if i == 0 else geo[-1:] if bits == 32 else []))
        start = len(out)
        rest = start + 2 + 12 * len(tags) + 4
        entries, extra = b"", b""
        for tag, code, x in tags:
            body = x[0] if code == 2 else struct.pack(f"<{len(x)}{_TYPES[code][0]}", *x)
            count = len(body) if code == 2 else len(x)
            if len(body) > 4:
                field = struct.pack("<I", rest + len(extra))
                extra += body + b"\0" * (len(body) % 2)
            else:
                field = body.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, code, count) + field
        out = out[:last] + struct.pack("<I", start) + out[last + 4 :] + struct.pack("<H", len(tags)) + entries
        last = len(out)
        out += b"\0\0\0\0" + extra
    return out


Fetch = Callable[[int, int], bytes]


def images(fetch: Fetch) -> list[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image of a file; ``fetch(at, n)`` gives n bytes of it. Both classic and BigTIFF."""
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or len(head) < 8:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack_from(f"{order}H", head, 2)
    if version == 42:
        word, count, entry, (at,) = "I", "H", 12, struct.unpack_from(f"{order}I", head, 4)
    elif version == 43 and len(head) == 16:
        word, count, entry, (at,) = "Q", "Q", 20, struct.unpack_from(f"{order}Q", head, 8)
    else:
        raise ValueError("not a TIFF file")
    room = struct.calcsize(word)
    found = []
    while at:
        first = struct.calcsize(count)
        (n,) = struct.unpack(f"{order}{count}", fetch(at, first))
        body = fetch(at + first, n * entry + room)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, size = struct.unpack_from(f"{order}HH{word}", body, entry * k)
            if kind not in _TYPES:
                continue
            code, each = _TYPES[kind]
            value = body[entry * (k + 1) - room : entry * (k + 1)]
            if each * size > room:
                value = fetch(struct.unpack(f"{order}{word}", value)[0], each * size)
            tags[tag] = struct.unpack_from(f"{order}{size}{code}", value)
        found.append((order, tags))
        (at,) = struct.unpack_from(f"{order}{word}", body, n * entry)
    return found


@dataclass(frozen=True)
class Image:
    """How an image of a file is laid out, in blocks that are strips or tiles."""

    height: int
    width: int
    rows: int
    cols: int
    tiled: bool
    dtype: str
    compression: int
    predictor: int
    bands: int
    apart: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, order: str, tags: dict[int, tuple]) -> Image:
        one = lambda tag, default: tags.get(tag, (default,))[0]
        compression, predictor, bands, bits = one(COMPRESSION, 1), one(PREDICTOR, 1), one(SAMPLES, 1), one(BITS, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        if compression not in (NONE, LZW, DEFLATE, 32946) or predictor not in (1, 2, 3) or bits not in (8, 16, 32, 64) or kind is None or len(set(tags.get(BITS, (1,)))) > 1:
            raise ValueError("unsupported TIFF layout")
        h, w, tiled = one(LENGTH, 0), one(WIDTH, 0), TILE_OFFSETS in tags
        rows, cols = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, h), h), w)
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[OFFSETS], tags[STRIP_BYTES])
        return cls(h, w, rows, cols, tiled, f"{order}{kind}{bits // 8}", compression, predictor, bands, one(PLANAR, 1) == 2, offsets, sizes)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.rows), -(-self.width // self.cols)

    def place(self, k: int) -> tuple[int, int]:
        """Row and column of the first cell of block k."""
        return k // self.grid[1] * self.rows, k % self.grid[1] * self.cols

    def number(self, k: int, band: int) -> int:
        """Where the file's lists have block k of a band."""
        if not 1 <= band <= self.bands:
            raise ValueError("unsupported TIFF layout")
        return k + (band - 1) * self.grid[0] * self.grid[1] if self.apart else k

    def block(self, fetch: Fetch, k: int, band: int = 1) -> np.ndarray | None:
        """The cells of block k within the image; None of one that the file leaves out."""
        r, c = self.place(k)
        i = self.number(k, band)
        if not self.sizes[i]:
            return None
        height = self.rows if self.tiled else min(self.rows, self.height - r)
        cells = _unpacked(fetch(self.offsets[i], self.sizes[i]), self.compression, self.predictor, np.dtype(self.dtype), height, self.cols, 1 if self.apart else self.bands)
        return cells[: self.height - r, : self.width - c, 0 if self.apart else band - 1]

    def values(self, fetch: Fetch, band: int = 1) -> np.ndarray:
        out = np.full((self.height, self.width), np.nan)
        for k in range(self.grid[0] * self.grid[1]):
            cells = self.block(fetch, k, band)
            if cells is not None:
                r, c = self.place(k)
                out[r : r + cells.shape[0], c : c + cells.shape[1]] = cells
        return out


def georeference(tags: dict[int, tuple]) -> tuple[GridMeta, float | None]:
    """(grid, sentinel) of a file's first image."""
    sx, sy = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE_POINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (2048, 3072)), 4326)
    text = tags[GDAL_NODATA][0].rstrip(b"\0 ").decode() if GDAL_NODATA in tags else ""
    return GridMeta(tags[LENGTH][0], tags[WIDTH][0], sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy, f"EPSG:{epsg}"), float(text) if text else None


def is_mask(tags: dict[int, tuple], of: dict[int, tuple]) -> bool:
    """Whether an image is the mask of the image with tags ``of``."""
    kind = of.get(SUBFILE, (0,))[0]
    return tags.get(SUBFILE, (0,))[0] & 7 == kind & 1 | 4 and (tags[LENGTH], tags[WIDTH]) == (of[LENGTH], of[WIDTH])


def hidden(values: np.ndarray, nodata: float | None) -> np.ndarray:
    """Cells that are no number, or near the sentinel."""
    bad = ~np.isfinite(values)
    if nodata is not None and nodata == nodata:
        bad |= np.isclose(values, nodata)
    return bad


def decode(blob: bytes, band: int = 1) -> tuple[np.ndarray, GridMeta, float | None]:
    """(values of a band as float64, NaN where the file's mask says so; georeference; sentinel)."""
    fetch = lambda at, n: blob[at : at + n]
    every = images(fetch)
    order, tags = every[0]
    values = Image.of(order, tags).values(fetch, band)
    for o, t in every[1:]:
        if is_mask(t, tags):
            values[Image.of(o, t).values(fetch) == 0] = np.nan
    return values, *georeference(tags)


def read(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """path, r, c, z of a band of one or many files; values near the sentinel are NULL."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                values, meta, nodata = decode(blob, band)
                bad = hidden(values, nodata)
                for r0 in range(0, meta.height, 256):
                    part, hide = values[r0 : r0 + 256], bad[r0 : r0 + 256]
                    h = len(part)
                    z = pa.array(part.ravel(), mask=hide.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * z.__len__()), pa.array(np.repeat(np.arange(r0, r0 + h, dtype=np.int32), meta.width)), pa.array(np.tile(np.arange(meta.width, dtype=np.int32), h)), z], names=["path", "r", "c", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, r int, c int, z double")


def tiles(cells: DataFrame, meta: GridMeta, size: int = 256, nodata: float = NODATA, **layout) -> DataFrame:
    """tr, tc, content: each tile of r, c, z as a GeoTIFF of its own, placed by its georeference; ``layout``: see ``encode``."""

    def build(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        tr, tc = int(r[0]) // size, int(c[0]) // size
        h, w = min(size, meta.height - tr * size), min(size, meta.width - tc * size)
        a = np.full((h, w), np.nan)
        a[r - tr * size, c - tc * size] = [np.nan if x is None else x for x in table.column("z").to_pylist()]
        at = GridMeta(h, w, meta.a, 0.0, meta.c + meta.a * tc * size, 0.0, meta.e, meta.f + meta.e * tr * size, meta.crs)
        return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "content": [encode(a, at, nodata, **layout)]})

    keyed = cells.select("r", "c", "z", (F.col("r") / size).cast("int").alias("tr"), (F.col("c") / size).cast("int").alias("tc"))
    return keyed.groupBy("tr", "tc").applyInArrow(build, "tr int, tc int, content binary")


def save(cells: DataFrame, meta: GridMeta, folder: str, name: str, size: int = 4096, **layout) -> list[str]:
    """Writes the tiles of r, c, z as files name_row_column.tif into a folder that the executors reach by pyarrow; their paths, from the tasks that wrote them."""

    def put(batches):
        for b in batches:
            for tr, tc, content in zip(*(b.column(n).to_pylist() for n in ("tr", "tc", "content"))):
                path = f"{folder}/{name}_{tr}_{tc}.tif"
                store, at = store_of(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as stream:
                    stream.write(content)
                yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r.path for r in tiles(cells, meta, size, **layout).mapInArrow(put, "path string").collect())


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that pyarrow opens for a path (local, hdfs, s3, gs and the like), and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)

"""GeoTIFF as a data source: one file of any size is read and written by many tasks.

Reading: partitions are runs of the file's own blocks, planned from its header; a task reads the byte ranges of its
blocks. Options: ``path`` (a file, or a folder of .tif files), ``band``, ``level`` (0 the full image, 1 the first overview and so on),
``columns`` (of path, r, c, z), ``grid`` (a, c, e, f and system of a grid on which files are placed) and a window of cells ``r0, r1, c0, c1`` (ends excluded), of which alone the blocks are read. Comparisons of r and c
with numbers narrow the window too in a session with spark.sql.python.filterPushdown.enabled (option ``pushdown``).

Writing: tasks encode and write blocks, and tell the driver their sizes; the driver lays them out by prefix sums and writes the header; tasks then
copy their blocks to their places in the file. Overviews are made level by level over the whole grid, so no tile's edge shows in them.

Files are opened by pyarrow: local or shared folders, hdfs, s3, gs. For other stores ``gtiff.read`` goes through Spark's own reader.
"""

from __future__ import annotations

import functools
import json
import pickle
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..checkpoints import materialize, release
from ..grid import GridMeta
from . import gtiff
from .gtiff import Image

#: Compressed bytes, and blocks, of a reading task.
PART_BYTES, PART_BLOCKS = 8 << 20, 256
#: Bytes of a file's start that are read at once for its header, and of a copy step.
HEAD_BYTES, COPY_BYTES = 1 << 16, 8 << 20
COLUMNS = {"path": "string", "r": "int", "c": "int", "z": "double"}
#: A file whose blocks have more bytes is written as BigTIFF.
CLASSIC_BYTES = 3_900_000_000


def fetcher(path: str) -> gtiff.Fetch:
    """Range reads of a file; its start is kept."""
    store, at = gtiff.store_of(path)
    f = store.open_input_file(at)
    head = f.read(HEAD_BYTES)

    def fetch(start: int, n: int) -> bytes:
        if start + n <= len(head):
            return head[start : start + n]
        f.seek(start)
        return f.read(n)

    return fetch


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file's image, with the blocks of its mask that lie over them."""

    path: str
    image: Image
    mask: Image | None
    band: int
    nodata: float | None
    blocks: list[int]
    window: tuple[int, int, int, int]
    shift: tuple[int, int] = (0, 0)


def image_of(fetch: gtiff.Fetch, level: int) -> tuple[Image, Image | None, float | None, GridMeta]:
    """(image, mask, sentinel, georeference of the full image) of a level of a file."""
    every = gtiff.images(fetch)
    first = every[0][1]
    shown = [(o, t) for o, t in every if t.get(gtiff.SUBFILE, (0,))[0] & 4 == 0]
    if not 0 <= level < len(shown):
        raise ValueError(f"the file has {len(shown)} levels")
    order, tags = shown[level]
    mask = next((Image.of(o, t) for o, t in every if gtiff.is_mask(t, tags)), None)
    meta, nodata = gtiff.georeference(first)
    return Image.of(order, tags), mask, nodata, meta


def offset_in(meta: GridMeta, grid: list, level: int = 0) -> tuple[int, int]:
    """Rows and columns by which a file lies within a grid (a, c, e, f, crs) of the same steps; another grid raises."""
    a, c, e, f, crs = grid
    down, right = (meta.f - f) / e / 2**level, (meta.c - c) / a / 2**level
    if meta.crs != crs or abs(meta.a / a - 1) > 1e-9 or abs(meta.e / e - 1) > 1e-9 or abs(down - round(down)) > 1e-3 or abs(right - round(right)) > 1e-3:
        raise ValueError("the file is not on the grid")
    return round(down), round(right)


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.band, self.level = options["path"], int(options.get("band", 1)), int(options.get("level", 0))
        self.columns = columns_of(options)
        self.grid = json.loads(options["grid"]) if options.get("grid") else None
        self.window = [int(options.get("r0", 0)), int(options.get("r1", 1 << 31)), int(options.get("c0", 0)), int(options.get("c1", 1 << 31))]

    def files(self) -> list[str]:
        store, at = gtiff.store_of(self.path)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return [self.path]
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.extension.lower() in ("tif", "tiff"))
        return [f"{self.path.rstrip('/')}/{n}" for n in names]

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.files():
            image, mask, nodata, meta = image_of(fetcher(path), self.level)
            down, right = offset_in(meta, self.grid, self.level) if self.grid else (0, 0)
            r0, r1, c0, c1 = max(0, self.window[0] - down), min(image.height, self.window[1] - down), max(0, self.window[2] - right), min(image.width, self.window[3] - right)
            if r0 >= r1 or c0 >= c1:
                continue
            across = image.grid[1]
            wanted = [r * across + c for r in range(r0 // image.rows, -(-r1 // image.rows)) for c in range(c0 // image.cols, -(-c1 // image.cols))]
            held, total = [], 0
            for k in wanted:
                size = image.sizes[image.number(k, self.band)]
                if held and (total + size > PART_BYTES or len(held) == PART_BLOCKS):
                    out.append((path, image, mask, nodata, held, (r0, r1, c0, c1), (down, right)))
                    held, total = [], 0
                held.append(k)
                total += size
            out.append((path, image, mask, nodata, held, (r0, r1, c0, c1), (down, right)))
        return [Blocks(p, _slim(i, [i.number(k, self.band) for k in b]), m, self.band, n, b, w, o) for p, i, m, n, b, w, o in out]

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no blocks in the window
            return
        fetch, image = fetcher(partition.path), partition.image
        masks = functools.lru_cache(4)(lambda k: partition.mask.block(fetch, k))
        r0, r1, c0, c1 = partition.window
        for k in partition.blocks:
            top, left = image.place(k)
            cells = image.block(fetch, k, partition.band)
            if cells is None:
                cells = np.full((min(image.rows, image.height - top), min(image.cols, image.width - left)), np.nan)
            cells = cells.astype(float)
            if partition.mask:
                _hide(cells, top, left, partition.mask, masks)
            rows, cols = np.arange(max(top, r0), min(top + cells.shape[0], r1)), np.arange(max(left, c0), min(left + cells.shape[1], c1))
            cells = cells[rows[0] - top : rows[-1] - top + 1, cols[0] - left : cols[-1] - left + 1]
            made = {
                "path": lambda: pa.array([partition.path] * cells.size, pa.string()), "r": lambda: pa.array(np.repeat(rows + partition.shift[0], len(cols)), pa.int32()), "c": lambda: pa.array(np.tile(cols + partition.shift[1], len(rows)), pa.int32()),
                "z": lambda: pa.array(cells.ravel(), mask=gtiff.hidden(cells, partition.nodata).ravel()),
            }
            yield pa.RecordBatch.from_arrays([made[n]() for n in self.columns], names=self.columns)


class NarrowingReader(GeoTiffReader):
    """For sessions that push filters down; Spark refuses such a reader elsewhere."""

    def pushFilters(self, filters):
        """Narrows the window; Spark still applies each filter to the rows."""
        for f in filters:
            at = {("r",): 0, ("c",): 2}.get(getattr(f, "attribute", None))
            if at is not None and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.window[at] = max(self.window[at], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.window[at + 1] = min(self.window[at + 1], f.value + (not isinstance(f, LessThan)))
            yield f


def _slim(image: Image, numbers: list[int]) -> Image:
    """The image with the places of some blocks only, so that a task carries no more."""
    spots = dict(zip(numbers, ((image.offsets[i], image.sizes[i]) for i in numbers)))
    return Image(**{n: getattr(image, n) for n in image.__dataclass_fields__} | {"offsets": {i: s[0] for i, s in spots.items()}, "sizes": {i: s[1] for i, s in spots.items()}})


def _hide(cells: np.ndarray, top: int, left: int, mask: Image, blocks) -> None:
    """Sets cells to NaN where the mask, whose blocks may lie otherwise, is 0."""
    for br in range(top // mask.rows, -(-(top + cells.shape[0]) // mask.rows)):
        for bc in range(left // mask.cols, -(-(left + cells.shape[1]) // mask.cols)):
            seen = blocks(br * mask.grid[1] + bc)
            if seen is None:
                continue
            r, c = br * mask.rows, bc * mask.cols
            r0, r1, c0, c1 = max(top, r), min(top + cells.shape[0], r + seen.shape[0]), max(left, c), min(left + cells.shape[1], c + seen.shape[1])
            part = cells[r0 - top : r1 - top, c0 - left : c1 - left]
            part[seen[r0 - r : r1 - r, c0 - c : c1 - c] == 0] = np.nan


def columns_of(options) -> list[str]:
    names = [n.strip() for n in options.get("columns", "path,r,c,z").split(",")]
    if not names or set(names) - set(COLUMNS):
        raise ValueError(f"columns are {', '.join(COLUMNS)}")
    return names


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    level: list[int]
    block: list[int]
    size: list[int]


class GeoTiffWriter(DataSourceArrowWriter):
    """Blocks (level, block, data) go to a part of their own for each task; ``commit`` lays out the file and leaves a plan."""

    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"], json.loads(options["layout"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written(None, [], [], [])
        store, at = gtiff.store_of(parts_of(self.path))
        out = None
        for b in iterator:
            for level, block, data in zip(*(b.column(n).to_pylist() for n in ("level", "block", "data"))):
                if out is None:
                    done.part = uuid.uuid4().hex
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{done.part}")
                out.write(data)
                done.level.append(level)
                done.block.append(block)
                done.size.append(len(data))
        if out:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None and m.part]
        total = sum(sum(m.size) for m in told)
        big = self.layout["big"] or total > CLASSIC_BYTES
        shapes = [tuple(s) for s in self.layout["shapes"]]
        counts = [-(-h // self.layout["tile"]) * -(-w // self.layout["tile"]) for h, w in shapes]
        empty = [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for n in counts]
        base = len(header(self.layout, empty, big))
        plan = []
        for m in told:
            at = base + np.cumsum([0, *m.size])
            for level, block, start, size in zip(m.level, m.block, at.tolist(), m.size):
                empty[level][0][block], empty[level][1][block] = start, size
            plan.append((m.part, base, int(at[-1]) - base))
            base = int(at[-1])
        store, at = gtiff.store_of(parts_of(self.path))
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/plan") as f:
            f.write(pickle.dumps({"head": header(self.layout, empty, big), "parts": plan, "size": base}))

    def abort(self, messages: list[Written | None]) -> None:
        store, at = gtiff.store_of(parts_of(self.path))
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


def parts_of(path: str) -> str:
    return f"{path}.parts"


class GeoTiffSource(DataSource):
    """spark.dataSource.register(GeoTiffSource), then spark.read.format("gtiff")."""

    @classmethod
    def name(cls) -> str:
        return "gtiff"

    def schema(self) -> str:
        return ", ".join(f"{n} {COLUMNS[n]}" for n in columns_of(self.options))

    def reader(self, schema) -> GeoTiffReader:
        return (NarrowingReader if self.options.get("pushdown") == "true" else GeoTiffReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options))


def header(layout: dict, levels: list[tuple[np.ndarray, np.ndarray]], big: bool) -> bytes:
    """All directories of a tiled file with one float32 image for each level, at its start; levels: offsets and sizes of their blocks."""
    word, count = ("Q", "Q") if big else ("I", "H")
    room, places = struct.calcsize(word), 16 if big else 4
    epsg = int(layout["crs"].rpartition(":")[2])
    geographic = epsg == 4326
    nodata = f"{layout['nodata']:g}".encode() + b"\0"
    out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    for k, ((h, w), (offsets, sizes)) in enumerate(zip(layout["shapes"], levels)):
        tags = [
            (gtiff.SUBFILE, 4, [int(k > 0)]), (gtiff.WIDTH, 4, [w]), (gtiff.LENGTH, 4, [h]), (gtiff.BITS, 3, [32]), (gtiff.COMPRESSION, 3, [layout["compression"]]), (gtiff.PHOTOMETRIC, 3, [1]),
            (gtiff.SAMPLES, 3, [1]), (gtiff.PREDICTOR, 3, [layout["predictor"]]), (gtiff.TILE_WIDTH, 4, [layout["tile"]]), (gtiff.TILE_LENGTH, 4, [layout["tile"]]),
            (gtiff.TILE_OFFSETS, places, offsets.tolist()), (gtiff.TILE_BYTES, places, sizes.tolist()), (gtiff.FORMAT, 3, [3]),
        ]
        if k == 0:
            a, c, e, f = layout["place"]
            keys = [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg]
            tags += [(gtiff.PIXEL_SCALE, 12, [a, -e, 0.0]), (gtiff.TIE_POINT, 12, [0.0, 0.0, 0.0, c, f, 0.0]), (gtiff.GEO_KEYS, 3, keys)]
        tags.append((gtiff.GDAL_NODATA, 2, [nodata]))
        start = len(out) + struct.calcsize(count) + (4 + 2 * room) * len(tags) + room
        entries, extra = b"", b""
        for tag, kind, x in tags:
            body = x[0] if kind == 2 else struct.pack(f"<{len(x)}{gtiff._TYPES[kind][0]}", *x)
            size = len(body) if kind == 2 else len(x)
            if len(body) > room:
                value = struct.pack(f"<{word}", start + len(extra))
                extra += body + b"\0" * (-len(body) % 8)
            else:
                value = body.ljust(room, b"\0")
            entries += struct.pack(f"<HH{word}", tag, kind, size) + value
        after = (start + len(extra) + 7) // 8 * 8 if k + 1 < len(levels) else 0
        out += struct.pack(f"<{count}", len(tags)) + entries + struct.pack(f"<{word}", after) + extra
        out += b"\0" * (max(after, len(out)) - len(out))
    return out


def overviews(cells: DataFrame, levels: int) -> list[DataFrame]:
    """r, c, z of levels 1 to ``levels``: means of the valid cells under each cell, each level from sums and counts of the one below."""
    sums = cells.select("r", "c", F.col("z").alias("s"), F.col("z").isNotNull().cast("long").alias("n"))
    out = []
    for _ in range(levels):
        half = lambda n: (F.col(n) / 2).cast("int").alias(n)
        sums = materialize(sums.groupBy(half("r"), half("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        out.append(sums)
    return out


def write(cells: DataFrame, meta: GridMeta, path: str, tile: int = 512, levels: int = 0, nodata: float = gtiff.NODATA, compression: int = gtiff.DEFLATE, predictor: int = 1, big: bool = False) -> None:
    """Writes r, c, z (NULL: the sentinel) as one tiled float32 file with ``levels`` overviews; a block without rows is left out of the file.

    No cell passes the driver: it gets the blocks' sizes and writes the header.
    """
    meta.require_north_up()
    if tile < 16 or tile % 16:
        raise ValueError("tiles have a multiple of 16 cells along an edge")
    spark = cells.sparkSession
    spark.dataSource.register(GeoTiffSource)
    shapes = [(-(-meta.height // 2**k), -(-meta.width // 2**k)) for k in range(levels + 1)]

    def encoded(level: int):
        across = -(-shapes[level][1] // tile)

        def encode(table: pa.Table) -> pa.Table:
            r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
            block = np.full((tile, tile), nodata, "<f4")
            z = table.column("z").to_numpy()
            block[r % tile, c % tile] = np.where(np.isnan(z), nodata, z)
            number = int(r[0]) // tile * across + int(c[0]) // tile
            return pa.table({"level": pa.array([level], pa.int32()), "block": pa.array([number], pa.int64()), "data": pa.array([gtiff._packed(block, compression, predictor)], pa.binary())})

        return encode

    coarser = overviews(cells, levels)
    means = [s.select("r", "c", (F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias("z")) for s in coarser]
    blocks = None
    for k, level in enumerate([cells.select("r", "c", F.col("z").cast("double").alias("z")), *means]):
        keyed = level.groupBy((F.col("r") / tile).cast("int").alias("tr"), (F.col("c") / tile).cast("int").alias("tc"))
        made = keyed.applyInArrow(encoded(k), "level int, block long, data binary")
        blocks = made if blocks is None else blocks.unionByName(made)
    layout = {"shapes": shapes, "tile": tile, "nodata": nodata, "compression": compression, "predictor": predictor, "big": big, "crs": meta.crs, "place": [meta.a, meta.c, meta.e, meta.f]}
    GeoTiffWriter({"path": path, "layout": "{}"}).abort([])  # what a broken run left
    blocks.write.format("gtiff").mode("append").option("path", path).option("layout", json.dumps(layout)).save()
    release(*coarser)
    _assemble(spark, path)


def _assemble(spark: SparkSession, path: str) -> None:
    """Copies each part to its place: in a folder by one task for each part, in an object store, where a file has one writer, by one task for all."""
    store, at = gtiff.store_of(parts_of(path))
    with store.open_input_file(f"{at}/plan") as f:
        plan = pickle.loads(f.read())
    target, to = gtiff.store_of(path)
    in_place = isinstance(target, fs.LocalFileSystem)
    if in_place:
        with open(to, "wb") as f:
            f.write(plan["head"])
            f.truncate(plan["size"])

    def pieces(part: str) -> Iterator[bytes]:
        with store.open_input_file(f"{at}/{part}") as f:
            while piece := f.read(COPY_BYTES):
                yield piece

    def copy(batches):
        for b in batches:
            for part, start in zip(b.column("part").to_pylist(), b.column("start").to_pylist()):
                with open(to, "r+b") as out:
                    out.seek(start)
                    for piece in pieces(part):
                        out.write(piece)
                yield pa.RecordBatch.from_pydict({"part": [part]})

    def stream(batches):
        with target.open_output_stream(to) as out:
            out.write(plan["head"])
            for b in batches:
                for part in b.column("part").to_pylist():
                    for piece in pieces(part):
                        out.write(piece)
        yield pa.RecordBatch.from_pydict({"part": [to]})

    parts = spark.createDataFrame([x[:2] for x in plan["parts"]], "part string, start long")
    if in_place:
        parts.repartition(max(1, len(plan["parts"]))).mapInArrow(copy, "part string").count()
    else:
        parts.repartition(1).sortWithinPartitions("start").mapInArrow(stream, "part string").count()
    store.delete_dir(at)


def read(spark: SparkSession, path: str, band: int = 1, level: int = 0, window: tuple[int, int, int, int] | None = None, columns: str = "r,c,z", grid: GridMeta | None = None) -> DataFrame:
    """Cells of a band of a file, or of all .tif files of a folder; ``window``: rows and columns r0, r1, c0, c1, ends excluded.

    With ``grid`` each file is placed on that grid by its georeference, so that a folder of tiles reads as one raster.
    """
    spark.dataSource.register(GeoTiffSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": path, "band": band, "level": level, "columns": columns, "pushdown": pushdown} | dict(zip(("r0", "r1", "c0", "c1"), window or ()))
    if grid is not None:
        options["grid"] = json.dumps([grid.a, grid.c, grid.e, grid.f, grid.crs])
    return spark.read.format("gtiff").options(**options).load()


def meta_of(path: str) -> GridMeta:
    return image_of(fetcher(path), 0)[3]

"""Rasters kept in folders: cells by blocks, of which a window reads its own, and layers that join without a shuffle."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..grid import GridMeta
from ..operators.regrid import crop_window

#: Edge of a block in cells: some 16 million of them, a few hundred megabytes.
BLOCK = 4096
#: From so many folders on, small blocks share them, in squares of at most BLOCK cells along an edge.
FOLDERS = 128
#: Cells of a layer for each of its buckets.
BUCKET_CELLS = 4_000_000


def z_order(r: Column, c: Column) -> Column:
    """The place of a cell on the Z-curve: bits of row and column by turns, for numbers below 65536."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    return F.shiftleft(spread(r.cast("long")), 1).bitwiseOR(spread(c.cast("long")))


def _shelf(cells: DataFrame, block: int) -> int:
    """Edge in cells of the squares that have a folder each: a block's, doubled while there would be more than FOLDERS of them."""
    ends = cells.agg(*[f(F.floor(F.col(n) / block)).alias(f"{n}_{k}") for n in ("r", "c") for k, f in (("low", F.min), ("high", F.max))]).first()
    shelf, spans = block, [(ends.r_low, ends.r_high), (ends.c_low, ends.c_high)]
    if ends.r_low is None:
        return shelf
    many = lambda k: (spans[0][1] // k - spans[0][0] // k + 1) * (spans[1][1] // k - spans[1][0] // k + 1)
    while shelf * 2 <= BLOCK and many(shelf // block) > FOLDERS:
        shelf *= 2
    return shelf


def write_cells(cells: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes cells (r, c and values) under ``path``: a folder for each block of cells, in which they follow the Z-curve, and a table of the blocks' bounds.

    Of small blocks a square of some has one folder (br and bc count those), so that files do not multiply. A folder is one task's at most; a file's parts
    then cover small squares, so that filters on r and c skip them too.
    """
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has between 1 and 65536 cells along an edge")
    shelf = _shelf(cells, block)
    spot = {"br": (F.col("r") / shelf).cast("int"), "bc": (F.col("c") / shelf).cast("int")}
    placed = cells.withColumns(spot | {"_z": z_order(F.col("r") % shelf, F.col("c") % shelf)})
    placed.repartition("br", "bc").sortWithinPartitions("br", "bc", "_z").drop("_z").write.partitionBy("br", "bc").parquet(f"{path}/cells")
    stored = cells.sparkSession.read.parquet(f"{path}/cells")
    limits = [f(n).alias(f"{n}_{k}") for n in ("r", "c") for k, f in (("low", F.min), ("high", F.max))]
    of = [(F.col(n) / block).cast("int").alias(f"b{n}") for n in ("r", "c")]
    held = stored.select("r", "c", *[F.col(f"b{n}").alias(f"s{n}") for n in ("r", "c")]).groupBy("sr", "sc", *of).agg(*limits, F.count("*").alias("n"))
    held.select("br", "bc", *[f"{n}_{k}" for n in ("r", "c") for k in ("low", "high")], "n", F.lit(block).alias("block"), F.lit(shelf).alias("shelf")).write.parquet(f"{path}/bounds")


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """br, bc, r_low, r_high, c_low, c_high, n, block: what each block holds."""
    return spark.read.parquet(f"{path}/bounds").drop("shelf")


def read_cells(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells under ``path``, or those of a window r0, r1, c0, c1 (ends excluded), for which the folders of other blocks are not opened."""
    cells = spark.read.parquet(f"{path}/cells")
    if window is None:
        return cells.drop("br", "bc")
    first = spark.read.parquet(f"{path}/bounds").select("shelf").first()
    shelf = first.shelf if first else BLOCK
    r0, r1, c0, c1 = window
    near = F.col("br").between(r0 // shelf, (r1 - 1) // shelf) & F.col("bc").between(c0 // shelf, (c1 - 1) // shelf)
    return cells.filter(near & F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).drop("br", "bc")


def read_region(spark: SparkSession, path: str, meta: GridMeta, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells under ``path`` that a rectangle in the grid's coordinates touches."""
    c, r, w, h = crop_window(meta, xmin, ymin, xmax, ymax)
    return read_cells(spark, path, (r, r + h, c, c + w))


class Layers:
    """Layers of one grid (r, c and a column each), kept in buckets of r and c: any of them join without a shuffle.

    Tables are made in the session's catalogue over files under ``path`` and dropped by ``close`` or at exit; the files stay unless the path is a scratch one.
    """

    def __init__(self, spark: SparkSession, meta: GridMeta, path: str | None = None):
        self.spark, self.meta, self.path = spark, meta, path or scratch(spark, ".layers")
        self.buckets = 1 + meta.height * meta.width // BUCKET_CELLS
        self.tables: dict[str, str] = {}
        atexit.register(self.close)

    def add(self, name: str, layer: DataFrame) -> None:
        """Keeps r, c and the column ``name`` of a layer."""
        table = f"layer_{name}_{uuid.uuid4().hex}"
        rows = layer.select("r", "c", name).repartition(self.buckets, "r", "c")
        rows.write.bucketBy(self.buckets, "r", "c").sortBy("r", "c").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table

    def get(self, *names: str) -> DataFrame:
        """r, c and the named layers, NULL where a layer has no cell that the first has."""
        first, *more = names
        out = self.spark.table(self.tables[first])
        for n in more:
            out = out.join(self.spark.table(self.tables[n]).hint("merge"), ["r", "c"], "left")
        return out

    def close(self) -> None:
        try:
            for table in self.tables.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone at exit
            return
        self.tables.clear()

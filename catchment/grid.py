"""The raster model: one row per cell (r, c, values), NoData as NULL; neighbours by window functions.

Neighbour windows need dense rows and columns (NoData cells present as rows); ``densify`` adds absent cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Direction codes 0..7 as (row step, column step): NE, E, SE, S, SW, W, NW, N.
DIRECTIONS = [(-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0)]
NO_DATA, NO_FLOW = -1, -2


@dataclass(frozen=True)
class GridMeta:
    """Affine georeference x = a*col + b*row + c, y = d*col + e*row + f, and the size in cells."""

    height: int
    width: int
    a: float = 1 / 3600
    b: float = 0.0
    c: float = 15.0
    d: float = 0.0
    e: float = -1 / 3600
    f: float = 50.0
    crs: str = "EPSG:4326"

    def require_north_up(self) -> None:
        if self.b or self.d:
            raise ValueError("rotated or sheared grids are not supported")

    def steps(self) -> tuple[float, float, float]:
        """Column, row and diagonal step in units of the CRS."""
        self.require_north_up()
        return abs(self.a), abs(self.e), math.hypot(self.a, self.e)


def normalise(cells: DataFrame, nodata: float | None = None, column: str = "z") -> DataFrame:
    """NaN, infinities and the sentinel become NULL."""
    z = F.col(column)
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if nodata is not None and not math.isnan(nodata):
        bad = bad | (z == nodata)
    return cells.withColumn(column, F.when(~bad, z))


def densify(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """All cells of the grid; those absent from ``cells`` have NULL values."""
    spark = cells.sparkSession
    every = spark.range(meta.height * meta.width).select((F.col("id") / meta.width).cast("int").alias("r"), (F.col("id") % meta.width).cast("int").alias("c"))
    return every.join(cells, ["r", "c"], "left")


def neighbours(cells: DataFrame, column: str = "z") -> DataFrame:
    """``cells`` with n0..n7: the column's value at each of the eight neighbours, NULL outside; two shuffles, no row multiplied."""
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    here = F.struct(F.col("c").alias("c"), F.col(column).alias("v"))
    side = lambda x, step: F.when(x["c"] == F.col("c") + step, x["v"])
    flat = cells.withColumn("_w", side(F.lag(here).over(row), -1)).withColumn("_e", side(F.lead(here).over(row), 1))
    line = F.struct(F.col("r").alias("r"), F.col("_w").alias("w"), F.col(column).alias("m"), F.col("_e").alias("e"))
    full = flat.withColumn("_up", F.lag(line).over(col)).withColumn("_dn", F.lead(line).over(col))
    up = lambda k: F.when(F.col("_up.r") == F.col("r") - 1, F.col(f"_up.{k}"))
    dn = lambda k: F.when(F.col("_dn.r") == F.col("r") + 1, F.col(f"_dn.{k}"))
    n = [up("e"), F.col("_e"), dn("e"), dn("m"), dn("w"), F.col("_w"), up("w"), up("m")]
    return full.select(*cells.columns, *[x.alias(f"n{k}") for k, x in enumerate(n)])


def is_edge(meta: GridMeta):
    return (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == meta.height - 1) | (F.col("c") == meta.width - 1)


#: Views of the test tables as grids: table, row, column, elevation, width.
VIEWS = {
    "dem_part": ("part", "p_partkey div 50", "p_partkey % 50", "double(p_size)", 50),
    "dem_orders": ("orders", "o_orderkey div 100", "o_orderkey % 100", "round(o_totalprice / 1000)", 100),
}


def view(spark: SparkSession, sf_dir: str, name: str, void: bool = False, tilted: bool = False) -> tuple[DataFrame, GridMeta]:
    """A test grid and its georeference; ``void`` punches NoData holes, ``tilted`` adds a slope."""
    if name == "dem_emb":
        emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        cells = emb.select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "v")).select("r", "c", F.round(F.col("v").cast("double") * 100).alias("z"))
        width = 64
    else:
        tab, r, c, z, width = VIEWS[name]
        cells = spark.read.parquet(f"{sf_dir}/{tab}.parquet").selectExpr(f"int({r}) AS r", f"int({c}) AS c", f"{z} AS z")
    if tilted:
        cells = cells.withColumn("z", 0.2 * F.col("z") + 0.5 * F.col("r"))
    if void:
        hole = (F.pmod(7 * F.col("r") + 13 * F.col("c"), F.lit(29)) == 0) | (F.col("r").between(10, 14) & F.col("c").between(10, 14))
        cells = cells.withColumn("z", F.when(~hole, F.col("z")))
    height = (cells.agg(F.max("r")).first()[0] or 0) + 1
    return cells, GridMeta(height, width)

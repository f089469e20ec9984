"""Elevation, pixel areas and their mask on one grid, from images that may lie on others."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import pixel_area
from ..functions.projection import epsg_of
from ..grid import GridMeta, densify, normalise
from ..sources.store import Layers
from . import regrid


@dataclass(frozen=True)
class Image:
    """Cells (r, c, z) on a grid; of overlapping images the highest priority shows."""

    cells: DataFrame
    meta: GridMeta
    priority: int


def reference(images: list[Image]) -> GridMeta:
    """The grid of the image of least priority, the first of a collection."""
    if not images:
        raise ValueError("there are no images")
    return min(images, key=lambda i: i.priority).meta


def window_of(meta: GridMeta, box: tuple[float, float, float, float], snap: bool = True) -> GridMeta:
    """The part of a grid that a rectangle (xmin, ymin, xmax, ymax) touches; without ``snap`` a grid of the same steps that begins at the rectangle's corner."""
    meta.require_north_up()
    if snap:
        c, r, w, h = regrid.crop_window(meta, *box)
        return replace(meta, height=h, width=w, c=meta.c + meta.a * c, f=meta.f + meta.e * r)
    loose = replace(meta, c=box[0] if meta.a > 0 else box[2], f=box[3] if meta.e < 0 else box[1])
    c, r, w, h = regrid.crop_window(loose, *box)
    return replace(loose, height=h, width=w)


def _offset(inner: GridMeta, outer: GridMeta) -> tuple[int, int] | None:
    """Rows and columns by which a grid lies within another of the same steps, if it does so by whole cells."""
    if epsg_of(inner.crs) != epsg_of(outer.crs) or abs(inner.a / outer.a - 1) > 1e-12 or abs(inner.e / outer.e - 1) > 1e-12:
        return None
    r, c = (inner.f - outer.f) / outer.e, (inner.c - outer.c) / outer.a
    return (round(r), round(c)) if abs(r - round(r)) < 1e-6 and abs(c - round(c)) < 1e-6 else None


def on_grid(image: Image, target: GridMeta, method: str = "bilinear") -> DataFrame:
    """r, c, z of an image on the target grid: shifted where its cells are the target's, else sampled anew."""
    cells = normalise(image.cells.select("r", "c", F.col("z").cast("double").alias("z")))
    if (off := _offset(target, image.meta)) is None:
        return regrid.reproject(cells, image.meta, target, method)
    r, c = F.col("r") - off[0], F.col("c") - off[1]
    return cells.select(r.alias("r"), c.alias("c"), "z").filter(F.col("r").between(0, target.height - 1) & F.col("c").between(0, target.width - 1))


def aligned(images: list[Image], box: tuple[float, float, float, float], method: str = "bilinear", snap: bool = True, path: str | None = None) -> Layers:
    """Layers dem (NULL: NoData), area_m2 (NULL where dem is) and valid over a rectangle in the coordinates of the reference grid.

    All cells of the window have a row in each layer, and the layers lie in one layout of buckets.
    """
    if method not in regrid.RESAMPLING:
        raise ValueError(f"resampling must be one of {', '.join(regrid.RESAMPLING)}")
    target = window_of(reference(images), box, snap)
    parts = [on_grid(i, target, method).withColumn("priority", F.lit(i.priority)) for i in images]
    dem = densify(regrid.mosaic(reduce(DataFrame.unionByName, parts)), target)
    out = Layers(images[0].cells.sparkSession, target, path)
    out.add("dem", dem.withColumnRenamed("z", "dem"))
    kept = out.get("dem")
    out.add("area_m2", kept.withColumn("area_m2", F.when(F.col("dem").isNotNull(), pixel_area(target))))
    out.add("valid", kept.withColumn("valid", F.col("dem").isNotNull()))
    return out

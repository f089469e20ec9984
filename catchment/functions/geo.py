"""Lengths and areas on the WGS84 ellipsoid as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import GridMeta

# fixed values: the WGS84 ellipsoid
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of latitude and of longitude at a latitude in degrees."""
    e2 = FLATTENING * (2 - FLATTENING)
    phi = F.radians(lat)
    w = 1 - e2 * F.pow(F.sin(phi), F.lit(2.0))
    meridian, normal = AXIS * (1 - e2) / F.pow(w, F.lit(1.5)), AXIS / F.sqrt(w)
    return F.radians(F.lit(1.0)) * meridian, F.radians(F.lit(1.0)) * normal * F.greatest(F.cos(phi), F.lit(0.0))


def row_steps(meta: GridMeta, metric: bool = True) -> tuple[Column, Column]:
    """(dx, dy) in metres at a row's centre, or in units of the CRS."""
    if not metric:
        return F.lit(abs(meta.a)), F.lit(abs(meta.e))
    lat = meta.f + meta.e * (F.col("r") + 0.5)
    per_lat, per_lon = metres_per_degree(lat)
    return abs(meta.a) * per_lon, abs(meta.e) * per_lat


def pixel_area(meta: GridMeta) -> Column:
    dx, dy = row_steps(meta)
    return dx * dy


def to_wgs84(epsg: int, points: np.ndarray) -> np.ndarray:
    """Longitude and latitude of points (n x 2) in WGS84 itself, Web Mercator, or a UTM zone on WGS84."""
    from .projection import unproject

    return np.column_stack(unproject(epsg, points[:, 0], points[:, 1]))

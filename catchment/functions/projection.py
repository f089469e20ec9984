"""Coordinate systems: longitude and latitude on WGS84, Web Mercator, and the UTM zones, for numpy arrays and for columns alike.

The transverse Mercator projection goes by its series in the third flattening, to the fourth power: far below a millimetre within a zone.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import AXIS, FLATTENING

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SCALE, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0
# fixed values: coefficients of the series in powers of the third flattening
_SERIES = {
    "forth": [{1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180}, {2: 13 / 48, 3: -3 / 5, 4: 557 / 1440}, {3: 61 / 240, 4: -103 / 140}, {4: 49561 / 161280}],
    "back": [{1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360}, {2: 1 / 48, 3: 1 / 15, 4: -437 / 1440}, {3: 17 / 480, 4: -37 / 840}, {4: 4397 / 161280}],
    "latitude": [{1: 2, 2: -2 / 3, 3: -2, 4: 116 / 45}, {2: 7 / 3, 3: -8 / 5, 4: -227 / 45}, {3: 56 / 15, 4: -136 / 35}, {4: 4279 / 630}],
}
_FORTH, _BACK, _LATITUDE = (tuple(sum(c * _N**p for p, c in term.items()) for term in terms) for terms in _SERIES.values())

_NAMES = "sin cos tan sinh cosh asin atan atan2 atanh exp log sqrt degrees radians"
_OF_NUMPY = {"asin": "arcsin", "atan": "arctan", "atan2": "arctan2", "atanh": "arctanh"}
_COLUMNS = SimpleNamespace(**{n: getattr(F, n) for n in _NAMES.split()})
_ARRAYS = SimpleNamespace(**{n: getattr(np, _OF_NUMPY.get(n, n)) for n in _NAMES.split()})


def epsg_of(crs: str | int) -> int:
    """The number of a coordinate system; one that is not known here raises."""
    code = int(str(crs).rpartition(":")[2])
    if code in (0, -1, 4326, 4979):
        return 4326
    if code in (3857, 900913):
        return 3857
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return code
    raise ValueError(f"coordinates in EPSG:{code} cannot be converted")


def _central(epsg: int) -> float:
    return (epsg % 100) * 6.0 - 183.0


def project(crs: str | int, lon, lat):
    """(x, y) in a coordinate system of longitudes and latitudes in degrees."""
    epsg = epsg_of(crs)
    if epsg == 4326:
        return lon, lat
    m = _COLUMNS if isinstance(lon, Column) else _ARRAYS
    if epsg == 3857:
        return m.radians(lon) * AXIS, m.log(m.tan(m.radians(lat) / 2 + np.pi / 4)) * AXIS
    east = m.radians(lon - _central(epsg))
    sine = m.sin(m.radians(lat))
    k = 2 * _N**0.5 / (1 + _N)
    t = m.sinh(m.atanh(sine) - m.atanh(sine * k) * k)
    xi, eta = m.atan2(t, m.cos(east)), m.atanh(m.sin(east) / m.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(_FORTH, 1):
        x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
        y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
    return x * (_SCALE * _RADIUS) + _EAST, y * (_SCALE * _RADIUS) + (_SOUTH if epsg > 32700 else 0.0)


def unproject(crs: str | int, x, y):
    """(longitude, latitude) in degrees of places in a coordinate system."""
    epsg = epsg_of(crs)
    if epsg == 4326:
        return x, y
    m = _COLUMNS if isinstance(x, Column) else _ARRAYS
    if epsg == 3857:
        return m.degrees(x / AXIS), m.degrees(m.atan(m.exp(y / AXIS)) * 2 - np.pi / 2)
    xi, eta = (y - (_SOUTH if epsg > 32700 else 0.0)) / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BACK, 1):
        u = u - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        v = v - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    chi = m.asin(m.sin(u) / m.cosh(v))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + m.sin(chi * (2 * j)) * d
    return m.degrees(m.atan2(m.sinh(v), m.cos(u))) + _central(epsg), m.degrees(lat)


def convert(source: str | int, target: str | int, x, y):
    """Places of one coordinate system in another."""
    if epsg_of(source) == epsg_of(target):
        return x, y
    return project(target, *unproject(source, x, y))

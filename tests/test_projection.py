"""Coordinate systems, reprojected rasters, percentiles by rank and statistics over polygons against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions.projection import convert, epsg_of, project, unproject
from catchment.grid import GridMeta
from catchment.operators import regrid, wetness


def test_known_places():
    # the zone's meridian at 50 degrees north; a degree east at the equator; Web Mercator's edge
    assert project(32633, np.array([15.0]), np.array([50.0])) == pytest.approx((500000.0, 5538630.7027), abs=1e-3)
    assert project(32633, np.array([16.0]), np.array([0.0]))[0] == pytest.approx(611280.5, abs=1)
    assert project(3857, np.array([180.0]), np.array([85.0511287798066])) == pytest.approx((20037508.3428, 20037508.3428), abs=1e-3)
    assert project(32733, np.array([15.0]), np.array([-10.0]))[1] == pytest.approx(10_000_000 - project(32633, np.array([15.0]), np.array([10.0]))[1], abs=1e-6)
    assert epsg_of("EPSG:900913") == 3857
    with pytest.raises(ValueError):
        epsg_of("EPSG:5514")


@pytest.mark.parametrize("crs", ["EPSG:4326", "EPSG:3857", "EPSG:32601", "EPSG:32633", "EPSG:32760"])
def test_there_and_back(spark, crs):
    rng = np.random.default_rng(1)
    middle = (int(crs[-2:]) * 6 - 183) if crs[5:8] in ("326", "327") else 0
    lon, lat = middle + rng.uniform(-3, 3, 200), rng.uniform(-80, 80, 200)
    x, y = project(crs, lon, lat)
    back = unproject(crs, x, y)
    np.testing.assert_allclose(back, (lon, lat), atol=1e-9)
    cells = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon[:20], lat[:20])], "lon double, lat double")
    px, py = project(crs, F.col("lon"), F.col("lat"))
    made = cells.select(px.alias("x"), py.alias("y"))
    qx, qy = unproject(crs, F.col("x"), F.col("y"))
    got = made.select("x", "y", qx.alias("lon"), qy.alias("lat")).collect()
    np.testing.assert_allclose([(r.x, r.y, r.lon, r.lat) for r in got], np.column_stack([x, y, lon, lat])[:20], atol=1e-6)


def frame(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape)], "r int, c int, z double")


@pytest.mark.parametrize("method, tolerance", [("nearest", 0), ("bilinear", 1e-9), ("bicubic", 1e-9)])
@pytest.mark.parametrize("coarse", [1, 6])
def test_reprojection_matches_plain_sampling(spark, method, tolerance, coarse):
    """Cell by cell in numpy; a coarser target takes many source tiles to one of its own."""
    rng = np.random.default_rng(2)
    z = rng.normal(size=(60, 70))
    z[rng.random(z.shape) < 0.02] = np.nan
    source = GridMeta(60, 70)
    target = GridMeta(80 // coarse, 70 // coarse, 25.0 * coarse, 0.0, 499_900.0, 0.0, -28.0 * coarse, 5_538_700.0, "EPSG:32633")
    got = {(r.r, r.c): r.z for r in regrid.reproject(frame(spark, z), source, target, method, size=16).collect()}
    assert set(got) == set(np.ndindex(target.height, target.width))
    weight = lambda d: (1 - abs(d)) if method == "bilinear" else (1.5 * abs(d) ** 3 - 2.5 * d * d + 1 if abs(d) <= 1 else -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 if abs(d) < 2 else 0)
    cell = lambda r, c: z[r, c] if 0 <= r < 60 and 0 <= c < 70 else math.nan
    for (r, c), value in got.items():
        lon, lat = convert(target.crs, source.crs, np.array([target.c + target.a * (c + 0.5)]), np.array([target.f + target.e * (r + 0.5)]))
        u, v = (lon[0] - source.c) / source.a, (lat[0] - source.f) / source.e
        if method == "nearest":
            want = cell(math.floor(v), math.floor(u))
        else:
            near = [(i, j) for i in range(math.floor(v - 0.5) - 1, math.floor(v - 0.5) + 3) for j in range(math.floor(u - 0.5) - 1, math.floor(u - 0.5) + 3)]
            if method == "bilinear":
                near = [(i, j) for i, j in near if abs(v - 0.5 - i) < 1 and abs(u - 0.5 - j) < 1]
            terms = [(weight(v - 0.5 - i) * weight(u - 0.5 - j), cell(i, j)) for i, j in near]
            want = sum(w * x for w, x in terms if abs(w) > 1e-12)
        assert (value is None) == math.isnan(want) and (value is None or abs(value - want) <= tolerance), (r, c)


def test_a_target_outside_the_source_is_empty(spark):
    target = GridMeta(5, 5, 25.0, 0.0, 100_000.0, 0.0, -25.0, 1_000_000.0, "EPSG:32633")
    got = regrid.reproject(frame(spark, np.ones((4, 4))), GridMeta(4, 4), target)
    assert got.count() == 25 and got.filter("z is not null").count() == 0


def test_percentiles_by_rank(spark, monkeypatch):
    monkeypatch.setattr(wetness, "RANKED_VALUES", 7)  # many ranges
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=200), np.full(150, 0.25), [1e9, -1e9]])
    cells = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "z double").repartition(5)
    wanted = [0, 1, 2.5, 33, 50, 66.6, 98, 100]
    assert wetness.percentiles(cells, wanted) == pytest.approx(np.percentile(v, wanted).tolist(), rel=1e-12)
    assert wetness.percentiles(cells.filter("z is null"), [5]) is None
    assert wetness.percentiles(spark.createDataFrame([(3.0,)], "z double"), [0, 40, 100]) == [3.0, 3.0, 3.0]
    plan = wetness.percentile_stretch(cells)._jdf.queryExecution().toString()
    assert "percentile(" not in plan.lower()


def test_statistics_over_many_polygons(spark, monkeypatch):
    monkeypatch.setattr(wetness, "SPAN_CELLS", 4)
    rng = np.random.default_rng(4)
    z = rng.integers(0, 50, (20, 30)).astype(float)
    z[rng.random(z.shape) < 0.1] = np.nan
    edges, rings = [], {}
    for zone in range(12):
        for g in range(1 + zone % 2):  # some zones have two polygons that overlap
            n = rng.integers(3, 7)
            angle = np.sort(rng.uniform(0, 2 * np.pi, n))
            x, y = rng.uniform(-2, 32) + 6 * np.cos(angle), rng.uniform(-2, 22) + 6 * np.sin(angle)
            rings.setdefault(zone, []).append((x, y))
            edges += [(zone, g, float(x[k]), float(y[k]), float(x[(k + 1) % n]), float(y[(k + 1) % n])) for k in range(n)]
    edges += [(99, 0, 100.0, 100.0, 110.0, 100.0), (99, 0, 110.0, 100.0, 100.0, 110.0), (99, 0, 100.0, 110.0, 100.0, 100.0)]
    table = spark.createDataFrame(edges, "zone int, g int, x1 double, y1 double, x2 double, y2 double")
    got = {r.zone: r for r in wetness.zonal_polygons(frame(spark, z), GridMeta(20, 30), table).collect()}
    assert set(got) == {*range(12), 99} and got[99].n == 0 and got[99]["mean"] is None
    for zone, parts in rings.items():
        held = []
        for r, c in np.ndindex(z.shape):
            inside = False
            for x, y in parts:
                crossings = 0
                for k in range(len(x)):
                    x1, y1, x2, y2 = x[k], y[k], x[(k + 1) % len(x)], y[(k + 1) % len(x)]
                    if (y1 > r + 0.5) != (y2 > r + 0.5) and c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / (y2 - y1) + x1:
                        crossings += 1
                inside |= crossings % 2 == 1
            if inside and not np.isnan(z[r, c]):
                held.append(z[r, c])
        assert got[zone].n == len(held)
        if held:
            assert (got[zone]["mean"], got[zone].low, got[zone].high) == pytest.approx((np.mean(held), min(held), max(held)))

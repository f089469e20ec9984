"""Round trips of files."""

import json
import sqlite3
import struct
import zipfile

import numpy as np

import pytest

from catchment.grid import GridMeta
from catchment.operators.wetness import rings
from pyspark.sql import functions as F

from catchment.sources import gtiff, gtiff_source, vectors


def test_gtiff_round_trip(spark, tmp_path):
    meta = GridMeta(5, 7)
    cells = spark.createDataFrame([(r, c, None if (r + c) % 6 == 0 else r * 10.5 + c) for r in range(5) for c in range(7)], "r int, c int, z double")
    for row in gtiff.tiles(cells, meta, size=4).collect():
        (tmp_path / f"{row.tr}_{row.tc}.tif").write_bytes(row.content)
    got = {}
    for path in sorted(tmp_path.glob("*.tif")):
        _, at, nodata = gtiff.decode(path.read_bytes())
        assert nodata == gtiff.NODATA and at.crs == "EPSG:4326"
        r0, c0 = round((at.f - meta.f) / meta.e), round((at.c - meta.c) / meta.a)
        got |= {(r.r + r0, r.c + c0): r.z for r in gtiff.read(spark, str(path)).collect()}
    assert got == {(r.r, r.c): r.z for r in cells.collect()}


def test_areas_of_interest(spark, tmp_path):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(collection))
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,5 1,0,5 1,1,5 0,0,5</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>'
    (tmp_path / "b.kml").write_text(kml)
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("doc.kml", kml)
    want = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    for name in ("a.geojson", "b.kml", "c.kmz"):
        assert rings(vectors.read_aoi(spark, str(tmp_path / name))) == want
    with pytest.raises(ValueError):
        vectors.read_aoi(spark, str(tmp_path / "d.shx"))


@pytest.mark.parametrize("compression", [gtiff.NONE, gtiff.LZW, gtiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, 32])
def test_layouts_of_a_file(compression, tile):
    rng = np.random.default_rng(1)
    meta = GridMeta(70, 53)
    v = rng.normal(size=(70, 53)).astype(np.float32).astype(float)
    v[rng.random(v.shape) < 0.1] = np.nan
    for predictor in (1, 2, 3):
        blob = gtiff.encode(v, meta, compression=compression, predictor=predictor, tile=tile, mask=True, overviews=(2, 4))
        got, at, _ = gtiff.decode(blob)
        assert np.array_equal(got, v, equal_nan=True) and at == meta and len(gtiff.images(lambda a, n, b=blob: b[a : a + n])) == 6
    with pytest.raises(ValueError):
        gtiff.decode(gtiff.encode(v, meta), band=2)


def test_lzw_of_a_known_stream():
    # the example of the format's description: 7 7 7 8 8 7 7 6 6 as nine-bit codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert gtiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and gtiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def test_files_of_a_grid(spark, tmp_path):
    meta = GridMeta(5, 7)
    cells = spark.createDataFrame([(r, c, r * 10.5 + c) for r in range(5) for c in range(7)], "r int, c int, z double")
    paths = gtiff.save(cells, meta, f"file://{tmp_path}", "dem", size=4, tile=16, compression=gtiff.LZW)
    assert len(paths) == 4 and sum(gtiff.read(spark, p).count() for p in paths) == 35


def _record(rings):
    points = [p for r in rings for p in r]
    starts = np.cumsum([0] + [len(r) for r in rings])[:-1].tolist()
    body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return struct.pack(">2i", 1, len(body) // 2) + body


def test_areas_from_packages_and_shapefiles(spark, tmp_path):
    ring = [(500000.0, 5538630.703), (500100.0, 5538630.703), (500100.0, 5538700.0), (500000.0, 5538630.703)]
    utm = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.shp", b"\0" * 100 + _record([ring]))
        z.writestr("a.prj", utm)
    (got,) = rings(vectors.read_aoi(spark, str(tmp_path / "a.zip")))
    assert got[0][0] == pytest.approx((15.0, 50.0), abs=1e-6)
    db = sqlite3.connect(tmp_path / "b.gpkg")
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    db.executescript("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id); CREATE TABLE gpkg_spatial_ref_sys (srs_id, organization_coordsys_id); CREATE TABLE t (geom)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 9)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (9, 32633)")
    db.executemany("INSERT INTO t VALUES (?)", [(b"GP\0\1" + struct.pack("<i", 9) + wkb,), (None,)])
    db.commit()
    db.close()
    (again,) = rings(vectors.read_aoi(spark, str(tmp_path / "b.gpkg")))
    assert np.allclose(again[0], got[0])
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.shp", b"\0" * 100 + _record([ring]))
        z.writestr("a.prj", 'PROJCS["Krovak"]')
    with pytest.raises(ValueError):
        vectors.read_aoi(spark, str(tmp_path / "c.zip"))


@pytest.fixture(scope="module")
def big_grid(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(100, 30, (150, 210)), 2).astype(np.float32).astype(float)
    v[rng.random(v.shape) < 0.05] = np.nan
    v[64:96, 32:64] = np.nan
    rows = [(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r, c in np.ndindex(v.shape) if not (64 <= r < 96 and 32 <= c < 64)]
    return spark.createDataFrame(rows, "r int, c int, z double"), GridMeta(150, 210, crs="EPSG:32633", a=30.0, c=5e5, e=-30.0, f=5.5e6), v


def _raster(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = np.nan if r.z is None else r.z
    return out


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression, predictor", [(gtiff.DEFLATE, 3), (gtiff.LZW, 1), (gtiff.NONE, 2)])
def test_one_file_of_many_blocks(spark, tmp_path, big_grid, big, compression, predictor):
    """Written and read by many tasks, classic and BigTIFF; a block without rows takes no room in the file."""
    cells, meta, v = big_grid
    path = f"file://{tmp_path}/a.tif"
    gtiff_source.write(cells, meta, path, tile=32, levels=2, compression=compression, predictor=predictor, big=big)
    assert [x.name for x in tmp_path.iterdir()] == ["a.tif"] and gtiff_source.meta_of(path) == meta
    np.testing.assert_array_equal(_raster(gtiff_source.read(spark, path), v.shape), v)
    image = gtiff_source.image_of(gtiff_source.fetcher(path), 0)[0]
    assert image.sizes.count(0) == 1 and (tmp_path / "a.tif").read_bytes()[2] == (43 if big else 42)
    for level, k in ((1, 2), (2, 4)):
        h, w = -(-150 // k), -(-210 // k)
        wide = np.full((h * k, w * k), np.nan)
        wide[:150, :210] = v
        with np.errstate(invalid="ignore"):
            n = (~np.isnan(wide)).reshape(h, k, w, k).sum((1, 3))
            mean = np.nansum(wide.reshape(h, k, w, k), (1, 3)) / n
        np.testing.assert_allclose(_raster(gtiff_source.read(spark, path, level=level), (h, w)), mean, rtol=1e-6)
    values, at, nodata = gtiff.decode((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(np.where(gtiff.hidden(values, nodata), np.nan, values), v, equal_nan=True) and at == meta


def test_a_window_reads_its_own_blocks(spark, tmp_path, big_grid):
    cells, meta, v = big_grid
    path = f"file://{tmp_path}/a.tif"
    gtiff_source.write(cells, meta, path, tile=32)
    reader = gtiff_source.GeoTiffReader({"path": path, "r0": "40", "r1": "70", "c0": "95", "c1": "130"})
    parts = reader.partitions()
    assert sorted(k for p in parts for k in p.blocks) == [r * 7 + c for r in (1, 2) for c in (2, 3, 4)]
    assert all(set(p.image.offsets) == set(p.blocks) for p in parts)  # a task is told of its own blocks only
    got = gtiff_source.read(spark, path, window=(40, 70, 95, 130), columns="z,c,r")
    assert got.columns == ["z", "c", "r"]
    out = _raster(got, v.shape)
    np.testing.assert_array_equal(out[40:70, 95:130], v[40:70, 95:130])
    assert got.count() == 30 * 35 and gtiff_source.read(spark, path, window=(150, 160, 0, 9)).count() == 0


def test_filters_narrow_the_window(spark, tmp_path, big_grid):
    cells, meta, v = big_grid
    path = f"file://{tmp_path}/a.tif"
    gtiff_source.write(cells, meta, path, tile=32)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = gtiff_source.read(spark, path).filter("r >= 40 and r < 70 and c = 100 and z > 100")
        assert {(r.r, r.c) for r in got.collect()} == {(r, 100) for r in range(40, 70) if v[r, 100] > 100}
        from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

        reader = gtiff_source.NarrowingReader({"path": path})
        filters = [GreaterThan(("r",), 39), LessThanOrEqual(("r",), 69), EqualTo(("c",), 100)]
        assert list(reader.pushFilters(filters)) == filters and reader.window == [40, 70, 100, 101]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_a_folder_of_files_with_masks(spark, tmp_path):
    """Strips and tiles, masks that are laid out otherwise, several files."""
    rng = np.random.default_rng(5)
    meta = GridMeta(70, 53)
    v = rng.normal(size=(70, 53)).astype(np.float32).astype(float)
    v[rng.random(v.shape) < 0.1] = np.nan
    (tmp_path / "a.tif").write_bytes(gtiff.encode(v, meta, tile=32, mask=True, overviews=(2,)))
    (tmp_path / "b.TIFF").write_bytes(gtiff.encode(v * 2, meta, compression=gtiff.LZW, predictor=2, mask=True))
    (tmp_path / "c.txt").write_text("no")
    got = gtiff_source.read(spark, str(tmp_path), columns="path,r,c,z")
    for name, want in (("a.tif", v), ("b.TIFF", v * 2)):
        np.testing.assert_array_equal(_raster(got.filter(got.path.endswith(name)), v.shape), want)
    with pytest.raises(Exception, match="levels"):
        gtiff_source.read(spark, str(tmp_path / "a.tif"), level=2).collect()
    with pytest.raises(ValueError):
        gtiff.images(lambda at, n: b"PK\3\4" * 4)
    with pytest.raises(ValueError):
        gtiff_source.columns_of({"columns": "r,q"})


def test_a_broken_write_leaves_no_parts(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (40, 0, 2.0)], "r int, c int, z double")
    path = f"file://{tmp_path}/a.tif"
    with pytest.raises(Exception):
        gtiff_source.write(cells.withColumn("z", F.raise_error(F.lit("broken")).cast("double")), GridMeta(64, 64), path, tile=32)
    gtiff_source.write(cells, GridMeta(64, 64), path, tile=32)
    assert [x.name for x in tmp_path.iterdir()] == ["a.tif"]
    assert sorted((r.r, r.c, r.z) for r in gtiff_source.read(spark, path).filter("z is not null").collect()) == [(0, 0, 1.0), (40, 0, 2.0)]

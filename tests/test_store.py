"""Rasters kept in blocks and in layers: what a plan opens, and that layers join without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.grid import GridMeta
from catchment.operators import export, regrid, wetness
from catchment.plans import pipeline
from catchment.sources import store


def frame(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape)], "r int, c int, z double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def z():
    rng = np.random.default_rng(7)
    out = rng.integers(0, 90, (40, 50)).astype(float)
    out[rng.random(out.shape) < 0.1] = np.nan
    return out


def test_a_window_opens_its_own_blocks(spark, tmp_path, z):
    path = f"file://{tmp_path}/grid"
    store.write_cells(frame(spark, z), path, block=8)
    got = store.read_cells(spark, path, (9, 15, 17, 30))
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(br" in plan and "PushedFilters: [IsNotNull(r)" in plan and "GreaterThanOrEqual(r,9)" in plan
    files = {r[0] for r in spark.read.parquet(f"{path}/cells").filter("br = 1 and bc between 2 and 3").select("_metadata.file_path").distinct().collect()}
    opened = {r[0] for r in spark.read.parquet(f"{path}/cells").filter("r between 9 and 14 and c between 17 and 29").select("_metadata.file_path").distinct().collect()}
    assert opened == files and len(files) < spark.read.parquet(f"{path}/cells").select("_metadata.file_path").distinct().count() / 5
    assert {(r.r, r.c): r.z for r in got.collect()} == {(r, c): (None if np.isnan(z[r, c]) else z[r, c]) for r in range(9, 15) for c in range(17, 30)}
    assert store.read_cells(spark, path).count() == 2000 and store.read_cells(spark, path, (100, 120, 0, 5)).count() == 0
    edges = store.bounds(spark, path).filter("br = 4 and bc = 6").first()
    assert (edges.r_low, edges.r_high, edges.c_low, edges.c_high, edges.n, edges.block) == (32, 39, 48, 49, 16, 8)
    with pytest.raises(ValueError):
        store.write_cells(frame(spark, z), path, block=1 << 17)


def test_small_blocks_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDERS", 16, raising=False)
    path = f"file://{tmp_path}/grid"
    z = np.arange(300.0 * 60).reshape(300, 60)
    store.write_cells(frame(spark, z), path, block=4)  # 75 x 15 blocks
    assert spark.read.parquet(f"{path}/cells").select("_metadata.file_path").distinct().count() <= 16
    blocks = {(b.br, b.bc): (b.r_low, b.r_high, b.c_low, b.c_high, b.n, b.block) for b in store.bounds(spark, path).collect()}
    assert blocks == {(i, j): (4 * i, 4 * i + 3, 4 * j, 4 * j + 3, 16, 4) for i in range(75) for j in range(15)}
    got = store.read_cells(spark, path, (100, 141, 17, 30))
    assert "PartitionFilters: [isnotnull(br" in plan_of(got)
    assert {(r.r, r.c): r.z for r in got.collect()} == {(r, c): z[r, c] for r in range(100, 141) for c in range(17, 30)}
    assert store.read_cells(spark, path).count() == z.size


def test_the_curve_interleaves_bits(spark):
    got = spark.range(1).select(*[store.z_order(F.lit(r), F.lit(c)).alias(f"z{k}") for k, (r, c) in enumerate([(0, 0), (0, 1), (1, 0), (3, 5), (65535, 65535), (65535, 0)])]).first()
    assert list(got) == [0, 1, 2, 0b011011, 2**32 - 1, int("10" * 16, 2)]


def test_cells_of_a_block_lie_along_the_curve(spark, tmp_path):
    path = f"file://{tmp_path}/grid"
    store.write_cells(frame(spark, np.zeros((16, 16))), path, block=16)
    order = [(r.r, r.c) for r in spark.read.parquet(f"{path}/cells").collect()]
    assert order[:5] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2)]


def test_layers_join_without_a_shuffle(spark, z):
    meta = GridMeta(*z.shape)
    layers = export.aligned([export.Image(frame(spark, z), meta, 0)], (15.0, 50 - 40 / 3600, 15 + 50 / 3600, 50.0))
    every = layers.get("dem", "area_m2", "valid")
    every.collect()
    plan = plan_of(every)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert layers.meta == meta and every.filter("valid <> (dem is not null) or (area_m2 is null) <> (dem is null)").count() == 0
    assert every.count() == 2000 and every.filter("valid").count() == int((~np.isnan(z)).sum())
    tables = list(layers.tables.values())
    layers.close()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_the_reference_grid_and_its_windows(spark, z):
    meta = GridMeta(*z.shape)
    other = GridMeta(10, 10, 1 / 1800, 0.0, 15.001, 0.0, -1 / 1800, 49.99)
    images = [export.Image(frame(spark, z), meta, 5), export.Image(frame(spark, z[:10, :10]), other, 2)]
    assert export.reference(images) == other
    x, y = (lambda c: 15 + c / 3600), (lambda r: 50 - r / 3600)
    window = export.window_of(meta, (x(3.2), y(9.5), x(7.4), y(2.1)))
    assert (window.height, window.width) == (8, 5) and (window.c, window.f) == pytest.approx((x(3), y(2)))
    loose = export.window_of(meta, (x(3.2), y(9.5), x(7.4), y(2.1)), snap=False)
    assert (loose.height, loose.width) == (8, 5) and (loose.c, loose.f) == pytest.approx((x(3.2), y(2.1)))
    shifted = export.on_grid(images[0], window)
    assert {(r.r, r.c): r.z for r in shifted.collect()} == {(r, c): (None if np.isnan(z[r + 2, c + 3]) else z[r + 2, c + 3]) for r in range(8) for c in range(5)}
    sampled = {(r.r, r.c): r.z for r in export.on_grid(images[0], loose, "nearest").collect()}
    assert sampled == {(r, c): (None if np.isnan(z[r + 2, c + 3]) else z[r + 2, c + 3]) for r in range(8) for c in range(5)}
    with pytest.raises(ValueError):
        export.reference([])
    with pytest.raises(ValueError):
        export.aligned(images, (15.0, 49.0, 16.0, 50.0), "cubic")


def test_a_layer_of_another_system(spark, z):
    meta = GridMeta(*z.shape)
    metres = GridMeta(60, 60, 25.0, 0.0, 499_900.0, 0.0, -25.0, 5_538_700.0, "EPSG:32633")
    there = regrid.reproject(frame(spark, z), meta, metres, "nearest")
    back = regrid.nearest_layer(frame(spark, z), meta, there, metres, "again", 2.0)
    rows = back.filter("again is not null").collect()
    assert back.count() == 2000 and len(rows) > 500 and sum(r.z == r.again * 2 for r in rows) > 0.6 * len(rows)


def test_a_run_tells_its_area(spark, z):
    run = pipeline.run(frame(spark, z), GridMeta(*z.shape), flow_method="d8")
    per = regrid.area_hectares(frame(spark, z), GridMeta(*z.shape)).first().area_ha
    assert run.metrics["area_ha"] == pytest.approx(per) and run.metrics["area_ha"] / run.metrics["valid_pixels"] == pytest.approx(0.0614, abs=0.001)
    assert wetness.overview(frame(spark, z)).count() == 500

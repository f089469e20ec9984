"""Terrain operators on hand-checked grids, argument errors, and properties."""

import json

import pytest
from pyspark.sql import functions as F

from catchment.grid import GridMeta, neighbours, normalise, view
from catchment.operators import conditioning, regrid, routing, wetness
from catchment.plans import pipeline
from catchment.sources import catalogue

BOWL = [[5, 5, 5, 5, 5], [5, 1, 1, 1, 5], [5, 1, 0, 1, 4], [5, 1, 1, 1, 5], [5, 5, 5, 5, 5]]


def grid(spark, rows):
    cells = [(r, c, None if z is None else float(z)) for r, row in enumerate(rows) for c, z in enumerate(row)]
    return spark.createDataFrame(cells, "r int, c int, z double"), GridMeta(len(rows), len(rows[0]))


def table(df, column, meta):
    got = {(r.r, r.c): r[column] for r in df.collect()}
    return [[got[r, c] for c in range(meta.width)] for r in range(meta.height)]


@pytest.mark.parametrize("size", [2, 128])
def test_bowl_through_the_chain(spark, size):
    cells, meta = grid(spark, BOWL)
    filled = conditioning.fill_depressions(cells, meta, size=size)
    assert table(filled, "filled", meta) == [[5] * 5, [5, 4, 4, 4, 5], [5, 4, 4, 4, 4], [5, 4, 4, 4, 5], [5] * 5]
    surface = filled.select("r", "c", F.col("filled").alias("z"))
    flat = conditioning.materialize(conditioning.resolve_flats(surface, meta, size=size))
    assert table(flat, "flat_mask", meta) == [[0] * 5, [0, 9, 7, 5, 0], [0, 9, 6, 5, 2], [0, 9, 7, 5, 0], [0] * 5]
    assert conditioning.flat_stats(flat).first().asDict() == {"n_flats": 1, "n_flat_cells": 10, "n_low_edges": 1, "n_high_edges": 8, "removed_highedges_unlabeled": 0, "removed_highedges_low_dominates": 1, "note_undrainable_flats": 0}
    drained = flat.select("r", "c", F.col("resolved").alias("z"))
    d8 = routing.d8(drained, meta, (1.0, 1.0))
    assert table(d8, "dir", meta) == [[2, 3, 3, 3, 4], [1, 2, 1, 2, 3], [1, 1, 1, 1, -2], [1, 0, 1, 0, 7], [0, 7, 7, 7, 6]]
    acc = routing.accumulate(d8.join(drained, ["r", "c"]), meta, size=size)
    assert table(acc, "acc", meta) == [[1] * 5, [1, 4, 2, 5, 1], [1, 2, 11, 12, 25], [1, 4, 2, 5, 1], [1] * 5]


def test_mfd_weights_and_ties(spark):
    cells, meta = grid(spark, [[9, 8, 7], [6, 5, 4], [3, 2, 1]])
    w = table(routing.mfd(cells, meta, steps=(1.0, 1.0)), "w", meta)[1][1]
    assert w == pytest.approx([0, 1 / 7, 2 / 7, 3 / 7, 1 / 7, 0, 0, 0], abs=1e-6)
    cells, meta = grid(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert table(routing.d8(cells, meta, (1.0, 1.0)), "dir", meta)[1][1] == 1


def test_nodata(spark):
    cells, meta = grid(spark, [[3, 3, 3], [3, None, 3], [3, 3, 3]])
    assert table(routing.d8(cells, meta), "dir", meta)[1][1] == -1
    assert conditioning.seeds(cells, meta).count() == 8
    assert table(neighbours(cells), "n3", meta)[0] == [3, None, 3]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-9999.0,), (1.0,)], "z double")
    assert [r.z for r in normalise(odd, -9999.0).collect()] == [None, None, None, 1.0]


def test_wetness_values(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (2.5, 10.0), (0.0, 1.0), (-1.0, 1.0), (None, 1.0)], "a double, s double")
    got = [r.t for r in rows.select(wetness.twi(F.col("a"), F.col("s")).alias("t")).collect()]
    assert got[:2] == pytest.approx([6.350811042642735, 2.651705894543047]) and got[2:] == [None] * 3


def test_stretches(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "z double")
    p = wetness.percentile_stretch(v).first()
    assert (p.lo, p.hi) == pytest.approx((1.06, 7.76))
    one = spark.createDataFrame([(3.0,), (3.0,)], "z double")
    assert wetness.sigma_stretch(one).first()[1:] == (0.0, 1.0) and wetness.percentile_stretch(one).first()[1:] == (3.0, 3.0)


def test_clip_touches(spark):
    cells, meta = view(spark, "/root/testdata/sf0.01", "dem_part")
    square = {"type": "Polygon", "coordinates": [[[15 + x / 3600, 50 - y / 3600] for x, y in ((2.2, 3.2), (4.4, 3.2), (4.4, 5.4), (2.2, 5.4), (2.2, 3.2))]]}
    kept = {(r.r, r.c) for r in wetness.clip(cells, meta, json.dumps(square)).filter("z is not null").collect()}
    assert kept == {(r, c) for r in (3, 4, 5) for c in (2, 3, 4)}
    centre = {(r.r, r.c) for r in wetness.clip(cells, meta, square, all_touched=False).filter("z is not null").collect()}
    assert centre == {(r, c) for r in (3, 4) for c in (2, 3)}


def test_plans_and_windows(spark):
    assert [regrid.tile_plan(*s) for s in ((1000, 1000), (4000, 4000), (30000, 100))] == [(1, 1), (2, 2), (3, 1)]
    w = regrid.windows(spark, 30, 1, 22, 1).orderBy("index").collect()
    assert [x.col_off for x in w] + [30] == [0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14, 16, 17, 19, 20, 21, 23, 24, 25, 27, 28, 30]


def test_errors(spark):
    cells, meta = grid(spark, [[1, 2], [3, 4]])
    for broken in (
        lambda: GridMeta(2, 2, b=0.1).steps(), lambda: routing.mfd(cells, meta, min_slope=-1), lambda: wetness.twi(F.col("z"), F.col("z"), -1),
        lambda: routing.accumulate(cells, meta), lambda: routing.accumulate(cells.withColumn("dir", F.lit(1)), meta, "m2"), lambda: routing.accumulate(cells.withColumn("dir", F.lit(1)), meta, "acres"),
        lambda: catalogue.dataset("nowhere"), lambda: pipeline.run(cells, meta, "d16"), lambda: wetness.percentile_stretch(cells, low=98, high=2), lambda: regrid.refine_plan(1, 1, "halve"),
        lambda: regrid.resample(cells, meta, meta, "cubic"), lambda: regrid.crop_window(meta, 0, 0, 0, 0),
    ):
        with pytest.raises(ValueError):
            broken()
    loop = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 1.0, 5)], "r int, c int, z double, dir int")
    with pytest.raises(Exception, match="cycl"):
        routing.accumulate(loop, GridMeta(1, 2)).collect()


def test_pipeline_layers(spark):
    run = pipeline.run(*grid(spark, BOWL), flow_method="d8")
    assert set(run.layers) == {"filled", "resolved", "flow", "acc", "slope", "twi"} and run.metrics["valid_pixels"] == 25
    assert run.twi.filter("twi is not null").count() == 9


def test_entry_contract(spark):
    import __spark_entry__ as entry

    every, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(every) and entry.entry(spark).count() > 0


def _flow(spark, rows, width):
    return spark.createDataFrame(rows, "r int, c int, z double, dir int, area_m2 double"), GridMeta(1, width)


def test_a_cell_without_mass_passes_on_what_it_gets(spark):
    cells, meta = _flow(spark, [(0, 0, 1.0, 1, 1.0), (0, 1, 1.0, 1, 0.0), (0, 2, 1.0, -2, 1.0)], 3)
    assert table(routing.accumulate(cells, meta, "m2"), "acc", meta) == [[1, 1, 2]]


@pytest.mark.parametrize("size", [2, 512])
def test_cycles_of_any_weight_raise_or_keep_what_is_complete(spark, size):
    half = [0.0] * 8
    rows = [(0, 0, 1.0, [0.0, 1.0] + half[2:]), (0, 1, 1.0, [0.0, 0.5] + half[2:]), (0, 2, 1.0, half[:5] + [0.5, 0.0, 0.0]), (0, 3, 1.0, half)]
    cells = spark.createDataFrame(rows, "r int, c int, z double, w array<float>")
    meta = GridMeta(1, 4)
    with pytest.raises(routing.FlowCycleError):
        routing.accumulate(cells, meta, size=size)
    assert table(routing.accumulate(cells, meta, size=size, cycle_check=False), "acc", meta) == [[1, 2, 1, 1]]


def test_clip_by_many_vertices_and_holes(spark):
    import math

    cells, meta = view(spark, "/root/testdata/sf0.01", "dem_part")
    at = lambda x, y: [15 + x / 3600, 50 - y / 3600]
    circle = lambda r, n: [at(25.3 + r * math.cos(2 * math.pi * k / n), 20.2 + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    ring = {"type": "Polygon", "coordinates": [circle(15, 100_000), circle(6, 377)]}
    kept = {(r.r, r.c) for r in wetness.clip(cells, meta, ring, all_touched=False).filter("z is not null").collect()}
    assert kept == {(r, c) for r in range(40) for c in range(50) if 6 < math.hypot(c + 0.5 - 25.3, r + 0.5 - 20.2) < 15}

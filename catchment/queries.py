"""Terrain queries on the test grids, each with the SQL that DuckDB evaluates for the same result."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import materialize, scratch
from .functions import geo, projection
from .grid import GridMeta, densify, is_edge, neighbours, view
from .operators import conditioning, export, regrid, routing, wetness
from .plans import pipeline
from .sources import gtiff, gtiff_source, store
from .sources.catalogue import DATASETS, catalogue, download_path, layer_name_column, scan_band
from .tiles import SIZE as TILE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
UNIT = (1.0, 1.0)
#: A polygon in (column, row) space, mapped through the default georeference.
AOI = {"type": "Polygon", "coordinates": [[[15 + x / 3600, 50 - y / 3600] for x, y in ((5.5, 5.5), (30.2, 8.1), (25.7, 33.4), (7.3, 28.9), (5.5, 5.5))]]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks -------------------------------------------------------------------------

PART = "cells AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::DOUBLE AS z FROM part)"
HOLE = "((7 * r + 13 * c) % 29 = 0 OR (r BETWEEN 10 AND 14 AND c BETWEEN 10 AND 14))"
VOID = f"solid AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::DOUBLE AS z FROM part), cells AS (SELECT r, c, CASE WHEN NOT {HOLE} THEN z END AS z FROM solid)"
SIZE = "size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells)"
DIRS = "dirs(k, dr, dc) AS (VALUES (0, -1, 1), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, -1), (5, 0, -1), (6, -1, -1), (7, -1, 0))"
PAIRS = "pairs AS (SELECT a.r, a.c, a.z, d.k, d.dr, d.dc, b.r AS nr, b.c AS nc, b.z AS nz FROM cells a CROSS JOIN dirs d LEFT JOIN cells b ON b.r = a.r + d.dr AND b.c = a.c + d.dc)"
BASE = f"{SIZE}, {DIRS}, {PAIRS}"
EDGE = "(r = 0 OR c = 0 OR r = (SELECT h FROM size) - 1 OR c = (SELECT w FROM size) - 1)"


def metres_sql(lat: str) -> tuple[str, str]:
    """SQL of the metres of a degree of latitude and longitude."""
    f = "(1 / 298.257223563)"
    e2 = f"({f} * (2 - {f}))"
    w = f"(1 - {e2} * power(sin(radians({lat})), 2))"
    return f"(radians(1.0) * 6378137.0 * (1 - {e2}) / power({w}, 1.5))", f"(radians(1.0) * 6378137.0 / sqrt({w}) * greatest(cos(radians({lat})), 0.0))"


ROW_LAT = "(50.0 - (r + 0.5) / 3600)"
DY, DX = (f"({m} / 3600)" for m in metres_sql(ROW_LAT))


# --- scans, masks, catalogue -----------------------------------------------------------------------


CATALOGUE = "datasets(place, id, band, resolution_m) AS (VALUES (0, 'FABDEM', NULL, 30), (1, 'GLO30', 'DEM', 30), (2, 'AW3D30', 'DSM', 30), (3, 'SRTMGL1_003', 'elevation', 30), (4, 'NASADEM_HGT', 'elevation', 30), (5, 'ASTER_GDEM', 'b1', 30), (6, 'CGIAR_SRTM90', 'elevation', 90), (7, 'MERIT_DEM', 'dem', 90), (8, 'MERIT_Hydro', 'elv', 90))"


@query(f"WITH {CATALOGUE} SELECT s_suppkey, id, band, resolution_m FROM supplier JOIN datasets ON place = s_suppkey % 9")
def dem_catalog(spark, sf_dir):
    """The dataset that each supplier asks for, by its id in the catalogue."""
    names = F.array(*[F.lit(d[0]) for d in DATASETS])
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 9).cast("int")).alias("id"))
    return asked.join(F.broadcast(catalogue(spark)), "id").select("s_suppkey", "id", "band", "resolution_m")


@query(f"WITH {PART} SELECT r, c, z FROM cells")
def scan_cells_part(spark, sf_dir):
    return view(spark, sf_dir, "dem_part")[0]


@query("SELECT vec_id::INT AS r, (i - 1)::INT AS c, round(embedding[i]::DOUBLE * 100) AS z FROM embeddings, range(1, 65) t(i)")
def scan_cells_emb(spark, sf_dir):
    return view(spark, sf_dir, "dem_emb")[0]


@query(f"WITH {VOID} SELECT count(*) AS total, count(z) AS valid, count(*) - count(z) AS nodata FROM cells")
def cell_counts(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    return cells.agg(F.count("*").alias("total"), F.count("z").alias("valid"), F.count_if(F.col("z").isNull()).alias("nodata"))


@query(f"WITH {VOID} SELECT r, c, coalesce(z, -9999.0) AS stored, z IS NULL AS nodata FROM cells")
def nodata_mask(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    return cells.select("r", "c", F.coalesce("z", F.lit(-9999.0)).alias("stored"), F.col("z").isNull().alias("nodata"))


@query(f"WITH {VOID} SELECT r, c, CASE WHEN r % 2 = 0 THEN z END AS masked, coalesce(z, 0.0) AS unmasked FROM cells")
def mask_unmask(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    return cells.select("r", "c", F.when(F.col("r") % 2 == 0, F.col("z")).alias("masked"), F.coalesce("z", F.lit(0.0)).alias("unmasked"))


@query("SELECT r, c, max_by(z, p) FILTER (z IS NOT NULL) AS z FROM (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS z, 2 AS p FROM part UNION ALL SELECT (p_partkey // 50)::INT, (p_partkey % 50)::INT, p_size + 100.0, 1 FROM part WHERE p_partkey % 50 < 25) GROUP BY r, c")
def mosaic(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part")
    top = cells.select("r", "c", F.when((F.col("r") * 50 + F.col("c")) % 3 != 0, F.col("z")).alias("z"), F.lit(2).alias("priority"))
    low = cells.filter("c < 25").select("r", "c", (F.col("z") + 100).alias("z"), F.lit(1).alias("priority"))
    return regrid.mosaic(top.unionByName(low))


@query(f"WITH {PART} SELECT (r // 8)::INT AS tr, (c // 8)::INT AS tc, count(*) AS n FROM cells WHERE r BETWEEN 5 AND 20 AND c BETWEEN 7 AND 22 GROUP BY ALL")
def tiles_in_region(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part")
    inside = cells.filter(F.col("r").between(5, 20) & F.col("c").between(7, 22))
    return inside.groupBy((F.col("r") / 8).cast("int").alias("tr"), (F.col("c") / 8).cast("int").alias("tc")).agg(F.count("*").alias("n"))


@query(f"WITH {VOID}, other AS (SELECT r, c FROM cells WHERE z IS NOT NULL) SELECT count(*) FILTER (o.r IS NOT NULL) AS \"both\", count(*) FILTER (o.r IS NULL) AS only_left, 0::BIGINT AS only_right FROM cells a LEFT JOIN other o USING (r, c)")
def align_check(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    return regrid.alignment(cells, cells.filter("z is not null"))


@query(f"WITH {PART} SELECT a.r, a.c, a.z, b.z / 1e8 AS shifted FROM cells a LEFT JOIN cells b ON b.r = a.r + 1 AND b.c = a.c")
def ref_scaled_shift(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part")
    ref = cells.select((F.col("r") - 1).alias("r"), "c", (F.col("z") / 1e8).alias("shifted"))
    return cells.join(ref, ["r", "c"], "left")


# --- grids -----------------------------------------------------------------------------------------


ORDER_ROWS = "rows AS (SELECT range::INT AS r FROM range(0, (SELECT max(o_orderkey // 100) + 1 FROM orders)))"


@query(f"WITH {ORDER_ROWS} SELECT r, round({DX}, 6) AS dx, round({DY}, 6) AS dy, round(sqrt({DX} * {DX} + {DY} * {DY}), 6) AS diag FROM rows")
def step_lengths(spark, sf_dir):
    return _steps(spark, view(spark, sf_dir, "dem_orders")[1])


def _steps(spark, meta):
    dx, dy = geo.row_steps(meta)
    return spark.range(meta.height).select(F.col("id").cast("int").alias("r")).select("r", F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("diag"))


@query("SELECT c_custkey, lat, round({0}, 4) AS per_lat, round({1}, 4) AS per_lon FROM (SELECT c_custkey, (c_custkey % 18001) / 100.0::DOUBLE - 90 AS lat FROM customer)".format(*metres_sql("lat")))
def metres_per_degree(spark, sf_dir):
    lat, lon = geo.metres_per_degree(F.col("lat"))
    places = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((F.col("c_custkey") % 18001) / 100 - 90).alias("lat"))
    return places.select("c_custkey", "lat", F.round(lat, 4).alias("per_lat"), F.round(lon, 4).alias("per_lon"))


@query(f"WITH {PART} SELECT r, c, round({DX} * {DY}, 4) AS area_m2 FROM cells")
def pixel_area(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part")
    return cells.select("r", "c", F.round(geo.pixel_area(meta), 4).alias("area_m2"))


# the target's size follows from the source's
WHOLE = "g AS (SELECT ceil((max(r) + 1 - 1.1::DOUBLE) / 0.75::DOUBLE)::BIGINT AS th, ceil((max(c) + 1 - 0.3::DOUBLE) / 0.8::DOUBLE)::BIGINT AS tw FROM cells), t AS (SELECT (i // (SELECT tw FROM g))::INT AS r, (i % (SELECT tw FROM g))::INT AS c FROM range(0, (SELECT th * tw FROM g)) v(i))"


def _resampled_whole(spark, sf_dir, method, grid="dem_part"):
    cells, source = view(spark, sf_dir, grid, void=True)
    source = GridMeta(source.height, source.width, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    target = GridMeta(math.ceil((source.height - 1.1) / 0.75), math.ceil((source.width - 0.3) / 0.8), 0.8, 0.0, 0.3, 0.0, 0.75, 1.1)
    return regrid.resample(cells, source, target, method)


@query(f"WITH {VOID}, {WHOLE} SELECT t.r, t.c, s.z FROM t LEFT JOIN cells s ON s.r = floor((t.r + 0.5) * 0.75 + 1.1) AND s.c = floor((t.c + 0.5) * 0.8 + 0.3)")
def resample_nearest_whole(spark, sf_dir):
    return _resampled_whole(spark, sf_dir, "nearest")


@query(f"""WITH {VOID}, {WHOLE}, p AS (SELECT r, c, (0.3 + 0.8 * (c + 0.5)) - 0.5 AS x, (1.1 + 0.75 * (r + 0.5)) - 0.5 AS y FROM t),
n AS (SELECT p.*, floor(x)::INT + dx AS sc, floor(y)::INT + dy AS sr FROM p, range(0, 2) a(dx), range(0, 2) b(dy)),
w AS (SELECT *, (1 - abs(x - sc)) * (1 - abs(y - sr)) AS w FROM n WHERE abs((1 - abs(x - sc)) * (1 - abs(y - sr))) > 1e-12)
SELECT w.r, w.c, round(CASE WHEN count(*) = count(s.z) THEN sum(w.w * s.z) END, 6) AS z FROM w LEFT JOIN cells s ON s.r = w.sr AND s.c = w.sc GROUP BY w.r, w.c""")
def resample_bilinear_whole(spark, sf_dir):
    return _resampled_whole(spark, sf_dir, "bilinear").select("r", "c", F.round("z", 6).alias("z"))


@query(f"WITH {PART}, rows AS (SELECT range::INT AS r FROM range(0, (SELECT max(r) + 1 FROM cells))) SELECT r, round({DX}, 6) AS dx, round({DY}, 6) AS dy, round(sqrt({DX} * {DX} + {DY} * {DY}), 6) AS diag FROM rows")
def step_lengths_whole(spark, sf_dir):
    return _steps(spark, view(spark, sf_dir, "dem_part")[1])


#: A grid for each part: its size in cells, the plan of its tiles, and how it is refined.
PLANS = """grids AS (SELECT p_partkey, (1 + p_partkey * 37 % 30000)::INT AS width, (p_size * 311)::INT AS height, CASE WHEN p_partkey % 2 = 0 THEN 'double' ELSE 'increment' END AS mode FROM part),
counts AS (SELECT *, greatest(1, ceil(width::DOUBLE * height * 4 / 23488102.0)) AS n FROM grids),
plans AS (SELECT p_partkey, width, height, mode, greatest(ceil(sqrt(n)), ceil(width / 10000.0))::INT AS cols, greatest(ceil(n / ceil(sqrt(n))), ceil(height / 10000.0))::INT AS rows FROM counts)"""


def _plans(spark, sf_dir):
    key = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    grids = part.select("p_partkey", (1 + key * 37 % 30000).cast("int").alias("width"), (F.col("p_size") * 311).cast("int").alias("height"), F.when(key % 2 == 0, "double").otherwise("increment").alias("mode"))
    cols, rows = regrid.plan_columns(F.col("width"), F.col("height"))
    return grids.withColumns({"cols": cols, "rows": rows})


@query(f"WITH {PLANS} SELECT p_partkey, width, height, cols, rows FROM plans")
def tile_plan(spark, sf_dir):
    return _plans(spark, sf_dir).drop("mode")


#: The edges of the windows of each part's grid.
EDGES_OF = """xs AS (SELECT p_partkey, height, cols, rows, i, CASE WHEN i = cols THEN width ELSE floor(i * (width / cols::DOUBLE)) END::INT AS x FROM (SELECT *, unnest(range(0, cols + 1)) AS i FROM plans)),
ys AS (SELECT p_partkey, j, CASE WHEN j = rows THEN height ELSE floor(j * (height / rows::DOUBLE)) END::INT AS y FROM (SELECT *, unnest(range(0, rows + 1)) AS j FROM plans)),
spans AS (SELECT a.p_partkey, (y0.j * a.cols + a.i)::INT AS index, y0.j::INT AS row_idx, a.i::INT AS col_idx, a.x AS x0, b.x AS x1, y0.y AS y0, y1.y AS y1
FROM xs a JOIN xs b ON b.p_partkey = a.p_partkey AND b.i = a.i + 1 JOIN ys y0 ON y0.p_partkey = a.p_partkey JOIN ys y1 ON y1.p_partkey = a.p_partkey AND y1.j = y0.j + 1)"""


@query(f"WITH {PLANS}, {EDGES_OF} SELECT p_partkey, index, row_idx, col_idx, x0 AS col_off, y0 AS row_off, x1 - x0 AS width, y1 - y0 AS height FROM spans")
def tile_windows(spark, sf_dir):
    return regrid.windows_of(_plans(spark, sf_dir).drop("mode"))


@query(f"WITH {PLANS}, {EDGES_OF} SELECT p_partkey, index, round(15 + (x0 + 1e-6) / 3600, 9) AS xmin, round(50 - (y1 - 1e-6) / 3600, 9) AS ymin, round(15 + (x1 - 1e-6) / 3600, 9) AS xmax, round(50 - (y0 + 1e-6) / 3600, 9) AS ymax FROM spans")
def window_bounds(spark, sf_dir):
    b = regrid.window_bounds(regrid.windows_of(_plans(spark, sf_dir).drop("mode")), GridMeta(1, 1))
    return b.select("p_partkey", "index", *[F.round(x, 9).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {PART} SELECT count(*) AS missing FROM (SELECT i // 50 AS r, i % 50 AS c FROM range(0, (SELECT (max(r) + 1) * 50 FROM cells)) t(i)) e ANTI JOIN cells USING (r, c)")
def tile_coverage(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part")
    return densify(cells.withColumn("here", F.lit(1)), meta).agg(F.count_if(F.col("here").isNull()).alias("missing"))


@query(f"WITH {PLANS} SELECT p_partkey, mode, CASE mode WHEN 'double' THEN cols * 2 ELSE cols + 1 END AS cols, CASE mode WHEN 'double' THEN rows * 2 ELSE rows + 1 END AS rows, cols AS from_cols, rows AS from_rows FROM plans")
def tile_refine(spark, sf_dir):
    plans = _plans(spark, sf_dir)
    cols, rows = regrid.refine_columns(F.col("cols"), F.col("rows"), F.col("mode"))
    return plans.select("p_partkey", "mode", cols.alias("cols"), rows.alias("rows"), F.col("cols").alias("from_cols"), F.col("rows").alias("from_rows"))


@query("SELECT round(min(x) - 5000 / {1}, 9) AS xmin, round(min(y) - 5000 / {0}, 9) AS ymin, round(max(x) + 5000 / {1}, 9) AS xmax, round(max(y) + 5000 / {0}, 9) AS ymax FROM (SELECT 15 + s_nationkey / 100.0::DOUBLE AS x, 50 + s_nationkey / 200.0::DOUBLE AS y FROM supplier)".format(*metres_sql("((min(y) + max(y)) / 2)")))
def buffered_bbox(spark, sf_dir):
    pts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((15 + F.col("s_nationkey") / 100).alias("x"), (50 + F.col("s_nationkey") / 200).alias("y"))
    return regrid.buffered_bbox(pts, 5).select(*[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {PART} SELECT (r // 2)::INT AS r, (c // 2)::INT AS c, avg(z) AS z FROM cells GROUP BY ALL")
def overview_avg(spark, sf_dir):
    return wetness.overview(view(spark, sf_dir, "dem_part")[0])


# --- stencils --------------------------------------------------------------------------------------


@query(f"WITH {VOID}, {BASE} SELECT r, c, count(nz) AS n, min(nz) AS low, max(nz) AS high FROM pairs GROUP BY r, c")
def neighbour_stats(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    n = [F.col(f"n{k}") for k in range(8)]
    return neighbours(cells).select("r", "c", sum(x.isNotNull().cast("long") for x in n).alias("n"), F.least(*n).alias("low"), F.greatest(*n).alias("high"))


@query(f"WITH {PART}, {SIZE} SELECT r, c FROM cells WHERE {EDGE}")
def edge_cells(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part")
    return cells.filter(is_edge(meta)).select("r", "c")


@query(f"WITH {VOID}, {BASE} SELECT r, c, any_value(z) AS z FROM pairs WHERE z IS NOT NULL GROUP BY r, c HAVING count(nz) < 8")
def fill_seeds_nodata(spark, sf_dir):
    return conditioning.seeds(*view(spark, sf_dir, "dem_part", void=True))


@query(f"WITH {VOID}, {SIZE} SELECT r, c, z FROM cells WHERE z IS NOT NULL AND {EDGE}")
def fill_seeds(spark, sf_dir):
    return conditioning.seeds(*view(spark, sf_dir, "dem_part", void=True), nodata_outlets=False)


CAND = "cand AS (SELECT r, c, any_value(z) AS z, coalesce(bool_and(nz >= z), true) AND any_value(z) IS NOT NULL AS candidate, coalesce(bool_or(nz > z), false) AS higher FROM pairs GROUP BY r, c)"
MARKS = f"""{CAND}, marks AS (SELECT a.r, a.c, a.z, a.candidate, (a.z IS NOT NULL AND ((a.candidate AND (a.r = 0 OR a.c = 0 OR a.r = (SELECT h FROM size) - 1 OR a.c = (SELECT w FROM size) - 1)) OR (NOT a.candidate AND EXISTS (SELECT 1 FROM cand b WHERE b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (b.r <> a.r OR b.c <> a.c) AND b.candidate AND b.z = a.z)))) AS low, a.candidate AND a.higher AS high FROM cand a)"""


@query(f"WITH {VOID}, {BASE}, {MARKS} SELECT r, c, candidate, low, high FROM marks")
def flat_edges(spark, sf_dir):
    return conditioning.flat_cells(*view(spark, sf_dir, "dem_part", void=True)).select("r", "c", "candidate", "low", "high")


@query(f"""WITH {VOID}, {BASE} SELECT p.r, p.c, round(CASE WHEN any_value(p.z) IS NOT NULL THEN degrees(atan(sqrt(
power((max(nz) FILTER (k = 1) - max(nz) FILTER (k = 5)) / (2 * any_value({DX})), 2) + power((max(nz) FILTER (k = 7) - max(nz) FILTER (k = 3)) / (2 * any_value({DY})), 2)))) END, 6) AS slope_deg FROM pairs p GROUP BY p.r, p.c""")
def slope_deg(spark, sf_dir):
    return wetness.slope_degrees(*view(spark, sf_dir, "dem_part", void=True)).select("r", "c", F.round("slope_deg", 6).alias("slope_deg"))


# --- direction and graphs ----------------------------------------------------------------------------

D8 = "drops AS (SELECT r, c, z, k, CASE WHEN nz < z THEN (z - nz) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END END AS t FROM pairs), d8 AS (SELECT r, c, CASE WHEN any_value(z) IS NULL AND count(z) = 0 THEN -1 ELSE coalesce(arg_min(k, k) FILTER (t = best), -2) END::SMALLINT AS dir FROM (SELECT *, max(t) OVER (PARTITION BY r, c) AS best FROM drops) GROUP BY r, c)"
MFD = "parts AS (SELECT r, c, k, CASE WHEN nz < z THEN CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) / 4 * ((z - nz) / sqrt(2.0::DOUBLE)) ELSE 0.5 * (z - nz) END ELSE 0.0::DOUBLE END AS p FROM pairs), mfd AS (SELECT r, c, k, CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 0 END::FLOAT AS w FROM parts WINDOW w AS (PARTITION BY r, c))"
EDGES8 = "edges AS (SELECT d.r, d.c, d.dir::INT AS k, d.r + x.dr AS nr, d.c + x.dc AS nc FROM d8 d JOIN dirs x ON x.k = d.dir JOIN cells v ON v.r = d.r + x.dr AND v.c = d.c + x.dc AND v.z IS NOT NULL)"


def _d8(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    return cells, meta, routing.d8(cells, meta, UNIT)


@query(f"WITH {VOID}, {BASE}, {D8} SELECT r, c, dir FROM d8")
def flow_dir_d8(spark, sf_dir):
    return _d8(spark, sf_dir)[2]


@query(f"WITH {VOID}, {BASE}, {D8} SELECT dir, count(*) AS n FROM d8 GROUP BY dir")
def d8_code_hist(spark, sf_dir):
    return _d8(spark, sf_dir)[2].groupBy("dir").agg(F.count("*").alias("n"))


@query(f"WITH {VOID}, {BASE}, {D8}, {EDGES8} SELECT r, c, k, nr, nc FROM edges")
def flow_edges_d8(spark, sf_dir):
    cells, _, flow = _d8(spark, sf_dir)
    return routing.flow_edges(flow, cells.filter("z is not null")).select("r", "c", "k", "nr", "nc")


@query(f"WITH {VOID}, {BASE}, {D8}, {EDGES8} SELECT nr AS r, nc AS c, count(*) AS indeg FROM edges GROUP BY nr, nc")
def flow_indegree(spark, sf_dir):
    cells, _, flow = _d8(spark, sf_dir)
    return routing.indegree(routing.flow_edges(flow, cells.filter("z is not null")))


@query(f"WITH {VOID}, {BASE}, {D8}, {EDGES8} SELECT r, c FROM cells WHERE z IS NOT NULL AND (r, c) NOT IN (SELECT (nr, nc) FROM edges)")
def flow_sources(spark, sf_dir):
    cells, _, flow = _d8(spark, sf_dir)
    valid = cells.filter("z is not null")
    return routing.sources(valid, routing.flow_edges(flow, valid))


@query(f"WITH {VOID}, {BASE}, {MFD} SELECT r, c, k, round(w::DOUBLE, 5) AS w FROM mfd")
def flow_dir_mfd(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    return routing.mfd(cells, meta, steps=UNIT).select("r", "c", F.posexplode("w").alias("k", "w")).select("r", "c", "k", F.round(F.col("w").cast("double"), 5).alias("w"))


@query(f"WITH {VOID}, {BASE}, {MFD} SELECT r, c, round(sum(w::DOUBLE), 4) AS total FROM mfd GROUP BY r, c")
def mfd_weight_sum(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    return routing.mfd(cells, meta, steps=UNIT).select("r", "c", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# --- fixed points ------------------------------------------------------------------------------------

FILL = f"""flood(r, c, w) USING KEY (r, c) AS (
SELECT r, c, any_value(z) FROM pairs WHERE z IS NOT NULL GROUP BY r, c HAVING count(nz) < 8
UNION SELECT n.r, n.c, min(greatest(n.z, f.w)) FROM flood f JOIN cells n ON n.r BETWEEN f.r - 1 AND f.r + 1 AND n.c BETWEEN f.c - 1 AND f.c + 1 AND n.z IS NOT NULL
LEFT JOIN recurring.flood o ON o.r = n.r AND o.c = n.c WHERE o.w IS NULL OR greatest(n.z, f.w) < o.w GROUP BY n.r, n.c)"""


@query(f"WITH RECURSIVE {VOID}, {BASE}, {FILL} SELECT c.r, c.c, c.z, coalesce(f.w, c.z) AS filled FROM cells c LEFT JOIN flood f ON f.r = c.r AND f.c = c.c")
def fill_depressions(spark, sf_dir):
    return conditioning.fill_depressions(*view(spark, sf_dir, "dem_part", void=True))


@query(f"WITH RECURSIVE {VOID}, {BASE}, {FILL} SELECT c.r, c.c, coalesce(f.w, c.z) - c.z AS depth FROM cells c LEFT JOIN flood f ON f.r = c.r AND f.c = c.c")
def fill_depth(spark, sf_dir):
    return conditioning.fill_depth(conditioning.fill_depressions(*view(spark, sf_dir, "dem_part", void=True)))


#: The filled grid takes the name ``cells`` for the stages after it.
FILLED = FILL.replace("pairs", "pairs0").replace("cells", "raw")
CHAIN_BASE = f"""solid AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::DOUBLE AS z FROM part), raw AS (SELECT r, c, CASE WHEN NOT {HOLE} THEN z END AS z FROM solid),
{DIRS}, pairs0 AS (SELECT a.r, a.c, a.z, d.k, b.z AS nz FROM raw a CROSS JOIN dirs d LEFT JOIN raw b ON b.r = a.r + d.dr AND b.c = a.c + d.dc), {FILLED},
cells AS (SELECT x.r, x.c, coalesce(f.w, x.z) AS z FROM raw x LEFT JOIN flood f ON f.r = x.r AND f.c = x.c), {SIZE}, {PAIRS}"""
LABELS = """grow(r, c, l) USING KEY (r, c) AS (SELECT r, c, r * (SELECT w FROM size) + c FROM marks WHERE low
UNION SELECT n.r, n.c, min(f.l) FROM grow f JOIN cells s ON s.r = f.r AND s.c = f.c JOIN cells n ON n.r BETWEEN f.r - 1 AND f.r + 1 AND n.c BETWEEN f.c - 1 AND f.c + 1 AND n.z = s.z
LEFT JOIN recurring.grow o ON o.r = n.r AND o.c = n.c WHERE o.l IS NULL OR f.l < o.l GROUP BY n.r, n.c),
flat AS (SELECT m.*, g.l AS root, CASE WHEN g.l IS NOT NULL THEN dense_rank() OVER (ORDER BY g.l NULLS LAST) END::INT AS label FROM marks m LEFT JOIN grow g ON g.r = m.r AND g.c = m.c)"""


def _bfs(name: str, source: str) -> str:
    return f"""{name}(r, c, d) USING KEY (r, c) AS (SELECT r, c, 1 FROM flat WHERE {source}
UNION SELECT n.r, n.c, min(f.d + 1) FROM {name} f JOIN flat s ON s.r = f.r AND s.c = f.c JOIN flat n ON n.r BETWEEN f.r - 1 AND f.r + 1 AND n.c BETWEEN f.c - 1 AND f.c + 1 AND n.candidate AND n.root = s.root
LEFT JOIN recurring.{name} o ON o.r = n.r AND o.c = n.c WHERE o.d IS NULL OR f.d + 1 < o.d GROUP BY n.r, n.c)"""


GRADIENTS = f"""{_bfs('up', 'high AND root IS NOT NULL AND NOT low')}, {_bfs('down', 'low')},
tops AS (SELECT f.root, max(u.d) AS top FROM flat f JOIN up u ON u.r = f.r AND u.c = f.c GROUP BY f.root),
masks AS (SELECT f.*, coalesce(CASE WHEN d.d IS NULL THEN -coalesce(u.d, 0) WHEN u.d IS NOT NULL THEN t.top - u.d + 2 * d.d ELSE 2 * d.d END, 0)::INT AS flat_mask
FROM flat f LEFT JOIN up u ON u.r = f.r AND u.c = f.c LEFT JOIN down d ON d.r = f.r AND d.c = f.c LEFT JOIN tops t ON t.root = f.root),
resolved AS (SELECT *, CASE WHEN label IS NOT NULL AND flat_mask > 0 THEN z + 1e-5::DOUBLE * flat_mask ELSE z END AS resolved FROM masks)"""


def _filled(spark, sf_dir, size=TILE):
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    filled = conditioning.fill_depressions(cells, meta, size=size)
    return filled.select("r", "c", F.col("filled").alias("z")), meta


@query(f"WITH RECURSIVE {CHAIN_BASE}, {MARKS}, {LABELS} SELECT r, c, label FROM flat")
def flat_labels(spark, sf_dir):
    return conditioning.flats(*_filled(spark, sf_dir)).select("r", "c", "label")


@query(f"WITH RECURSIVE {CHAIN_BASE}, {MARKS}, {LABELS}, {GRADIENTS} SELECT r, c, label, flat_mask, round(resolved, 9) AS resolved FROM resolved")
def resolve_flats(spark, sf_dir):
    return conditioning.resolve_flats(*_filled(spark, sf_dir)).select("r", "c", "label", "flat_mask", F.round("resolved", 9).alias("resolved"))


@query(f"""WITH RECURSIVE {CHAIN_BASE}, {MARKS}, {LABELS} SELECT max(label)::BIGINT AS n_flats, count(label) AS n_flat_cells, count(*) FILTER (low) AS n_low_edges,
count(*) FILTER (high AND label IS NOT NULL AND NOT low) AS n_high_edges, count(*) FILTER (high AND label IS NULL) AS removed_highedges_unlabeled, count(*) FILTER (high AND label IS NOT NULL AND low) AS removed_highedges_low_dominates FROM flat""")
def flat_stats(spark, sf_dir):
    return conditioning.flat_stats(conditioning.resolve_flats(*_filled(spark, sf_dir))).drop("note_undrainable_flats")


#: Directions and accumulation on the resolved surface; it takes the name ``cells`` in turn.
ROUTED = f"""{CHAIN_BASE}, {MARKS}, {LABELS}, {GRADIENTS}, surface AS (SELECT r, c, resolved AS z FROM resolved),
pairs2 AS (SELECT a.r, a.c, a.z, d.k, d.dr, d.dc, b.r AS nr, b.c AS nc, b.z AS nz FROM surface a CROSS JOIN dirs d LEFT JOIN surface b ON b.r = a.r + d.dr AND b.c = a.c + d.dc)"""
ACC8 = D8.replace("pairs", "pairs2") + """, edges AS (SELECT d.r, d.c, d.r + x.dr AS nr, d.c + x.dc AS nc, 1.0::DOUBLE AS w FROM d8 d JOIN dirs x ON x.k = d.dir JOIN surface v ON v.r = d.r + x.dr AND v.c = d.c + x.dc AND v.z IS NOT NULL)"""
ACCM = MFD.replace("pairs", "pairs2") + """, edges AS (SELECT d.r, d.c, d.r + x.dr AS nr, d.c + x.dc AS nc, d.w::DOUBLE AS w FROM mfd d JOIN dirs x ON x.k = d.k JOIN surface v ON v.r = d.r + x.dr AND v.c = d.c + x.dc AND v.z IS NOT NULL WHERE d.w > 0)"""
FLUX = """flux AS (SELECT r, c, {mass} AS m, 0 AS step FROM surface WHERE z IS NOT NULL UNION ALL SELECT e.nr, e.nc, sum(f.m * e.w), any_value(f.step) + 1 FROM flux f JOIN edges e ON e.r = f.r AND e.c = f.c GROUP BY e.nr, e.nc),
acc AS (SELECT s.r, s.c, coalesce(sum(f.m), 0) AS acc FROM surface s LEFT JOIN flux f ON f.r = s.r AND f.c = s.c GROUP BY s.r, s.c)"""


def _accumulated(spark, sf_dir, method, out="cells", steps=UNIT, size=TILE):
    surface, meta = _filled(spark, sf_dir, size)
    drained = materialize(conditioning.resolve_flats(surface, meta, size=size).select("r", "c", F.col("resolved").alias("z")))  # read twice
    flow = routing.route(drained, meta, method, steps).join(drained, ["r", "c"]).withColumn("area_m2", geo.pixel_area(meta))
    return routing.accumulate(flow, meta, out, size), meta


@query(f"WITH RECURSIVE {ROUTED}, {ACC8}, {FLUX.format(mass='1.0::DOUBLE')} SELECT r, c, acc FROM acc")
def flow_acc_d8_cells(spark, sf_dir):
    return _accumulated(spark, sf_dir, "d8")[0]


@query(f"WITH RECURSIVE {ROUTED}, {ACC8}, {FLUX.format(mass=f'({DX} * {DY})')} SELECT r, c, round(acc * 1e-6, 8) AS acc FROM acc")
def flow_acc_d8_km2(spark, sf_dir):
    return _accumulated(spark, sf_dir, "d8", "km2")[0].select("r", "c", F.round("acc", 8).alias("acc"))


@query(f"WITH RECURSIVE {ROUTED}, {ACCM}, {FLUX.format(mass='1.0::DOUBLE')} SELECT r, c, round(acc, 3) AS acc FROM acc")
def flow_acc_mfd_cells(spark, sf_dir):
    return _accumulated(spark, sf_dir, "mfd_quinn_1991")[0].select("r", "c", F.round("acc", 3).alias("acc"))


# --- wetness, clip, statistics -------------------------------------------------------------------------


@query("SELECT p_partkey, round(CASE WHEN acc > 0 THEN ln(acc / tan(radians(greatest(slope, 0.1)))) END, 9) AS twi FROM (SELECT p_partkey, (p_size - 5) / 10.0::DOUBLE AS acc, (p_partkey % 40)::DOUBLE AS slope FROM part)")
def twi(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ((F.col("p_size") - 5) / 10).alias("acc"), (F.col("p_partkey") % 40).cast("double").alias("slope"))
    return part.select("p_partkey", F.round(wetness.twi(F.col("acc"), F.col("slope")), 9).alias("twi"))


SLOPE = f"""pairs3 AS (SELECT a.r, a.c, a.z, d.k, b.z AS nz FROM raw a CROSS JOIN dirs d LEFT JOIN raw b ON b.r = a.r + d.dr AND b.c = a.c + d.dc),
slope AS (SELECT r, c, CASE WHEN any_value(z) IS NOT NULL THEN degrees(atan(sqrt(power((max(nz) FILTER (k = 1) - max(nz) FILTER (k = 5)) / (2 * any_value({DX})), 2) + power((max(nz) FILTER (k = 7) - max(nz) FILTER (k = 3)) / (2 * any_value({DY})), 2)))) END AS s FROM pairs3 GROUP BY r, c)"""


@query(f"WITH RECURSIVE {ROUTED}, {ACC8}, {FLUX.format(mass=f'({DX} * {DY})')}, {SLOPE} SELECT a.r, a.c, round(CASE WHEN acc > 0 AND s IS NOT NULL THEN ln(acc * 1e-6 / tan(radians(greatest(s, 0.1)))) END, 6) AS twi FROM acc a JOIN slope USING (r, c)")
def twi_pipeline_d8(spark, sf_dir):
    acc, meta = _accumulated(spark, sf_dir, "d8", "km2")
    slope = wetness.slope_degrees(view(spark, sf_dir, "dem_part", void=True)[0], meta)
    return acc.join(slope, ["r", "c"]).select("r", "c", F.round(wetness.twi(F.col("acc"), F.col("slope_deg")), 6).alias("twi"))


#: Weights by metres on the ellipsoid, of which the steps of a row are its centre's.
MFD_METRIC = f"parts AS (SELECT r, c, k, CASE WHEN nz < z THEN CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) / 4 * ((z - nz) / sqrt({DX} * {DX} + {DY} * {DY})) ELSE 0.5 * ((z - nz) / CASE WHEN dc <> 0 THEN {DX} ELSE {DY} END) END ELSE 0.0::DOUBLE END AS p FROM pairs), mfd AS (SELECT r, c, k, CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 0 END::FLOAT AS w FROM parts WINDOW w AS (PARTITION BY r, c))"
ACC_METRIC = ACCM.replace(MFD.replace("pairs", "pairs2"), MFD_METRIC.replace("pairs", "pairs2"))


@query(f"WITH RECURSIVE {ROUTED}, {ACC_METRIC}, {FLUX.format(mass=f'({DX} * {DY})')}, {SLOPE} SELECT a.r, a.c, round(CASE WHEN acc > 0 AND s IS NOT NULL THEN ln(acc * 1e-6 / tan(radians(greatest(s, 0.1)))) END, 6) AS twi FROM acc a JOIN slope USING (r, c)")
def twi_pipeline_mfd(spark, sf_dir):
    """The default run: multiple flow by metric steps, areas in km2."""
    return pipeline.run(*view(spark, sf_dir, "dem_part", void=True)).twi.select("r", "c", F.round("twi", 6).alias("twi"))


@query(f"""WITH {PART}, edges(x1, y1, x2, y2) AS (VALUES (5.5::DOUBLE, 5.5::DOUBLE, 30.2::DOUBLE, 8.1::DOUBLE), (30.2, 8.1, 25.7, 33.4), (25.7, 33.4, 7.3, 28.9), (7.3, 28.9, 5.5, 5.5)),
box AS (SELECT * FROM cells WHERE r BETWEEN 5 AND 33 AND c BETWEEN 5 AND 30),
judged AS (SELECT r, c, any_value(z) AS z, count(*) FILTER ((y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / (y2 - y1) + x1) % 2 = 1 AS inside,
bool_or(greatest(0, least((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)), least((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1))) <= least(1, greatest((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)), greatest((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1)))) AS met
FROM box CROSS JOIN edges GROUP BY r, c) SELECT r, c, CASE WHEN inside OR met THEN z END AS z FROM judged""")
def clip_polygon(spark, sf_dir):
    cells, meta = view(spark, sf_dir, "dem_part")
    return wetness.clip(cells, meta, AOI)


@query(f"WITH {VOID} SELECT count(z) AS n, round(avg(z) - 2 * stddev_pop(z), 6) AS lo, round(avg(z) + 2 * stddev_pop(z), 6) AS hi FROM cells")
def stretch_sigma(spark, sf_dir):
    return wetness.sigma_stretch(view(spark, sf_dir, "dem_part", void=True)[0]).select("n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {VOID} SELECT count(z) AS n, round(greatest(avg(z) - 2 * stddev_pop(z), quantile_cont(z, 0.05)), 6) AS lo, round(least(avg(z) + 2 * stddev_pop(z), quantile_cont(z, 0.95)), 6) AS hi FROM cells")
def stretch_sigma_clamped(spark, sf_dir):
    return wetness.sigma_stretch(view(spark, sf_dir, "dem_part", void=True)[0], clamp=(5, 95)).select("n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {VOID} SELECT count(z) AS n, round(quantile_cont(z, 0.02), 6) AS lo, round(quantile_cont(z, 0.98), 6) AS hi FROM cells")
def stretch_percentile(spark, sf_dir):
    return wetness.percentile_stretch(view(spark, sf_dir, "dem_part", void=True)[0]).select("n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {VOID} SELECT r, c, least(greatest(floor((z - 10) / 30.0 * 16), 0), 15)::INT AS bin FROM cells WHERE z IS NOT NULL UNION ALL SELECT r, c, NULL FROM cells WHERE z IS NULL")
def stretch_bins(spark, sf_dir):
    return view(spark, sf_dir, "dem_part", void=True)[0].select("r", "c", wetness.stretched(F.col("z"), 10.0, 40.0, 16).alias("bin"))


@query(f"WITH {VOID} SELECT (r // 10)::INT AS zone, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, min(z) AS low, max(z) AS high FROM cells GROUP BY ALL")
def zonal_stats(spark, sf_dir):
    s = wetness.zonal_stats(view(spark, sf_dir, "dem_part", void=True)[0], (F.col("r") / 10).cast("int"))
    return s.select("zone", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high")


# --- several tiles, default steps, and what is left of the library ---------------------------------------

ORDERS = f"solid AS (SELECT (o_orderkey // 100)::INT AS r, (o_orderkey % 100)::INT AS c, round(o_totalprice / 1000) AS z FROM orders), cells AS (SELECT r, c, CASE WHEN NOT {HOLE} THEN z END AS z FROM solid)"


@query(ORACLE_SQL["resample_nearest_whole"].replace(VOID, ORDERS))
def resample_nearest(spark, sf_dir):
    return _resampled_whole(spark, sf_dir, "nearest", "dem_orders")


@query(ORACLE_SQL["resample_bilinear_whole"].replace(VOID, ORDERS))
def resample_bilinear(spark, sf_dir):
    return _resampled_whole(spark, sf_dir, "bilinear", "dem_orders").select("r", "c", F.round("z", 6).alias("z"))


#: Edge of tiles so small that a grid of any size has many.
SMALL = 16


@query(f"WITH RECURSIVE {ORDERS}, {BASE}, {FILL} SELECT c.r, c.c, c.z, coalesce(f.w, c.z) AS filled FROM cells c LEFT JOIN flood f ON f.r = c.r AND f.c = c.c")
def fill_depressions_tiles(spark, sf_dir):
    return conditioning.fill_depressions(*view(spark, sf_dir, "dem_orders", void=True), size=SMALL * 2)


@query(ORACLE_SQL["resolve_flats"])
def resolve_flats_tiles(spark, sf_dir):
    return conditioning.resolve_flats(*_filled(spark, sf_dir, SMALL), size=SMALL).select("r", "c", "label", "flat_mask", F.round("resolved", 9).alias("resolved"))


@query(ORACLE_SQL["flow_acc_d8_cells"])
def flow_acc_d8_tiles(spark, sf_dir):
    return _accumulated(spark, sf_dir, "d8", size=SMALL)[0]


@query(ORACLE_SQL["flow_acc_mfd_cells"])
def flow_acc_mfd_tiles(spark, sf_dir):
    return _accumulated(spark, sf_dir, "mfd_quinn_1991", size=SMALL)[0].select("r", "c", F.round("acc", 3).alias("acc"))


@query(f"WITH RECURSIVE {ROUTED}, {ACC8}, {FLUX.format(mass=f'({DX} * {DY})')} SELECT r, c, round(acc, 2) AS acc FROM acc")
def flow_acc_d8_m2(spark, sf_dir):
    return _accumulated(spark, sf_dir, "d8", "m2")[0].select("r", "c", F.round("acc", 2).alias("acc"))


@query(f"WITH RECURSIVE {ROUTED}, {ACC8}, {FLUX.format(mass='1.0::DOUBLE')} SELECT sum(acc) AS leaves, (SELECT count(*) FROM surface WHERE z IS NOT NULL)::DOUBLE AS valid FROM acc a JOIN surface s USING (r, c) WHERE s.z IS NOT NULL AND (r, c) NOT IN (SELECT (r, c) FROM edges)")
def outlet_mass(spark, sf_dir):
    """What leaves the grid by single flow is what it holds."""
    surface, meta = _filled(spark, sf_dir)
    drained = conditioning.resolve_flats(surface, meta).select("r", "c", F.col("resolved").alias("z"))
    flow = routing.d8(drained, meta, UNIT).join(drained, ["r", "c"])
    valid = flow.filter("z is not null")
    inner = routing.flow_edges(flow.select("r", "c", "dir"), valid).select("r", "c", F.lit(True).alias("inner"))
    held = routing.accumulate(flow, meta).join(valid.select("r", "c"), ["r", "c"]).join(inner, ["r", "c"], "left")
    return held.agg(F.sum(F.when(F.col("inner").isNull(), F.col("acc"))).alias("leaves"), F.count("*").cast("double").alias("valid"))


@query(f"WITH {VOID}, {BASE}, {D8} SELECT r, c, dir FROM d8".replace("sqrt(2.0::DOUBLE)", "sqrt(2 * power(1 / 3600.0::DOUBLE, 2))").replace("ELSE 1.0::DOUBLE", "ELSE 1 / 3600.0::DOUBLE"))
def flow_dir_d8_crs(spark, sf_dir):
    """Default steps: units of the coordinate system."""
    return routing.d8(*view(spark, sf_dir, "dem_part", void=True))


@query(f"WITH {VOID}, {BASE}, {MFD_METRIC} SELECT r, c, k, round(w::DOUBLE, 5) AS w FROM mfd")
def flow_dir_mfd_metric(spark, sf_dir):
    """Default steps: metres on the ellipsoid."""
    return routing.mfd(*view(spark, sf_dir, "dem_part", void=True)).select("r", "c", F.posexplode("w").alias("k", "w")).select("r", "c", "k", F.round(F.col("w").cast("double"), 5).alias("w"))


def _weights(spark, sf_dir, **how):
    return routing.mfd(*view(spark, sf_dir, "dem_part", void=True), **how).select("r", "c", F.posexplode("w").alias("k", "w")).select("r", "c", "k", F.round(F.col("w").cast("double"), 5).alias("w"))


@query(f"WITH {VOID}, {BASE}, {MFD} SELECT r, c, k, round(w::DOUBLE, 5) AS w FROM mfd".replace("WHEN nz < z THEN", "WHEN (z - nz) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END > 5 THEN"))
def flow_dir_mfd_min_slope(spark, sf_dir):
    return _weights(spark, sf_dir, steps=UNIT, min_slope=5.0)


@query(f"WITH {VOID}, {BASE}, {MFD} SELECT r, c, k, round(w::DOUBLE, 5) AS w FROM mfd".replace("sqrt(2.0::DOUBLE) / 4 * ((z - nz) / sqrt(2.0::DOUBLE))", "sqrt(2.0::DOUBLE) / 4 * ((z - nz) / sqrt(2 * power(1 / 3600.0::DOUBLE, 2)))").replace("0.5 * (z - nz)", "0.5 * ((z - nz) / (1 / 3600.0::DOUBLE))"))
def flow_dir_mfd_projected(spark, sf_dir):
    """Steps in units of the coordinate system, as for a projected grid."""
    return _weights(spark, sf_dir, metric=False)


BLOCK = "solid AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::DOUBLE AS z FROM part), cells AS (SELECT r, c, CASE WHEN NOT (r % 4 IN (0, 3) OR c % 10 IN (3, 8)) THEN z END AS z FROM solid)"
EDGE_FILL = FILL.replace("GROUP BY r, c HAVING count(nz) < 8", "AND (r = 0 OR c = 0 OR r = (SELECT h FROM size) - 1 OR c = (SELECT w FROM size) - 1) GROUP BY r, c")


def _blocks(spark, sf_dir):
    """The whole grid cut into blocks by NoData; those off the edge touch neither it nor another block."""
    cells, meta = view(spark, sf_dir, "dem_part")
    hole = (F.col("r") % 4).isin(0, 3) | (F.col("c") % 10).isin(3, 8)
    return cells.withColumn("z", F.when(~hole, F.col("z"))), meta


@query(f"WITH RECURSIVE {BLOCK}, {BASE}, {EDGE_FILL} SELECT c.r, c.c, c.z, coalesce(f.w, c.z) AS filled FROM cells c LEFT JOIN flood f ON f.r = c.r AND f.c = c.c")
def fill_unseeded(spark, sf_dir):
    """A component without an outlet stays as it is."""
    return conditioning.fill_depressions(*_blocks(spark, sf_dir), nodata_outlets=False)


@query(f"WITH {VOID}, {BASE} SELECT r, c FROM pairs p WHERE z IS NOT NULL AND nz IS NULL AND nr IS NOT NULL GROUP BY r, c")
def nodata_adjacent(spark, sf_dir):
    """Valid cells beside NoData within the grid."""
    cells, _ = view(spark, sf_dir, "dem_part", void=True)
    beside = neighbours(cells.withColumn("hole", F.col("z").isNull().cast("int")), "hole")
    return beside.filter(F.col("z").isNotNull() & (F.greatest(*[F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(8)]) == 1)).select("r", "c")


UNDRAINED = """solid AS (SELECT p_partkey, (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c FROM part), cells AS (SELECT r, c, CASE WHEN r % 8 BETWEEN 2 AND 5 AND c % 8 BETWEEN 2 AND 5 AND r < (SELECT max(r) FROM solid) AND c < 49
THEN CASE WHEN r % 8 BETWEEN 3 AND 4 AND c % 8 BETWEEN 3 AND 4 THEN 1.0::DOUBLE ELSE 5.0 + (p_partkey % 2) END END AS z FROM solid)"""


@query(f"""WITH {UNDRAINED}, {BASE}, {CAND} SELECT 0::BIGINT AS n_flats, 0::BIGINT AS n_flat_cells, 0::BIGINT AS n_low_edges, count(*) FILTER (candidate AND higher) AS n_high_edges, 0::BIGINT AS removed_highedges_unlabeled,
0::BIGINT AS removed_highedges_low_dominates, (count(*) FILTER (candidate AND higher) > 0)::INT AS note_undrainable_flats FROM cand""")
def flat_stats_undrained(spark, sf_dir):
    """Pits all over the grid that drain nowhere: no flat, and a note."""
    cells, meta = view(spark, sf_dir, "dem_part")
    inner = F.col("r") % 8
    across = F.col("c") % 8
    ring = inner.between(2, 5) & across.between(2, 5) & (F.col("r") < meta.height - 1) & (F.col("c") < meta.width - 1)
    pit = inner.between(3, 4) & across.between(3, 4)
    raised = cells.withColumn("z", F.when(ring, F.when(pit, 1.0).otherwise(5.0 + (F.col("r") * 50 + F.col("c")) % 2)))
    return conditioning.flat_stats(conditioning.resolve_flats(raised, meta))


@query(f"""WITH {VOID}, {WHOLE}, p AS (SELECT r, c, (0.3 + 0.8 * (c + 0.5)) - 0.5 AS x, (1.1 + 0.75 * (r + 0.5)) - 0.5 AS y FROM t),
n AS (SELECT p.*, floor(x)::INT + dx AS sc, floor(y)::INT + dy AS sr FROM p, range(-1, 3) a(dx), range(-1, 3) b(dy)),
k AS (SELECT *, CASE WHEN abs(x - sc) <= 1 THEN 1.5 * power(abs(x - sc), 3) - 2.5 * power(x - sc, 2) + 1 WHEN abs(x - sc) < 2 THEN -0.5 * power(abs(x - sc), 3) + 2.5 * power(x - sc, 2) - 4 * abs(x - sc) + 2 ELSE 0 END
* CASE WHEN abs(y - sr) <= 1 THEN 1.5 * power(abs(y - sr), 3) - 2.5 * power(y - sr, 2) + 1 WHEN abs(y - sr) < 2 THEN -0.5 * power(abs(y - sr), 3) + 2.5 * power(y - sr, 2) - 4 * abs(y - sr) + 2 ELSE 0 END AS w FROM n)
SELECT k.r, k.c, round(CASE WHEN count(*) = count(s.z) THEN sum(k.w * s.z) END, 10) AS z FROM k LEFT JOIN cells s ON s.r = k.sr AND s.c = k.sc WHERE abs(k.w) > 1e-12 GROUP BY k.r, k.c""")
def resample_bicubic(spark, sf_dir):
    return _resampled_whole(spark, sf_dir, "bicubic").select("r", "c", F.round("z", 10).alias("z"))


@query(f"""WITH {PART}, {SIZE}, boxes AS (SELECT s_suppkey, 0.2 + s_suppkey * 7 % 50 AS x0, 0.5 + s_suppkey * 7 % 50 + s_nationkey AS x1, 0.4 + s_suppkey * 3 % 40 AS y0, 0.5 + s_suppkey * 3 % 40 + s_nationkey AS y1 FROM supplier),
cut AS (SELECT s_suppkey, greatest(floor(x0), 0)::INT AS c0, least(ceil(x1), w)::INT AS c1, greatest(floor(y0), 0)::INT AS r0, least(ceil(y1), h)::INT AS r1 FROM boxes, size)
SELECT s_suppkey, c0 AS col_off, r0 AS row_off, c1 - c0 AS width, r1 - r0 AS height, round(15 + c0 / 3600.0::DOUBLE, 9) AS xmin, round(50 - r1 / 3600.0::DOUBLE, 9) AS ymin, round(15 + c1 / 3600.0::DOUBLE, 9) AS xmax, round(50 - r0 / 3600.0::DOUBLE, 9) AS ymax
FROM cut WHERE c1 > c0 AND r1 > r0""")
def snapped_region(spark, sf_dir):
    """The window of cells of each supplier's region, and the region widened to their borders."""
    _, meta = view(spark, sf_dir, "dem_part")
    key, more = F.col("s_suppkey"), F.col("s_nationkey")
    x0, y0 = 0.2 + key * 7 % 50, 0.4 + key * 3 % 40
    at = lambda x: meta.c + meta.a * x
    down = lambda y: meta.f + meta.e * y
    boxes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", at(x0).alias("xmin"), at(0.5 + key * 7 % 50 + more).alias("xmax"), down(0.5 + key * 3 % 40 + more).alias("ymin"), down(y0).alias("ymax"))
    cut = regrid.crop_columns(boxes, meta)
    return cut.select("s_suppkey", "col_off", "row_off", "width", "height", *[F.round(x, 9).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {VOID} SELECT round(sum({DX} * {DY}) / 1e4, 4) AS area_ha FROM cells WHERE z IS NOT NULL")
def area_ha(spark, sf_dir):
    return regrid.area_hectares(*view(spark, sf_dir, "dem_part", void=True)).select(F.round("area_ha", 4).alias("area_ha"))


@query(f"WITH {PART} SELECT a.r, a.c, a.z, b.z / 1e8 AS reference FROM cells a LEFT JOIN cells b ON b.r = a.r + 2 AND b.c = a.c")
def reference_join(spark, sf_dir):
    cells, _ = view(spark, sf_dir, "dem_part")
    return regrid.reference_layer(cells, cells, "reference", 1e8, 2)


@query("SELECT r, c, max_by(z, p) FILTER (z IS NOT NULL) AS z FROM (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS z, 2 AS p FROM part UNION ALL SELECT (p_partkey // 50)::INT, (p_partkey % 50)::INT, 100.0 + p_size, 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY r, c")
def scan_images(spark, sf_dir):
    """Two images of a dataset, each with a quality band beside its elevation."""
    cells, _ = view(spark, sf_dir, "dem_part")
    key = F.col("r") * 50 + F.col("c")
    top = cells.select("r", "c", F.lit(2).alias("priority"), F.create_map(F.lit("QA"), F.lit(1.0), F.lit("DEM"), F.when(key % 7 != 0, F.col("z")).otherwise(float("nan"))).alias("bands"))
    low = cells.filter(key % 2 == 0).select("r", "c", F.lit(1).alias("priority"), F.create_map(F.lit("QA"), F.lit(1.0), F.lit("DEM"), F.col("z") + 100).alias("bands"))
    return scan_band(top.unionByName(low), "GLO30")


@query(f"""WITH {CATALOGUE}, asked AS (SELECT p_partkey, ['flow_acc', 'twi', 'dem', 'slope', 'mask'][p_partkey % 5 + 1] AS layer, id, CASE WHEN p_size % 2 = 0 THEN 'd8' ELSE 'mfd_quinn_1991' END AS flow FROM part JOIN datasets ON place = p_size % 9)
SELECT p_partkey, layer, CASE WHEN layer IN ('flow_acc', 'twi') THEN layer || '_' || id || '_' || flow WHEN layer IN ('dem', 'slope') THEN layer || '_' || id ELSE layer END AS name FROM asked""")
def layer_names(spark, sf_dir):
    """The file name of the layer, dataset and method that each part stands for."""
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))
    layer = pick(("flow_acc", "twi", "dem", "slope", "mask"), F.col("p_partkey") % 5)
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", layer.alias("layer"), pick([d[0] for d in DATASETS], F.col("p_size") % 9).alias("id"), F.when(F.col("p_size") % 2 == 0, "d8").otherwise("mfd_quinn_1991").alias("flow"))
    return asked.select("p_partkey", "layer", layer_name_column(F.col("layer"), F.col("id"), F.col("flow")).alias("name"))


@query(ORACLE_SQL["layer_names"].replace("SELECT p_partkey, layer, CASE", "SELECT p_partkey, 'runs/' || (p_partkey % 3) || '/' || CASE").replace("AS name FROM asked", "|| '.tif' AS path FROM asked"))
def download_paths(spark, sf_dir):
    """Where the file of each part's layer goes when it is copied under its name."""
    named = layer_names(spark, sf_dir)
    source = F.concat(F.lit("runs/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("layer"), F.lit(".out"))
    return named.select("p_partkey", download_path(source, F.col("name")).alias("path"))


# --- files of a whole grid ----------------------------------------------------------------------------------


def _file(spark, sf_dir, levels=0):
    """The orders grid, with holes, as one GeoTIFF file of many blocks."""
    path = scratch(spark, ".tif")
    gtiff_source.write(*view(spark, sf_dir, "dem_orders", void=True), path, tile=64, levels=levels, predictor=3)
    return path


@query(f"WITH {ORDERS} SELECT r, c, z FROM cells")
def gtiff_file(spark, sf_dir):
    """A grid written as one file and read back."""
    return gtiff_source.read(spark, _file(spark, sf_dir))


@query(f"WITH {ORDERS}, s AS (SELECT max(r) + 1 AS h FROM cells) SELECT r, c, z FROM cells, s WHERE r >= h // 3 AND r < h - h // 4 AND c >= 21 AND c < 83")
def gtiff_window(spark, sf_dir):
    """A window of a file, of which only the blocks under it are read."""
    path = _file(spark, sf_dir)
    h = gtiff_source.meta_of(path).height
    return gtiff_source.read(spark, path, window=(h // 3, h - h // 4, 21, 83))


@query(f"""WITH {ORDERS}, levels AS (SELECT unnest(range(1, 4)) AS level)
SELECT level::INT AS level, (r // (1 << level))::INT AS r, (c // (1 << level))::INT AS c, round(avg(z)::FLOAT::DOUBLE, 3) AS z FROM cells, levels GROUP BY ALL""")
def gtiff_overviews(spark, sf_dir):
    """The overviews of a file: means of the cells under each cell, across the borders of blocks."""
    path = _file(spark, sf_dir, levels=3)
    every = [gtiff_source.read(spark, path, level=k).select(F.lit(k).alias("level"), "r", "c", F.round("z", 3).alias("z")) for k in (1, 2, 3)]
    return every[0].unionByName(every[1]).unionByName(every[2])


# --- many polygons ------------------------------------------------------------------------------------------

#: A quadrilateral for each supplier, in (column, row) space of the parts grid.
QUADS = """corners AS (SELECT s_suppkey AS zone, s_suppkey * 13 % 50 + 0.3 AS x, s_suppkey * 7 % 40 + 0.2 AS y, 3.25 + s_nationkey AS w, 2.75 + s_nationkey / 2.0 AS h FROM supplier),
edges AS (SELECT zone, x::DOUBLE AS x1, y::DOUBLE AS y1, (x + w)::DOUBLE AS x2, (y + 1.1)::DOUBLE AS y2 FROM corners UNION ALL SELECT zone, x + w, y + 1.1, x + w - 1.2, y + h FROM corners
UNION ALL SELECT zone, x + w - 1.2, y + h, x - 0.9, y + h - 0.6 FROM corners UNION ALL SELECT zone, x - 0.9, y + h - 0.6, x, y FROM corners)"""


def _quads(spark, sf_dir):
    key, more = F.col("s_suppkey"), F.col("s_nationkey")
    at = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("zone"), (key * 13 % 50 + 0.3).alias("x"), (key * 7 % 40 + 0.2).alias("y"), (3.25 + more).alias("w"), (2.75 + more / 2).alias("h"))
    x, y, w, h = (F.col(n) for n in "xywh")
    ring = [(x, y), (x + w, y + 1.1), (x + w - 1.2, y + h), (x - 0.9, y + h - 0.6)]
    sides = [F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(ring, ring[1:] + ring[:1])]
    return at.select("zone", F.lit(0).alias("g"), F.inline(F.array(*sides)))


@query(f"""WITH {VOID}, {QUADS}, inside AS (SELECT e.zone, c.r, c.c, any_value(c.z) AS z FROM cells c JOIN edges e ON (e.y1 > c.r + 0.5) <> (e.y2 > c.r + 0.5) AND c.c + 0.5 < (e.x2 - e.x1) * (c.r + 0.5 - e.y1) / (e.y2 - e.y1) + e.x1
GROUP BY e.zone, c.r, c.c HAVING count(*) % 2 = 1)
SELECT s.s_suppkey AS zone, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, min(z) AS low, max(z) AS high FROM supplier s LEFT JOIN inside i ON i.zone = s.s_suppkey GROUP BY s.s_suppkey""")
def zonal_polygons(spark, sf_dir):
    """Statistics of the cells whose centres lie in each of many overlapping polygons."""
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    s = wetness.zonal_polygons(cells, meta, _quads(spark, sf_dir))
    return s.select("zone", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high")


# --- coordinate systems ---------------------------------------------------------------------------------------

UTM = "EPSG:32633"
#: A target grid in metres over the parts grid; its rows follow from the table.
METRES = GridMeta(0, 44, 25.0, 0.0, 499_960.0, 0.0, -28.0, 5_538_660.0, UTM)


def _utm_sql() -> str:
    """SQL of lon and lat of places x and y in the zone, written from the series."""
    n = projection._N
    inner = [f"({b!r} * sin({2 * k} * xi) * cosh({2 * k} * eta))" for k, b in enumerate(projection._BACK, 1)]
    outer = [f"({b!r} * cos({2 * k} * xi) * sinh({2 * k} * eta))" for k, b in enumerate(projection._BACK, 1)]
    lat = [f"({d!r} * sin({2 * k} * chi))" for k, d in enumerate(projection._LATITUDE, 1)]
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return f"""e1 AS (SELECT *, y / {scale!r} AS xi, (x - 500000.0::DOUBLE) / {scale!r} AS eta FROM places), e2 AS (SELECT *, xi - {' - '.join(inner)} AS u, eta - {' - '.join(outer)} AS v FROM e1),
e3 AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM e2), lonlat AS (SELECT * EXCLUDE (xi, eta, u, v, chi), 15 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees(chi + {' + '.join(lat)}) AS lat FROM e3)"""


TARGET = f"rows AS (SELECT ceil((max(r) + 3) * 31.0 / 28)::INT AS th FROM cells), places AS (SELECT (i // 44)::INT AS r, (i % 44)::INT AS c, 499960.0::DOUBLE + 25 * (i % 44 + 0.5) AS x, 5538660.0::DOUBLE - 28 * (i // 44 + 0.5) AS y FROM range(0, (SELECT th * 44 FROM rows)) t(i)), {_utm_sql()}, p AS (SELECT r, c, (lon - 15) * 3600 AS u, (50 - lat) * 3600 AS v FROM lonlat)"


def _reprojected(spark, sf_dir, method):
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    target = replace(METRES, height=math.ceil((meta.height + 2) * 31.0 / 28))
    return regrid.reproject(cells, meta, target, method, size=32)


@query(f"WITH {VOID}, {TARGET} SELECT p.r, p.c, s.z FROM p LEFT JOIN cells s ON s.r = floor(v) AND s.c = floor(u)")
def reproject_nearest(spark, sf_dir):
    """From degrees to a grid in metres."""
    return _reprojected(spark, sf_dir, "nearest")


@query(f"""WITH {VOID}, {TARGET}, n AS (SELECT p.*, floor(u - 0.5)::INT + dx AS sc, floor(v - 0.5)::INT + dy AS sr FROM p, range(0, 2) a(dx), range(0, 2) b(dy)),
w AS (SELECT *, (1 - abs(u - 0.5 - sc)) * (1 - abs(v - 0.5 - sr)) AS w FROM n) SELECT w.r, w.c, round(CASE WHEN count(*) = count(s.z) THEN sum(w.w * s.z) END, 4) AS z FROM w LEFT JOIN cells s ON s.r = w.sr AND s.c = w.sc GROUP BY w.r, w.c""")
def reproject_bilinear(spark, sf_dir):
    return _reprojected(spark, sf_dir, "bilinear").select("r", "c", F.round("z", 4).alias("z"))


@query(f"WITH places AS (SELECT c_custkey, 300000.0::DOUBLE + c_custkey * 7919 % 400000 AS x, 1000000.0::DOUBLE + c_custkey * 104729 % 7000000 AS y FROM customer), {_utm_sql()} SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat, round(x, 3) AS x_again, round(y, 3) AS y_again FROM lonlat")
def utm_round_trip(spark, sf_dir):
    """Places in a zone as longitude and latitude, and back."""
    key = F.col("c_custkey")
    at = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key, (F.lit(300000.0) + key * 7919 % 400000).alias("x"), (F.lit(1000000.0) + key * 104729 % 7000000).alias("y"))
    lon, lat = projection.unproject(UTM, F.col("x"), F.col("y"))
    there = at.select(key, lon.alias("lon"), lat.alias("lat"))
    x, y = projection.project(UTM, F.col("lon"), F.col("lat"))
    return there.select(key, F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round(x, 3).alias("x_again"), F.round(y, 3).alias("y_again"))


@query(ORACLE_SQL["clip_polygon"])
def clip_projected(spark, sf_dir):
    """A grid in metres clipped by a polygon in degrees."""
    cells, meta = view(spark, sf_dir, "dem_part")
    grid = replace(METRES, height=meta.height, width=meta.width)
    corners = np.array([(5.5, 5.5), (30.2, 8.1), (25.7, 33.4), (7.3, 28.9), (5.5, 5.5)])
    ring = np.column_stack(projection.unproject(UTM, grid.c + grid.a * corners[:, 0], grid.f + grid.e * corners[:, 1]))
    return wetness.clip(cells, grid, {"type": "Polygon", "coordinates": [ring.tolist()]})


# --- stored rasters and aligned layers ----------------------------------------------------------------------


@query(f"WITH {ORDERS}, s AS (SELECT max(r) + 1 AS h FROM cells) SELECT r, c, z FROM cells, s WHERE r >= h // 2 AND r < h - 3 AND c >= 37 AND c < 71")
def stored_region(spark, sf_dir):
    """A grid kept in blocks of cells, and the cells that a rectangle touches read from its own blocks."""
    cells, meta = view(spark, sf_dir, "dem_orders", void=True)
    path = scratch(spark, ".grid")
    store.write_cells(cells, path, block=16)
    x, y = (lambda c: meta.c + meta.a * c), (lambda r: meta.f + meta.e * r)
    return store.read_region(spark, path, meta, x(37.2), y(meta.height - 3.4), x(70.6), y(meta.height // 2 + 0.3)).select("r", "c", "z")


@query(f"WITH {ORDERS} SELECT (r // 16)::INT AS br, (c // 16)::INT AS bc, min(r) AS r_low, max(r) AS r_high, min(c) AS c_low, max(c) AS c_high, count(*) AS n FROM cells GROUP BY ALL")
def stored_bounds(spark, sf_dir):
    path = scratch(spark, ".grid")
    store.write_cells(view(spark, sf_dir, "dem_orders", void=True)[0], path, block=16)
    return store.bounds(spark, path).drop("block")


@query(f"""WITH {VOID}, coarse AS (SELECT (r // 2)::INT AS r, (c // 2)::INT AS c, avg(z) AS z FROM cells WHERE (r // 2 + c // 2) % 3 <> 0 GROUP BY ALL), s AS (SELECT max(r) + 1 AS h FROM cells),
t AS (SELECT a.r, a.c, coalesce(b.z, a.z) AS z FROM cells a LEFT JOIN coarse b ON b.r = a.r // 2 AND b.c = a.c // 2, s WHERE a.r >= 3 AND a.r < h AND a.c >= 4 AND a.c < 47)
SELECT (r - 3)::INT AS r, (c - 4)::INT AS c, z AS dem, CASE WHEN z IS NOT NULL THEN round({DX} * {DY}, 4) END AS area_m2, z IS NOT NULL AS valid FROM t""")
def aligned_export(spark, sf_dir):
    """Elevation, area and mask over a region on the grid of the first image, under a coarser image of higher priority."""
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    coarse = wetness.overview(cells.filter((F.floor(F.col("r") / 2) + F.floor(F.col("c") / 2)) % 3 != 0))
    half = replace(meta, height=-(-meta.height // 2), width=25, a=meta.a * 2, e=meta.e * 2)
    x, y = (lambda c: meta.c + meta.a * c), (lambda r: meta.f + meta.e * r)
    layers = export.aligned([export.Image(coarse, half, 2), export.Image(cells, meta, 1)], (x(4.3), y(meta.height), x(46.5), y(3.2)), "nearest")
    return layers.get("dem", "area_m2", "valid").select("r", "c", "dem", F.round("area_m2", 4).alias("area_m2"), "valid")


@query(f"WITH {VOID}, coarse AS (SELECT (r // 2)::INT AS r, (c // 2)::INT AS c, avg(z) AS z FROM cells GROUP BY ALL) SELECT a.r, a.c, a.z, b.z / 1e8 AS upstream FROM cells a LEFT JOIN coarse b ON b.r = a.r // 2 AND b.c = a.c // 2")
def reference_nearest(spark, sf_dir):
    """A layer of a coarser grid at each cell."""
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    half = replace(meta, height=-(-meta.height // 2), width=25, a=meta.a * 2, e=meta.e * 2)
    return regrid.nearest_layer(cells, meta, wetness.overview(cells), half, "upstream", 1e8)


@query(f"WITH RECURSIVE {VOID}, {BASE}, {FILL} SELECT c.r, c.c, coalesce(coalesce(f.w, c.z) - c.z, 0.0) AS depth FROM cells c LEFT JOIN flood f ON f.r = c.r AND f.c = c.c")
def fill_depth_sentinel(spark, sf_dir):
    """Depths of a grid whose NoData is a number."""
    return conditioning.fill_depth(conditioning.fill_depressions(*view(spark, sf_dir, "dem_part", void=True)), nodata=-9999.0)


@query(f"WITH {VOID}, {BASE}, {MFD} SELECT m.r, m.c, m.k, m.r + x.dr AS nr, m.c + x.dc AS nc, round(m.w::DOUBLE, 5) AS w FROM mfd m JOIN dirs x ON x.k = m.k JOIN cells v ON v.r = m.r + x.dr AND v.c = m.c + x.dc AND v.z IS NOT NULL WHERE m.w > 0")
def flow_edges_mfd(spark, sf_dir):
    """The edges of multiple flow with their weights."""
    cells, meta = view(spark, sf_dir, "dem_part", void=True)
    edges = routing.flow_edges(routing.mfd(cells, meta, steps=UNIT), cells.filter("z is not null"))
    return edges.select("r", "c", "k", "nr", "nc", F.round("w", 5).alias("w"))


RANDOM = "cells AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_size::DOUBLE AS z, ((p_partkey * 7 + p_size * 3) % 10 - 2)::INT AS dir FROM part)"


@query(f"""WITH RECURSIVE {RANDOM}, {DIRS}, n AS (SELECT count(*) AS n FROM cells), edges AS (SELECT a.r, a.c, b.r AS nr, b.c AS nc FROM cells a JOIN dirs d ON d.k = a.dir JOIN cells b ON b.r = a.r + d.dr AND b.c = a.c + d.dc),
flux AS (SELECT r, c, 1.0::DOUBLE AS m, 0 AS step FROM cells UNION ALL SELECT e.nr, e.nc, sum(f.m), any_value(f.step) + 1 FROM flux f JOIN edges e ON e.r = f.r AND e.c = f.c WHERE f.step < (SELECT n FROM n) GROUP BY e.nr, e.nc),
sums AS (SELECT r, c, sum(m) AS acc, bool_or(step = (SELECT n FROM n)) AS circles FROM flux GROUP BY r, c),
given AS (SELECT e.nr AS r, e.nc AS c, sum(s.acc) AS m FROM edges e JOIN sums s ON s.r = e.r AND s.c = e.c AND NOT s.circles GROUP BY ALL)
SELECT s.r, s.c, CASE WHEN circles THEN 1 + coalesce(g.m, 0) ELSE acc END AS acc FROM sums s LEFT JOIN given g ON g.r = s.r AND g.c = s.c""")
def flow_acc_unchecked(spark, sf_dir):
    """Directions that run in circles: with the check off, cells on a circle keep their own mass and what is complete."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cells = part.selectExpr("int(p_partkey div 50) AS r", "int(p_partkey % 50) AS c", "double(p_size) AS z", "int((p_partkey * 7 + p_size * 3) % 10 - 2) AS dir")
    _, meta = view(spark, sf_dir, "dem_part")
    return routing.accumulate(cells, meta, size=SMALL, cycle_check=False)


@query("SELECT p_partkey, CASE WHEN acc = 0 THEN '-infinity'::DOUBLE ELSE round(ln(acc / tan(radians(greatest(slope, 0.1)))), 9) END AS twi FROM (SELECT p_partkey, (p_size % 7)::DOUBLE AS acc, (p_partkey % 40)::DOUBLE AS slope FROM part)")
def twi_image(spark, sf_dir):
    """The index without a guard of the accumulation."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") % 7).cast("double").alias("acc"), (F.col("p_partkey") % 40).cast("double").alias("slope"))
    return part.select("p_partkey", F.round(wetness.twi_image(F.col("acc"), F.col("slope")), 9).alias("twi"))


@query(f"WITH {ORDERS}, h AS (SELECT max(r) + 1 AS h FROM cells) SELECT i // 100 AS r, i % 100 AS c, z FROM (SELECT unnest(range(0, (SELECT h * 100 FROM h))) AS i) LEFT JOIN cells ON r = i // 100 AND c = i % 100 WHERE EXISTS (SELECT 1 FROM cells t WHERE t.r // 64 = i // 100 // 64 AND t.c // 64 = i % 100 // 64)".replace("SELECT i // 100 AS r, i % 100 AS c", "SELECT (i // 100)::INT AS r, (i % 100)::INT AS c"))
def tiled_export(spark, sf_dir):
    """A grid exported as a file for each tile by the tasks that hold them, and assembled from the folder by georeference."""
    cells, meta = view(spark, sf_dir, "dem_orders", void=True)
    folder = scratch(spark, ".tiles")
    gtiff.save(cells, meta, folder, "dem", size=64, compression=gtiff.LZW)
    return gtiff_source.read(spark, folder, grid=meta)

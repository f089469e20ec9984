"""Slope, the topographic wetness index, clipping and statistics."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import materialize, release
from ..functions.geo import row_steps
from ..functions.projection import convert, epsg_of
from ..grid import GridMeta, neighbours

MIN_SLOPE = 0.1
#: An edge this near to a cell, in cells, touches it: coordinates in degrees are no more exact.
_NEAR = 1e-9


def slope_degrees(cells: DataFrame, meta: GridMeta, steps: tuple[float, float] | None = None) -> DataFrame:
    """r, c, slope_deg by central differences of the four neighbours; NULL at borders and beside NoData."""
    dx, dy = (F.lit(steps[0]), F.lit(steps[1])) if steps else row_steps(meta)
    gx, gy = (F.col("n1") - F.col("n5")) / (2 * dx), (F.col("n7") - F.col("n3")) / (2 * dy)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    return neighbours(cells.select("r", "c", "z")).select("r", "c", F.when(F.col("z").isNotNull(), slope).alias("slope_deg"))


def twi(acc: Column, slope_deg: Column, min_slope_deg: float = MIN_SLOPE) -> Column:
    """ln(acc / tan(slope)), the slope at least ``min_slope_deg``; NULL without positive finite input."""
    if min_slope_deg < 0:
        raise ValueError("min_slope_deg must not be negative")
    tan = F.tan(F.radians(F.greatest(slope_deg, F.lit(float(min_slope_deg)))))
    fine = acc.isNotNull() & slope_deg.isNotNull() & ~F.isnan(acc) & ~F.isnan(slope_deg) & (acc > 0) & (acc < float("inf")) & (F.abs(slope_deg) < float("inf"))
    return F.when(fine & (tan > 0), F.log(acc / F.when(tan > 0, tan)))


def twi_image(acc: Column, slope_deg: Column, min_slope_deg: float = MIN_SLOPE) -> Column:
    """The index as images form it: no guard of the accumulation, so 0 gives minus infinity and less gives NaN; NULL where either is."""
    if min_slope_deg < 0:
        raise ValueError("min_slope_deg must not be negative")
    ratio = acc / F.tan(F.radians(F.greatest(slope_deg, F.lit(float(min_slope_deg)))))
    value = F.when(ratio > 0, F.log(ratio)).when(ratio == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(acc.isNotNull() & slope_deg.isNotNull(), value)


def rings(geojson: str | dict) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a GeoJSON geometry, feature or collection, as lists of rings; null geometries are dropped."""
    g = json.loads(geojson) if isinstance(geojson, str) else geojson
    kind = (g or {}).get("type")
    if kind == "FeatureCollection":
        return [p for f in g["features"] for p in rings(f)]
    if kind == "Feature":
        return rings(g["geometry"]) if g.get("geometry") else []
    if kind == "Polygon":
        return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in g["coordinates"]]]
    if kind == "MultiPolygon":
        return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in poly] for poly in g["coordinates"]]
    raise ValueError(f"not a polygon: {kind}")


def _edges(spark: SparkSession, polygons, meta: GridMeta) -> DataFrame:
    """g, x1, y1, x2, y2: the edges of polygon g in (column, row) space, where the cell is the unit square at (c, r)."""
    parts = []
    for g, polygon in enumerate(polygons):
        for ring in polygon:
            p = np.array(ring, float)
            p = np.column_stack([(p[:, 0] - meta.c) / meta.a, (p[:, 1] - meta.f) / meta.e])
            parts.append(np.column_stack([np.full(len(p), g), p, np.roll(p, -1, axis=0)]))
    every = np.vstack(parts)
    return spark.createDataFrame(pa.table(dict(zip(("g", "x1", "y1", "x2", "y2"), every.T))))


def spans(spark: SparkSession, polygons, meta: GridMeta, all_touched: bool) -> DataFrame:
    """r, c0, c1: the cells of each row that lie in some polygon, as disjoint ranges."""
    return zone_spans(_edges(spark, polygons, meta).withColumn("zone", F.lit(0)), meta, all_touched).drop("zone")


def zone_spans(edges: DataFrame, meta: GridMeta, all_touched: bool) -> DataFrame:
    """zone, r, c0, c1: the cells of each row that lie in some polygon of a zone, as ranges that are disjoint within it.

    ``edges``: zone, g (a number of the polygon within the zone), x1, y1, x2, y2 in (column, row) space.
    A cell lies in a polygon if its centre does by the even-odd rule over all rings, or, with ``all_touched``,
    if an edge meets its square. Work grows with the edges and the rows they cross, not with edges times cells.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = lambda first, last: F.explode(F.when(first <= last, F.sequence(first, last)))
    top, bottom = F.lit(0), F.lit(meta.height - 1)
    x_at = lambda y: (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = edges.filter("y1 <> y2").select("*", rows(F.greatest(F.ceil(low - 0.5).cast("int"), top), F.least(F.ceil(high - 0.5).cast("int") - 1, bottom)).alias("r"))
    crossings = crossed.select("zone", "g", "r", x_at(F.col("r") + 0.5).alias("x"))
    line = Window.partitionBy("zone", "g", "r").orderBy("x")
    pairs = crossings.select("zone", "r", F.col("x").alias("a"), F.lead("x").over(line).alias("b"), F.row_number().over(line).alias("k")).filter("k % 2 = 1 and b is not null")
    found = pairs.select("zone", "r", F.ceil(F.col("a") - 0.5).cast("int").alias("c0"), (F.ceil(F.col("b") - 0.5) - 1).cast("int").alias("c1"))
    if all_touched:
        met = edges.select("*", low.alias("low"), high.alias("high"), rows(F.greatest(F.ceil(low - 1 - _NEAR).cast("int"), top), F.least(F.floor(high + _NEAR).cast("int"), bottom)).alias("r"))
        flat = F.col("y1") == F.col("y2")
        ends = [F.when(flat, x).otherwise(x_at(y)) for x, y in ((F.col("x1"), F.greatest(F.col("low"), F.col("r").cast("double"))), (F.col("x2"), F.least(F.col("high"), F.col("r") + 1.0)))]
        found = found.unionByName(met.select("zone", "r", F.ceil(F.least(*ends) - 1 - _NEAR).cast("int").alias("c0"), F.floor(F.greatest(*ends) + _NEAR).cast("int").alias("c1")))
    row = Window.partitionBy("zone", "r").orderBy("c0", "c1")
    before = F.max("c1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.filter("c0 <= c1").withColumn("new", F.coalesce((F.col("c0") > before + 1).cast("int"), F.lit(0)))
    return begun.withColumn("part", F.sum("new").over(row)).groupBy("zone", "r", "part").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).select("zone", "r", "c0", "c1")


#: Columns of cells that a range of a zone is cut into, so that ranges and cells meet by equality.
SPAN_CELLS = 256


def zonal_polygons(cells: DataFrame, meta: GridMeta, edges: DataFrame, column: str = "z", all_touched: bool = False) -> DataFrame:
    """zone, n, mean, sd, low, high over the cells with a value in each zone's polygons (``edges``: see ``zone_spans``); zones may overlap, and one without a cell has n = 0.

    Ranges are cut at every SPAN_CELLS columns and joined to cells by row and piece; each cell appears once for each zone that holds it,
    and sums are formed before the shuffle.
    """
    first, last = (F.col(n) / SPAN_CELLS for n in ("c0", "c1"))
    inside = zone_spans(edges, meta, all_touched).filter(f"c1 >= 0 and c0 < {meta.width}").withColumns({"c0": F.greatest("c0", F.lit(0)), "c1": F.least("c1", F.lit(meta.width - 1))})
    pieces = inside.withColumn("piece", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    valued = cells.filter(F.col(column).isNotNull()).select("r", "c", F.col(column).alias("v"), (F.col("c") / SPAN_CELLS).cast("int").alias("piece"))
    held = valued.join(pieces, ["r", "piece"]).filter(F.col("c").between(F.col("c0"), F.col("c1")))
    stats = held.groupBy("zone").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
    return edges.select("zone").distinct().join(stats, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def clip(cells: DataFrame, meta: GridMeta, geojson: str | dict, all_touched: bool = True, crs: str = "EPSG:4326") -> DataFrame:
    """Cells of the polygon's bounding box; those outside the polygon have z NULL. With ``all_touched`` any contact counts.

    ``crs``: the polygon's coordinate system; where the grid has another, the polygon's corners are carried over, to six places.
    """
    polygons = rings(geojson)
    if epsg_of(crs) != epsg_of(meta.crs):
        moved = lambda ring: np.round(np.column_stack(convert(crs, meta.crs, *np.array(ring, float).T)), 6).tolist()
        polygons = [[moved(ring) for ring in polygon] for polygon in polygons]
    if not polygons:
        raise ValueError("the area of interest is empty")
    meta.require_north_up()
    xs, ys = [p[0] for g in polygons for ring in g for p in ring], [p[1] for g in polygons for ring in g for p in ring]
    c0, c1 = sorted(((min(xs) - meta.c) / meta.a, (max(xs) - meta.c) / meta.a))
    r0, r1 = sorted(((min(ys) - meta.f) / meta.e, (max(ys) - meta.f) / meta.e))
    box = cells.filter(F.col("r").between(math.floor(r0), math.ceil(r1) - 1) & F.col("c").between(math.floor(c0), math.ceil(c1) - 1))
    held = spans(cells.sparkSession, polygons, meta, all_touched).groupBy("r").agg(F.collect_list(F.struct("c0", "c1")).alias("spans"))
    inside = F.coalesce(F.exists("spans", lambda s: F.col("c").between(s.c0, s.c1)), F.lit(False))
    return box.join(held, "r", "left").withColumn("z", F.when(inside, F.col("z"))).select(box.columns)


#: Distinct values in each range of their order.
RANKED_VALUES = 1_000_000


def percentiles(cells: DataFrame, wanted: list[float], column: str = "z") -> list[float] | None:
    """Exact percentiles (0 to 100) with linear interpolation between ranks; None without values.

    Values are counted, so that a frequent one is one row, and sorted in ranges; the ranks asked for are then found from the ranges' totals
    and read from the ranges that hold them. No task sees more than a range.
    """
    counted = materialize(cells.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")))
    rows = counted.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not rows.k:
        release(counted)
        return None
    placed = materialize(counted.repartitionByRange(1 + rows.k // RANKED_VALUES, "v").withColumn("part", F.spark_partition_id()))
    base, below = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each range
        base[r.part], below = (below, below + r.n), below + r.n
    at = [p / 100 * (rows.n - 1) for p in wanted]
    ranks = sorted({min(k, rows.n - 1) for x in at for k in (math.floor(x), math.floor(x) + 1)})
    held = {part for part, (lo, hi) in base.items() if any(lo <= k < hi for k in ranks)}
    start = F.element_at(F.create_map(*[F.lit(x) for part in held for x in (part, base[part][0])]), F.col("part"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.filter(F.col("part").isin(*held)).withColumn("hi", start + upto)
    hit = found.filter(F.exists(F.array(*[F.lit(k).cast("long") for k in ranks]), lambda k: (k < F.col("hi")) & (k >= F.col("hi") - F.col("n")))).select("v", "n", "hi").collect()
    value = {k: r.v for r in hit for k in ranks if r.hi - r.n <= k < r.hi}
    release(counted, placed)
    low = [math.floor(x) for x in at]
    return [value[k] + (value[min(k + 1, rows.n - 1)] - value[k]) * (x - k) for x, k in zip(at, low)]


def sigma_stretch(cells: DataFrame, column: str = "z", k: float = 2.0, clamp: tuple[float, float] | None = None) -> DataFrame:
    """lo, hi: mean plus or minus k deviations, optionally within percentiles; [0, 1] where degenerate."""
    if clamp and not 0 <= clamp[0] < clamp[1] <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    v = F.col(column)
    stats = cells.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    lo, hi = F.col("m") - k * F.col("s"), F.col("m") + k * F.col("s")
    if clamp and (found := percentiles(cells, list(clamp), column)):
        lo, hi = F.greatest(lo, F.lit(found[0])), F.least(hi, F.lit(found[1]))
    fine = (F.col("n") > 0) & (F.col("s") > 0) & (lo < hi)
    return stats.select("n", F.when(fine, lo).otherwise(0.0).alias("lo"), F.when(fine, hi).otherwise(1.0).alias("hi"))


def percentile_stretch(cells: DataFrame, column: str = "z", low: float = 2, high: float = 98) -> DataFrame:
    """lo, hi: interpolated percentiles; the extremes where they coincide, NULL without values."""
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    v = F.col(column)
    s = cells.agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("b"))
    found = percentiles(cells, [low, high], column) or [0.0, 0.0]
    ends = ("a", "b") if found[0] >= found[1] else None
    return s.select("n", *[(F.col(ends[i]) if ends else F.lit(found[i])).cast("double").alias(n) for i, n in enumerate(("lo", "hi"))])


def stretched(value: Column, lo: Column | float, hi: Column | float, bins: int = 256) -> Column:
    """Bin of a value on a stretch; values outside saturate."""
    lo, hi = (F.lit(x) if not isinstance(x, Column) else x for x in (lo, hi))
    return F.when(value.isNotNull(), F.least(F.greatest(F.floor((value - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))


def zonal_stats(cells: DataFrame, zone: Column, column: str = "z") -> DataFrame:
    v = F.col(column)
    return cells.groupBy(zone.alias("zone")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def overview(cells: DataFrame, factor: int = 2) -> DataFrame:
    """A coarser grid of averages over blocks of valid cells."""
    return cells.groupBy((F.col("r") / factor).cast("int").alias("r"), (F.col("c") / factor).cast("int").alias("c")).agg(F.avg("z").alias("z"))

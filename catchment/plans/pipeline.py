"""From elevation to wetness: conditioning, routing, accumulation, slope, index, clip."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialize
from ..functions.geo import pixel_area
from ..functions.projection import epsg_of
from ..grid import GridMeta
from ..operators import conditioning, routing, wetness
from ..operators.regrid import area_hectares


@dataclass
class Result:
    """Layers of a run and its metrics in seconds, cells and hectares."""

    layers: dict[str, DataFrame]
    meta: GridMeta
    metrics: dict[str, float] = field(default_factory=dict)

    @property
    def twi(self) -> DataFrame:
        return self.layers["twi"]


def run(cells: DataFrame, meta: GridMeta, flow_method: str = "mfd_quinn_1991", aoi: str | dict | None = None, out: str = "km2") -> Result:
    """Layers filled, resolved, flow, acc, slope and twi of a grid (r, c, z), the index clipped to ``aoi`` if given."""
    if flow_method not in routing.METHODS:
        raise ValueError(f"flow method must be one of {', '.join(routing.METHODS)}")
    metrics, began = {}, time.time()

    def timed(name: str, df: DataFrame) -> DataFrame:
        at = time.time()
        df = materialize(df)
        metrics[f"{name}_s"] = time.time() - at
        return df

    filled = timed("depression_filling", conditioning.fill_depressions(cells, meta))
    surface = filled.select("r", "c", F.col("filled").alias("z"))
    resolved = timed("flat_resolution", conditioning.resolve_flats(surface, meta))
    drained = resolved.select("r", "c", F.col("resolved").alias("z"))
    flow = timed("flow_direction", routing.route(drained, meta, flow_method))
    loaded = flow.join(drained, ["r", "c"]).withColumn("area_m2", pixel_area(meta))
    acc = timed("flow_accumulation", routing.accumulate(loaded, meta, out))
    slope = timed("slope", wetness.slope_degrees(cells, meta))
    index = acc.join(slope, ["r", "c"]).select("r", "c", wetness.twi(F.col("acc"), F.col("slope_deg")).alias("z"))
    if aoi is not None:
        index = wetness.clip(index, meta, aoi)
    index = timed("twi", index.withColumnRenamed("z", "twi"))
    metrics["valid_pixels"] = cells.filter("z is not null").count()
    metrics["area_ha"] = area_hectares(cells, meta).first().area_ha if epsg_of(meta.crs) == 4326 else metrics["valid_pixels"] * abs(meta.a * meta.e) / 1e4
    metrics["total_time_s"] = time.time() - began
    return Result({"filled": filled, "resolved": resolved, "flow": flow, "acc": acc, "slope": slope, "twi": index}, meta, metrics)

"""The catalogue of elevation datasets, and names of exported layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: dataset ids, their elevation band, and cell size in metres
DATASETS = [
    ("FABDEM", None, 30), ("GLO30", "DEM", 30), ("AW3D30", "DSM", 30), ("SRTMGL1_003", "elevation", 30), ("NASADEM_HGT", "elevation", 30),
    ("ASTER_GDEM", "b1", 30), ("CGIAR_SRTM90", "elevation", 90), ("MERIT_DEM", "dem", 90), ("MERIT_Hydro", "elv", 90),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "id string, band string, resolution_m int")


def dataset(name: str) -> tuple[str, str | None, int]:
    for row in DATASETS:
        if row[0] == name:
            return row
    raise ValueError(f"unknown elevation dataset {name!r}; one of {', '.join(r[0] for r in DATASETS)}")


def scan_band(bands: DataFrame, name: str) -> DataFrame:
    """r, c, z of a dataset of the catalogue, from cells of its images (r, c, priority, bands: a map by name).

    The dataset's elevation band is taken, or of one that names none the first band of the map; overlapping images are
    joined by priority, and values that are no numbers become NULL.
    """
    from ..grid import normalise
    from ..operators.regrid import mosaic

    band = dataset(name)[1]
    value = F.element_at("bands", F.lit(band)) if band else F.element_at(F.map_values("bands"), 1)
    return mosaic(normalise(bands.select("r", "c", "priority", value.cast("double").alias("z"))))


def layer_name(layer: str, dem: str, flow: str) -> str:
    """Exported file name: layers that depend on routing carry both suffixes, those of the elevation its own."""
    if layer in ("flow_acc", "twi"):
        return f"{layer}_{dem}_{flow}"
    if layer in ("dem", "slope"):
        return f"{layer}_{dem}"
    return layer


def layer_name_column(layer: Column, dem: Column, flow: Column) -> Column:
    """``layer_name`` for columns."""
    both, own = F.concat_ws("_", layer, dem, flow), F.concat_ws("_", layer, dem)
    return F.when(layer.isin("flow_acc", "twi"), both).when(layer.isin("dem", "slope"), own).otherwise(layer)


def download_path(source: Column, name: Column) -> Column:
    """Where a layer's file goes under a name: a .tif beside the file it is copied from."""
    folder = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, name, F.lit(".tif"))

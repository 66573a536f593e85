"""Dimension rows of forecast models: channel sets, grids and names, built by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pressure levels of the models, in hPa.
LEVELS_13 = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 850, 925, 1000)
LEVELS_37 = (1, 2, 3, 5, 7, 10, 20, 30, 50, 70, 100, 125, 150, 175, 200, 225, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 775, 800, 825, 850, 875, 900, 925, 950, 975, 1000)
#: For each model the parts of its channel list in order, (variables, levels).
CHANNELS: dict[str, tuple[tuple[tuple[str, ...], tuple[int, ...]], ...]] = {
    "pangu": ((("z", "q", "t", "u", "v"), LEVELS_13[::-1]), (("msl", "u10", "v10", "t2m"), ())),
    "fengwu": ((("u10", "v10", "t2m", "msl"), ()), (("z", "q", "u", "v", "t"), LEVELS_13)),
    "fuxi": ((("z", "t", "u", "v", "r"), LEVELS_13), (("t2m", "u10", "v10", "msl", "tp"), ())),
    "stormer": ((("t2m", "u10", "v10", "msl"), ()), (("z", "u", "v", "t", "q"), LEVELS_13)),
    "neuralgcm": ((("z", "t", "u", "v", "q", "ciwc", "clwc"), LEVELS_37),),
}
#: Rows, columns, first latitude, its step and the step of longitude.
GRIDS: dict[str, tuple[int, int, float, float, float]] = {
    "pangu": (721, 1440, 90.0, -0.25, 0.25), "fengwu": (721, 1440, 90.0, -0.25, 0.25), "fuxi": (721, 1440, 90.0, -0.25, 0.25), "neuralgcm": (721, 1440, 90.0, -0.25, 0.25),
    "aurora": (720, 1440, 90.0, -0.25, 0.25), "stormer": (128, 256, -89.296875, 1.40625, 1.40625),
}
#: Short and long names of variables.
LONG_NAMES = {
    "z": "geopotential", "t": "temperature", "u": "u_component_of_wind", "v": "v_component_of_wind", "q": "specific_humidity", "r": "relative_humidity", "w": "vertical_velocity",
    "ciwc": "specific_cloud_ice_water_content", "clwc": "specific_cloud_liquid_water_content", "t2m": "2m_temperature", "u10": "10m_u_component_of_wind", "v10": "10m_v_component_of_wind",
    "msl": "mean_sea_level_pressure", "sp": "surface_pressure", "tp": "total_precipitation", "tcc": "total_cloud_cover", "sst": "sea_surface_temperature", "siconc": "sea_ice_cover", "lsm": "land_sea_mask",
}


def channel_list(model: str) -> list[tuple[str, int | None]]:
    if model not in CHANNELS:
        raise KeyError(f"{model!r} is unknown; known are {sorted(CHANNELS)}")
    return [(v, level) for variables, levels in CHANNELS[model] for v in variables for level in (levels or (None,))]


def channel_sets(spark: SparkSession, *models: str) -> DataFrame:
    """[S3, X2] ``model, ord, variable, level_hpa`` of the models' channels, of all models if none is named."""
    rows = [(m, k, v, level) for m in models or CHANNELS for k, (v, level) in enumerate(channel_list(m))]
    return spark.createDataFrame(rows, "model string, ord int, variable string, level_hpa int")


def latitudes(spark: SparkSession, *models: str) -> DataFrame:
    """[X2] ``model, lat_i, lat``: latitude rows of the models' grids."""
    rows = [(m, i, GRIDS[m][2] + i * GRIDS[m][3]) for m in models or GRIDS for i in range(GRIDS[m][0])]
    return spark.createDataFrame(rows, "model string, lat_i int, lat double")


def longitudes(spark: SparkSession, *models: str) -> DataFrame:
    """[X2] ``model, lon_i, lon``: columns of the models' grids."""
    rows = [(m, j, j * GRIDS[m][4]) for m in models or GRIDS for j in range(GRIDS[m][1])]
    return spark.createDataFrame(rows, "model string, lon_i int, lon double")


def truth_fields(cells: DataFrame, *models: str) -> DataFrame:
    """[X2] Analysis cells (``variable, level_hpa, lat_i, lon_i``) as each model's truth: its channels, with ``model, ord, lat, lon`` of its grid.

    Cells must be on the model's grid already; those outside it and other channels are left out.
    """
    spark = cells.sparkSession
    channels = channel_sets(spark, *models).withColumnsRenamed({"variable": "_v", "level_hpa": "_l"})
    found = cells.join(F.broadcast(channels), (F.col("variable") == F.col("_v")) & F.col("level_hpa").eqNullSafe(F.col("_l"))).drop("_v", "_l")  # some hundred channels
    return found.join(F.broadcast(latitudes(spark, *models)), ["model", "lat_i"]).join(F.broadcast(longitudes(spark, *models)), ["model", "lon_i"])  # axes of the grids


def names(spark: SparkSession) -> DataFrame:
    """[P4] ``variable, long_name``."""
    return spark.createDataFrame(list(LONG_NAMES.items()), "variable string, long_name string")

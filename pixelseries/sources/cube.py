"""Cubes as long tables cube_obs(tile_id, year, sensor, t, doy, y, x, valid, v). Dense arrays on disk: see arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sensor_cube(cubes: DataFrame, tile_id: str, year: int, sensor: str) -> DataFrame:
    """One sensor's cube of a tile-year; empty if there is none. Partition columns prune the scan."""
    return cubes.where((F.col("tile_id") == tile_id) & (F.col("year") == year) & (F.col("sensor") == sensor))


def load_roi(raster: DataFrame, value: str = "value") -> DataFrame:
    """(y, x) of the raster's cells above 0, with the grid's height and width: a mask, whatever its values were. The grid is that
    of all cells, those at 0 too."""
    grid = raster.agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))  # one row
    return raster.where(F.col(value) > 0).select("y", "x").join(F.broadcast(grid))


def block(cubes: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Rows of a half-open rectangle; the predicates reach the row groups."""
    return cubes.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def cube_info(cubes: DataFrame, *keys: str) -> DataFrame:
    """Shape of each cube: steps, height, width, rows."""
    return cubes.groupBy(*keys).agg(F.countDistinct("t").alias("steps"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("rows"))


def select_band(rows: DataFrame, values: str, band: int, name: str = "value") -> DataFrame:
    return rows.withColumn(name, F.get(values, F.lit(band)))

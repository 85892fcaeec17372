"""Sinks: partitioned tables, committed mosaics, ledgers, lists, band exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.operators.grid import patch
from pixelseries.operators.layout import morton
from pixelseries.sources import commits


def write_mosaic(mosaic: DataFrame, path: str, keys: Sequence[str] = ("tile_id",), tags: dict[str, Column] | None = None) -> DataFrame:
    """Day mosaics by keys (tile, and for radar orbit and polarisation), year and month, with tag columns (band, orbit, number of
    sources and the like), committed: a rerun replaces the months that it has, and nothing is seen of a write that fails. Ranges of the Morton key
    within a month go to different writers, so no month is one task's. Returns what was published; read_mosaic reads it."""
    rows = mosaic.withColumns({"year": F.year("date"), "month": F.month("date"), "__z": morton(F.col("y"), F.col("x"))} | (tags or {}))
    dealt = rows.repartitionByRange(*keys, "year", "month", "__z").sortWithinPartitions(*keys, "year", "month", "date", "y", "x").drop("__z")
    return commits.write(dealt, path, [*keys, "year", "month"])


def read_mosaic(spark: SparkSession, path: str, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    return commits.read(spark, path, [*keys, "year", "month"])


def write_patches(rows: DataFrame, path: str, size: int, height: int, width: int) -> None:
    """Pixels by the patch that holds them, a folder for each patch, in order of time and place."""
    named = rows.withColumns(patch(F.col("y"), F.col("x"), size, height, width)).drop("patch_x", "patch_y")
    named.repartitionByRange("patch", "date").sortWithinPartitions("patch", "date", "y", "x").write.mode("overwrite").partitionBy("patch").parquet(path)


def write_representation(rows: DataFrame, path: str, values: str = "z", block_rows: int = 256) -> None:
    """Vectors of pixels as 32-bit floats, in blocks of rows of the grid, row-major inside."""
    out = rows.select(F.floor(F.col("y") / block_rows).cast("int").alias("block"), "y", "x", F.col(values).cast("array<float>").alias(values))
    out.repartitionByRange("block", "y", "x").sortWithinPartitions("block", "y", "x").write.mode("overwrite").partitionBy("block").parquet(path)


def not_written(rows: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys the ledger does not hold."""
    return rows.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def write_once(rows: DataFrame, ledger: DataFrame, keys: Sequence[str], path: str, overwrite: bool = False) -> None:
    todo = rows if overwrite else not_written(rows, ledger, keys)
    mode = "overwrite" if overwrite else "append"
    todo.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_ledger(done: DataFrame, path: str) -> None:
    done.select("tile_id").distinct().write.mode("append").parquet(path)


def write_list(tiles: DataFrame, path: str) -> None:
    """Sorted ids, one a line, in one file: a list of tiles is short."""
    tiles.select("tile_id").orderBy("tile_id").coalesce(1).write.mode("overwrite").text(path)


def write_series(series: DataFrame, path: str) -> None:
    """Training series by tile, year and sensor, sorted by chunk and pixel."""
    rows = series.repartition("tile_id", "year", "sensor", "chunk").sortWithinPartitions("tile_id", "year", "sensor", "chunk", "row", "col")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id", "year", "sensor").parquet(path)


def write_splits(assigned: DataFrame, path: str) -> None:
    """JSON lists of tiles, one folder for each worker."""
    assigned.write.mode("overwrite").partitionBy("worker").json(path)


def bands_long(rows: DataFrame, values: str = "z") -> DataFrame:
    """(y, x, band, value) of vectors, bands from 1 as in raster files."""
    out = rows.select("y", "x", F.posexplode(values).alias("band", "value"))
    return out.withColumn("band", F.col("band") + 1)


def bands_wide(rows: DataFrame, n: int, values: str = "z") -> DataFrame:
    return rows.select("y", "x", *(F.get(values, F.lit(k)).alias(f"band_{k + 1}") for k in range(n)))

"""Lists of tiles and years, rings of polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseries.functions.names import listed_tile


def tiles_in(spark: SparkSession, path: str, pattern: str = "tile_*.tif") -> DataFrame:
    """Sorted ids of the tile files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(listed_tile(F.col("path")).alias("tile_id")).orderBy("tile_id")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without the blank ones, as tile_id."""
    return spark.read.text(path).select(F.trim("value").alias("tile_id")).where(F.length("tile_id") > 0)


def nth_line(rows: DataFrame, n: int, order: str = "tile_id") -> DataFrame:
    """The n-th row (from 1) by order; only n rows of each task take part."""
    first = rows.orderBy(order).limit(n)
    return first.withColumn("__n", F.row_number().over(Window.orderBy(order))).where(F.col("__n") == n).drop("__n")


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("path"))


def as_json(tiles: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, list): a JSON array of each key's sorted strings; such lists are short."""
    return tiles.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(column))).alias("list"))


def rings_with_crs(features: DataFrame, default: int = 4326) -> DataFrame:
    """Features whose reference system is unknown (null or 0) get the default one."""
    return features.withColumn("epsg", F.coalesce(F.nullif("epsg", F.lit(0)), F.lit(default)))


def numeric_years(names: DataFrame, column: str = "name") -> DataFrame:
    """Names that are numbers, in string order."""
    return names.where(F.col(column).rlike("^[0-9]+$")).orderBy(column)


def years_with_data(tiles: DataFrame, data: DataFrame, first: int = 2016, last: int = 2024) -> DataFrame:
    """(tile_id, year) of the years in range for which data has rows."""
    years = tiles.select("tile_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return years.join(data.select("tile_id", "year"), ["tile_id", "year"], "left_semi")


def tiles_without_data(tiles: DataFrame, data: DataFrame) -> DataFrame:
    return tiles.join(data.select("tile_id"), "tile_id", "left_anti")


def edges(rings: DataFrame) -> DataFrame:
    """rings (feature_id, ring_id, seq, vx, vy) as edges (feature_id, ring_id, x1, y1, x2, y2), the last one closing."""
    ring = Window.partitionBy("feature_id", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(n) for c, n in (("vx", "x2"), ("vy", "y2"))]
    return rings.select("feature_id", "ring_id", F.col("vx").alias("x1"), F.col("vy").alias("y1"), *nxt)

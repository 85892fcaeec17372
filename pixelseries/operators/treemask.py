"""Tree pixels on cropland and their time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CROPLAND = 40
MIN_TREE = 0.1


def tree_mask(fine: DataFrame, factor: int = 10, cropland: int = CROPLAND, least: float = MIN_TREE) -> DataFrame:
    """(y, x) of cells whose mean tree cover is above the least and which hold cropland. fine: (fy, fx, tree, lc)."""
    cells = fine.groupBy(F.floor(F.col("fy") / factor).cast("int").alias("y"), F.floor(F.col("fx") / factor).cast("int").alias("x"))
    means = cells.agg(F.avg(F.col("tree").cast("double")).alias("cover"), F.bool_or(F.col("lc") == cropland).alias("crop"))
    return means.where((F.col("cover") > least) & F.col("crop")).select("y", "x", "cover")


def layer_mosaic(layers: DataFrame) -> DataFrame:
    """(y, x, value): of layers (layer_seq, y, x, value) the last one on top."""
    return layers.groupBy("y", "x").agg(F.max_by("value", "layer_seq").alias("value"))


def collections_mosaic(*collections: DataFrame) -> DataFrame:
    """(y, x, value): of several collections of layers the last collection's last layer on top. Rows are (layer_seq, y, x, value)."""
    each = [c.select(F.struct(F.lit(k).alias("collection"), "layer_seq").alias("layer_seq"), "y", "x", "value") for k, c in enumerate(collections)]
    both = each[0]
    for c in each[1:]:
        both = both.unionByName(c)
    return layer_mosaic(both)


def square_mask(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Set cells within the smaller side of a mask that is not square; the sides are the grid's, whatever cells are set."""
    side = min(height, width)
    return mask.where((F.col("value") != 0) & (F.col("y") < side) & (F.col("x") < side)).select("y", "x")


def masked(cube: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    return cube.join(mask.select(*keys), list(keys), "left_semi")


def common_steps(cube: DataFrame, mask_steps: DataFrame, *keys: str) -> DataFrame:
    """Steps that both the cube and its mask have, when their lengths differ."""
    steps = mask_steps.groupBy(*keys).agg((F.max("t") + 1).alias("__steps"))
    return cube.join(steps, list(keys)).where("t < __steps").drop("__steps")


def pixel_series(cube: DataFrame, *keys: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A pixel's observations in time order, with the extra columns; the bands of an invalid one are null."""
    v = F.when(F.col("valid"), F.col("v"))
    return cube.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_list(F.struct("t", "doy", *extra, v.alias("v")))).alias("series"))

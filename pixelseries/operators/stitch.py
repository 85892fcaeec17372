"""Stitching patch results onto a target grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.functions.optical import percent


def target_window(patches: DataFrame, target: tuple[float, float, float], height: int, width: int) -> DataFrame:
    """Adds row0, col0, row1, col1: a patch's box in pixels of the target (origin x, origin y, pixel size), rounded half to
    even and clamped."""
    ox, oy, size = target
    clamp = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0), F.bround(c).cast("int")))
    return patches.withColumns(
        {
            "col0": clamp((F.col("minx") - ox) / size, width),
            "col1": clamp((F.col("maxx") - ox) / size, width),
            "row0": clamp((F.lit(oy) - F.col("maxy")) / size, height),
            "row1": clamp((F.lit(oy) - F.col("miny")) / size, height),
        }
    )


def wrong_crs(patches: DataFrame, epsg: int) -> DataFrame:
    return patches.where(F.col("epsg") != epsg)


def scale_factors(results: DataFrame, roi_rows: DataFrame, *keys: str) -> DataFrame:
    """Result rows by ROI rows of each patch."""
    a = results.groupBy(*keys).agg((F.max("y") + 1).alias("result_rows"))
    b = roi_rows.groupBy(*keys).agg((F.max("y") + 1).alias("roi_rows"))
    return a.join(b, list(keys)).withColumn("factor", F.col("result_rows") / F.col("roi_rows"))


def placed(patches: DataFrame, values: DataFrame, key: str, rows: int, cols: int) -> DataFrame:
    """(key, y, x, ...): a patch's values (py, px of rows x cols) at the target pixels of its window (row0, col0, row1, col1):
    each target pixel takes the nearest value at the patch's scale. An equi-join by patch and value."""
    height, width = F.col("row1") - F.col("row0"), F.col("col1") - F.col("col0")
    cells = patches.where((height > 0) & (width > 0)).select("*", F.explode(F.sequence(F.col("row0"), F.col("row1") - 1)).alias("y"))
    cells = cells.select("*", F.explode(F.sequence(F.col("col0"), F.col("col1") - 1)).alias("x"))
    py, px = F.floor((F.col("y") - F.col("row0")) * rows / height).cast("int"), F.floor((F.col("x") - F.col("col0")) * cols / width).cast("int")
    return cells.select(key, "y", "x", py.alias("py"), px.alias("px")).join(values, [key, "py", "px"]).drop("py", "px")


def stitch(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """(y, x, winner, values, n_patches): of the patches on a target pixel the last by order; of rows with equal order the
    one with the greatest values."""
    best = rows.groupBy("y", "x").agg(F.max(F.struct(order, *values)).alias("b"), F.count("*").alias("n_patches"))
    return best.select("y", "x", F.col(f"b.{order}").alias("winner"), *(F.col(f"b.{v}").alias(v) for v in values), "n_patches")


def stitch_coverage(stitched: DataFrame, roi: DataFrame, total: int) -> DataFrame:
    """Covered target pixels as shares of the ROI's and of all pixels."""
    covered = stitched.select("y", "x").distinct()
    inside = covered.join(roi.select("y", "x").distinct(), ["y", "x"], "left_semi")
    counts = covered.agg(F.count("*").alias("n_covered")).join(inside.agg(F.count("*").alias("n_inside")), F.lit(True))
    counts = counts.join(roi.select("y", "x").distinct().agg(F.count("*").alias("n_roi")), F.lit(True))  # rows of one
    return counts.withColumns({"pct_roi": percent(F.col("n_inside"), F.col("n_roi")), "pct_all": percent(F.col("n_covered"), F.lit(total))})


def bilinear(source: DataFrame, value: str, height: int | Column, width: int | Column, zoom: int) -> DataFrame:
    """(y, x, value) of a grid `zoom` times as fine: every target pixel lies between two rows and two columns of source
    pixels, whose values come with its weights; at the right and lower edges the neighbour is clamped. Source pixels list the
    targets that they have a part in, so the work is dealt as the source is."""
    height, width = (c if isinstance(c, Column) else F.lit(c) for c in (height, width))

    def reach(k: Column, size: Column) -> Column:
        """(t, weight) along one axis: targets from the source pixel before to the next one; the last pixel is its own next."""
        own = F.transform(F.sequence(k * zoom, k * zoom + zoom - 1), lambda t: F.struct(t.alias("t"), F.when(k == size - 1, 1.0).otherwise(1 - (t - k * zoom) / zoom).alias("w")))
        back = F.transform(F.sequence((k - 1) * zoom, k * zoom - 1), lambda t: F.struct(t.alias("t"), ((t - (k - 1) * zoom) / zoom).alias("w")))
        return F.filter(F.when(k > 0, F.concat(own, back)).otherwise(own), lambda p: p["w"] > 0)

    rows = source.select(F.col(value), F.explode(reach(F.col("y"), height)).alias("p"), reach(F.col("x"), width).alias("across"))
    taps = rows.select(value, F.col("p.t").alias("y"), F.col("p.w").alias("wy"), F.explode("across").alias("q"))
    return taps.groupBy("y", F.col("q.t").alias("x")).agg(F.sum(F.col("wy") * F.col("q.w") * F.col(value)).alias(value))

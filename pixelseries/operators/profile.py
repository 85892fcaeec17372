"""Profiles of cubes and rasters: statistics, gaps, sparsity, audits, equalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.functions.mix import PRIME, mixed
from pixelseries.functions.optical import legacy_classes
from pixelseries.functions.vectors import allclose


def time_index(rows: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """t: rank of the date among its cube's dates, from 0. Only the distinct dates are ranked."""
    dates = rows.select(*keys, date).distinct()
    ranked = dates.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1)
    return rows.join(ranked, [*keys, date])


def band_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"))


def valid_counts(cube: DataFrame, *keys: str) -> DataFrame:
    """Valid steps of each sensor and whether any optical value is not 0, for each pixel."""
    s, some = F.col("sensor"), F.exists("v", lambda x: x != 0)
    return cube.groupBy(*keys).agg(
        F.count_if((s == "S2") & F.col("valid")).alias("s2_valid"),
        F.count_if((s == "S1A") & some).alias("s1a_valid"),
        F.count_if((s == "S1D") & some).alias("s1d_valid"),
        F.bool_or((s == "S2") & some).alias("s2_any"),
    )


def eligible(counts: DataFrame, least: int = 10) -> DataFrame:
    """Pixels with some optical value, and enough valid optical and radar steps."""
    return counts.where(F.col("s2_any") & (F.col("s2_valid") >= least) & (F.col("s1a_valid") + F.col("s1d_valid") >= least))


def busiest_step(rows: DataFrame, counts: Column, *keys: str) -> DataFrame:
    """The step with the most counted rows, the lowest of equal ones."""
    steps = rows.groupBy(*keys, "t").agg(F.count_if(counts).alias("n"))
    best = steps.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("t")).alias("back"))).alias("b"))
    return best.select(*keys, (-F.col("b.back")).alias("t"), F.col("b.n").alias("n"))


def mask_sparsity(cube: DataFrame, pixels: int, *keys: str) -> DataFrame:
    """Share of the grid's pixels that are valid at any step."""
    seen = cube.where("valid").select(*keys, "y", "x").distinct()
    return seen.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") / F.lit(float(pixels))).alias("share"))


def doy_profile(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.min("doy").alias("first_doy"), F.max("doy").alias("last_doy"), F.countDistinct("doy").alias("n_doys"))


def gap_stats(cube: DataFrame, *keys: str) -> DataFrame:
    """Least, median and largest difference of a pixel's consecutive days; null for a single observation."""
    days = cube.select(*keys, "doy").distinct()
    gap = F.col("doy") - F.lag("doy").over(Window.partitionBy(*keys).orderBy("doy"))
    out = days.withColumn("gap", gap).groupBy(*keys)
    return out.agg(F.min("gap").alias("min_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").alias("max_gap"))


def missing_fraction(cube: DataFrame, missing: Column, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.avg(missing.cast("double")).alias("missing"))


def mask_fraction(mask: DataFrame, value: str = "value") -> DataFrame:
    """All entries, those that are exactly 1, and their share."""
    out = mask.agg(F.count("*").alias("total"), F.count_if(F.col(value) == 1).alias("ones"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("ones") / F.col("total")))


def raster_audit(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Extent and range of each raster, and whether it holds anything but 0."""
    out = rows.groupBy(*keys).agg(F.max("y").alias("max_y"), F.max("x").alias("max_x"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return out.withColumn("usable", (F.col("lowest") != 0) | (F.col("highest") != 0))


def tile_report(rows: DataFrame, value: str, nodata: float, *keys: str) -> DataFrame:
    """Of each raster: width, height, values, share without data, and the kind of its values."""
    out = rows.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"), F.avg((F.col(value) == nodata).cast("double")).alias("nodata_share"))
    return out.withColumn("dtype", F.lit(dict(rows.dtypes)[value]))


def asked_tiles(asked: DataFrame, report: DataFrame, grids: DataFrame, *keys: str) -> DataFrame:
    """The report of each tile asked for, with the reference system and affine terms of its grid; found is false, and the rest null,
    where there is no raster. One row a tile asked for, however often."""
    crs = grids.select(*keys, "epsg", F.array(*(F.col(c).cast("double") for c in "abcdef")).alias("transform"))
    out = asked.select(*keys).distinct().join(report.withColumn("found", F.lit(True)), list(keys), "left").join(crs, list(keys), "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def grid_audit(rasters: DataFrame, grids: DataFrame, part: float = 1e-5) -> DataFrame:
    """Each raster's grid against the expected one: size, EPSG code and affine terms; missing is null. Cell sizes agree within a tolerance,
    origins within `part` of an expected cell. A tolerance relative to the coordinates would let a northing of 5,000 km be 50 m off."""
    terms = lambda t: F.array(*(F.col(f"{t}.{c}") for c in "abde"))
    both = rasters.alias("r").join(grids.alias("g"), "grid_id", "left")
    same = (F.col("r.width") == F.col("g.width")) & (F.col("r.height") == F.col("g.height")) & (F.col("r.epsg") == F.col("g.epsg"))
    for c, u, v in ("cab", "fde"):
        same &= F.abs(F.col(f"r.{c}") - F.col(f"g.{c}")) <= (F.abs(f"g.{u}") + F.abs(f"g.{v}")) * part
    return both.select("grid_id", (same & allclose(terms("r"), terms("g"))).alias("matches"))


def legacy_products(obs: DataFrame, *keys: str) -> DataFrame:
    """Products whose classes are exactly {0, 4}."""
    return obs.groupBy(*keys).agg(F.collect_set("scl").alias("classes")).where(legacy_classes(F.col("classes"))).select(*keys)


def equalize(rows: DataFrame, value: str, levels: int = 256) -> DataFrame:
    """Adds level (0..levels-1 by minimum and maximum) and equalized (through the cumulative histogram). The histogram has
    at most `levels` rows, so it is summed by one task and joined back."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)
    quantised = rows.join(F.broadcast(span)).withColumn("level", F.when(F.col("hi") > F.col("lo"), F.floor(scaled).cast("int")).otherwise(0)).drop("lo", "hi")
    counted = quantised.groupBy("level").agg(F.count("*").alias("c"))
    whole = Window.orderBy("level")
    cdf = counted.withColumn("cdf", F.sum("c").over(whole)).withColumn("n", F.sum("c").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cdf = cdf.withColumn("least", F.first("cdf").over(whole))
    mapped = F.when(F.col("n") > F.col("least"), F.bround((F.col("cdf") - F.col("least")) / (F.col("n") - F.col("least")) * (levels - 1)).cast("int")).otherwise(F.col("level"))
    return quantised.join(F.broadcast(cdf.select("level", mapped.alias("equalized"))), "level")


def head_by_hash(rows: DataFrame, key: Column, n: int = 1) -> DataFrame:
    """n rows picked by a portable hash: a repeatable random pixel."""
    return rows.withColumn("__h", mixed(key)).orderBy("__h", key).limit(n).drop("__h")


def sampled_missing(cube: DataFrame, missing: Column, key: Column, share: float) -> DataFrame:
    """missing_fraction of about `share` of the rows, picked by a portable hash: the sampling is the feature."""
    return missing_fraction(cube.where(mixed(key) < int(share * PRIME) * PRIME), missing)


def channel_order(values: Column, order: Sequence[int]) -> Column:
    return F.array(*(F.get(values, F.lit(k)) for k in order))

"""Repeatable sampling of observations, by hashes that any engine can compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.functions.mix import mixed
from pixelseries.functions.vectors import any_nonzero, standardized

STEPS = 40
MIXUP_SEED = 29


def sample_steps(rows: DataFrame, pixel: Sequence[str], ordinal: str, valid: Column, h: Column, k: int = STEPS) -> DataFrame:
    """Exactly k steps of each pixel, in order: of N valid steps (all steps, if none is valid) those of the k least hashes if
    N >= k, else k draws with replacement, each a hash of pixel and draw. Adds rank (0..k-1 in order of the ordinal).
    More than k steps of a pixel are never needed, so the rest is dropped while it is ranked."""
    w = Window.partitionBy(*pixel)
    rows = rows.withColumns({"__ok": valid.cast("int"), "__h": h})
    rows = rows.withColumn("__rk", F.row_number().over(w.orderBy(F.desc("__ok"), "__h", ordinal))).where(F.col("__rk") <= k)
    rows = rows.withColumns({"__n_ok": F.sum("__ok").over(w), "__all": F.count("*").over(w)}).where("__n_ok = 0 or __ok = 1")
    n = F.when(F.col("__n_ok") > 0, F.col("__n_ok")).otherwise(F.col("__all"))  # k at most
    drawn = lambda j: mixed(*map(F.col, pixel), j) % n == F.col("__rk") - 1
    copies = F.when(n >= k, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), drawn))
    taken = rows.withColumn("__copy", F.explode(copies))
    out = taken.withColumn("rank", F.row_number().over(w.orderBy(ordinal, "__copy")) - 1)
    return out.drop("__ok", "__h", "__rk", "__n_ok", "__all", "__copy")


def orbit_union(ascending: DataFrame, descending: DataFrame) -> DataFrame:
    """Both orbits' steps; ordinal, a struct, puts all ascending ones first, not the days in order."""
    both = ascending.withColumn("orbit_rank", F.lit(0)).unionByName(descending.withColumn("orbit_rank", F.lit(1)))
    return both.withColumn("ordinal", F.struct("orbit_rank", "t"))


def sample_matrix(sampled: DataFrame, pixel: Sequence[str], mean: Sequence[float], std: Sequence[float], name: str) -> DataFrame:
    """Each pixel's k rows of standardised bands and the raw day, in order of rank."""
    row = F.array_append(standardized(F.col("v").cast("array<double>"), mean, std), F.col("doy").cast("double"))
    out = sampled.groupBy(*pixel).agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("rows"))
    return out.select(*pixel, F.col("rows.row").alias(name))


def radar_valid() -> Column:
    return any_nonzero(F.col("v"))


def shuffled(tiles: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """Rows in order of a hash, at most `most`: a capped, shuffled training sample."""
    out = tiles.withColumn("__h", mixed(key)).orderBy("__h", key)
    return (out if most is None else out.limit(most)).drop("__h")


def mixup(rows: DataFrame, key: str, values: str, share: float, bucket_rows: int = 10_000) -> DataFrame:
    """share * v + (1 - share) * the vector of the next key in a hash order of each bucket of keys; buckets of about
    `bucket_rows` keys, by another hash."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("__bucket", mixed(F.col(key), seed=MIXUP_SEED) % buckets)
    order = Window.partitionBy("__bucket").orderBy(mixed(F.col(key)), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = F.coalesce(F.lead(values).over(order), F.first(values).over(whole))
    return rows.withColumn("mixed", F.zip_with(F.col(values), partner, lambda a, b: a * share + b * (1 - share))).drop("__bucket")

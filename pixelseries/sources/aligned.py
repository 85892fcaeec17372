"""Cubes stored for scoring: bucketed by pixel, the days of their steps in a time dimension.

Two cubes with the same buckets are sampled, grouped and fused by pixel as they lie on disk: no shuffle is left between the scans and the
scorer. A pixel's steps in one year are some hundreds, so no bucket is hot. The time dimension has a row for each step of a cube,
however many pixels that has. Dates are looked up in it by a broadcast if it is short, else by a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
MOST_BROADCAST_ROWS = 1_000_000


def time_dimension(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, date, doy): the distinct dates of each cube, numbered from 0. A cube has one row a date here, so its window is short."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    return rows.select(*keys, "date").where("date is not null").distinct().select(*keys, nth.alias("t"), "date", F.dayofyear("date").alias("doy"))


def looked_up(rows: DataFrame, times: DataFrame, on: list[str], most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of the time dimension; rows without a step there go. Broadcast only after its rows are counted."""
    short = times.limit(most + 1).count() <= most
    return rows.join(F.broadcast(times) if short else times, on)


def with_steps(rows: DataFrame, times: DataFrame, *keys: str, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """rows with t in place of the date."""
    return looked_up(rows, times.drop("doy"), [*keys, "date"], most).drop("date", "doy")


def with_days(rows: DataFrame, times: DataFrame, *keys: str, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """rows with date and doy of their t."""
    return looked_up(rows, times, [*keys, "t"], most)


def write_aligned(rows: DataFrame, name: str, path: str, pixel: str = "px", buckets: int = BUCKETS) -> DataFrame:
    """Writes rows as the table `name`, one file a bucket of pixels, sorted by pixel, and returns the table."""
    dealt = rows.repartition(buckets, F.col(pixel))  # by the hash that buckets go by
    dealt.write.bucketBy(buckets, pixel).sortBy(pixel).format("parquet").option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)

"""Ledgers of finished work, splits of lists, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.functions.names import duration
from pixelseries.operators.layout import numbered


def open_tiles(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles without a result."""
    return tiles.join(done.select(key), key, "left_anti")


def _placed(tiles: DataFrame, key: str, prefix: int) -> DataFrame:
    """Adds __n (place in order of the key, from 0) and __all (number of tiles). Tiles of a key's prefix are one cell."""
    rows = numbered(tiles, [], [F.substring(key, 1, prefix)], [F.col(key)], "__n")
    return rows.join(F.broadcast(tiles.agg(F.count("*").alias("__all"))))  # one row


def balanced_split(tiles: DataFrame, workers: int, key: str = "tile_id", prefix: int = 12) -> DataFrame:
    """worker (0..): contiguous shares in order of the key, the first ones a tile larger; none is lost."""
    size, extra = F.floor(F.col("__all") / workers), F.col("__all") % workers
    late = extra + F.floor((F.col("__n") - extra * (size + 1)) / size)
    worker = F.when(F.col("__n") < extra * (size + 1), F.floor(F.col("__n") / (size + 1))).otherwise(late)
    return _placed(tiles, key, prefix).withColumn("worker", worker.cast("int")).drop("__n", "__all")


def ratio_split(tiles: DataFrame, first: int, second: int, key: str = "tile_id", prefix: int = 12) -> DataFrame:
    """pool: 1 for the first floor(n * first / (first + second)) tiles in order, 2 for the rest."""
    if first < 0 or second < 0 or first + second == 0:
        raise ValueError("shares are not negative and not both 0")
    bound = F.floor(F.col("__all") * first / (first + second))
    return _placed(tiles, key, prefix).withColumn("pool", F.when(F.col("__n") < bound, 1).otherwise(2)).drop("__n", "__all")


def progress(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    """One row: tiles expected, done and open."""
    marked = tiles.select(key).join(done.select(key, F.lit(1).alias("has")).distinct(), key, "left")
    out = marked.agg(F.count("*").alias("n_expected"), F.count("has").alias("n_done"))
    return out.withColumn("n_open", F.col("n_expected") - F.col("n_done"))


def throughput(ledger: DataFrame, *keys: str, total: int | None = None) -> DataFrame:
    """Samples a second and tiles an hour of a ledger (started, ended, samples), and the time left for `total` tiles."""
    seconds = F.unix_timestamp(F.max("ended")) - F.unix_timestamp(F.min("started"))
    out = ledger.groupBy(*keys).agg(F.count("*").alias("n_tiles"), F.sum("samples").alias("samples"), seconds.alias("seconds"))
    out = out.withColumns({"samples_a_second": F.try_divide("samples", "seconds"), "tiles_an_hour": F.try_divide(F.col("n_tiles") * 3600.0, F.col("seconds"))})
    if total is None:
        return out
    return out.withColumn("left", duration(F.col("seconds") * (total - F.col("n_tiles")) / F.col("n_tiles")))

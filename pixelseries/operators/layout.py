"""Physical layout for random access: pixels by Morton key, chunks, shards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.functions.mix import mixed


def numbered(rows: DataFrame, group: Sequence[str], cell: Sequence[Column], inside: Sequence[Column], name: str) -> DataFrame:
    """rows with gapless numbers from 0 in each group (all rows, if it names none), by the cells' order, then by the order
    inside. Only a cell's rows meet in one task; of the others just the cells' counts are needed."""
    keys = [f"__cell{k}" for k in range(len(cell))]
    rows = rows.withColumns(dict(zip(keys, cell)))
    before = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*group, *keys).count().select(*group, *keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*inside))
    out = rows.withColumn("__nth", nth).join(first, [*group, *keys])
    return out.withColumn(name, (F.col("__first") + F.col("__nth") - 1).cast("long")).drop("__first", "__nth", *keys)


def spread_bits(v: Column, bits: int = 31) -> Column:
    """Bit k of a number moves to bit 2k."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k))
    return out


def morton(y: Column, x: Column, bits: int = 31) -> Column:
    """Z-order key: the bits of x and y in turn, x lowest. 31 bits hold every place that is not negative in an int."""
    return spread_bits(x, bits).bitwiseOR(F.shiftleft(spread_bits(y, bits), 1))


def by_locality(rows: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows in ranges of (keys, Morton key), sorted inside, so that row groups are small squares."""
    keyed = rows.withColumn("morton", morton(F.col("y"), F.col("x")))
    return keyed.repartitionByRange(partitions, *keys, "morton").sortWithinPartitions(*keys, "morton")


def interleaved(y: int, x: int) -> int:
    """The Z-order key of a place."""
    return sum(((x >> k & 1) | (y >> k & 1) << 1) << 2 * k for k in range(max(y, x, 1).bit_length()))


def morton_ranges(y0: int, y1: int, x0: int, x1: int, most: int = 32) -> list[tuple[int, int]]:
    """Inclusive ranges of keys that hold the places of a half-open rectangle: those of the quadrants inside it. While there are more than
    `most`, the nearest neighbours are joined, which only takes in keys of other places."""
    bits = max(y1 - 1, x1 - 1, 0).bit_length()
    found: list[tuple[int, int]] = []
    todo = [(0, 0, bits)] if y1 > max(y0, 0) and x1 > max(x0, 0) else []
    while todo:
        y, x, level = todo.pop()
        size = 1 << level
        if y >= y1 or x >= x1 or y + size <= y0 or x + size <= x0:
            continue
        if y >= y0 and x >= x0 and y + size <= y1 and x + size <= x1 or level == 0:
            at = interleaved(y, x)
            found.append((at, at + size * size - 1))
        else:
            half = size // 2
            todo += [(y + dy, x + dx, level - 1) for dy in (0, half) for dx in (0, half)]
    found.sort()
    out: list[tuple[int, int]] = []
    for low, high in found:
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1], reverse=True)[: most - 1]
        cuts = [0, *sorted(gaps), len(out)]
        out = [(out[i][0], out[j - 1][1]) for i, j in zip(cuts, cuts[1:])]
    return out


def block_by_ranges(rows: DataFrame, y0: int, y1: int, x0: int, x1: int, most: int = 32) -> DataFrame:
    """Rows of a half-open rectangle of a table in Morton order: ranges of the key, which the scan compares with the row groups' bounds, and the
    rectangle itself."""
    key = F.col("morton")
    inside = F.lit(False)
    for low, high in morton_ranges(y0, y1, x0, x1, most):
        inside = inside | ((key >= low) & (key <= high))
    return rows.where(inside & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def permuted(places: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A bijection of 0 .. n - 1: a Feistel network over the least even number of bits that holds n, walked on while it leaves the range."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in range(rounds):
            h = (right + np.uint64((seed * 1_000_003 + k * 7919 + 1) & ((1 << 63) - 1))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shuffled_shards(rows: DataFrame, number: str, n: int, size: int, seed: int = 17) -> DataFrame:
    """rows with shard and slot: the gapless numbers from 0 to n - 1 go to shuffled places, of which every `size` make a shard, so that all
    shards but the last hold exactly that many. Nothing is sorted or moved for it, and a rerun gives the same."""

    @F.pandas_udf("long")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(permuted(k.to_numpy(np.int64), n, seed))

    out = rows.withColumn("__place", place(F.col(number).cast("long")))
    return out.withColumns({"shard": F.floor(F.col("__place") / size).cast("int"), "slot": (F.col("__place") % size).cast("int")}).drop("__place")


def training_rows(optical: DataFrame, radar: DataFrame, pixel: str) -> DataFrame:
    """One row a pixel with the series of all sensors: s2, s1a and s1d, arrays of (doy, v) in order of time; empty where a sensor has none.
    optical has pixel, date, doy, v; radar also orbit."""
    series = lambda rows, name: rows.groupBy(pixel).agg(F.array_sort(F.collect_list(F.struct("date", "doy", "v"))).alias(name))
    out = series(optical, "s2")
    for name, orbit in (("s1a", "ascending"), ("s1d", "descending")):
        out = out.join(series(radar.where(F.col("orbit") == orbit), name), pixel, "full")
    return out.select(pixel, *(F.coalesce(F.transform(c, lambda r: F.struct(r["doy"].alias("doy"), r["v"].alias("v"))), F.array()).alias(c) for c in ("s2", "s1a", "s1d")))


def chunked(pixels: DataFrame, size: int, *keys: str) -> DataFrame:
    """chunk: every `size` pixels of a key in row-major order."""
    return numbered(pixels, list(keys), [F.col("y")], [F.col("x")], "chunk").withColumn("chunk", F.floor(F.col("chunk") / size).cast("int"))


def shard(rows: DataFrame, shards: int, pixel: Column, seed: int = 17) -> DataFrame:
    """shard: by a hash of the pixel, so that a pixel's sensors share a shard."""
    return rows.withColumn("shard", (mixed(pixel, seed=seed) % shards).cast("int"))


def write_shards(rows: DataFrame, shards: int, pixel: Column, path: str) -> None:
    """Rows by shard, a folder each, in order of the Morton key; a hot shard is dealt to several writers by its key's range."""
    placed = shard(rows, shards, pixel).withColumn("morton", morton(F.col("y"), F.col("x")))
    placed.repartitionByRange("shard", "morton").sortWithinPartitions("shard", "morton").write.partitionBy("shard").parquet(path)

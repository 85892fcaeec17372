"""Streams with keyed state and event-time timers: day composites that come out once, running coverage, gaps that late days split.

State is kept by block of pixels (or by pixel), so a key is bounded by its block, whatever the region. A day's timer fires when the
watermark passes the end of the day; its rows come out once and its state goes. What arrives for a day after that is late: it is not
lost but comes out at once as rows of kind 'late', which the sink keeps apart. These operators need the RocksDB state store, which
`ready` sets for the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
BLOCK = 32
MARK = "closing"


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def by_block(stream: DataFrame, groups: Sequence[str], late: str, block: int = BLOCK) -> DataFrame:
    """The columns that the operators below take, with the watermark: day (days since the epoch), groups, block (its row and column), and the rest."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    row, column = F.floor(F.col("y") / block).cast("int"), F.floor(F.col("x") / block).cast("int")
    return rows.withColumns({"day": F.unix_date(F.to_date("ts")).cast("long"), "block_row": row, "block_column": column} | {g: F.col(g).cast("string") for g in groups})


class DayComposite(StatefulProcessor):
    """Of each pixel of a day the value of the least item. State: a day's pixels of a block, as three arrays."""

    def __init__(self, groups: Sequence[str]) -> None:
        self.groups = list(groups)
        self.columns = ["kind", "day", *self.groups, "y", "x", "item_id", "value"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "y array<int>, x array<int>, item array<long>, value array<int>")

    def _rows(self, kind: str, key: tuple, y: np.ndarray, x: np.ndarray, item: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        fixed = {"kind": kind, "day": int(key[0])} | dict(zip(self.groups, key[1 : 1 + len(self.groups)]))
        out = pd.DataFrame({"y": y, "x": x, "item_id": item, "value": value}).assign(**fixed)[self.columns]
        return out.astype({"kind": str, "day": "int64", "y": "int32", "x": "int32", "item_id": "int64", "value": "int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[~new[MARK]]
        if not len(new):
            return
        end = (int(key[0]) + 1) * DAY_MS
        if timerValues.getCurrentWatermarkInMs() >= end:
            yield self._rows("late", key, new["y"], new["x"], new["item_id"], new["value"])
            return
        parts = [new[["y", "x", "item_id", "value"]]]
        if self.held.exists():
            parts.insert(0, pd.DataFrame(dict(zip(("y", "x", "item_id", "value"), self.held.get()))))
        best = pd.concat(parts, ignore_index=True).sort_values(["y", "x", "item_id", "value"], kind="stable").drop_duplicates(["y", "x"])
        self.held.update(tuple(best[c].astype(int).tolist() for c in ("y", "x", "item_id", "value")))
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield self._rows("day", key, *map(np.array, self.held.get()))
            self.held.clear()

    def close(self) -> None:
        pass


def day_composites(stream: DataFrame, groups: Sequence[str] = (), late: str = "2 days", block: int = BLOCK) -> DataFrame:
    """kind, day (days since the epoch), groups, y, x, item_id, value: the composite of each day once it is over (kind 'day'), and rows
    that come after that (kind 'late'). stream has ts, y, x, item_id, value, groups, and perhaps closing marks. For append mode."""
    rows = by_block(_markable(stream), groups, late, block)
    keys = ["day", *groups, "block_row", "block_column"]
    names = ", ".join(f"{g} string" for g in groups)
    schema = f"kind string, day long, {names + ', ' if names else ''}y int, x int, item_id long, value int"
    wanted = rows.select(*keys, "y", "x", F.col("item_id").cast("long").alias("item_id"), F.col("value").cast("int").alias("value"), MARK)
    return wanted.groupBy(*keys).transformWithStateInPandas(DayComposite(groups), outputStructType=schema, outputMode="append", timeMode="eventtime")


class DayCoverage(StatefulProcessor):
    """The seen pixels of a day and block as bits; their number comes out whenever it grows. A day's bits go when it is over."""

    def __init__(self, groups: Sequence[str], block: int) -> None:
        self.groups, self.block = list(groups), block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bits = handle.getValueState("bits", "bits binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        end = (int(key[0]) + 1) * DAY_MS
        new = pd.concat(list(rows), ignore_index=True)
        new = new[~new[MARK]]
        if not len(new) or timerValues.getCurrentWatermarkInMs() >= end:
            return
        size = -(-self.block * self.block // 8)
        bits = np.frombuffer(bytes(self.bits.get()[0]), np.uint8).copy() if self.bits.exists() else np.zeros(size, np.uint8)
        before = int(np.bitwise_count(bits).sum())
        at = ((new["y"] % self.block) * self.block + new["x"] % self.block).to_numpy()
        np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        n = int(np.bitwise_count(bits).sum())
        if n > before:
            self.bits.update((bits.tobytes(),))
            self.handle.registerTimer(end)
            yield pd.DataFrame({"day": [int(key[0])]} | {g: [v] for g, v in zip(self.groups, key[1:])} | {"block_row": [int(key[-2])], "block_column": [int(key[-1])], "n": [n]}).astype({"block_row": "int32", "block_column": "int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.bits.clear()
        return iter(())

    def close(self) -> None:
        pass


def day_coverage(stream: DataFrame, groups: Sequence[str] = (), late: str = "2 days", block: int = BLOCK) -> DataFrame:
    """day, groups, block_row, block_column, n: the pixels of a day and block that were seen so far, whenever there are more. For update mode;
    stream has ts, y, x and groups."""
    rows = by_block(_markable(stream), groups, late, block)
    keys = ["day", *groups, "block_row", "block_column"]
    schema = ", ".join(["day long", *(f"{g} string" for g in groups), "block_row int", "block_column int", "n long"])
    return rows.select(*keys, "y", "x", MARK).groupBy(*keys).transformWithStateInPandas(DayCoverage(groups, block), outputStructType=schema, outputMode="update", timeMode="eventtime")


def coverage_percent(updates: DataFrame, pixels: int, *groups: str) -> DataFrame:
    """day, groups, n, pct of the updates of day_coverage: a block's counts only grow, so its last one is its greatest."""
    last = updates.groupBy("day", *groups, "block_row", "block_column").agg(F.max("n").alias("n"))
    out = last.groupBy("day", *groups).agg(F.sum("n").alias("n"))
    return out.withColumn("pct", F.col("n") * 100.0 / F.lit(pixels))


class GapTracker(StatefulProcessor):
    """A pixel's days in order. A new day splits the gap that it falls in: that gap is taken back, its two parts are added."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "days array<long>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = np.array(self.days.get()[0] if self.days.exists() else [], np.int64)
        after = np.union1d(before, np.concatenate([p["day"].to_numpy(np.int64) for p in rows]))
        gaps = lambda d: set(zip(d[1:].tolist(), np.diff(d).tolist()))  # noqa: E731  of whole lists: a batch may split a gap at several places
        old, new = gaps(before), gaps(after)
        out = [(int(key[0]), d, g, c) for found, c in ((old - new, -1), (new - old, 1)) for d, g in sorted(found)]
        if len(after) > len(before):
            self.days.update((after.tolist(),))
        if out:
            yield pd.DataFrame(out, columns=["pixel", "day", "gap", "change"]).astype({"pixel": "int64", "day": "int64", "gap": "int64", "change": "int32"})

    def close(self) -> None:
        pass


def pixel_gaps(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(pixel, day, gap, change) of a stream with pixel and day (days since the epoch), in any order of arrival: the days since a pixel's
    observation before, which come (1) and are taken back (-1) when a late day splits them. With ttl_ms the state of pixels without
    news for so long goes; such a query looks at its state in every batch, so it needs a processing-time trigger and does not end by
    itself. For append mode; net_gaps adds the changes up."""
    rows = stream.select(F.col("pixel").cast("long").alias("pixel"), F.col("day").cast("long").alias("day"))
    mode = "none" if ttl_ms is None else "processingtime"
    return rows.groupBy("pixel").transformWithStateInPandas(GapTracker(ttl_ms), outputStructType="pixel long, day long, gap long, change int", outputMode="append", timeMode=mode)


def net_gaps(changes: DataFrame) -> DataFrame:
    """(pixel, day, gap) that the changes leave."""
    return changes.groupBy("pixel", "day", "gap").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


def batch_gaps(rows: DataFrame) -> DataFrame:
    """The same of a table."""
    days = rows.select("pixel", "day").distinct()
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("pixel").orderBy("day"))
    return days.withColumn("gap", gap).where("gap IS NOT NULL")


def _markable(stream: DataFrame) -> DataFrame:
    return stream if MARK in stream.columns else stream.withColumn(MARK, F.lit(False))


def run_to_the_end(spark: SparkSession, stream: DataFrame, operator, folder: str, mode: str = "append") -> tuple[DataFrame, dict]:
    """Runs operator over all that the stream has now, then over a closing mark later than any day, which fires the timers still set: its
    rows, and the last progress of the stream's state. Both runs share a checkpoint, as a stream and its restart do."""
    at = f"{folder}/timers-{uuid.uuid4().hex}"
    ready(spark)
    mark = stream.schema
    spark.createDataFrame([], mark).write.parquet(f"{at}/marks")
    marks = spark.readStream.schema(mark).parquet(f"{at}/marks").withColumn(MARK, F.lit(True))
    both = _markable(stream).unionByName(marks)
    out = operator(both)
    progress: dict = {}
    for turn in range(2):
        if turn:
            columns = [F.lit("9000-01-01").cast(f.dataType) if f.name == "ts" else F.lit(0 if f.dataType.typeName() in ("integer", "long", "short") else None).cast(f.dataType) for f in mark.fields]
            spark.range(1).select(*(c.alias(f.name) for c, f in zip(columns, mark.fields))).coalesce(1).write.mode("append").parquet(f"{at}/marks")
        writer = out.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", f"{at}/rows").outputMode("append").start()
        else:
            query = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={k}")).outputMode(mode).start()
        query.awaitTermination()
        progress = query.lastProgress or progress
    return spark.read.schema(out.schema).parquet(f"{at}/rows"), progress

"""Streams over files equal the batch results."""

from __future__ import annotations

import os
import random
import time
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pixelseries.operators import composite
from pixelseries.plans import views as V
from pixelseries.streaming import arrivals as A
from pixelseries.streaming import timers as T


@pytest.fixture(scope="module")
def arrived(spark, small, tmp_path_factory):
    """Radar observations in four files in order of time, and a last one that moves the watermark."""
    folder = str(tmp_path_factory.mktemp("sar") / "rows")
    rows = V.sar(spark, small)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    last = rows.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 60 DAYS"), "item_id": F.lit(-1).cast("long"), "amp": F.lit(1.0)})
    last.withColumn("date", F.to_date("ts")).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def test_daily_radar_equals_batch(spark, arrived, tmp_path):
    folder, rows = arrived
    stream = A.once(A.timed(A.scene_stream(spark, folder, rows.schema, 10), late="40 days"))
    out = A.drained(A.daily_radar(stream), str(tmp_path))
    got = sorted(map(tuple, out.where("day < '2024-02-20'").collect()))
    want = sorted(map(tuple, composite.radar_mosaic(rows).select("date", "orbit", "pol", "y", "x", "code").collect()))
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_sliding_activity(spark, arrived, tmp_path):
    folder, rows = arrived
    out = A.drained(A.sliding_activity(A.timed(A.scene_stream(spark, folder, rows.schema, 10), late="1 day")), str(tmp_path))
    got = {r.start.date(): r.n for r in out.collect()}  # windows that the watermark has closed
    days = [r.ts.date() for r in rows.select("ts").collect()]
    assert len(got) > 10 and all(n == sum(start <= d < start + timedelta(days=10) for d in days) for start, n in got.items())


def test_ledger_upsert(spark, small, tmp_path):
    tiles = V.tiles(spark, small)
    src, led = str(tmp_path / "src"), str(tmp_path / "ledger")
    tiles.coalesce(1).write.parquet(src)
    tiles.limit(3).coalesce(1).write.mode("append").parquet(src)
    stream = A.scene_stream(spark, src, tiles.schema)
    A.ledger_upsert(stream, led, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(led).count() == tiles.select("tile_id").distinct().count()


def files(spark, folder: str, parts: list[list[tuple]], schema: str) -> None:
    """One file for each part, read in this order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for p in Path(folder).glob("part-*.parquet"):
            os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k)) if p.name not in files.seen else None
            files.seen.add(p.name)


files.seen = set()
OBS = "ts timestamp, orbit string, y int, x int, item_id long, value int"


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2023, 1, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour)


def test_days_come_out_once_and_late_rows_are_kept_apart(spark, tmp_path):
    """Three rows are for days that are over; they change no composite and are lost nowhere."""
    parts = [
        [(at(1, 5), "a", 0, 0, 7, 70), (at(1, 6), "a", 0, 0, 3, 30), (at(2), "a", 40, 1, 5, 50), (at(1), "d", 0, 0, 1, 10)],
        [(at(1, 9), "a", 0, 0, 2, 20), (at(9), "a", 1, 1, 8, 80)],  # the first is not late yet; the second moves the watermark to day 8
        [(at(1, 7), "a", 0, 0, 1, 11), (at(2, 2), "d", 3, 3, 1, 12), (at(2), "a", 40, 1, 4, 13), (at(9, 1), "a", 1, 1, 6, 60)],
        [(at(20), "a", 1, 1, 9, 90)],
    ]
    files(spark, str(tmp_path / "src"), parts, OBS)
    stream = A.scene_stream(spark, str(tmp_path / "src"), spark.read.parquet(str(tmp_path / "src")).schema)
    out, progress = T.run_to_the_end(spark, stream, lambda rows: T.day_composites(rows, ["orbit"], late="1 day"), str(tmp_path))
    got = [(r.kind, date(1970, 1, 1) + timedelta(days=r.day), r.orbit, r.y, r.x, r.item_id, r.value) for r in out.collect()]
    d = lambda n: at(n).date()
    assert sorted(g[1:] for g in got if g[0] == "day") == sorted([(d(1), "a", 0, 0, 2, 20), (d(1), "d", 0, 0, 1, 10), (d(2), "a", 40, 1, 5, 50), (d(9), "a", 1, 1, 6, 60), (d(20), "a", 1, 1, 9, 90)])
    assert sorted(g[1:] for g in got if g[0] == "late") == sorted([(d(1), "a", 0, 0, 1, 11), (d(2), "d", 3, 3, 1, 12), (d(2), "a", 40, 1, 4, 13)])
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_composites_equal_batch(spark, small, tmp_path):
    rows = V.sar(spark, small).withColumn("value", composite.db_code(F.col("amp"))).where("value <> 0").select("ts", "orbit", "pol", "y", "x", "item_id", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "src"))
    stream = A.scene_stream(spark, str(tmp_path / "src"), rows.schema, 10)
    out, progress = T.run_to_the_end(spark, stream, lambda r: T.day_composites(r, ["orbit", "pol"], block=4), str(tmp_path))
    got = sorted(tuple(r) for r in out.select(F.date_from_unix_date(F.col("day").cast("int")), "orbit", "pol", "y", "x", "value").collect())
    assert got == sorted(map(tuple, composite.radar_mosaic(V.sar(spark, small)).select("date", "orbit", "pol", "y", "x", "code").collect()))
    assert {r.kind for r in out.select("kind").distinct().collect()} == {"day"} and progress["stateOperators"][0]["numRowsTotal"] == 0


def test_coverage_grows_and_its_state_goes(spark, tmp_path):
    parts = [[(at(1), "a", 0, 0, 1, 1), (at(1), "a", 0, 5, 1, 1)], [(at(1, 3), "a", 0, 0, 2, 1), (at(1, 4), "a", 3, 3, 2, 1)], [(at(1, 8), "a", 0, 5, 3, 1)], [(at(8), "a", 0, 0, 1, 1)], [(at(1), "a", 2, 2, 9, 9)]]
    files(spark, str(tmp_path / "src"), parts, OBS)
    stream = A.scene_stream(spark, str(tmp_path / "src"), spark.read.parquet(str(tmp_path / "src")).schema)
    out, progress = T.run_to_the_end(spark, stream, lambda r: T.day_coverage(r, ["orbit"], late="1 day", block=4), str(tmp_path), "update")
    assert sorted((r.day - 19358, r.block_column, r.n) for r in out.collect()) == [(0, 0, 1), (0, 0, 2), (0, 1, 1), (7, 0, 1)]  # each batch that saw more
    assert sorted((r.day - 19358, r.n, r.pct) for r in T.coverage_percent(out, 20, "orbit").collect()) == [(0, 3, 15.0), (7, 1, 5.0)]
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_in_any_order_of_arrival(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(p, d) for p in range(6) for d in rnd.sample(range(60), 12)]
    rows += rows[:10]  # seen twice
    rnd.shuffle(rows)
    files(spark, str(tmp_path / "src"), [rows[k::4] for k in range(4)], "pixel long, day long")
    table = spark.read.parquet(str(tmp_path / "src"))
    out = A.drained(T.pixel_gaps(A.scene_stream(T.ready(spark), str(tmp_path / "src"), table.schema)), str(tmp_path))
    assert sorted(map(tuple, T.net_gaps(out).collect())) == sorted(map(tuple, T.batch_gaps(table).collect()))
    assert out.where("change < 0").count() > 0


def test_gaps_with_a_time_to_live(spark, tmp_path):
    files(spark, str(tmp_path / "src"), [[(1, 10), (1, 15), (2, 3)], [(1, 12), (2, 4)]], "pixel long, day long")
    stream = A.scene_stream(T.ready(spark), str(tmp_path / "src"), spark.read.parquet(str(tmp_path / "src")).schema)
    writer = T.pixel_gaps(stream, ttl_ms=3_600_000).writeStream.format("memory").queryName("gaps_with_ttl").outputMode("append")
    query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    got, until = [], time.time() + 90
    while len(got) < 5 and time.time() < until and query.isActive:
        time.sleep(1)
        got = sorted(map(tuple, spark.table("gaps_with_ttl").collect()))
    query.stop()
    assert got == [(1, 12, 2, 1), (1, 15, 3, 1), (1, 15, 5, -1), (1, 15, 5, 1), (2, 4, 1, 1)]

"""Rasters on other grids, and boxes of very different size."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.functions import crs
from pixelseries.operators import resample, vector

ITEM = "item_id int, a double, c double, e double, f double, width int, height int, zone int, south boolean"


def cells_of(spark, items):
    rows = [(i[0], y, x, 100 * i[0] + 10 * y + x) for i in items for y in range(i[6]) for x in range(i[5])]
    return spark.createDataFrame(rows, "item_id int, y int, x int, v int")


def test_a_finer_grid_has_no_holes(spark) -> None:
    items = [(1, 20.0, 500000.0, -20.0, 5000080.0, 4, 4, 32, False)]
    target = resample.Grid(10.0, 500000.0, -10.0, 5000080.0, 8, 8, 32)
    got = {(r.y, r.x): r.v for r in resample.resample(cells_of(spark, items), spark.createDataFrame(items, ITEM), target).collect()}
    assert got == {(y, x): 100 + 10 * (y // 2) + x // 2 for y in range(8) for x in range(8)}


def test_a_coarser_and_shifted_grid_takes_the_cell_below_the_centre(spark) -> None:
    items = [(1, 10.0, 500000.0, -10.0, 5000080.0, 8, 8, 32, False), (2, 10.0, 900000.0, -10.0, 5000080.0, 8, 8, 32, False)]  # the second is far off
    target = resample.Grid(20.0, 499990.0, -20.0, 5000090.0, 6, 6, 32)
    got = {(r.item_id, r.y, r.x): r.v for r in resample.resample(cells_of(spark, items), spark.createDataFrame(items, ITEM), target).collect()}
    want = {}
    for y in range(6):
        for x in range(6):
            sx, sy = math.floor((499990 + 20 * (x + 0.5) - 500000) / 10), math.floor((5000080 - (5000090 - 20 * (y + 0.5))) / 10)
            if 0 <= sx < 8 and 0 <= sy < 8:
                want[1, y, x] = 100 + 10 * sy + sx
    assert got == want


@pytest.mark.parametrize(("lat", "south"), [(48.0, False), (-33.0, True)])
def test_a_raster_of_the_next_zone_fills_the_middle(spark, lat, south) -> None:
    """A raster of 40 x 40 cells of zone 33 around a place that lies in the middle of a small target in zone 32: all of it is seen, and each
    value is that of the cell whose place, projected back, holds the target's centre."""
    at = spark.createDataFrame([(11.98, lat)], "lon double, lat double")
    e32, n32 = crs.to_utm(F.col("lon"), F.col("lat"), F.lit(32))
    e33, n33 = crs.to_utm(F.col("lon"), F.col("lat"), F.lit(33))
    x, y, u, v = (round(c, -1) for c in at.select(e32, n32, e33, n33).first())
    items = [(1, 20.0, u - 400, -20.0, v + 400, 40, 40, 33, south)]
    target = resample.Grid(10.0, x - 100, -10.0, y + 100, 20, 20, 32, south)
    rows = resample.resample(cells_of(spark, items), spark.createDataFrame(items, ITEM), target)
    assert rows.count() == 400 and rows.select("y", "x").distinct().count() == 400
    centre = resample.source_cells(spark.createDataFrame(items, ITEM), target)
    east, north = F.lit(u - 400) + (F.col("sx") + 0.5) * 20, F.lit(v + 400) - (F.col("sy") + 0.5) * 20
    back = resample.moved(centre, east, north, F.lit(33), F.lit(south), F.lit(32), F.lit(south))
    far = F.greatest(F.abs(F.col("__e") - (x - 100) - (F.col("x") + 0.5) * 10), F.abs(F.col("__n") - (y + 100) + (F.col("y") + 0.5) * 10))
    assert back.agg(F.max(far)).first()[0] < 15  # half a source cell's diagonal, and a little


def test_templates(spark) -> None:
    items = spark.createDataFrame([(1, 20.0, 500000.0, -20.0, 5000080.0, 4, 3, 32, False), (2, 10.0, 300000.0, -10.0, 6000000.0, 5, 5, 33, True)], ITEM)
    got = {r.item_id: r for r in resample.templates(items).collect()}
    assert (got[1].epsg, got[1].minx, got[1].miny, got[1].maxx, got[1].maxy) == (32632, 500000.0, 5000020.0, 500080.0, 5000080.0) and got[2].epsg == 32733
    assert got[1].west == pytest.approx(9.0) and 45.1 < got[1].south < got[1].north < 45.2 and got[2].north < 0


def test_the_cells_of_items_in_one_partition_are_dealt(spark) -> None:
    """A table of items is a small file; the work that comes of it is not one task's, and grows by partitions."""
    kind = "item_id int, a double, c double, e double, f double, width int, height int, zone int, south boolean"
    target = resample.Grid(10.0, 300000.0, -10.0, 5000000.0, 1000, 1000, 32)
    for n in (2, 4):
        items = spark.createDataFrame([(k, 20.0, 300000.0, -20.0, 5000000.0, 200, 200, 32, False) for k in range(n)], kind).coalesce(1)
        cells = resample.source_cells(items, target)
        assert cells.rdd.getNumPartitions() == resample.parts(items, target) >= 3 * n
        sizes = cells.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[1] == n * 402 * 402 and sizes[0] < sizes[1] / n


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_of_any_size_meet(spark, seed) -> None:
    rnd = random.Random(seed)

    def some(n: int) -> list[tuple]:
        out = []
        for k in range(n):
            size = rnd.choice([0.0, 0.01, 0.5, 3.0, 300.0]) * rnd.choice([1, rnd.random()])
            x, y = rnd.choice([rnd.uniform(-180, 180), float(rnd.randrange(-5, 5))]), rnd.choice([rnd.uniform(-90, 90), float(rnd.randrange(-5, 5))])
            out.append((k, x, y, x + size, y + size * rnd.choice([1, 0.1])))
        return out

    left, right = some(120), some(150)
    schema = "double, ".join(["int, minx ", "miny ", "maxx ", "maxy double"])
    a, b = (spark.createDataFrame(rows, f"{name} {schema}") for rows, name in ((left, "l"), (right, "r")))
    got = sorted(map(tuple, vector.boxes_meeting(a, b, 1.0, "l", "r").collect()))
    assert got == sorted((i, j) for i, x0, y0, x1, y1 in left for j, u0, v0, u1, v1 in right if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1) and len(got) > 500
    levels = a.select(vector.box_level(1.0)).distinct().count()
    cells = vector.box_cells(b, 1.0, list(range(-20, 10))).groupBy("r", "at").count().agg(F.max("count")).first()[0]
    assert cells <= 4 and levels <= 61


def test_rows_with_the_same_box_are_tested_once(spark) -> None:
    """Every pair of their rows is there, with repeated ids, and none of a box with a missing side; the cells are joined by distinct boxes."""
    schema = "double, ".join(["int, minx ", "miny ", "maxx ", "maxy double"])
    left = [(k % 200, 0.0, 0.0, 2.0, 2.0) for k in range(300)] + [(900, 50.0, 50.0, 51.0, 51.0), (901, None, 0.0, 2.0, 2.0), (902, 1.0, 1.0, float("nan"), 2.0)]
    right = [(k, 1.0, -0.0, 3.0, 9.0) for k in range(100)] + [(800, -1.0, 1.0, 0.0, 1.0), (801, 4.0, None, 5.0, 5.0)]
    a, b = (spark.createDataFrame(rows, f"{name} {schema}") for rows, name in ((left, "l"), (right, "r")))
    pairs = vector.boxes_meeting(a, b, 5.0, "l", "r")
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for i in [k % 200 for k in range(300)] for j in [*range(100), 800])
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [minx") == 2


def test_pairs_of_boxes_store_in_few_bits(spark, tmp_path) -> None:
    """Six million pairs of rows with the same boxes, of one file each: whole, dealt over tasks, and written in under 3 bits a pair. No task holds
    the pairs of a block, as the blocks are sorted between the joins and the lists that are unfolded."""
    schema = "bigint, minx double, miny double, maxx double, maxy double"
    left = spark.range(2000).selectExpr("id * 7919 % 100003 as l", "0D as minx", "0D as miny", "2D as maxx", "2D as maxy").coalesce(1)
    right = spark.range(3000).selectExpr("id * 7907 % 100003 as r", "1D as minx", "1D as miny", "3D as maxx", "3D as maxy").coalesce(1)
    far = [spark.createDataFrame([(900_000 + k, 50.0 * k, 50.0, 50.0 * k + 1, 51.0)], f"{name} {schema}") for k, name in ((1, "l"), (2, "r"))]
    pairs = vector.boxes_meeting(left.union(far[0]), right.union(far[1]), 5.0, "l", "r")
    pairs.write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == 6_000_000
    assert got.select("l").distinct().join(left, "l", "left_semi").count() == 2000 and got.select("r").distinct().join(right, "r", "left_semi").count() == 3000
    files = list(tmp_path.joinpath("pairs").glob("part-*.parquet"))
    assert sum(f.stat().st_size for f in files) * 8 < 6_000_000 * 3
    most = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert len(files) > 2 and most < 6_000_000 * 0.6
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(r_ids") < plan.index("Generate explode(l_ids") < plan.index("Sort [") < plan.index("Join Inner")


def test_pairs_of_boxes_keep_rows_without_an_id(spark) -> None:
    schema = "minx double, miny double, maxx double, maxy double"
    box = (0.0, 0.0, 1.0, 1.0)
    a, b = spark.createDataFrame([(None, *box), ("x", *box), ("x", *box)], f"l string, {schema}"), spark.createDataFrame([(None, *box), (5, *box)], f"r int, {schema}")
    assert Counter(map(tuple, vector.boxes_meeting(a, b, 5.0, "l", "r").collect())) == {(None, None): 1, (None, 5): 1, ("x", None): 2, ("x", 5): 2}
    for l, r in ((a.limit(0), b), (a, b.limit(0)), (a.limit(0), b.limit(0))):
        assert vector.boxes_meeting(l, r, 5.0, "l", "r").count() == 0


def test_windows_that_meet_any_make_no_pairs(spark) -> None:
    windows = spark.createDataFrame([(k, float(k % 3) * 20, 0.0, float(k % 3) * 20 + 2, 2.0) for k in range(300)], "w int, minx double, miny double, maxx double, maxy double")
    corners = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5)]
    rings = spark.createDataFrame([(f, 0, k, x + 20 * (f % 2) * 2, y) for f in range(200) for k, (x, y) in enumerate(corners)], "feature_id int, ring_id int, seq int, vx double, vy double")
    met = vector.meets_any(windows, rings, 5.0)
    assert sorted(r.w for r in met.collect()) == [k for k in range(300) if k % 3 != 1]
    assert met.columns == windows.columns and "Join Inner" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_centroid_of_a_union_that_overlaps(spark) -> None:
    """Against a fine raster: squares that overlap, one inside another, one with a hole, one apart, and a triangle across them."""
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    shapes = [(1, 0, square(0, 0, 4, 4)), (2, 0, square(2, 1, 5, 2)), (3, 0, square(1, 1, 1, 1)), (4, 0, square(10, 10, 4, 4)), (4, 1, square(11, 11, 2, 2)), (5, 0, [(3.0, -1.0), (12.0, 12.5), (2.0, 6.0)]), (6, 0, square(0, 0, 4, 4))]
    rows = [(1, f, r, k, float(x), float(y)) for f, r, corners in shapes for k, (x, y) in enumerate(corners)]
    got = vector.union_moments(spark.createDataFrame(rows, "g int, feature_id int, ring_id int, seq int, vx double, vy double"), 1.5, "g").first()
    step = 0.01
    n = int(16 / step)

    def inside(corners, x, y):
        out = False
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            out = out ^ ((y1 > y) != (y2 > y)) & (x1 + (y - y1) * (x2 - x1) / ((y2 - y1) or 1) > x)
        return out

    x, y = np.meshgrid((np.arange(n) + 0.5) * step - 1.5, (np.arange(n) + 0.5) * step - 1.5)
    features = {}
    for f, _, corners in shapes:
        features[f] = features.get(f, False) ^ inside(corners, x, y)
    mask = np.logical_or.reduce(list(features.values()))
    assert got.area == pytest.approx(mask.sum() * step * step, rel=2e-3)
    assert (got.cx, got.cy) == (pytest.approx(x[mask].mean(), abs=5e-3), pytest.approx(y[mask].mean(), abs=5e-3))

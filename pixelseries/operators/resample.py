"""Loading rasters on a target grid: every target cell looks up the source cell that its centre falls in.

Rasters are rows of cells (item_id, y, x, values) with a table of their grids: item_id, a, c, e, f (cell sizes and upper left corner),
width, height, zone and south (UTM). The target is one grid. An item's edges, projected into the target's zone, bound the target
cells that can see it, so only those are made, and each finds its source cell by an equi-join on (item_id, y, x).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.functions.crs import FALSE_NORTH, from_utm, to_utm
from pixelseries.operators.grid import cell, lonlat_bounds


@dataclass(frozen=True)
class Grid:
    """A north-up grid in a UTM zone: cell size a > 0 and e < 0, upper left corner (c, f)."""

    a: float
    c: float
    e: float
    f: float
    width: int
    height: int
    zone: int
    south: bool = False


def moved(rows: DataFrame, east: Column, north: Column, zone: Column, south: Column, to_zone: Column, to_south: Column) -> DataFrame:
    """rows with __e and __n: UTM metres of one zone and hemisphere in another; unchanged where they are the same. In steps of their
    own, as one expression would repeat the first projection in every term of the second."""
    lon, lat = from_utm(F.col("__e0"), F.col("__n0"), zone, south)
    rows = rows.withColumns({"__e0": east, "__n0": north}).withColumns({"__lon": lon, "__lat": lat})
    e, n = to_utm(F.col("__lon"), F.col("__lat"), to_zone)
    n = n + F.when(to_south, FALSE_NORTH).otherwise(0.0) - F.when(F.col("__lat") < 0, FALSE_NORTH).otherwise(0.0)
    same = (zone == to_zone) & (south == to_south)
    return rows.withColumns({"__e": F.when(same, F.col("__e0")).otherwise(e), "__n": F.when(same, F.col("__n0")).otherwise(n)}).drop("__e0", "__n0", "__lon", "__lat")


def parts(items: DataFrame, target: Grid, cells: int = 50_000) -> int:
    """Partitions of about `cells` target cells, by the sizes of the items: their table is small, what comes of it is not."""
    seen = lambda a, n, b, most: F.least(F.abs(F.col(a)) * F.col(n) / abs(b) + 4, F.lit(float(most)))
    n = items.agg(F.sum(seen("a", "width", target.a, target.width) * seen("e", "height", target.e, target.height) + 84)).first()[0]
    return min(20_000, 1 + int((n or 0) / cells))


def target_windows(items: DataFrame, target: Grid, steps: int = 20) -> DataFrame:
    """items with the window of target cells, x0 to x1 and y0 to y1, that can see them: the bounds of steps + 1 points a side, a cell wider,
    clipped to the target. Items that cannot be seen are left out."""
    at = F.col("__k") / F.lit(float(steps))
    w, h = F.col("a") * F.col("width"), F.col("e") * F.col("height")
    sides = F.array(*(F.struct((F.col("c") + u * w).alias("e"), (F.col("f") + v * h).alias("n")) for u, v in ((at, F.lit(0.0)), (at, F.lit(1.0)), (F.lit(0.0), at), (F.lit(1.0), at))))
    rows = items.select("item_id", "a", "c", "e", "f", "width", "height", "zone", "south").repartition(parts(items, target), "item_id")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("__k"))
    points = rows.select("item_id", "zone", "south", F.explode(sides).alias("p"))
    points = moved(points, F.col("p.e"), F.col("p.n"), F.col("zone"), F.col("south"), F.lit(target.zone), F.lit(target.south))
    seen = points.select("item_id", cell(F.col("__e"), F.lit(target.c), F.lit(target.a)).alias("x"), cell(F.col("__n"), F.lit(target.f), F.lit(target.e)).alias("y"))
    bounds = seen.groupBy("item_id").agg(
        F.greatest(F.lit(0), F.min("x") - 1).alias("x0"), F.least(F.lit(target.width), F.max("x") + 2).alias("x1"), F.greatest(F.lit(0), F.min("y") - 1).alias("y0"), F.least(F.lit(target.height), F.max("y") + 2).alias("y1")
    )
    return items.join(bounds.where("x1 > x0 and y1 > y0"), "item_id")


def source_cells(items: DataFrame, target: Grid) -> DataFrame:
    """(item_id, y, x, sy, sx): the target cells near an item, each with the place in its grid where the centre falls, inside or just outside.
    A filter on that place would be pushed below the projections and repeat them; the join with the cells that exist does without. Rows of cells are dealt before they are made,
    as the items' own few partitions would have all the projections."""
    rows = target_windows(items, target).select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")).repartition(parts(items, target), "item_id", "y")
    rows = rows.select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    east, north = target.c + (F.col("x") + 0.5) * target.a, target.f + (F.col("y") + 0.5) * target.e
    rows = moved(rows, east, north, F.lit(target.zone), F.lit(target.south), F.col("zone"), F.col("south"))
    place = lambda v, start, size: F.coalesce(cell(v, F.col(start), F.col(size)), F.lit(-1))  # noqa: E731  never null, so no null check is pushed down either
    return rows.select("item_id", "y", "x", place(F.col("__n"), "f", "e").alias("sy"), place(F.col("__e"), "c", "a").alias("sx"))


def resample(cells: DataFrame, items: DataFrame, target: Grid) -> DataFrame:
    """cells (item_id, y, x, values) on the target grid, by the nearest source cell: finer, coarser or from another zone. Target cells without
    a source cell, and items without any, have no rows."""
    there = cells.withColumnsRenamed({"y": "sy", "x": "sx"})
    values = [c for c in cells.columns if c not in ("item_id", "y", "x")]
    return source_cells(items, target).join(there, ["item_id", "sy", "sx"]).select("item_id", "y", "x", *values)


def templates(items: DataFrame) -> DataFrame:
    """item_id, epsg, width, height, the transform's terms, and the bounds in metres (minx to maxy) and degrees (west to north, by 21 points a side)."""
    boxes = items.select(
        "item_id", (F.col("zone") + F.when(F.col("south"), 32700).otherwise(32600)).alias("epsg"), "width", "height", *"acef", "zone", "south", F.col("c").alias("minx"), (F.col("f") + F.col("e") * F.col("height")).alias("miny"), (F.col("c") + F.col("a") * F.col("width")).alias("maxx"), F.col("f").alias("maxy")
    )
    degrees = lonlat_bounds(boxes, F.col("zone"), F.col("south"), "item_id", steps=20).withColumnsRenamed({"south": "south_end"})
    return boxes.drop("zone", "south").join(degrees, "item_id").withColumnRenamed("south_end", "south")

"""Grids: affine transforms, windows, tiles, patches, block means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.functions.crs import epsg, from_utm, simple_zone, to_utm


def world(a: Column, c: Column, index: Column) -> Column:
    """Coordinate of a pixel edge: origin plus index times size."""
    return c + a * index


def cell(coordinate: Column, origin: Column, size: Column) -> Column:
    """Index of the cell that holds a coordinate."""
    return F.floor((coordinate - origin) / size).cast("int")


def snap_to_grid(points: DataFrame, a: float, c: float, e: float, f: float, keep: Column) -> DataFrame:
    """One value for each target cell: of the native pixels (px, py, value) in a cell the one with the least `keep`."""
    y, x = cell(F.col("py"), F.lit(f), F.lit(e)), cell(F.col("px"), F.lit(c), F.lit(a))
    return points.withColumns({"y": y, "x": x}).groupBy("y", "x").agg(F.min_by("value", keep).alias("value"))


def origin(minx: Column, maxy: Column, pixel: float) -> Column:
    """Affine terms of a north-up grid from its upper left corner."""
    return F.struct(F.lit(pixel).alias("a"), F.lit(0.0).alias("b"), minx.alias("c"), F.lit(0.0).alias("d"), F.lit(-pixel).alias("e"), maxy.alias("f"))


def shifted(affine: Column, x: Column, y: Column) -> Column:
    """The transform of a window that starts at pixel (x, y)."""
    return affine.withField("c", affine["c"] + x * affine["a"]).withField("f", affine["f"] + y * affine["e"])


def scaled(affine: Column, factor: int) -> Column:
    return affine.withField("a", affine["a"] * factor).withField("e", affine["e"] * factor)


def windows(grids: DataFrame, size: int) -> DataFrame:
    """Row-major windows of each grid (width, height), clipped at its edges: row, col, x0, y0, w, h."""
    ys = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(size))).alias("y0")
    out = grids.where("width > 0 and height > 0").select("*", ys)
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(size))).alias("x0"))
    return out.withColumns(
        {"row": F.floor(F.col("y0") / size).cast("int"), "col": F.floor(F.col("x0") / size).cast("int"), "w": F.least(F.lit(size), F.col("width") - F.col("x0")), "h": F.least(F.lit(size), F.col("height") - F.col("y0"))}
    )


def subtiles(boxes: DataFrame, size: float = 20000.0) -> DataFrame:
    """Tiles of a box from its lower left corner, rows upward, clipped: row, col and their own box."""
    nx, ny = F.ceil((F.col("maxx") - F.col("minx")) / size).cast("int"), F.ceil((F.col("maxy") - F.col("miny")) / size).cast("int")
    out = boxes.where("maxx > minx and maxy > miny").select("*", F.explode(F.sequence(F.lit(0), ny - 1)).alias("row"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), nx - 1)).alias("col"))
    x0, y0 = F.col("minx") + F.col("col") * F.lit(size), F.col("miny") + F.col("row") * F.lit(size)
    return out.withColumns({"x0": x0, "y0": y0, "x1": F.least(x0 + size, F.col("maxx")), "y1": F.least(y0 + size, F.col("maxy"))})


def patch(y: Column, x: Column, size: int, height: int, width: int) -> dict[str, Column]:
    """patch_x, patch_y and the name x0_y0_x1_y1, whose ends are clipped to the grid."""
    px, py = (F.floor(x / size) * size).cast("int"), (F.floor(y / size) * size).cast("int")
    name = F.concat_ws("_", px, py, F.least(px + size, F.lit(width)), F.least(py + size, F.lit(height)))
    return {"patch_x": px, "patch_y": py, "patch": name}


def patch_cells(rows: DataFrame, size: int) -> DataFrame:
    """rows with the name x0_y0 of their patch, and y and x counted from its corner: all patches have the same size, whatever the grid's edges."""
    y0, x0 = (F.floor(F.col(k) / size) * size for k in ("y", "x"))
    return rows.withColumns({"name": F.concat_ws("_", x0, y0), "y": F.col("y") % size, "x": F.col("x") % size})


def patches_with_data(rows: DataFrame, roi: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Rows of patches that hold any ROI pixel."""
    named = rows.withColumns(patch(F.col("y"), F.col("x"), size, height, width))
    used = roi.select(patch(F.col("y"), F.col("x"), size, height, width)["patch"].alias("patch")).distinct()
    return named.join(used, "patch", "left_semi")


def regrid(rows: DataFrame, rate: int) -> DataFrame:
    """Every rate-th pixel of both axes, numbered anew."""
    kept = rows.where((F.col("y") % rate == 0) & (F.col("x") % rate == 0))
    return kept.withColumns({"y": (F.col("y") / rate).cast("int"), "x": (F.col("x") / rate).cast("int")})


def block_mean(rows: DataFrame, value: str, factor: int, height: Column, width: Column, whole_numbers: bool = False) -> DataFrame:
    """Means of blocks of factor x factor pixels; remainder rows and columns are dropped, whole numbers truncated."""
    inside = rows.where((F.col("y") < F.floor(height / factor) * factor) & (F.col("x") < F.floor(width / factor) * factor))
    keys = [F.floor(F.col(k) / factor).cast("int").alias(k) for k in ("y", "x")]
    others = [c for c in rows.columns if c not in ("y", "x", value)]
    mean = F.sum(value) / F.lit(float(factor * factor))
    return inside.groupBy(*others, *keys).agg((mean.cast("long") if whole_numbers else mean).alias(value))


def dense(grid: DataFrame, values: DataFrame, column: str, n: int) -> DataFrame:
    """Every (y, x) of the grid with its vector, or n zeros."""
    zeros = F.array_repeat(F.lit(0.0), n)
    return grid.join(values, ["y", "x"], "left").withColumn(column, F.coalesce(column, zeros))


def grid_pixels(grids: DataFrame) -> DataFrame:
    """All (y, x) of grids (width, height), made by the executors."""
    rows = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def zone_strips(boxes: DataFrame) -> DataFrame:
    """The UTM zones that lon/lat boxes touch, each with the box clipped to the zone's strip of six degrees."""
    rows = boxes.select("*", F.explode(F.sequence(simple_zone(F.col("minx")), simple_zone(F.col("maxx")))).alias("zone"))
    west = F.col("zone") * 6 - 186
    out = rows.withColumns({"west": F.greatest(F.col("minx"), west.cast("double")), "east": F.least(F.col("maxx"), (west + 6).cast("double"))})
    return out.withColumn("epsg", epsg(F.col("zone"), (F.col("miny") + F.col("maxy")) / 2))


def utm_bounds(boxes: DataFrame, zone: Column, *keys: str, steps: int = 20) -> DataFrame:
    """Bounds of lon/lat boxes in a UTM zone, from points along their edges."""
    share = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    rows = boxes.select("*", zone.alias("__zone"), share)
    at = F.col("k") / F.lit(float(steps))
    lon, lat = F.col("minx") + (F.col("maxx") - F.col("minx")) * at, F.col("miny") + (F.col("maxy") - F.col("miny")) * at
    sides = F.array(*(F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((lon, F.col("miny")), (lon, F.col("maxy")), (F.col("minx"), lat), (F.col("maxx"), lat))))
    points = rows.select(*keys, "__zone", F.explode(sides).alias("p"))
    east, north = to_utm(F.col("p.lon"), F.col("p.lat"), F.col("__zone"))
    xy = points.select(*keys, east.alias("e"), north.alias("n"))
    return xy.groupBy(*keys).agg(F.min("e").alias("min_e"), F.min("n").alias("min_n"), F.max("e").alias("max_e"), F.max("n").alias("max_n"))


def lonlat_bounds(boxes: DataFrame, zone: Column, south: Column, *keys: str, steps: int = 20) -> DataFrame:
    """West, south, east and north of boxes in UTM metres, from points along their edges."""
    rows = boxes.select("*", zone.alias("__zone"), south.alias("__south"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    at = F.col("k") / F.lit(float(steps))
    x, y = F.col("minx") + (F.col("maxx") - F.col("minx")) * at, F.col("miny") + (F.col("maxy") - F.col("miny")) * at
    sides = F.array(*(F.struct(a.alias("e"), b.alias("n")) for a, b in ((x, F.col("miny")), (x, F.col("maxy")), (F.col("minx"), y), (F.col("maxx"), y))))
    points = rows.select(*keys, "__zone", "__south", F.explode(sides).alias("p"))
    lon, lat = from_utm(F.col("p.e"), F.col("p.n"), F.col("__zone"), F.col("__south"))
    ends = points.select(*keys, lon.alias("lon"), lat.alias("lat"))
    return ends.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def ordinal(y: Column, x: Column, width: int) -> Column:
    """Row-major number of a pixel."""
    return y.cast("long") * width + x


def from_ordinal(n: Column, width: int) -> tuple[Column, Column]:
    """(y, x) of a row-major number."""
    return F.floor(n / width).cast("int"), F.pmod(n, F.lit(width)).cast("int")


def common_extent(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the rasters within the height and width that all of a key's rasters (raster) have: the common crop from the
    upper left corner."""
    sizes = rows.groupBy(*keys, "raster").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    least = sizes.groupBy(*keys).agg(F.min("h").alias("__h"), F.min("w").alias("__w"))
    return rows.join(least, list(keys)).where((F.col("y") < F.col("__h")) & (F.col("x") < F.col("__w"))).drop("__h", "__w")

"""Grids, crops, audits and stitching of patches as queries, with the SQL of the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.functions import vectors
from pixelseries.functions.radar import db_code
from pixelseries.operators import grid, profile, stitch, treemask, vector
from pixelseries.plans import views as V
from pixelseries.plans.registry import query, r6
from pixelseries.sources import cube, lists


@query("SELECT fy AS y, fx AS x, (SELECT max(fy) + 1 FROM fine) AS height, (SELECT max(fx) + 1 FROM fine) AS width FROM fine WHERE tree", "fine")
def roi_load(s: SparkSession, d: str) -> DataFrame:
    return cube.load_roi(V.fine(s, d).select(F.col("fy").alias("y"), F.col("fx").alias("x"), (F.col("tree").cast("int") * 7).alias("value")))


@query("SELECT CAST(floor((lat - 90) / -3.0::DOUBLE) AS INTEGER) AS y, CAST(floor((lon + 180) / 4.0::DOUBLE) AS INTEGER) AS x, arg_min(id, id) AS value FROM pts GROUP BY ALL", "pts")
def snap_to_grid(s: SparkSession, d: str) -> DataFrame:
    points = V.pts(s, d).select(F.col("lon").alias("px"), F.col("lat").alias("py"), F.col("id").alias("value"))
    return grid.snap_to_grid(points, 4.0, -180.0, -3.0, 90.0, F.col("value"))


@query("SELECT date, px, b0 FROM cube WHERE year = 2022 AND px % 2 = 0", "cube", dates=("date",))
def sensor_cube(s: SparkSession, d: str) -> DataFrame:
    k = F.col("px") % 2
    rows = V.cube(s, d).withColumns({"tile_id": F.when(k == 0, "even").otherwise("odd"), "sensor": F.lit("S2")})
    return cube.sensor_cube(rows, "even", 2022, "S2").select("date", "px", "b0")


@query("SELECT year, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n, round(avg((b1 = 0)::INT::DOUBLE), 6) AS nodata_share, 'bigint' AS dtype FROM cube GROUP BY year", "cube")
def tile_report(s: SparkSession, d: str) -> DataFrame:
    rows = V.cube(s, d).withColumn("b1", F.col("b1").cast("long"))
    return profile.tile_report(rows, "b1", 0, "year").withColumn("nodata_share", r6(F.col("nodata_share")))


@query(
    """SELECT a.year AS year, width IS NOT NULL AS found, width, height, n, round(share, 6) AS nodata_share, CASE WHEN width IS NOT NULL THEN 'bigint' END AS dtype, epsg, east
    FROM (SELECT DISTINCT year(o_orderdate) + 22 AS year FROM orders) a
    LEFT JOIN (SELECT year, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n, avg((b1 = 0)::INT::DOUBLE) AS share FROM cube GROUP BY year) USING (year)
    LEFT JOIN (SELECT DISTINCT year, 32600 + year % 60 AS epsg, year * 10.0::DOUBLE AS east FROM cube WHERE year % 2 = 0) USING (year)""", "cube")  # fmt: skip
def asked_tiles(s: SparkSession, d: str) -> DataFrame:
    """Years asked for by other tables: some have no raster, and every other one has no known grid."""
    rows = V.cube(s, d).withColumn("b1", F.col("b1").cast("long"))
    asked = V.table(s, d, "orders").select((F.year("o_orderdate") + 22).alias("year"))
    terms = {c: F.lit(v) for c, v in zip("abdef", (10, 0, 0, -10, 0))} | {"c": F.col("year") * 10}
    grids = rows.where("year % 2 = 0").select("year").distinct().withColumns({"epsg": 32600 + F.col("year") % 60, **terms})
    out = profile.asked_tiles(asked, profile.tile_report(rows, "b1", 0, "year"), grids, "year")
    return out.select("year", "found", "width", "height", "n", r6(F.col("nodata_share")).alias("nodata_share"), "dtype", "epsg", F.get("transform", F.lit(2)).alias("east"))


@query("SELECT y, x, arg_max(value, k * 1000000000 + item_id) AS value FROM (SELECT CASE WHEN pol = 'vv' THEN 0 ELSE 1 END AS k, item_id, y, x, code AS value FROM coded) GROUP BY y, x", "coded")
def collections_mosaic(s: SparkSession, d: str) -> DataFrame:
    layers = V.sar(s, d).select("pol", F.col("item_id").alias("layer_seq"), "y", "x", db_code(F.col("amp")).alias("value"))
    return treemask.collections_mosaic(layers.where("pol = 'vv'"), layers.where("pol = 'vh'"))


@query("SELECT c_custkey AS grid_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 <> 1 AND c_custkey % 4 <> 2 END AS matches FROM customer")
def grid_audit(s: SparkSession, d: str) -> DataFrame:
    """Rasters against expected grids: every third is a pixel wider, every fourth shifted, of every fifth no grid is known."""
    k = F.col("c_custkey")

    def terms(shift: Column) -> list[Column]:
        return [F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), (k * 20.0 + shift).alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), (k * 30.0).alias("f")]

    t = V.table(s, d, "customer")
    rasters = t.select(k.alias("grid_id"), (F.lit(100) + F.when(k % 3 == 1, 1).otherwise(0)).alias("width"), F.lit(90).alias("height"), F.lit(32632).alias("epsg"), *terms(F.when(k % 4 == 2, 5.0).otherwise(1e-9)))
    grids = t.where(k % 5 != 0).select(k.alias("grid_id"), F.lit(100).alias("width"), F.lit(90).alias("height"), F.lit(32632).alias("epsg"), *terms(F.lit(0.0)))
    return profile.grid_audit(rasters, grids)


@query("SELECT px, t FROM (SELECT px, row_number() OVER (PARTITION BY px ORDER BY date) - 1 AS t FROM cube) WHERE t < px % 20 + 3", "cube")
def common_steps(s: SparkSession, d: str) -> DataFrame:
    """Steps of cubes whose masks have other lengths."""
    c = profile.time_index(V.cube(s, d), "px").select("px", "t")
    masks = c.select("px").distinct().select("px", F.explode(F.sequence(F.lit(0), F.col("px") % 20 + 2)).alias("t"))
    return treemask.common_steps(c, masks, "px")


@query("SELECT tile_id FROM tiles WHERE CAST(regexp_extract(tile_id, 'zone(\\d+)_', 1) AS INTEGER) <> 32643", "tiles")
def wrong_crs(s: SparkSession, d: str) -> DataFrame:
    from pixelseries.functions.names import tile_part

    return stitch.wrong_crs(V.tiles(s, d).withColumn("epsg", tile_part(F.col("tile_id"), 1)), 32643).select("tile_id")


@query("SELECT s_suppkey AS feature_id, CASE WHEN s_suppkey % 3 = 0 THEN 4326 WHEN s_suppkey % 3 = 1 THEN 4326 ELSE 32633 END AS epsg FROM supplier")
def rings_with_crs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return lists.rings_with_crs(V.table(s, d, "supplier").select(k.alias("feature_id"), F.when(k % 3 == 1, 0).when(k % 3 == 2, 32633).alias("epsg")))


WINDOWS = """SELECT s_suppkey AS id, s_suppkey AS nr, greatest(0, s_suppkey * 7 % 40 - 2) AS col0, least(40, s_suppkey * 7 % 40 + 4) AS col1, greatest(0, s_suppkey * 11 % 40 - 3) AS row0, least(40, s_suppkey * 11 % 40 + 3) AS row1 FROM supplier"""


@query(
    f"""SELECT y, x, max(nr) AS winner, arg_max((nr * 31 + ((y - row0) * 3 // (row1 - row0)) * 7 + (x - col0) * 2 // (col1 - col0)) % 1000, nr) AS v, count(*) AS n_patches
    FROM (SELECT *, unnest(range(row0, row1)) AS y FROM (SELECT *, unnest(range(col0, col1)) AS x FROM ({WINDOWS}))) GROUP BY y, x"""
)
def stitch_patches(s: SparkSession, d: str) -> DataFrame:
    """Patches of 3 x 2 values spread over their windows of the target, the last patch on top."""
    k = F.col("s_suppkey")
    t = V.table(s, d, "supplier")
    windows = t.select(
        k.alias("id"), F.greatest(F.lit(0), k * 7 % 40 - 2).alias("col0"), F.least(F.lit(40), k * 7 % 40 + 4).alias("col1"), F.greatest(F.lit(0), k * 11 % 40 - 3).alias("row0"), F.least(F.lit(40), k * 11 % 40 + 3).alias("row1")
    )
    values = t.select(k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).select("id", F.floor(F.col("j") / 2).cast("int").alias("py"), (F.col("j") % 2).alias("px"))
    values = values.withColumn("v", (F.col("id") * 31 + F.col("py") * 7 + F.col("px")) % 1000)
    return stitch.stitch(stitch.placed(windows, values, "id", 3, 2), "id", ["v"])


@query(f"SELECT id, 3 AS result_rows, row1 - row0 AS roi_rows, round(3.0::DOUBLE / (row1 - row0), 6) AS factor FROM ({WINDOWS})")
def scale_factors(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = V.table(s, d, "supplier")
    results = t.select(k.alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("y"))
    height = F.least(F.lit(40), k * 11 % 40 + 3) - F.greatest(F.lit(0), k * 11 % 40 - 3)
    roi = t.select(k.alias("id"), F.explode(F.sequence(F.lit(0), height - 1)).alias("y"))
    return stitch.scale_factors(results, roi, "id").withColumn("factor", r6(F.col("factor")))


@query("SELECT id, lon + 40 AS c, lat - 30 AS f, 20.0::DOUBLE AS a, -20.0::DOUBLE AS e, lon + 40 + 60 AS edge, CAST(3 AS INTEGER) AS back FROM pts", "pts")
def affine_windows(s: SparkSession, d: str) -> DataFrame:
    """A grid's transform moved to a window (4 right, 3 down), made twice as coarse, and an edge of it in world coordinates."""
    g = grid.scaled(grid.shifted(grid.origin(F.col("lon"), F.col("lat"), 10.0), F.lit(4), F.lit(3)), 2)
    rows = V.pts(s, d).select("id", g.alias("g"))
    edge = grid.world(F.col("g.a"), F.col("g.c"), F.lit(3))
    return rows.select("id", "g.c", "g.f", "g.a", "g.e", edge.alias("edge"), grid.cell(edge + 1.0, F.col("g.c"), F.col("g.a")).alias("back"))


@query("SELECT px, date, y * 16 + x AS n, y AS y_again, x AS x_again FROM cube", "cube", dates=("date",))
def row_major(s: SparkSession, d: str) -> DataFrame:
    n = grid.ordinal(F.col("y"), F.col("x"), 16)
    y, x = grid.from_ordinal(n, 16)
    return V.cube(s, d).select("px", "date", n.alias("n"), y.alias("y_again"), x.alias("x_again"))


@query("SELECT k AS raster, y, x FROM (SELECT DISTINCT y, x FROM cube), range(3) t(k) WHERE y < 16 - 2 AND x < 16 - 3 AND y < 16 - k AND x < 16 - (3 - k) AND y < 14 AND x < 13", "cube")
def common_extent(s: SparkSession, d: str) -> DataFrame:
    """Three rasters, each cut otherwise, cropped to what all have."""
    cells = V.cube(s, d).select("y", "x").distinct()
    rasters = cells.select("y", "x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("raster"))
    rasters = rasters.where((F.col("y") < 16 - F.col("raster")) & (F.col("x") < 13 + F.col("raster")))
    return grid.common_extent(rasters.withColumn("one", F.lit(1)), "one").select("raster", "y", "x")


@query("SELECT DISTINCT doy, " + ", ".join(f"round({f}(doy / 365.0::DOUBLE * {2 * math.pi!r}::DOUBLE * {math.exp(math.log(365.0) * k / 3)!r}::DOUBLE), 6) + 0.0::DOUBLE AS {f}{k}" for f in ("sin", "cos") for k in range(4)) + " FROM cube", "cube")
def doy_frequencies(s: SparkSession, d: str) -> DataFrame:
    e = V.cube(s, d).select("doy").distinct().select("doy", vectors.doy_frequencies(F.col("doy"), 4).alias("e"))
    return e.select("doy", *(r6(F.get("e", F.lit(k + 4 * j))).alias(f"{f}{k}") for j, f in enumerate(("sin", "cos")) for k in range(4)))


@query("SELECT px, date, round(greatest(0.0::DOUBLE, b0 / 100.0::DOUBLE - b1 / 200.0::DOUBLE + 0.5), 6) AS h, abs(b0 - b1) <= 1e-8::DOUBLE + b1 * 1e-5::DOUBLE AS same FROM cube", "cube", dates=("date",))
def dense_layer(s: SparkSession, d: str) -> DataFrame:
    h = vectors.relu(vectors.linear(F.slice("v", 1, 2), [[0.01, -0.005]], [0.5]))
    same = vectors.allclose(F.array(F.col("b0").cast("double")), F.array(F.col("b1").cast("double")))
    return V.cube(s, d).select("px", "date", F.round(F.get(h, F.lit(0)), 6).alias("h"), same.alias("same"))


@query("SELECT DISTINCT y, x FROM (SELECT feature_id, y, x, sum(CASE WHEN (y1 > y + 0.5) <> (y2 > y + 0.5) AND x1 + (y + 0.5 - y1) * (x2 - x1) / (y2 - y1) > x + 0.5 THEN 1 ELSE 0 END) AS n FROM edges, range(52) a(y), range(52) b(x) GROUP BY ALL) WHERE n % 2 = 1", "edges")
def union_mask(s: SparkSession, d: str) -> DataFrame:
    pixels = s.range(52).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(51))).alias("x"))
    return vector.union_mask(vector.pixels_inside(V.rings(s, d), pixels))


@query("SELECT item_id FROM scenes WHERE EXISTS (SELECT 1 FROM (SELECT feature_id, min(vx) AS x0, min(vy) AS y0, max(vx) AS x1, max(vy) AS y1 FROM rings GROUP BY feature_id) WHERE minx <= x1 AND x0 <= maxx AND miny <= y1 AND y0 <= maxy)", "scenes", "rings")
def meets_any(s: SparkSession, d: str) -> DataFrame:
    return vector.meets_any(V.scenes(s, d), V.rings(s, d), 5.0).select("item_id")


@query("SELECT item_id FROM scenes WHERE (minx + maxx) / 2 BETWEEN -20 AND 20 AND (miny + maxy) / 2 BETWEEN -10 AND 30", "scenes")
def centres_in_box(s: SparkSession, d: str) -> DataFrame:
    lon, lat = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    return V.scenes(s, d).where(vector.in_box(lon, lat, (-20, -10, 20, 30))).select("item_id")


@query("SELECT px, date, b2::DOUBLE AS c0, b0::DOUBLE AS c1, b1::DOUBLE AS c2 FROM cube", "cube", dates=("date",))
def channel_order(s: SparkSession, d: str) -> DataFrame:
    v = V.cube(s, d).select("px", "date", profile.channel_order(F.col("v"), (2, 0, 1)).alias("v"))
    return v.select("px", "date", *(F.get("v", F.lit(k)).alias(f"c{k}") for k in range(3)))

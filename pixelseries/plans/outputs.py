"""Sinks, lists and layouts as queries: what is written into the shared folder and read back, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseries.functions import names
from pixelseries.functions.mix import mixed_sql
from pixelseries.operators import composite, grid, layout, ledger, profile, treemask
from pixelseries.plans import views as V
from pixelseries.plans.registry import place, query
from pixelseries.sources import arrays, commits, lists, sinks
from pixelseries.streaming import arrivals

PATCH = "((x // 5) * 5) || '_' || ((y // 5) * 5) || '_' || least((x // 5) * 5 + 5, 16) || '_' || least((y // 5) * 5 + 5, 16)"


@query(
    """SELECT date, orbit, pol, y, x, arg_min(code, item_id) AS code, 2 AS n_bands, any_value(n_sources) AS n_sources
    FROM (SELECT * FROM coded WHERE code <> 0) JOIN (SELECT date, orbit, pol, count(DISTINCT item_id) AS n_sources FROM sar GROUP BY ALL) USING (date, orbit, pol) GROUP BY date, orbit, pol, y, x""",
    "coded", dates=("date",))
def mosaic_written(s: SparkSession, d: str) -> DataFrame:
    """A mosaic that is written twice, as a rerun would: its rows are there once."""
    path, sar = place(s, "mosaic"), V.sar(s, d)
    mosaic = composite.with_source_count(composite.radar_mosaic(sar), sar)
    for _ in range(2):
        sinks.write_mosaic(mosaic, path, ("orbit", "pol"), {"n_bands": F.lit(2).cast("long")})
    return sinks.read_mosaic(s, path, ("orbit", "pol")).select("date", "orbit", "pol", "y", "x", "code", "n_bands", "n_sources")


@query(f"SELECT {PATCH} AS patch, px, date, b0 FROM cube", "cube", dates=("date",))
def patches_written(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "patches")
    sinks.write_patches(V.cube(s, d), path, 5, 16, 16)
    return s.read.parquet(path).select("patch", "px", "date", "b0")


STEPS = "SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS t FROM cube"


def with_steps(rows: DataFrame) -> DataFrame:
    """t: the number of a row's date among all dates, which are few."""
    dates = rows.select("date").distinct()
    return rows.join(F.broadcast(dates.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))), "date")


def steps_of(rows: DataFrame) -> int:
    return (rows.agg(F.max("t")).first()[0] or 0) + 1


@query(f"SELECT t, y, x, b0, b1, b2 FROM ({STEPS}) WHERE y >= 4 AND y < 9 AND x >= 2 AND x < 11 AND t < 30 AND (b0 > 0 OR b1 > 0 OR b2 > 0)", "cube")
def array_block(s: SparkSession, d: str) -> DataFrame:
    """A block of a dense array that was written from the cube: only its byte ranges are read."""
    path = place(s, "array")
    rows = with_steps(V.cube(s, d)).select(F.lit("all").alias("name"), F.lit("bands").alias("sensor"), "t", "y", "x", "v")
    arrays.write_patches(rows, path, {"bands": {"steps": steps_of(rows), "height": 16, "width": 16, "channels": 3, "dtype": "uint16"}})
    found = arrays.read_arrays(s, path).where("y >= 4 AND y < 9 AND x >= 2 AND x < 11 AND t < 30")
    return found.select("t", "y", "x", *(F.get("v", F.lit(k)).alias(f"b{k}") for k in range(3))).where("b0 > 0 OR b1 > 0 OR b2 > 0")


PATCHES = f"SELECT (x // 5 * 5) || '_' || (y // 5 * 5) AS patch, y % 5 AS y, x % 5 AS x, * EXCLUDE (y, x) FROM ({STEPS}) SEMI JOIN roi USING (px)"


@query(f"SELECT patch, 'optical' AS sensor, t, y, x, b0 AS first_value FROM ({PATCHES}) WHERE b0 > 0 UNION ALL SELECT DISTINCT patch, 'roi', 0, y, x, 1 FROM ({PATCHES})", "cube", "roi")
def dense_patches(s: SparkSession, d: str) -> DataFrame:
    """Patches of 5 x 5 pixels as arrays of that very size, filled with zeros: a region's optical values and its mask, each in a file of its own."""
    path = place(s, "dense-patches")
    rows = with_steps(V.cube(s, d)).join(V.roi(s, d).select("px"), "px", "left_semi")
    optical = grid.patch_cells(rows, 5).select("name", F.lit("optical").alias("sensor"), "t", "y", "x", "v")
    mask = optical.select("name", F.lit("roi").alias("sensor"), F.lit(0).alias("t"), "y", "x", F.array(F.lit(1.0)).alias("v")).distinct()
    size = {"height": 5, "width": 5}
    arrays.write_patches(optical.unionByName(mask), path, {"optical": {"steps": steps_of(rows), "channels": 3, "dtype": "uint16"} | size, "roi": {"steps": 1, "channels": 1, "dtype": "uint8"} | size})
    part = F.split("path", "/")
    found = arrays.read_arrays(s, path).select(F.element_at(part, -2).alias("patch"), F.regexp_replace(F.element_at(part, -1), ".npy", "").alias("sensor"), "t", "y", "x", F.get("v", F.lit(0)).alias("first_value"))
    return found.where("first_value > 0")


@query("SELECT y // 8 AS block, y, x, embedding[1]::DOUBLE AS first_value, embedding[64]::DOUBLE AS last_value FROM (SELECT vec_id // 25 AS y, vec_id % 25 AS x, embedding FROM embeddings)")
def representation_written(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "representation")
    sinks.write_representation(V.rep(s, d), path, block_rows=8)
    return s.read.parquet(path).select("block", "y", "x", F.get("z", F.lit(0)).cast("double").alias("first_value"), F.get("z", F.lit(63)).cast("double").alias("last_value"))


@query("SELECT year, (y * 16 + x) // 50 AS chunk, count(DISTINCT px) AS pixels, count(*) AS steps FROM cube GROUP BY ALL", "cube")
def series_written(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "series")
    series = treemask.pixel_series(profile.time_index(V.cube(s, d), "px", "year"), "px", "year")
    chunk = F.floor(grid.ordinal(F.col("y"), F.col("x"), 16) / 50).cast("int")
    sinks.write_series(series.select(F.lit("t").alias("tile_id"), "year", F.lit("S2").alias("sensor"), chunk.alias("chunk"), F.col("y").alias("row"), F.col("x").alias("col"), "px", "series"), path)
    return s.read.parquet(path).groupBy("year", "chunk").agg(F.countDistinct("px").alias("pixels"), F.sum(F.size("series")).alias("steps"))


@query("SELECT tile_id, ntile(7) OVER (ORDER BY tile_id) - 1 AS worker FROM tiles", "tiles")
def splits_written(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "splits")
    sinks.write_splits(ledger.balanced_split(V.tiles(s, d), 7).select("tile_id", "worker"), path)
    return s.read.json(path).select("tile_id", F.col("worker").cast("int").alias("worker"))


@query("SELECT tile_id, CASE WHEN nr % 3 = 0 THEN 'before' ELSE 'now' END AS run FROM tiles WHERE nr % 3 = 0 OR nr % 2 = 0", "tiles")
def ledger_resumed(s: SparkSession, d: str) -> DataFrame:
    """A second run into the same table writes only the tiles that are not there, whole and with rows that pass the audit."""
    path, t = place(s, "results"), V.tiles(s, d).select("tile_id", "nr")
    packs = 1 + t.count() // 1000  # tiles are many and of a row each
    runs = {"before": t.where("nr % 3 = 0"), "now": t.where("nr % 3 = 0 OR nr % 2 = 0")}
    for run, todo in runs.items():
        commits.write_missing(todo.withColumn("run", F.lit(run)), path, ["tile_id"], lambda rows: rows.where("nr IS NOT NULL"), packs)
    return commits.read(s, path, ["tile_id"]).select("tile_id", "run")


@query("SELECT tile_id FROM tiles ORDER BY tile_id LIMIT 1 OFFSET 4", "tiles")
def listed_tile(s: SparkSession, d: str) -> DataFrame:
    """The fifth line of a written list."""
    path = place(s, "list")
    sinks.write_list(V.tiles(s, d), path)
    return lists.nth_line(lists.text_list(s, path), 5)


@query("SELECT tile_id FROM tiles WHERE nr % 7 = 3", "tiles")
def json_list(s: SparkSession, d: str) -> DataFrame:
    """A JSON array, written as one text and read back."""
    path = place(s, "json")
    lists.as_json(V.tiles(s, d).where("nr % 7 = 3"), "tile_id").select("list").coalesce(1).write.text(path)
    return lists.json_list(s, path).select(F.col("path").alias("tile_id"))


@query("SELECT nr % 7 AS worker, to_json(list(tile_id ORDER BY tile_id))::VARCHAR AS list FROM tiles GROUP BY ALL", "tiles")
def json_splits(s: SparkSession, d: str) -> DataFrame:
    return lists.as_json(V.tiles(s, d).withColumn("worker", F.col("nr") % 7), "tile_id", "worker")


@query("SELECT px, date, b0 FROM cube WHERE y >= 4 AND y < 9 AND x >= 2 AND x < 11", "cube", dates=("date",))
def locality_block(s: SparkSession, d: str) -> DataFrame:
    """A block of a table in Morton order, by ranges of keys: the row groups that hold none of it are left out by their bounds."""
    path = place(s, "locality")
    layout.by_locality(V.cube(s, d), 8).write.option("parquet.block.size", str(1 << 16)).parquet(path)
    return layout.block_by_ranges(s.read.parquet(path), 4, 9, 2, 11).select("px", "date", "b0")


@query(f"SELECT shard, count(*) AS n, count(DISTINCT px) AS pixels FROM (SELECT px, {mixed_sql('px')} % 8 AS shard FROM cube) GROUP BY shard", "cube")
def shards_written(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "shards")
    layout.write_shards(V.cube(s, d), 8, F.col("px"), path)
    return s.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("px").alias("pixels"))


@query(
    """SELECT shard, CAST(least(30, n - shard * 30) AS BIGINT) AS pixels, least(30, n - shard * 30) AS slots FROM (SELECT n, unnest(range((n + 29) // 30)) AS shard
    FROM (SELECT count(*) AS n FROM (SELECT px FROM cube UNION SELECT px FROM radar_cube)))""",
    "cube", "radar_cube")
def training_shards(s: SparkSession, d: str) -> DataFrame:
    """Pixels with all sensors in one row, shuffled into shards of exactly 30."""
    path = place(s, "training")
    rows = layout.training_rows(V.cube(s, d).select("px", "date", "doy", "v"), V.radar_cube(s, d).select("px", "date", "doy", "v", "orbit"), "px")
    rows = layout.numbered(rows, [], [F.pmod("px", F.lit(16))], [F.col("px")], "number")
    shards = layout.shuffled_shards(rows, "number", rows.count(), 30).drop("number")
    shards.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return s.read.parquet(path).groupBy("shard").agg(F.count_distinct("px").alias("pixels"), (F.max("slot") + 1).alias("slots"))


@query("SELECT y, x, z[1] AS band_1, z[2] AS band_2, z[3] AS band_3 FROM rep", "rep")
def bands_wide(s: SparkSession, d: str) -> DataFrame:
    return sinks.bands_wide(V.rep(s, d), 3)


@query("SELECT DISTINCT 'S2_' || nr % 9 AS name, CAST(nr % 9 + 2016 AS VARCHAR) AS year FROM tiles WHERE nr % 9 <> 4", "tiles")
def numeric_years(s: SparkSession, d: str) -> DataFrame:
    k = F.col("nr") % 9
    rows = V.tiles(s, d).select(F.when(k == 4, "no_year").otherwise((k + 2016).cast("string")).alias("year"), F.concat(F.lit("S2_"), k.cast("string")).alias("name")).distinct()
    return lists.numeric_years(rows, "year").select("name", "year")


@query("SELECT tile_id FROM tiles WHERE nr % 5 <> 1", "tiles")
def tiles_without_data(s: SparkSession, d: str) -> DataFrame:
    t = V.tiles(s, d)
    return lists.tiles_without_data(t, t.where("nr % 5 = 1")).select("tile_id")


@query("SELECT nr, tile_id AS listed, 'tile_' || tile_id AS named FROM tiles", "tiles")
def tile_names(s: SparkSession, d: str) -> DataFrame:
    t = F.col("tile_id")
    path = F.concat(F.lit("folder/tile_"), t, F.lit(".tif"))
    return V.tiles(s, d).select("nr", names.listed_tile(path).alias("listed"), names.tile_name(*(names.tile_part(t, k) for k in (1, 2, 3))).alias("named"))


@query("SELECT DISTINCT date, orbit, pol, strftime(date, '%Y-%m-%d') || '_' || pol || '_' || orbit AS radar_name, strftime(date, '%Y-%m-%d') || '_mosaic' AS optical_name FROM sar", "sar", dates=("date",))
def mosaic_names(s: SparkSession, d: str) -> DataFrame:
    rows = V.sar(s, d).select("date", "orbit", "pol").distinct()
    return rows.select("*", names.mosaic_name(F.col("date"), F.col("pol"), F.col("orbit")).alias("radar_name"), names.mosaic_name(F.col("date")).alias("optical_name"))


@query("SELECT item_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, year(ts) || '-01-01 00:00:00' AS first_second, year(ts) || '-12-31 23:59:59' AS last_second FROM sar", "sar")
def iso_times(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("item_id") % 2 == 0, "Z").otherwise(""))
    first, last = names.year_bounds(F.year("ts"))
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return V.sar(s, d).select("item_id", form(names.iso_time(text)).alias("at"), form(first).alias("first_second"), form(last).alias("last_second"))


@query("SELECT DISTINCT tile_id FROM tiles WHERE nr % 2 = 1 OR nr % 3 = 0", "tiles")
def stream_ledger(s: SparkSession, d: str) -> DataFrame:
    """A stream of finished tiles into a ledger that already holds some of them: each is there once."""
    path = place(s, "stream-ledger")
    V.tiles(s, d).where("nr % 3 = 0").select("tile_id").write.parquet(path)
    done = V.tiles_of(arrivals.table_stream(s, d, "supplier")).where("nr % 2 = 1")
    arrivals.ledger_upsert(done, path, place(s, "checkpoint")).awaitTermination()
    return s.read.parquet(path)


@query("SELECT tile_id FROM tiles", "tiles")
def tiles_listed(s: SparkSession, d: str) -> DataFrame:
    """Ids of tile files, listed by their names; other files of the folder do not count."""
    path = place(s, "tiles")
    named = V.tiles(s, d).select(F.concat(F.lit("tile_"), "tile_id", F.lit(".tif")).alias("file"), F.col("tile_id").cast("binary").alias("content"))
    arrays.put_files(named, path)
    arrays.put_files(named.withColumn("file", F.concat(F.lit("other_"), "file")), path)
    return lists.tiles_in(s, path)

"""The operators as queries over the given tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.functions import crs, names, optical, vectors
from pixelseries.functions.mix import PRIME, mixed, mixed_sql
from pixelseries.functions.radar import db_code
from pixelseries.operators import composite, grid, layout, ledger, profile, resample, sampling, score, stitch, treemask, vector
from pixelseries.plans import views as V
from pixelseries.plans.registry import ORACLES, QUERIES, place, query, r6
from pixelseries.sources import aligned, catalog, lists, sinks
from pixelseries.streaming import arrivals, timers

__all__ = ["ORACLES", "QUERIES"]

# --- optical ---------------------------------------------------------------------------------------------------------


@query("SELECT date, count(*) AS n, count(*) FILTER (scl NOT IN (0, 1, 2, 3, 8, 9)) AS n_valid FROM obs GROUP BY date", "obs", dates=("date",))
def optical_valid_class(s: SparkSession, d: str) -> DataFrame:
    return V.obs(s, d).groupBy("date").agg(F.count("*").alias("n"), F.count_if(optical.valid_class(F.col("scl"))).alias("n_valid"))


@query("SELECT date, y, x, item_seq FROM first_valid", "first_valid", dates=("date",))
def first_valid_item(s: SparkSession, d: str) -> DataFrame:
    return composite.first_valid(V.obs(s, d), V.roi(s, d))


@query("SELECT date, n, round(pct, 6) AS pct FROM covered", "covered", dates=("date",))
def day_coverage(s: SparkSession, d: str) -> DataFrame:
    roi = V.roi(s, d)
    return composite.coverage(composite.first_valid(V.obs(s, d), roi), roi, "date").withColumn("pct", r6(F.col("pct")))


@query("SELECT date, n, round(pct, 6) AS pct FROM covered WHERE pct >= 70", "covered", dates=("date",))
def coverage_gate(s: SparkSession, d: str) -> DataFrame:
    roi = V.roi(s, d)
    return composite.passing(composite.coverage(composite.first_valid(V.obs(s, d), roi), roi, "date"), 70.0).withColumn("pct", r6(F.col("pct")))


LABEL_SQL = "CASE scl " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in optical.CLASS_LABELS.items()) + " END"


@query(f"SELECT date, scl, {LABEL_SQL} AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM roi), 6) AS pct FROM obs GROUP BY date, scl", "obs", "roi", dates=("date",))
def class_histogram(s: SparkSession, d: str) -> DataFrame:
    return composite.class_histogram(V.obs(s, d), V.roi(s, d)).withColumn("pct", r6(F.col("pct")))


@query(
    """SELECT o.date, o.y, o.x, o.item_seq, CASE WHEN o.date > DATE '2022-01-25' AND p0 >= 1000 THEN p0 - 1000 ELSE p0 END AS p0
    FROM obs o JOIN first_valid f USING (date, px, item_seq) JOIN covered c ON c.date = o.date AND pct >= 10""",
    "obs", "first_valid", "covered", dates=("date",))
def day_mosaic_harmonized(s: SparkSession, d: str) -> DataFrame:
    return composite.day_mosaic(V.obs(s, d), V.roi(s, d), ["p0"], min_coverage=10.0)


DAY = "(date - DATE '1970-01-01')"


@query(
    f"""SELECT date, y, x, item_seq FROM (SELECT o.*, row_number() OVER (PARTITION BY date, o.y, o.x ORDER BY {mixed_sql("o.y", "o.x", DAY, "item_seq")}, item_seq) AS nth
    FROM obs o JOIN roi USING (px) ANTI JOIN first_valid f USING (date, px)) WHERE nth = 1""",
    "obs", "roi", "first_valid", dates=("date",))
def fallback_pick(s: SparkSession, d: str) -> DataFrame:
    obs, roi = V.obs(s, d), V.roi(s, d)
    return composite.fallback(obs, roi, composite.first_valid(obs, roi))


@query("SELECT px, date FROM obs GROUP BY px, date HAVING list_sort(list(DISTINCT scl)) = [0, 4]", "obs", dates=("date",))
def legacy_products(s: SparkSession, d: str) -> DataFrame:
    return profile.legacy_products(V.obs(s, d), "px", "date")


# --- radar -----------------------------------------------------------------------------------------------------------


@query("SELECT item_id, code FROM coded", "coded")
def radar_db_code(s: SparkSession, d: str) -> DataFrame:
    return V.sar(s, d).select("item_id", db_code(F.col("amp")).alias("code"))


@query("SELECT date, orbit, count(*) AS n_items FROM sar GROUP BY date, orbit", "sar", dates=("date",))
def radar_day_orbit_groups(s: SparkSession, d: str) -> DataFrame:
    rows = V.sar(s, d).select(F.col("ts").alias("acquired"), F.nullif(F.col("orbit"), F.lit("unknown")).alias("orbit"))
    return catalog.by_day_and_orbit(rows)


RADAR_COVERAGE = "SELECT date, orbit, pol, max(p) AS pct FROM (SELECT date, orbit, pol, tile, 100.0::DOUBLE * count(DISTINCT px) / 64 AS p FROM sar WHERE amp > 0 GROUP BY ALL) GROUP BY date, orbit, pol"


@query(f"SELECT date, orbit, pol, round(pct, 6) AS pct FROM ({RADAR_COVERAGE})", "sar", dates=("date",))
def radar_coverage(s: SparkSession, d: str) -> DataFrame:
    return composite.radar_item_coverage(V.sar(s, d), V.RADAR_PIXELS).withColumn("pct", r6(F.col("pct")))


@query("SELECT date, orbit, pol, round(100.0::DOUBLE * count(DISTINCT px) / 64, 6) AS pct FROM sar WHERE amp > 0 GROUP BY ALL", "sar", dates=("date",))
def radar_coverage_union(s: SparkSession, d: str) -> DataFrame:
    return composite.radar_item_coverage(V.sar(s, d), V.RADAR_PIXELS, union=True).withColumn("pct", r6(F.col("pct")))


@query("SELECT date, orbit, pol, y, x, arg_min(code, item_id) AS code FROM coded WHERE code <> 0 GROUP BY ALL", "coded", dates=("date",))
def radar_mosaic(s: SparkSession, d: str) -> DataFrame:
    return composite.radar_mosaic(V.sar(s, d))


def _status(s: SparkSession, d: str) -> DataFrame:
    groups = composite.radar_groups(V.sar(s, d), V.RADAR_PIXELS)
    return composite.radar_status(groups, 3.0, F.col("orbit") == "unknown").withColumn("month", F.date_format("date", "yyyy-MM"))


STATUS = """SELECT *, strftime(date, '%Y-%m') AS month, CASE WHEN orbit = 'unknown' THEN 'failed' WHEN n = 0 THEN 'no_data' WHEN 100.0::DOUBLE * best / 64 < 3 THEN 'skipped' ELSE 'success' END AS status
    FROM (SELECT date, orbit, pol, sum(n) AS n, max(n) AS best FROM (SELECT date, orbit, pol, tile, count(DISTINCT px) FILTER (amp > 0) AS n FROM sar GROUP BY ALL) GROUP BY ALL)"""
SUMMARY = f"""SELECT month, date, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'no_data') AS n_no_data,
    count(*) FILTER (status = 'failed') AS n_failed, count(*) AS n_all, bool_or(status = 'success') OR bool_and(status = 'skipped') AS ok FROM ({STATUS}) GROUP BY month, date"""


@query(f"SELECT * EXCLUDE (month) FROM ({SUMMARY})", "sar", dates=("date",))
def run_status(s: SparkSession, d: str) -> DataFrame:
    return composite.status_summary(_status(s, d), "date")


@query(f"SELECT month, count(*) FILTER (ok) AS n_ok, count(*) AS n_groups, CASE WHEN bool_and(ok) THEN 'all' WHEN bool_or(ok) THEN 'partial' ELSE 'none' END AS verdict FROM ({SUMMARY}) GROUP BY month", "sar")
def run_verdict(s: SparkSession, d: str) -> DataFrame:
    return composite.run_verdict(composite.status_summary(_status(s, d), "month", "date"), "month")


# --- catalog ---------------------------------------------------------------------------------------------------------


@query("SELECT acquired::DATE AS date, count(*) AS n_items, array_to_string(list(item_id ORDER BY acquired, item_id), ' ') AS items FROM scenes GROUP BY ALL", "scenes", dates=("date",))
def group_by_day(s: SparkSession, d: str) -> DataFrame:
    return catalog.by_day(V.scenes(s, d)).withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), " "))


@query("SELECT item_id, row_number() OVER (PARTITION BY acquired::DATE ORDER BY acquired, item_id) - 1 AS item_seq FROM scenes", "scenes")
def item_order(s: SparkSession, d: str) -> DataFrame:
    return catalog.item_order(V.scenes(s, d)).select("item_id", "item_seq")


@query("SELECT item_id FROM scenes WHERE minx <= 20 AND maxx >= -20 AND miny <= 30 AND maxy >= -10 AND acquired >= '1998-01-01' AND acquired <= TIMESTAMP '1998-12-31 00:00:00' AND cloud_cover < 50", "scenes")
def catalog_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.search_optical(V.scenes(s, d), (-20, -10, 20, 30), "1998-01-01", "1998-12-31", 50).select("item_id")


@query("SELECT item_id FROM scenes WHERE minx <= 20 AND maxx >= -20 AND miny <= 30 AND maxy >= -10 AND acquired >= '1998-01-01' AND acquired <= TIMESTAMP '1998-12-31 00:00:00' AND orbit = 'ascending'", "scenes")
def catalog_search_radar(s: SparkSession, d: str) -> DataFrame:
    return catalog.search_radar(V.scenes(s, d), (-20, -10, 20, 30), "1998-01-01", "1998-12-31", "ascending").select("item_id")


@query("SELECT year, (n // 15) AS chunk, first_day + CAST(n AS INTEGER) AS chunk_start, least(first_day + CAST(n AS INTEGER) + 14, last_day) AS chunk_end FROM (SELECT *, unnest(range(0, (last_day - first_day) + 1, 15)) AS n FROM spans)", "spans", dates=("chunk_start", "chunk_end"))
def date_chunks(s: SparkSession, d: str) -> DataFrame:
    return catalog.date_chunks(V.spans(s, d)).select("year", "chunk", "chunk_start", "chunk_end")


@query("SELECT item_id, (acquired::DATE - first_day) // 15 AS chunk FROM scenes JOIN spans ON year(acquired) = year", "spans")
def chunked_search(s: SparkSession, d: str) -> DataFrame:
    return catalog.search_chunked(V.scenes(s, d), V.spans(s, d)).select("item_id", "chunk")


@query(
    """SELECT year, part, first_day + CAST(part * piece // 86400 AS INTEGER) AS part_start,
    CASE WHEN part = 6 THEN last_day ELSE first_day + CAST((part + 1) * piece // 86400 AS INTEGER) - 1 END AS part_end
    FROM (SELECT *, ((last_day - first_day)::BIGINT + 1) * 86400 // 7 AS piece, unnest(range(7)) AS part FROM spans)""",
    "spans", dates=("part_start", "part_end"))
def date_partitions(s: SparkSession, d: str) -> DataFrame:
    return catalog.date_partitions(V.spans(s, d), 7).select("year", "part", "part_start", "part_end")


@query("SELECT l_orderkey AS item_id, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL")
def dedup_items(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("first_line"))
    return catalog.keep_first(rows, ["item_id"], ["first_line"])


@query("SELECT orbit, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM scenes GROUP BY orbit", "scenes")
def footprint_union(s: SparkSession, d: str) -> DataFrame:
    return catalog.footprint(V.scenes(s, d), "orbit")


@query("SELECT date, count(DISTINCT pol) AS n FROM sar GROUP BY date HAVING count(DISTINCT pol) = 2", "sar", dates=("date",))
def both_bands(s: SparkSession, d: str) -> DataFrame:
    days = V.sar(s, d).groupBy("date").agg(F.collect_set("pol").alias("assets"))
    return catalog.with_assets(days, ["vv", "vh"]).select("date", F.size("assets").alias("n"))


# --- cubes and profiles ----------------------------------------------------------------------------------------------


@query("SELECT px, year, date, row_number() OVER (PARTITION BY px, year ORDER BY date) - 1 AS t FROM cube", "cube", dates=("date",))
def time_index(s: SparkSession, d: str) -> DataFrame:
    return profile.time_index(V.cube(s, d), "px", "year").select("px", "year", "date", "t")


@query("SELECT px, year, min(gap) AS min_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, max(gap) AS max_gap FROM (SELECT px, year, doy - lag(doy) OVER (PARTITION BY px, year ORDER BY doy) AS gap FROM (SELECT DISTINCT px, year, doy FROM cube)) GROUP BY px, year", "cube")
def doy_gap_stats(s: SparkSession, d: str) -> DataFrame:
    return profile.gap_stats(V.cube(s, d), "px", "year").withColumn("median_gap", r6(F.col("median_gap")))


@query("SELECT year, min(doy) AS first_doy, max(doy) AS last_doy, count(DISTINCT doy) AS n_doys FROM cube GROUP BY year", "cube")
def doy_profile(s: SparkSession, d: str) -> DataFrame:
    return profile.doy_profile(V.cube(s, d), "year")


@query("SELECT year, t, n FROM (SELECT year, doy AS t, count(*) FILTER (valid) AS n FROM cube GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, t) = 1", "cube")
def busiest_step(s: SparkSession, d: str) -> DataFrame:
    return profile.busiest_step(V.cube(s, d).withColumn("t", F.col("doy")), F.col("valid"), "year")


@query("SELECT year, count(DISTINCT px) AS n, count(DISTINCT px) / 256.0::DOUBLE AS share FROM cube WHERE valid GROUP BY year", "cube")
def mask_sparsity(s: SparkSession, d: str) -> DataFrame:
    return profile.mask_sparsity(V.cube(s, d), V.PIXELS, "year")


@query("SELECT year, round(avg((NOT valid)::INT::DOUBLE), 6) AS missing FROM cube GROUP BY year", "cube")
def missing_fraction(s: SparkSession, d: str) -> DataFrame:
    return profile.missing_fraction(V.cube(s, d), ~F.col("valid"), "year").withColumn("missing", r6(F.col("missing")))


@query(f"SELECT round(avg((NOT valid)::INT::DOUBLE), 6) AS missing FROM cube WHERE {mixed_sql('px * 10000 + doy')} < {PRIME // 2} * {PRIME}::BIGINT", "cube")
def sampled_missing(s: SparkSession, d: str) -> DataFrame:
    key = F.col("px").cast("long") * 10000 + F.col("doy")
    return profile.sampled_missing(V.cube(s, d), ~F.col("valid"), key, 0.5).withColumn("missing", r6(F.col("missing")))


@query("SELECT count(*) AS total, count(*) FILTER (tree) AS ones, round(count(*) FILTER (tree) / count(*)::DOUBLE, 6) AS share FROM fine", "fine")
def mask_fraction(s: SparkSession, d: str) -> DataFrame:
    return profile.mask_fraction(V.fine(s, d).select(F.col("tree").cast("int").alias("value"))).withColumn("share", r6(F.col("share")))


@query("SELECT date, min(b0) AS lowest, max(b0) AS highest, round(avg(b0), 6) AS mean FROM cube GROUP BY date", "cube", dates=("date",))
def band_statistics(s: SparkSession, d: str) -> DataFrame:
    return profile.band_stats(V.cube(s, d), "b0", "date").withColumn("mean", r6(F.col("mean")))


@query(
    """SELECT px, doy, date, CAST(level AS INTEGER) AS level, CASE WHEN n > least_cdf THEN CAST(round_even((cdf - least_cdf) / (n - least_cdf)::DOUBLE * 255, 0) AS INTEGER) ELSE level END AS equalized FROM (
    SELECT q.*, h.cdf, h.n, h.least_cdf FROM (SELECT px, doy, date, CAST(floor((b0 - lo) / (hi - lo)::DOUBLE * 255) AS INTEGER) AS level FROM cube, (SELECT min(b0) AS lo, max(b0) AS hi FROM cube)) q
    JOIN (SELECT level, cdf, max(cdf) OVER () AS n, min(cdf) OVER () AS least_cdf FROM (SELECT level, sum(count(*)) OVER (ORDER BY level) AS cdf
        FROM (SELECT CAST(floor((b0 - lo) / (hi - lo)::DOUBLE * 255) AS INTEGER) AS level FROM cube, (SELECT min(b0) AS lo, max(b0) AS hi FROM cube)) GROUP BY level)) h USING (level))""",
    "cube", dates=("date",))
def equalize_levels(s: SparkSession, d: str) -> DataFrame:
    return profile.equalize(V.cube(s, d), "b0").select("px", "doy", "date", "level", "equalized")


@query("SELECT date, max(y) AS max_y, max(x) AS max_x, min(b0) AS lowest, max(b0) AS highest, min(b0) <> 0 OR max(b0) <> 0 AS usable FROM cube GROUP BY date", "cube", dates=("date",))
def raster_audit(s: SparkSession, d: str) -> DataFrame:
    return profile.raster_audit(V.cube(s, d), "b0", "date")


@query(f"SELECT px FROM (SELECT DISTINCT px FROM cube) ORDER BY {mixed_sql('px')}, px LIMIT 1", "cube")
def random_pixel(s: SparkSession, d: str) -> DataFrame:
    return profile.head_by_hash(V.cube(s, d).select("px").distinct(), F.col("px"))


@query("SELECT year, count(DISTINCT doy) AS steps, max(y) + 1 AS height, max(x) + 1 AS width, count(*) AS rows FROM cube GROUP BY year", "cube")
def cube_shape(s: SparkSession, d: str) -> DataFrame:
    from pixelseries.sources.cube import cube_info

    return cube_info(V.cube(s, d).withColumn("t", F.col("doy")), "year")


@query("SELECT px, date, b0 FROM cube WHERE y >= 4 AND y < 9 AND x >= 2 AND x < 11", "cube", dates=("date",))
def block_scan(s: SparkSession, d: str) -> DataFrame:
    from pixelseries.sources.cube import block, select_band

    return select_band(block(V.cube(s, d), 4, 9, 2, 11), "v", 0).select("px", "date", F.col("value").cast("long").alias("b0"))


@query(
    """SELECT px, s2_valid, s1a_valid, s1d_valid FROM (SELECT px, count(*) FILTER (valid) AS s2_valid, bool_or(b0 <> 0 OR b1 <> 0 OR b2 <> 0) AS s2_any FROM cube GROUP BY px)
    JOIN (SELECT px, count(*) FILTER (orbit = 'ascending' AND (vv <> 0 OR vh <> 0)) AS s1a_valid, count(*) FILTER (orbit = 'descending' AND (vv <> 0 OR vh <> 0)) AS s1d_valid FROM radar_cube GROUP BY px) USING (px)
    WHERE s2_any AND s2_valid >= 20 AND s1a_valid + s1d_valid >= 20""",
    "cube", "radar_cube")
def pixel_eligibility(s: SparkSession, d: str) -> DataFrame:
    optical = V.cube(s, d).select("px", F.lit("S2").alias("sensor"), "valid", "v")
    sensor = F.when(F.col("orbit") == "ascending", "S1A").otherwise("S1D")
    both = optical.unionByName(V.radar_cube(s, d).select("px", sensor.alias("sensor"), F.lit(True).alias("valid"), "v"))
    return profile.eligible(profile.valid_counts(both, "px"), 20).select("px", "s2_valid", "s1a_valid", "s1d_valid")


# --- trees -----------------------------------------------------------------------------------------------------------


@query("SELECT y, x, round(cover, 6) AS cover FROM tree_mask", "tree_mask")
def tree_cover_mask(s: SparkSession, d: str) -> DataFrame:
    return treemask.tree_mask(V.fine(s, d), 2).withColumn("cover", r6(F.col("cover")))


@query("SELECT px, date, doy, row_number() OVER (PARTITION BY px ORDER BY date) - 1 AS t, CASE WHEN valid THEN b0 ELSE -1 END AS b0 FROM cube SEMI JOIN tree_mask USING (y, x)", "cube", "tree_mask", dates=("date",))
def tree_pixel_series(s: SparkSession, d: str) -> DataFrame:
    rows = treemask.masked(V.cube(s, d), treemask.tree_mask(V.fine(s, d), 2))
    series = treemask.pixel_series(profile.time_index(rows, "px"), "px", extra=("date",))
    each = series.select("px", F.explode("series").alias("o"))
    return each.select("px", "o.date", "o.doy", "o.t", F.coalesce(F.get("o.v", F.lit(0)).cast("long"), F.lit(-1)).alias("b0"))


@query("SELECT y, x, arg_max(code, item_id) AS value FROM coded GROUP BY y, x", "coded")
def layer_mosaic(s: SparkSession, d: str) -> DataFrame:
    return treemask.layer_mosaic(V.sar(s, d).select(F.col("item_id").alias("layer_seq"), "y", "x", db_code(F.col("amp")).alias("value")))


@query("SELECT fy AS y, fx AS x FROM fine WHERE tree AND fy < 30 AND fx < 30", "fine")
def square_mask(s: SparkSession, d: str) -> DataFrame:
    return treemask.square_mask(V.fine(s, d).select(F.col("fy").alias("y"), F.col("fx").alias("x"), F.col("tree").cast("int").alias("value")), 30, 50)


# --- grids -----------------------------------------------------------------------------------------------------------

PATCH = "((x // 5) * 5) || '_' || ((y // 5) * 5) || '_' || least((x // 5) * 5 + 5, 16) || '_' || least((y // 5) * 5 + 5, 16)"


@query(f"SELECT {PATCH} AS patch, count(*) AS n FROM cube GROUP BY ALL", "cube")
def patch_assignment(s: SparkSession, d: str) -> DataFrame:
    return V.cube(s, d).select(grid.patch(F.col("y"), F.col("x"), 5, 16, 16)["patch"].alias("patch")).groupBy("patch").agg(F.count("*").alias("n"))


@query(f"SELECT {PATCH} AS patch, count(*) AS n FROM cube WHERE {PATCH} IN (SELECT {PATCH} FROM tree_mask) GROUP BY ALL", "cube", "tree_mask")
def patch_with_data(s: SparkSession, d: str) -> DataFrame:
    mask = treemask.tree_mask(V.fine(s, d), 2)
    return grid.patches_with_data(V.cube(s, d), mask, 5, 16, 16).groupBy("patch").agg(F.count("*").alias("n"))


@query("SELECT y // 3 AS y, x // 3 AS x, k - 1 AS dim, round(sum(z[k]) / 9, 6) AS value FROM rep, range(1, 5) t(k) WHERE y < (SELECT max(y) + 1 FROM rep) // 3 * 3 AND x < 24 GROUP BY ALL", "rep")
def block_mean(s: SparkSession, d: str) -> DataFrame:
    rep = V.rep(s, d)
    each = rep.join(F.broadcast(rep.agg((F.max("y") + 1).alias("h")))).select("h", "y", "x", F.posexplode(F.slice("z", 1, 4)).alias("dim", "value"))  # one row
    return grid.block_mean(each, "value", 3, F.col("h"), F.lit(25)).select("y", "x", "dim", r6(F.col("value")).alias("value"))


@query("SELECT y // 2 AS y, x // 2 AS x, vec_id FROM rep WHERE y % 2 = 0 AND x % 2 = 0", "rep")
def regrid_rate(s: SparkSession, d: str) -> DataFrame:
    return grid.regrid(V.rep(s, d).select("y", "x", "vec_id"), 2)


@query("SELECT item_id, (y0 // 512) AS \"row\", (x0 // 512) AS col, least(512, width - x0) AS w, least(512, height - y0) AS h FROM (SELECT *, unnest(range(0, width, 512)) AS x0 FROM (SELECT *, unnest(range(0, height, 512)) AS y0 FROM (SELECT o_orderkey AS item_id, CAST(o_custkey % 1500 + 1 AS INTEGER) AS width, CAST(o_orderkey % 1100 + 1 AS INTEGER) AS height FROM orders)))")
def windows_grid(s: SparkSession, d: str) -> DataFrame:
    grids = V.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 1500 + 1).cast("int").alias("width"), (F.col("o_orderkey") % 1100 + 1).cast("int").alias("height"))
    return grid.windows(grids, 512).select("item_id", "row", "col", "w", "h")


@query(
    """SELECT id, "row", col, round(least(minx + col * 20000.0::DOUBLE + 20000, maxx) - (minx + col * 20000.0::DOUBLE), 6) AS w FROM (SELECT *, unnest(range(0, CAST(ceil((maxx - minx) / 20000) AS BIGINT))) AS col FROM (SELECT *, unnest(range(0, CAST(ceil((maxy - miny) / 20000) AS BIGINT))) AS "row"
    FROM (SELECT c_custkey AS id, 0.0::DOUBLE AS minx, 0.0::DOUBLE AS miny, 1000.0::DOUBLE * (c_custkey % 70 + 1) AS maxx, 1000.0::DOUBLE * (c_custkey % 45 + 1) AS maxy FROM customer)))"""
)
def subtiles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    boxes = V.table(s, d, "customer").select(k.alias("id"), F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), (F.lit(1000.0) * (k % 70 + 1)).alias("maxx"), (F.lit(1000.0) * (k % 45 + 1)).alias("maxy"))
    return grid.subtiles(boxes).select("id", "row", "col", r6(F.col("x1") - F.col("x0")).alias("w"))


@query("SELECT y, x, z[1] AS z0, n_values FROM (SELECT g.y, g.x, coalesce(r.z, list_value(0.0::DOUBLE)) AS z, (r.z IS NOT NULL)::INT AS n_values FROM (SELECT y, unnest(range(30)) AS x FROM (SELECT DISTINCT y FROM rep)) g LEFT JOIN rep r USING (y, x))", "rep")
def dense_scatter(s: SparkSession, d: str) -> DataFrame:
    rep = V.rep(s, d)
    full = rep.select("y").distinct().select("y", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("x"))
    out = grid.dense(full, rep.select("y", "x", "z"), "z", 64)
    return out.select("y", "x", F.get("z", F.lit(0)).alias("z0"), vectors.any_nonzero(F.col("z")).cast("int").alias("n_values"))


@query("SELECT px, date, CAST(sum(((x >> k) & 1) << (2 * k)) + sum(((y >> k) & 1) << (2 * k + 1)) AS BIGINT) AS morton FROM (SELECT px, y::BIGINT AS y, x::BIGINT AS x, date FROM cube), range(0, 16) t(k) GROUP BY px, date", "cube", dates=("date",))
def morton_key(s: SparkSession, d: str) -> DataFrame:
    return V.cube(s, d).select("px", "date", layout.morton(F.col("y"), F.col("x")).alias("morton"))


@query(f"SELECT px, date, {mixed_sql('px')} % 8 AS shard FROM cube", "cube", dates=("date",))
def shard_assignment(s: SparkSession, d: str) -> DataFrame:
    return layout.shard(V.cube(s, d), 8, F.col("px")).select("px", "date", "shard")


@query("SELECT y, x, (row_number() OVER (ORDER BY y, x) - 1) // 100 AS chunk FROM tree_mask", "tree_mask")
def series_chunks(s: SparkSession, d: str) -> DataFrame:
    return layout.chunked(treemask.tree_mask(V.fine(s, d), 2), 100).select("y", "x", "chunk")


# --- stitching -------------------------------------------------------------------------------------------------------


@query("SELECT y // 2 AS y, x // 2 AS x, max(vec_id) AS winner, round(arg_max(z[1], vec_id), 6) AS z0, count(*) AS n_patches FROM rep GROUP BY ALL", "rep")
def stitch_overwrite(s: SparkSession, d: str) -> DataFrame:
    rows = V.rep(s, d).select(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), F.col("vec_id").alias("patch_seq"), F.get("z", F.lit(0)).alias("z0"))
    return stitch.stitch(rows, "patch_seq", ["z0"]).withColumn("z0", r6(F.col("z0")))


@query(
    """SELECT count(*) AS n_covered, count(*) FILTER (inside) AS n_inside, (SELECT count(*) FROM (SELECT DISTINCT y, x FROM roi)) AS n_roi,
    round(100.0::DOUBLE * count(*) FILTER (inside) / (SELECT count(*) FROM (SELECT DISTINCT y, x FROM roi)), 6) AS pct_roi, round(100.0::DOUBLE * count(*) / 500, 6) AS pct_all
    FROM (SELECT DISTINCT y // 2 AS y, x // 2 AS x, EXISTS (SELECT 1 FROM roi WHERE roi.y = rep.y // 2 AND roi.x = rep.x // 2) AS inside FROM rep)""",
    "rep", "roi",
)
def stitch_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = V.rep(s, d).select(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"))
    out = stitch.stitch_coverage(rows, V.roi(s, d), 500)
    return out.withColumns({"pct_roi": r6(F.col("pct_roi")), "pct_all": r6(F.col("pct_all"))})


@query(
    """SELECT ty AS y, tx AS x, round(sum(w * v), 6) AS value FROM (
    SELECT ty, tx, CASE dy WHEN 0 THEN 1 - fy ELSE fy END * CASE dx WHEN 0 THEN 1 - fx ELSE fx END AS w, least(y0 + dy, h - 1) AS y, least(x0 + dx, 24) AS x
    FROM (SELECT ty, tx, h, CAST(floor(ty / 2.0::DOUBLE) AS BIGINT) AS y0, ty / 2.0::DOUBLE - floor(ty / 2.0::DOUBLE) AS fy, CAST(floor(tx / 2.0::DOUBLE) AS BIGINT) AS x0, tx / 2.0::DOUBLE - floor(tx / 2.0::DOUBLE) AS fx
        FROM (SELECT h, ty, unnest(range(50)) AS tx FROM (SELECT h, unnest(range(2 * h)) AS ty FROM (SELECT max(y) + 1 AS h FROM rep)))), range(2) a(dy), range(2) b(dx)) t
    JOIN (SELECT y, x, z[1] AS v FROM rep) USING (y, x) GROUP BY ty, tx""",
    "rep",
)
def bilinear_resample(s: SparkSession, d: str) -> DataFrame:
    rep = V.rep(s, d).select("y", "x", F.get("z", F.lit(0)).alias("value"))
    rep = rep.join(F.broadcast(rep.agg((F.max("y") + 1).alias("h"))))  # one row
    return stitch.bilinear(rep, "value", F.col("h"), 25, 2).select("y", "x", r6(F.col("value")).alias("value"))


@query(
    """SELECT s_suppkey AS id, CAST(least(40, greatest(0, round_even((s_suppkey * 7 % 40 - 2.5::DOUBLE), 0))) AS INTEGER) AS col0, CAST(least(40, greatest(0, round_even(s_suppkey * 7 % 40 + 3.5::DOUBLE, 0))) AS INTEGER) AS col1,
    CAST(least(40, greatest(0, round_even(40 - (s_suppkey * 11 % 40 + 3.5::DOUBLE), 0))) AS INTEGER) AS row0, CAST(least(40, greatest(0, round_even(40 - (s_suppkey * 11 % 40 - 2.5::DOUBLE), 0))) AS INTEGER) AS row1 FROM supplier"""
)
def target_window(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = V.table(s, d, "supplier").select(k.alias("id"), (k * 7 % 40 - 2.5).alias("minx"), (k * 7 % 40 + 3.5).alias("maxx"), (k * 11 % 40 - 2.5).alias("miny"), (k * 11 % 40 + 3.5).alias("maxy"))
    return stitch.target_window(p, (0.0, 40.0, 1.0), 40, 40).select("id", "col0", "col1", "row0", "row1")


# --- sampling and features -------------------------------------------------------------------------------------------



def sampled_sql(rows: str, k: int, h: str, ordinal: str) -> str:
    """Sampled steps of each px of rows (px, ok, ...): the same columns, n_steps, copy and rank."""
    return f"""SELECT *, row_number() OVER (PARTITION BY px ORDER BY {ordinal}, copy) - 1 AS rank FROM (
    SELECT e.*, j AS copy FROM (SELECT *, CASE WHEN n_ok > 0 THEN n_ok ELSE n END AS n_steps FROM (
        SELECT *, count(*) FILTER (ok) OVER (PARTITION BY px) AS n_ok, count(*) OVER (PARTITION BY px) AS n, row_number() OVER (PARTITION BY px ORDER BY ok DESC, {h}, {ordinal}) AS rk FROM ({rows}))
        WHERE n_ok = 0 OR ok) e, range({k}) t(j)
    WHERE CASE WHEN n_steps >= {k} THEN j = 0 AND rk <= {k} ELSE {mixed_sql("px", "j")} % n_steps = rk - 1 END)"""


@query("SELECT px, date, item_seq, rank FROM (" + sampled_sql("SELECT *, scl NOT IN (0, 1, 2, 3, 8, 9) AS ok FROM obs", 40, mixed_sql("px", DAY, "item_seq"), "date, item_seq") + ")", "obs", dates=("date",))
def sample_k(s: SparkSession, d: str) -> DataFrame:
    rows = V.obs(s, d).withColumn("ordinal", F.struct("date", "item_seq"))
    h = mixed(F.col("px"), F.unix_date("date"), F.col("item_seq"))
    return sampling.sample_steps(rows, ["px"], "ordinal", optical.valid_class(F.col("scl")), h).select("px", "date", "item_seq", "rank")


@query("SELECT px, date, count(*) AS times FROM (" + sampled_sql("SELECT *, valid AS ok FROM cube", 60, mixed_sql("px", DAY), "date") + ") GROUP BY px, date", "cube", dates=("date",))
def sample_with_repeats(s: SparkSession, d: str) -> DataFrame:
    rows = V.cube(s, d).withColumn("ordinal", F.unix_date("date"))
    out = sampling.sample_steps(rows, ["px"], "ordinal", F.col("valid"), mixed(F.col("px"), F.unix_date("date")), 60)
    return out.groupBy("px", "date").agg(F.count("*").alias("times"))


MEAN, STD = optical.OPTICAL_MEAN[:3], optical.OPTICAL_STD[:3]
Z = [f"(b{k} - {m!r}::DOUBLE) / ({t!r}::DOUBLE + 1e-9::DOUBLE)" for k, (m, t) in enumerate(zip(MEAN, STD))]
S2 = sampled_sql("SELECT *, valid AND px % 5 <> 0 AS ok FROM cube", 40, mixed_sql("px", DAY), "date")
S1 = sampled_sql("SELECT *, CASE orbit WHEN 'ascending' THEN 0 ELSE 1 END AS orbit_rank, vv <> 0 OR vh <> 0 AS ok FROM radar_cube", 40, mixed_sql("px", DAY, "CASE orbit WHEN 'ascending' THEN 0 ELSE 1 END"), "orbit_rank, date")


def _optical_steps(s: SparkSession, d: str) -> DataFrame:
    """Of every fifth pixel no step counts as valid, so all of its steps take part."""
    rows = V.cube(s, d).withColumn("ordinal", F.unix_date("date"))
    return sampling.sample_steps(rows, ["px"], "ordinal", F.col("valid") & (F.col("px") % 5 != 0), mixed(F.col("px"), F.unix_date("date")))


def _radar_steps(s: SparkSession, d: str) -> DataFrame:
    rows = V.radar_cube(s, d).withColumn("t", F.unix_date("date"))
    both = sampling.orbit_union(rows.where("orbit = 'ascending'"), rows.where("orbit = 'descending'"))
    return sampling.sample_steps(both, ["px"], "ordinal", sampling.radar_valid(), mixed(F.col("px"), F.unix_date("date"), F.col("orbit_rank")))


@query(f"SELECT px, rank, doy, {', '.join(f'round({z}, 6) AS v{k}' for k, z in enumerate(Z))} FROM ({S2})", "cube")
def sample_matrix_s2(s: SparkSession, d: str) -> DataFrame:
    rows = sampling.sample_matrix(_optical_steps(s, d), ["px"], MEAN, STD, "m").select("px", F.posexplode("m").alias("rank", "v"))
    return rows.select("px", "rank", F.get("v", F.lit(3)).cast("int").alias("doy"), *(r6(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(3)))


RADAR_Z = [f"({b} - {m!r}::DOUBLE) / ({t!r}::DOUBLE + 1e-9::DOUBLE)" for b, m, t in zip(("vv", "vh"), optical.RADAR_MEAN, optical.RADAR_STD)]


@query(f"SELECT px, rank, doy, round({RADAR_Z[0]}, 6) AS vv, round({RADAR_Z[1]}, 6) AS vh FROM ({S1})", "radar_cube")
def sample_matrix_s1(s: SparkSession, d: str) -> DataFrame:
    rows = sampling.sample_matrix(_radar_steps(s, d), ["px"], optical.RADAR_MEAN, optical.RADAR_STD, "m").select("px", F.posexplode("m").alias("rank", "v"))
    return rows.select("px", "rank", F.get("v", F.lit(2)).cast("int").alias("doy"), r6(F.get("v", F.lit(0))).alias("vv"), r6(F.get("v", F.lit(1))).alias("vh"))


@query(f"SELECT px, date, {', '.join(f'round({z}, 6) AS v{k}' for k, z in enumerate(Z))} FROM cube", "cube", dates=("date",))
def standardize(s: SparkSession, d: str) -> DataFrame:
    z = V.cube(s, d).select("px", "date", vectors.standardized(F.col("v"), MEAN, STD).alias("z"))
    return z.select("px", "date", *(r6(F.get("z", F.lit(k))).alias(f"v{k}") for k in range(3)))


@query("SELECT px, orbit_rank, date, row_number() OVER (PARTITION BY px ORDER BY orbit_rank, date) AS nth FROM (SELECT px, CASE orbit WHEN 'ascending' THEN 0 ELSE 1 END AS orbit_rank, date FROM (SELECT DISTINCT px, orbit, date FROM sar WHERE orbit <> 'unknown'))", "sar", dates=("date",))
def orbit_union_order(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = V.sar(s, d).select("px", "orbit", "date").distinct().withColumn("t", F.datediff("date", F.lit("2020-01-01").cast("date")))
    both = sampling.orbit_union(rows.where("orbit = 'ascending'"), rows.where("orbit = 'descending'"))
    return both.select("px", "orbit_rank", "date", F.row_number().over(Window.partitionBy("px").orderBy("ordinal")).alias("nth"))


@query(
    "SELECT DISTINCT doy, "
    + ", ".join(f"round({f}(doy * {math.exp(-math.log(10000.0) * 2 * i / 8)!r}::DOUBLE), 6) + 0.0::DOUBLE AS e{2 * i + k}" for i in range(4) for k, f in enumerate(("sin", "cos")))
    + " FROM cube",
    "cube",
)
def doy_encoding(s: SparkSession, d: str) -> DataFrame:
    e = V.cube(s, d).select("doy").distinct().select("doy", vectors.doy_encoding(F.col("doy"), 8).alias("e"))
    return e.select("doy", *(r6(F.get("e", F.lit(k))).alias(f"e{k}") for k in range(8)))


@query(
    """SELECT px, k - 1 AS dim, round(sum(w * v[k]) / sum(w), 6) AS pooled FROM (SELECT px, [b0, b1, b2] AS v, exp(doy / 100.0::DOUBLE - max(doy / 100.0::DOUBLE) OVER (PARTITION BY px)) AS w FROM cube WHERE valid), range(1, 4) t(k) GROUP BY px, k""",
    "cube",
)
def softmax_pool(s: SparkSession, d: str) -> DataFrame:
    out = score.softmax_pool(V.cube(s, d).where("valid"), F.col("doy") / F.lit(100.0), "v", 3, "px")
    return out.withColumn("pooled", r6(F.col("pooled")))


@query("SELECT vec_id, o AS out, round(sum(z[k] * (((o * 31 + (k - 1) * 17) % 11 - 5) / 10.0::DOUBLE)), 6) AS value FROM rep, range(1, 65) t(k), range(4) u(o) GROUP BY ALL", "rep")
def linear_map(s: SparkSession, d: str) -> DataFrame:
    weights = [[((o * 31 + k * 17) % 11 - 5) / 10 for k in range(64)] for o in range(4)]
    out = V.rep(s, d).select("vec_id", F.posexplode(vectors.linear(F.col("z"), weights, [0.0] * 4)).alias("out", "value"))
    return out.withColumn("value", r6(F.col("value")))


@query("SELECT vec_id, 128 AS width, round(list_sum(z) + list_sum(list_reverse(z)), 6) AS total FROM rep", "rep")
def fusion_concat(s: SparkSession, d: str) -> DataFrame:
    z = V.rep(s, d).select("vec_id", vectors.fused(F.col("z"), F.reverse("z"), "concat").alias("f"))
    return z.select("vec_id", F.size("f").alias("width"), r6(F.aggregate("f", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("SELECT vec_id, 64 AS width, round(z[1] + z[64], 6) AS first_value FROM rep", "rep")
def fusion_sum(s: SparkSession, d: str) -> DataFrame:
    z = V.rep(s, d).select("vec_id", vectors.fused(F.col("z"), F.reverse("z"), "sum").alias("f"))
    return z.select("vec_id", F.size("f").alias("width"), r6(F.get("f", F.lit(0))).alias("first_value"))


@query("SELECT label, k - 1 AS dim, round(avg(embedding[k]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(k) GROUP BY ALL")
def repeat_average(s: SparkSession, d: str) -> DataFrame:
    runs = V.table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("z"))
    return score.repeat_average(runs, "z", "label").withColumn("value", r6(F.col("value")))


@query(f"SELECT px, year, count(*) AS n FROM (SELECT DISTINCT px, year FROM cube) WHERE px IN (SELECT px FROM (SELECT DISTINCT px FROM cube) ORDER BY {mixed_sql('px')}, px LIMIT 50) GROUP BY ALL", "cube")
def capped_sample(s: SparkSession, d: str) -> DataFrame:
    c = V.cube(s, d)
    some = sampling.shuffled(c.select("px").distinct(), F.col("px"), 50)
    return c.select("px", "year").distinct().join(some, "px", "left_semi").groupBy("px", "year").agg(F.count("*").alias("n"))


@query("SELECT y, x, k AS band, z[k] AS value FROM rep, range(1, 65) t(k)", "rep")
def band_export(s: SparkSession, d: str) -> DataFrame:
    return sinks.bands_long(V.rep(s, d))


# --- zones, polygons, boxes ------------------------------------------------------------------------------------------

ZONE = """CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat < 84 AND lon >= 9 AND lon < 21 THEN 33
    WHEN lat >= 72 AND lat < 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat < 84 AND lon >= 33 AND lon < 42 THEN 37 ELSE least(60, greatest(1, CAST(floor((lon + 180) / 6) AS INTEGER) + 1)) END"""


@query(f"SELECT id, {ZONE} AS zone, {ZONE} + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg FROM pts", "pts")
def utm_zone(s: SparkSession, d: str) -> DataFrame:
    zone = crs.utm_zone(F.col("lon"), F.col("lat"))
    return V.pts(s, d).select("id", zone.alias("zone"), crs.epsg(zone, F.col("lat")).alias("epsg"))


# the projection's series (Karney 2011) written once more as SQL over a source with lon, lat and zone, or e, n, zone and south


def _series(terms: tuple[float, ...], f: str, x: str, g: str = "", y: str = "") -> str:
    return " + ".join(f"{c!r}::DOUBLE * {f}({2 * j} * {x})" + (f" * {g}({2 * j} * {y})" if g else "") for j, c in enumerate(terms, 1))


def to_utm_sql(source: str) -> str:
    scale, ecc = f"{crs.K0 * crs.RADIUS!r}::DOUBLE", f"{crs.ECC!r}::DOUBLE"
    return f"""SELECT *, 500000 + {scale} * (eta + {_series(crs.ALPHA, "cos", "xi", "sinh", "eta")}) AS e,
        {scale} * (xi + {_series(crs.ALPHA, "sin", "xi", "cosh", "eta")}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS n
    FROM (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta
        FROM (SELECT *, sinh(atanh(s) - {ecc} * atanh({ecc} * s)) AS t FROM (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM ({source}))))"""


def from_utm_sql(source: str) -> str:
    scale = f"{crs.K0 * crs.RADIUS!r}::DOUBLE"
    return f"""SELECT *, degrees(atan2(sinh(gx), cos(gy))) + zone * 6 - 183 AS lon, degrees(chi + {_series(crs.DELTA, "sin", "chi")}) AS lat
    FROM (SELECT *, asin(sin(gy) / cosh(gx)) AS chi FROM (SELECT *, eta - ({_series(crs.BETA, "cos", "xi", "sinh", "eta")}) AS gx, xi - ({_series(crs.BETA, "sin", "xi", "cosh", "eta")}) AS gy
        FROM (SELECT *, (n - CASE WHEN south THEN 10000000 ELSE 0 END) / {scale} AS xi, (e - 500000) / {scale} AS eta FROM ({source}))))"""


@query("SELECT id, round(e, 3) AS e, round(n, 3) AS n, round(lon, 6) + 0.0::DOUBLE AS lon, round(lat, 6) + 0.0::DOUBLE AS lat FROM (" + to_utm_sql(f"SELECT *, {ZONE} AS zone FROM pts") + ")", "pts")
def utm_round_trip(s: SparkSession, d: str) -> DataFrame:
    zone = crs.utm_zone(F.col("lon"), F.col("lat"))
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), zone)
    there = V.pts(s, d).select("id", zone.alias("zone"), (F.col("lat") < 0).alias("south"), east.alias("e"), north.alias("n"))
    lon, lat = crs.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return there.select("id", F.round("e", 3).alias("e"), F.round("n", 3).alias("n"), r6(lon).alias("lon"), r6(lat).alias("lat"))


BOXES = f"SELECT id, zone, lat < 0 AS south, e - 5000 AS x0, e + 5000 AS x1, n - 3000 AS y0, n + 3000 AS y1 FROM ({to_utm_sql(f'SELECT *, {ZONE} AS zone FROM pts')})"
EDGES = f"""SELECT id, zone, south, CASE side WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x0 + (x1 - x0) * k / 4 END AS e, CASE side WHEN 2 THEN y0 WHEN 3 THEN y1 ELSE y0 + (y1 - y0) * k / 4 END AS n
    FROM ({BOXES}), range(5) a(k), range(4) b(side)"""


@query(f"SELECT id, round(min(lon), 6) + 0.0::DOUBLE AS west, round(min(lat), 6) + 0.0::DOUBLE AS south, round(max(lon), 6) + 0.0::DOUBLE AS east, round(max(lat), 6) + 0.0::DOUBLE AS north FROM ({from_utm_sql(EDGES)}) GROUP BY id", "pts")
def lonlat_bounds(s: SparkSession, d: str) -> DataFrame:
    zone = crs.utm_zone(F.col("lon"), F.col("lat"))
    east, north = crs.to_utm(F.col("lon"), F.col("lat"), zone)
    boxes = V.pts(s, d).select("id", zone.alias("zone"), (F.col("lat") < 0).alias("south"), (east - 5000).alias("minx"), (east + 5000).alias("maxx"), (north - 3000).alias("miny"), (north + 3000).alias("maxy"))
    return grid.lonlat_bounds(boxes, F.col("zone"), F.col("south"), "id", steps=4).select("id", *(r6(F.col(c)).alias(c) for c in ("west", "south", "east", "north")))


@query("SELECT item_id, zone, greatest(minx, zone * 6 - 186) AS west, least(maxx, zone * 6 - 180) AS east FROM (SELECT *, unnest(range(least(60, greatest(1, CAST(floor((minx + 180) / 6) AS BIGINT) + 1)), least(60, greatest(1, CAST(floor((maxx + 180) / 6) AS BIGINT) + 1)) + 1)) AS zone FROM scenes)", "scenes")
def zone_strips(s: SparkSession, d: str) -> DataFrame:
    return grid.zone_strips(V.scenes(s, d)).select("item_id", "zone", "west", "east")


@query(
    """SELECT feature_id, count(*) AS n, sum(px)::BIGINT AS px_sum FROM (
    SELECT feature_id, px, sum(CASE WHEN (y1 > cy) <> (y2 > cy) AND x1 + (cy - y1) * (x2 - x1) / (y2 - y1) > cx THEN 1 ELSE 0 END) AS n
    FROM edges, (SELECT DISTINCT vec_id % 50 * 1000 + vec_id // 10 AS px, vec_id // 10 + 0.5::DOUBLE AS cy, vec_id % 50 + 0.5::DOUBLE AS cx FROM embeddings) GROUP BY ALL)
    WHERE n % 2 = 1 GROUP BY feature_id""",
    "edges",
)
def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    pixels = V.table(s, d, "embeddings").select(F.floor(v / 10).cast("int").alias("y"), (v % 50).cast("int").alias("x")).distinct()
    inside = vector.pixels_inside(V.rings(s, d), pixels)
    return inside.groupBy("feature_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * 1000 + F.col("y")).alias("px_sum"))


@query("SELECT feature_id, min(vx) AS minx, max(vy) AS maxy, CAST(ceil((max(vx) - min(vx)) / 0.5::DOUBLE) AS BIGINT) AS width, CAST(ceil((max(vy) - min(vy)) / 0.5::DOUBLE) AS BIGINT) AS height FROM rings GROUP BY feature_id", "rings")
def geometry_bounds(s: SparkSession, d: str) -> DataFrame:
    return vector.bounds(V.rings(s, d), 0.5, "feature_id").select("feature_id", "minx", "maxy", "width", "height")


@query(
    """SELECT g AS "group", round(sum(area), 4) AS area, round(sum(mx) / sum(area), 4) AS cx, round(sum(my) / sum(area), 4) AS cy FROM (
        SELECT g, sign * (b - a) / 6 * (o + m * a + 4 * (o + m * c) + o + m * b) AS area, sign * (b - a) / 6 * ((o + m * a) ** 2 + 4 * (o + m * c) ** 2 + (o + m * b) ** 2) / 2 AS mx,
            sign * (b - a) / 6 * ((o + m * a) * a + 4 * (o + m * c) * c + (o + m * b) * b) AS my
        FROM (SELECT *, CASE WHEN inside = turn THEN -1 ELSE 1 END AS sign FROM (SELECT *, sum(turn) OVER (PARTITION BY g, a ORDER BY x, turn DESC, feature_id, m) AS inside FROM (
            SELECT *, CASE WHEN row_number() OVER (PARTITION BY g, a, feature_id ORDER BY x, m) % 2 = 1 THEN 1 ELSE -1 END AS turn FROM (
                SELECT l.g, l.feature_id, l.m, l.o, a, b, (a + b) / 2 AS c, l.o + l.m * (a + b) / 2 AS x FROM lines l JOIN slabs s ON l.g = s.g AND l.ya < (a + b) / 2 AND l.yb > (a + b) / 2))) WHERE inside = turn OR inside = 0)) GROUP BY g""".replace(
        "FROM lines l JOIN slabs s",
        """FROM (SELECT feature_id % 3 AS g, feature_id, least(y1, y2) AS ya, greatest(y1, y2) AS yb, (x2 - x1) / (y2 - y1) AS m, x1 - (x2 - x1) / (y2 - y1) * y1 AS o FROM edges WHERE y1 <> y2) l
        JOIN (SELECT g, y AS a, lead(y) OVER (PARTITION BY g ORDER BY y) AS b FROM (SELECT DISTINCT feature_id % 3 AS g, y1 AS y FROM edges UNION SELECT p.g, (q.o - p.o) / (p.m - q.m)
            FROM (SELECT feature_id % 3 AS g, least(y1, y2) AS ya, greatest(y1, y2) AS yb, (x2 - x1) / (y2 - y1) AS m, x1 - (x2 - x1) / (y2 - y1) * y1 AS o FROM edges WHERE y1 <> y2) p
            JOIN (SELECT feature_id % 3 AS g, least(y1, y2) AS ya, greatest(y1, y2) AS yb, (x2 - x1) / (y2 - y1) AS m, x1 - (x2 - x1) / (y2 - y1) * y1 AS o FROM edges WHERE y1 <> y2) q
            ON p.g = q.g AND p.m < q.m AND (q.o - p.o) / (p.m - q.m) > greatest(p.ya, q.ya) AND (q.o - p.o) / (p.m - q.m) < least(p.yb, q.yb))) s""",
    ),
    "edges")
def union_centroid(s: SparkSession, d: str) -> DataFrame:
    """Area and centroid of the union of many overlapping polygons, by group."""
    rings = V.rings(s, d)
    groups = rings.withColumn("group", F.col("feature_id") % 3)
    out = vector.union_moments(groups, 2.0, "group")
    return out.select("group", *(F.round(c, 4).alias(c) for c in ("area", "cx", "cy")))


@query("SELECT feature_id, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cy FROM edges GROUP BY feature_id", "edges")
def centroid(s: SparkSession, d: str) -> DataFrame:
    return vector.centroids(V.rings(s, d), "feature_id").select("feature_id", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@query("SELECT a.item_id, b.feature_id FROM (SELECT item_id, minx, miny, maxx, maxy FROM scenes) a JOIN (SELECT feature_id, min(vx) AS x0, min(vy) AS y0, max(vx) AS x1, max(vy) AS y1 FROM rings GROUP BY feature_id) b ON minx <= x1 AND x0 <= maxx AND miny <= y1 AND y0 <= maxy", "scenes", "rings")
def bbox_overlap(s: SparkSession, d: str) -> DataFrame:
    return vector.boxes_meeting(V.scenes(s, d), vector.bounds(V.rings(s, d), 1.0, "feature_id"), 5.0, "item_id", "feature_id")


POINTS = "SELECT id % 25 AS grp, CAST(round(lon * 100) AS BIGINT) AS vx, CAST(round(lat * 100) AS BIGINT) AS vy FROM pts"


@query(
    f"""SELECT a.grp, a.vx::DOUBLE AS vx, a.vy::DOUBLE AS vy FROM ({POINTS}) a JOIN ({POINTS}) b ON a.grp = b.grp AND (a.vx <> b.vx OR a.vy <> b.vy) JOIN ({POINTS}) c ON c.grp = a.grp
    GROUP BY a.grp, a.vx, a.vy, b.vx, b.vy HAVING bool_and((b.vx - a.vx) * (c.vy - a.vy) - (b.vy - a.vy) * (c.vx - a.vx) > 0
        OR ((b.vx - a.vx) * (c.vy - a.vy) = (b.vy - a.vy) * (c.vx - a.vx) AND c.vx BETWEEN least(a.vx, b.vx) AND greatest(a.vx, b.vx) AND c.vy BETWEEN least(a.vy, b.vy) AND greatest(a.vy, b.vy)))""",
    "pts",
)
def convex_hull(s: SparkSession, d: str) -> DataFrame:
    points = V.pts(s, d).select((F.col("id") % 25).alias("grp"), F.round(F.col("lon") * 100).alias("vx"), F.round(F.col("lat") * 100).alias("vy"))
    return vector.convex_hulls(points, "grp").select("grp", "vx", "vy")


HULL_EDGES = """SELECT feature_id, vx AS x1, vy AS y1, coalesce(lead(vx) OVER w, first(vx) OVER w2) AS x2, coalesce(lead(vy) OVER w, first(vy) OVER w2) AS y2 FROM rings
    WINDOW w AS (PARTITION BY feature_id ORDER BY seq), w2 AS (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query(
    f"""SELECT feature_id, count(*) AS n, sum(x * 1000 + y)::BIGINT AS px_sum FROM (SELECT e.feature_id, x, y, bool_and((x2 - x1) * (y + 0.5::DOUBLE - y1) - (y2 - y1) * (x + 0.5::DOUBLE - x1) > 0) AS inside
    FROM ({HULL_EDGES}) e, range(60) a(x), range(60) b(y) GROUP BY ALL) WHERE inside GROUP BY feature_id""",
    "rings",
)
def hull_raster(s: SparkSession, d: str) -> DataFrame:
    """Pixels inside the hulls of the suppliers' quadrilaterals, which are their own hulls."""
    hulls = vector.convex_hulls(V.rings(s, d).select("feature_id", "vx", "vy"), "feature_id").withColumn("ring_id", F.lit(0))
    line = s.range(60)
    pixels = line.select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("x"))
    return vector.pixels_inside(hulls, pixels).groupBy("feature_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * 1000 + F.col("y")).alias("px_sum"))


# --- ledgers ---------------------------------------------------------------------------------------------------------


@query(r"SELECT tile_id, CAST(regexp_extract(tile_id, 'zone(\d+)_r(\d+)_c(\d+)', 1) AS INTEGER) AS epsg, CAST(regexp_extract(tile_id, 'zone(\d+)_r(\d+)_c(\d+)', 2) AS INTEGER) AS r, CAST(regexp_extract(tile_id, 'zone(\d+)_r(\d+)_c(\d+)', 3) AS INTEGER) AS c FROM tiles", "tiles")
def parse_tile_id(s: SparkSession, d: str) -> DataFrame:
    t = F.col("tile_id")
    return V.tiles(s, d).select("tile_id", *(names.tile_part(t, k).alias(n) for k, n in enumerate(("epsg", "r", "c"), 1)))


@query("SELECT tile_id FROM tiles WHERE nr % 3 <> 0", "tiles")
def resume_anti(s: SparkSession, d: str) -> DataFrame:
    t = V.tiles(s, d)
    return ledger.open_tiles(t, t.where("nr % 3 = 0")).select("tile_id")


@query("SELECT count(*) AS n_expected, count(*) FILTER (nr % 3 = 0) AS n_done, count(*) FILTER (nr % 3 <> 0) AS n_open FROM tiles", "tiles")
def missing_outputs(s: SparkSession, d: str) -> DataFrame:
    t = V.tiles(s, d)
    return ledger.progress(t, t.where("nr % 3 = 0"))


@query("SELECT tile_id, ntile(7) OVER (ORDER BY tile_id) - 1 AS worker FROM tiles", "tiles")
def balanced_split(s: SparkSession, d: str) -> DataFrame:
    return ledger.balanced_split(V.tiles(s, d), 7).select("tile_id", "worker")


@query("SELECT tile_id, CASE WHEN row_number() OVER (ORDER BY tile_id) <= floor(count(*) OVER () * 3 / 8.0) THEN 1 ELSE 2 END AS pool FROM tiles", "tiles")
def ratio_split(s: SparkSession, d: str) -> DataFrame:
    return ledger.ratio_split(V.tiles(s, d), 3, 5).select("tile_id", "pool")


@query(
    """SELECT user_id, n_tiles, samples, seconds, round(samples / seconds::DOUBLE, 6) AS samples_a_second, round(n_tiles * 3600.0::DOUBLE / seconds, 6) AS tiles_an_hour FROM (
    SELECT user_id, count(*) AS n_tiles, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS samples, nullif(floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT, 0) AS seconds FROM events GROUP BY user_id)"""
)
def throughput(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("ended"), F.floor("value").alias("samples"))
    out = ledger.throughput(rows, "user_id").withColumn("seconds", F.nullif("seconds", F.lit(0)))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("samples_a_second", "tiles_an_hour")})


@query("SELECT tile_id, nr + 2016 - nr // 9 * 9 AS year FROM tiles WHERE nr % 2 = 0", "tiles")
def years_with_data(s: SparkSession, d: str) -> DataFrame:
    t = V.tiles(s, d)
    data = t.where("nr % 2 = 0").select("tile_id", (F.col("nr") % 9 + 2016).alias("year"))
    return lists.years_with_data(t.select("tile_id"), data)


@query("SELECT year, 'S2_P' || (year - 1990) || '_' || strftime(first_day, '%Y%m%d') || CASE WHEN first_day = last_day THEN '' WHEN year(first_day) = year(last_day) AND month(first_day) = month(last_day) THEN '-' || strftime(last_day, '%d') ELSE '-' || strftime(last_day, '%m%d') END AS label FROM spans", "spans")
def partition_label(s: SparkSession, d: str) -> DataFrame:
    return V.spans(s, d).select("year", names.partition_label(F.col("start"), F.col("end"), F.col("year") - 1990, "S2").alias("label"))


# --- scoring ---------------------------------------------------------------------------------------------------------


LINEAR = [(o * 31 + k * 7) % 11 - 5 for o in range(4) for k in range(7)]


LINEAR_SQL = f"""SELECT px, o AS out, round(CASE WHEN n2 = 40 AND n1 = 40 THEN total END, 6) AS value FROM (SELECT px, o, sum(n2) AS n2, sum(n1) AS n1, sum(t) AS total FROM (
    SELECT px, o, 1 AS n2, 0 AS n1, (rank + 1) / 10.0::DOUBLE * (list_extract({LINEAR}, o * 7 + 1) * {Z[0]} + list_extract({LINEAR}, o * 7 + 2) * {Z[1]} + list_extract({LINEAR}, o * 7 + 3) * {Z[2]} + list_extract({LINEAR}, o * 7 + 4) * doy / 100.0::DOUBLE) AS t FROM ({S2}), range(4) u(o)
    UNION ALL SELECT px, o, 0, 1, (rank + 1) / 10.0::DOUBLE * (list_extract({LINEAR}, o * 7 + 5) * {RADAR_Z[0]} + list_extract({LINEAR}, o * 7 + 6) * {RADAR_Z[1]} + list_extract({LINEAR}, o * 7 + 7) * doy / 100.0::DOUBLE) FROM ({S1}), range(4) u(o)) GROUP BY px, o)
    WHERE n2 = 40 AND n1 = 40"""


def _linear_scorer() -> Callable:
    w = np.array(LINEAR, float).reshape(4, 7)
    w[:, [3, 6]] /= 100
    by_rank = (np.arange(40) + 1)[:, None] / 10
    return lambda a, b: (a * by_rank).sum(axis=1) @ w[:, :4].T + (b * by_rank).sum(axis=1) @ w[:, 4:].T


def _linear_scores(matrices: DataFrame) -> DataFrame:
    z = score.score_batches(matrices, ["s2", "s1"], "px", _linear_scorer, 4, "double")
    return z.select("px", F.posexplode("z").alias("out", "value")).withColumn("value", r6(F.col("value")))


@query(LINEAR_SQL, "cube", "radar_cube")
def batch_score_linear(s: SparkSession, d: str) -> DataFrame:
    """The scorer hook with a linear scorer: each pixel's two matrices in one batch, four outputs."""
    return _linear_scores(_matrices(s, d))


@query(LINEAR_SQL, "cube", "radar_cube")
def aligned_score(s: SparkSession, d: str) -> DataFrame:
    """The same scores from cubes that are stored bucketed by pixel, with a time dimension: no shuffle behind the scans."""
    both = ((V.cube(s, d), "optical"), (V.radar_cube(s, d), "radar"))
    rows = {k: r.withColumn("sensor", F.lit(k)) for r, k in both}
    folder = place(s, "aligned")
    aligned.time_dimension(rows["optical"].select("sensor", "date").unionByName(rows["radar"].select("sensor", "date")), "sensor").write.parquet(f"{folder}/times")
    times, held = s.read.parquet(f"{folder}/times"), {}
    for k, r in rows.items():
        r = aligned.with_steps(r.drop("doy"), times, "sensor")
        held[k] = aligned.with_days(aligned.write_aligned(r, f"aligned_{k}_{uuid.uuid4().hex}", f"{folder}/{k}", buckets=8), times, "sensor")
    day = F.unix_date("date")
    s2 = sampling.sample_steps(held["optical"].withColumn("ordinal", day), ["px"], "ordinal", F.col("valid") & (F.col("px") % 5 != 0), mixed(F.col("px"), day))
    s1 = held["radar"].withColumn("orbit_rank", F.when(F.col("orbit") == "ascending", 0).otherwise(1)).withColumn("ordinal", F.struct("orbit_rank", "t"))
    s1 = sampling.sample_steps(s1, ["px"], "ordinal", sampling.radar_valid(), mixed(F.col("px"), day, F.col("orbit_rank")))
    s2 = sampling.sample_matrix(s2, ["px"], MEAN, STD, "s2")
    return _linear_scores(s2.join(sampling.sample_matrix(s1, ["px"], optical.RADAR_MEAN, optical.RADAR_STD, "s1"), "px"))


def _matrices(s: SparkSession, d: str) -> DataFrame:
    s2 = sampling.sample_matrix(_optical_steps(s, d), ["px"], MEAN, STD, "s2")
    return s2.join(sampling.sample_matrix(_radar_steps(s, d), ["px"], optical.RADAR_MEAN, optical.RADAR_STD, "s1"), "px")


@query(None)
def batch_score(s: SparkSession, d: str) -> DataFrame:
    """Encodes the sampled optical and radar steps of each pixel, with an example's weights, which each task loads from a file and checks."""
    a, b = score.EncoderShape(3), score.EncoderShape(2)
    reduce = np.random.default_rng(3).normal(0, 0.2, (16, 32)).astype(np.float32)
    path = f"{place(s, 'weights')}.npz"
    score.save_arrays(path, score.model_arrays(score.random_weights(a, 1), score.random_weights(b, 2), reduce, np.zeros(16, np.float32)))
    return score.score_batches(_matrices(s, d), ["s2", "s1"], "px", lambda: score.checked_model(score.load_arrays(path), a, b, 16), 16)


@query(f"SELECT vec_id, round(0.7 * z[1] + 0.3 * coalesce(lead(z[1]) OVER w, first(z[1]) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS m0 FROM rep WINDOW w AS (PARTITION BY {mixed_sql('vec_id', seed=sampling.MIXUP_SEED)} % ((SELECT count(*) FROM rep) + 499) // 500 ORDER BY {mixed_sql('vec_id')}, vec_id)".replace("% ((SELECT count(*) FROM rep) + 499) // 500", "% (((SELECT count(*) FROM rep) + 499) // 500)"), "rep")
def mixup_pairs(s: SparkSession, d: str) -> DataFrame:
    out = sampling.mixup(V.rep(s, d).select("vec_id", "z"), "vec_id", "z", 0.7, bucket_rows=500)
    return out.select("vec_id", r6(F.get("mixed", F.lit(0))).alias("m0"))


@query("SELECT item_id, least(65535, greatest(0, CAST(trunc(amp * 30000) AS INTEGER))) AS stored FROM sar", "sar")
def stored_values(s: SparkSession, d: str) -> DataFrame:
    return V.sar(s, d).select("item_id", optical.stored_value(F.col("amp") * 30000).alias("stored"))


SIDES = """SELECT item_id, least(60, greatest(1, CAST(floor(((minx + maxx) / 2 + 180) / 6) AS INTEGER) + 1)) AS zone, CASE side WHEN 0 THEN minx WHEN 1 THEN maxx ELSE minx + (maxx - minx) * (k / 20.0::DOUBLE) END AS lon,
    CASE side WHEN 2 THEN miny WHEN 3 THEN maxy ELSE miny + (maxy - miny) * (k / 20.0::DOUBLE) END AS lat FROM scenes, range(21) a(k), range(4) b(side)"""


@query(f"SELECT item_id, round(min(e), 3) AS min_e, round(min(n), 3) AS min_n, round(max(e), 3) AS max_e, round(max(n), 3) AS max_n FROM ({to_utm_sql(SIDES)}) GROUP BY item_id", "scenes")
def utm_bounds(s: SparkSession, d: str) -> DataFrame:
    out = grid.utm_bounds(V.scenes(s, d), crs.simple_zone((F.col("minx") + F.col("maxx")) / 2), "item_id")
    return out.select("item_id", *(F.round(c, 3).alias(c) for c in ("min_e", "min_n", "max_e", "max_n")))


# --- streams: all files read as a stream, the result as of the end ---------------------------------------------------


def _stream(s: SparkSession, d: str) -> DataFrame:
    return arrivals.timed(V.sar_rows(arrivals.table_stream(s, d, "events")))


def _settled(stream: DataFrame) -> DataFrame:
    return arrivals.settled(stream, arrivals.work_folder(stream.sparkSession))


@query("SELECT date AS day, orbit, pol, y, x, arg_min(code, item_id) AS code FROM coded WHERE code <> 0 GROUP BY ALL", "coded", dates=("day",))
def stream_daily_radar(s: SparkSession, d: str) -> DataFrame:
    return _settled(arrivals.daily_radar(_stream(s, d)))


@query("SELECT date AS day, y, x, min(item_id) AS item_id FROM sar WHERE amp > 0 GROUP BY ALL", "sar", dates=("day",))
def stream_daily_first(s: SparkSession, d: str) -> DataFrame:
    return _settled(arrivals.daily_first(_stream(s, d).withColumn("valid", F.col("amp") > 0)))


@query("SELECT date AS day, orbit, count(*) AS n FROM sar GROUP BY ALL", "sar", dates=("day",))
def stream_daily_pixels(s: SparkSession, d: str) -> DataFrame:
    return _settled(arrivals.daily_pixels(_stream(s, d), "orbit"))


@query("SELECT strftime(CAST(date - CAST(k AS INTEGER) AS DATE), '%Y-%m-%d') AS start, count(*) AS n FROM sar, range(10) t(k) GROUP BY ALL", "sar")
def stream_sliding_activity(s: SparkSession, d: str) -> DataFrame:
    return _settled(arrivals.sliding_activity(_stream(s, d))).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("SELECT item_id, px FROM sar", "sar")
def stream_once(s: SparkSession, d: str) -> DataFrame:
    out = arrivals.once(_stream(s, d)).select("item_id", "px")
    return arrivals.drained(out, arrivals.work_folder(s))


def _radar_values(s: SparkSession, d: str) -> DataFrame:
    return V.sar_rows(arrivals.table_stream(s, d, "events")).select("ts", "y", "x", "orbit", "pol", "item_id", db_code(F.col("amp")).alias("value")).where("value <> 0")


@query("SELECT date AS day, orbit, pol, y, x, min(item_id) AS item_id, arg_min(code, item_id) AS code FROM coded WHERE code <> 0 GROUP BY ALL", "coded", dates=("day",))
def stream_day_composites(s: SparkSession, d: str) -> DataFrame:
    """Composites that come out once, when their day's timer fires; late rows would be of another kind."""
    groups = ("orbit", "pol")
    out, _ = timers.run_to_the_end(s, _radar_values(s, d), lambda rows: timers.day_composites(rows, groups), arrivals.work_folder(s))
    return out.where("kind = 'day'").select(F.date_from_unix_date(F.col("day").cast("int")).alias("day"), *groups, "y", "x", "item_id", F.col("value").alias("code"))


@query("SELECT date AS day, orbit, count(DISTINCT px) AS n, 100.0::DOUBLE * count(DISTINCT px) / 64 AS pct FROM coded WHERE code <> 0 GROUP BY ALL", "coded", dates=("day",))
def stream_day_coverage(s: SparkSession, d: str) -> DataFrame:
    """Pixels seen so far by day and orbit, in update mode, and their percentage."""
    out, _ = timers.run_to_the_end(s, _radar_values(s, d), lambda rows: timers.day_coverage(rows, ("orbit",)), arrivals.work_folder(s), "update")
    return timers.coverage_percent(out, 64, "orbit").withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))


@query("SELECT px AS pixel, date AS day, date - before AS gap FROM (SELECT px, date, lag(date) OVER (PARTITION BY px ORDER BY date) AS before FROM (SELECT DISTINCT px, date FROM sar)) WHERE before IS NOT NULL", "sar", dates=("day",))
def stream_gaps(s: SparkSession, d: str) -> DataFrame:
    """Days between a pixel's observations, of a stream that brings them in any order."""
    days = V.sar_rows(arrivals.table_stream(s, d, "events")).select(F.col("px").alias("pixel"), F.unix_date(F.to_date("ts")).alias("day"))
    out = arrivals.drained(timers.pixel_gaps(days), arrivals.work_folder(timers.ready(s)))
    return timers.net_gaps(out).withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))


@query("SELECT px, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT px, ts, sum(fresh) OVER (PARTITION BY px ORDER BY ts) AS nth FROM (SELECT px, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY px ORDER BY ts) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh FROM sar)) GROUP BY px, nth", "sar")
def stream_spells(s: SparkSession, d: str) -> DataFrame:
    """Runs of a pixel's observations without a gap of three days."""
    spells = arrivals.spells(arrivals.timed(V.sar_rows(arrivals.table_stream(s, d, "events"))), "3 days", "px")
    return _settled(spells).select("px", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# rasters of 4 x 4 cells of 20 m, every other one in the neighbouring zone, and a target grid of 10 m across the zones' border
TARGET = resample.Grid(10.0, 722000.0, -10.0, 5324600.0, 400, 420, 32)
RASTERS = f"""SELECT item_id, 20.0::DOUBLE AS a, floor(e / 20) * 20 AS c, -20.0::DOUBLE AS e, floor(n / 20) * 20 AS f, 4 AS width, 4 AS height, zone, false AS south, e0, n0 FROM (
    SELECT item_id, zone, e, n, e0, n0 FROM ({to_utm_sql(f"""SELECT item_id, lon, lat, zone1 AS zone, e AS e0, n AS n0 FROM ({to_utm_sql(
    "SELECT s_suppkey AS item_id, 12 + ((s_suppkey * 7) % 40 - 20) * 0.0005::DOUBLE AS lon, 48 + ((s_suppkey * 11) % 40) * 0.0005::DOUBLE AS lat, 32 AS zone, 32 + s_suppkey % 2 AS zone1 FROM supplier")})""")}))"""


def rasters(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = V.table(s, d, "supplier").select(k.alias("item_id"), (F.lit(12) + (k * 7 % 40 - 20) * F.lit(0.0005)).alias("lon"), (F.lit(48) + (k * 11 % 40) * F.lit(0.0005)).alias("lat"), (F.lit(32) + k % 2).cast("int").alias("zone"))
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    corner = lambda v: (F.floor(v / 20) * 20).cast("double")
    return at.select("item_id", F.lit(20.0).alias("a"), corner(e).alias("c"), F.lit(-20.0).alias("e"), corner(n).alias("f"), F.lit(4).alias("width"), F.lit(4).alias("height"), "zone", F.lit(False).alias("south"))


CENTRES = f"""SELECT r.*, x, y, {TARGET.c!r}::DOUBLE + (x + 0.5) * 10 AS te, {TARGET.f!r}::DOUBLE - (y + 0.5) * 10 AS tn FROM
    (SELECT *, unnest(range(CAST(floor((e0 - {TARGET.c!r}) / 10) AS BIGINT) - 20, CAST(floor((e0 - {TARGET.c!r}) / 10) AS BIGINT) + 20)) AS x FROM
        (SELECT *, unnest(range(CAST(floor(({TARGET.f!r} - n0) / 10) AS BIGINT) - 20, CAST(floor(({TARGET.f!r} - n0) / 10) AS BIGINT) + 20)) AS y FROM ({RASTERS}))) r"""
IN_ITEMS = to_utm_sql(f"SELECT * EXCLUDE (zone, s, lam, t, xi, eta, e, n, gx, gy, chi), zone1 AS zone FROM ({from_utm_sql(f'SELECT item_id, a, c, f, zone AS zone1, 32 AS zone, false AS south, x, y, te AS e, tn AS n FROM ({CENTRES})')})".replace("EXCLUDE (zone, s, lam, t, xi, eta, e, n, gx, gy, chi)", "EXCLUDE (zone, xi, eta, e, n, gx, gy, chi)"))


@query(
    f"""SELECT item_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (item_id * 31 + sy * 7 + sx) % 1000 AS v FROM (
        SELECT item_id, x, y, CAST(floor((e - c) / a) AS BIGINT) AS sx, CAST(floor((f - n) / a) AS BIGINT) AS sy FROM ({IN_ITEMS}))
    WHERE sx >= 0 AND sx < 4 AND sy >= 0 AND sy < 4 AND x >= 0 AND x < {TARGET.width} AND y >= 0 AND y < {TARGET.height}"""
)
def resampled(s: SparkSession, d: str) -> DataFrame:
    """Rasters of 20 m, of the target's zone and of its neighbour, on a grid of 10 m."""
    items = rasters(s, d)
    cells = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j")).select("item_id", F.floor(F.col("j") / 4).cast("int").alias("y"), (F.col("j") % 4).alias("x"))
    cells = cells.withColumn("v", (F.col("item_id") * 31 + F.col("y") * 7 + F.col("x")) % 1000)
    return resample.resample(cells, items, TARGET)


RASTER_EDGES = f"""SELECT item_id, zone, south, CASE side WHEN 0 THEN c WHEN 1 THEN c + 80 ELSE c + 80 * k / 20 END AS e, CASE side WHEN 2 THEN f WHEN 3 THEN f - 80 ELSE f - 80 * k / 20 END AS n
    FROM ({RASTERS}), range(21) a(k), range(4) b(side)"""


@query(
    f"""SELECT item_id, 32600 + zone AS epsg, 4 AS width, 4 AS height, c AS minx, f - 80 AS miny, c + 80 AS maxx, f AS maxy, west, south, east, north
    FROM (SELECT item_id, c, f, zone FROM ({RASTERS})) JOIN (SELECT item_id, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM ({from_utm_sql(RASTER_EDGES)}) GROUP BY item_id) USING (item_id)"""
)
def roi_templates(s: SparkSession, d: str) -> DataFrame:
    """Code, size and bounds of rasters, in metres and in degrees."""
    out = resample.templates(rasters(s, d)).drop(*"acef")
    return out.withColumns({c: r6(F.col(c)) for c in ("west", "south", "east", "north")})

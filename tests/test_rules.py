"""Boundary rows of the rules, by hand."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.functions import crs, names, optical, radar, vectors
from pixelseries.operators import composite, grid, layout, ledger, profile, sampling, score, stitch, treemask, vector
from pixelseries.sources import catalog, cube, lists, sinks


def values(spark, column, *rows, schema):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_class_validity(spark):
    rows = [(float(k),) for k in range(12)] + [(float("nan"),), (None,)]
    assert values(spark, optical.valid_class(F.col("s")), *rows, schema="s double") == [k in (4, 5, 6, 7, 10, 11) for k in range(12)] + [False, False]


def test_offset(spark):
    rows = [(1500, date(2022, 1, 25)), (1500, date(2022, 1, 26)), (1000, date(2022, 1, 26)), (999, date(2022, 1, 26))]
    assert values(spark, optical.harmonized(F.col("v"), F.col("d")), *rows, schema="v int, d date") == [1500, 500, 0, 999]


def test_db_code(spark):
    rows = [(1.0,), (0.5,), (0.001,), (1e6,), (0.0,), (-1.0,), (math.nan,), (math.inf,), (None,)]
    assert values(spark, radar.db_code(F.col("a")), *rows, schema="a double") == [10000, 8795, 0, 32767, 0, 0, 0, 0, 0]
    assert values(spark, radar.db_code(F.col("a"), F.lit(0)), (1.0,), schema="a double") == [0]


def test_first_valid_coverage_and_gate(spark):
    obs = spark.createDataFrame([("2023-01-01", 0, 0, 0, 3), ("2023-01-01", 0, 0, 1, 4), ("2023-01-01", 0, 0, 2, 5), ("2023-01-01", 9, 9, 0, 4)], "date string, y int, x int, item_seq int, scl int")
    roi = spark.createDataFrame([(0, 0), (0, 1)], "y int, x int")
    chosen = composite.first_valid(obs, roi)
    assert [tuple(r) for r in chosen.collect()] == [("2023-01-01", 0, 0, 1)]
    covered = composite.coverage(chosen, roi, "date")
    assert covered.first()["pct"] == 50.0
    assert composite.passing(covered, 50.0).count() == 1 and composite.passing(covered, 50.1).count() == 0


def test_selection_does_not_depend_on_partitions(spark, small):
    from pixelseries.plans import views as V

    obs, roi = V.obs(spark, small), V.roi(spark, small)
    one, many = (sorted(map(tuple, composite.first_valid(obs.repartition(n), roi).collect())) for n in (1, 13))
    assert one == many


def test_radar_rules(spark):
    sar = spark.createDataFrame([(1, "d", "unknown", "vv", 0, 0, 0, 0.0), (2, "d", "unknown", "vv", 0, 0, 1, 0.5), (3, "d", "unknown", "vv", 0, 1, 0, 1.0)], "item_id int, date string, orbit string, pol string, y int, x int, tile int, amp double")
    assert sorted((r["x"], r["code"]) for r in composite.radar_mosaic(sar).collect()) == [(0, 8795), (1, 10000)]
    assert composite.radar_item_coverage(sar, 10).first()["pct"] == 10.0
    assert composite.radar_item_coverage(sar, 10, union=True).first()["pct"] == 20.0
    status = composite.radar_status(spark.createDataFrame([("g", 1, 12.0), ("g", 1, 3.0), ("h", 0, 0.0)], "g string, n int, pct double"))
    assert sorted((r["g"], r["ok"]) for r in composite.status_summary(status, "g").collect()) == [("g", True), ("h", False)]
    assert values(spark, radar.orbit_name(F.col("o")), (None,), ("ascending",), schema="o string") == ["unknown", "ascending"]


def test_legacy_products(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 4), ("b", 0), ("b", 4), ("b", 5)], "k string, scl int")
    assert [r["k"] for r in profile.legacy_products(rows, "k").collect()] == ["a"]


def test_gaps_and_busiest(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (1, 12), (2, 7)], "px int, doy int")
    got = {r["px"]: (r["min_gap"], r["median_gap"], r["max_gap"]) for r in profile.gap_stats(rows, "px").collect()}
    assert got == {1: (4, 5.5, 7), 2: (None, None, None)}
    steps = spark.createDataFrame([(3, True), (2, True), (1, False)], "t int, ok boolean")
    assert tuple(profile.busiest_step(steps, F.col("ok")).first()) == (2, 1)


def test_sampling(spark):
    few = spark.createDataFrame([(1, t, t < 3, t * 11) for t in range(4)] + [(2, t, False, t * 7) for t in range(4)] + [(3, t, True, (t * 37) % 101) for t in range(50)], "px int, t int, ok boolean, h long")
    out = sampling.sample_steps(few, ["px"], "t", F.col("ok"), F.col("h"), 5).toPandas()
    for px, g in out.groupby("px"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(5)) and list(g.t) == sorted(g.t)
        assert set(g.t) <= set(range({1: 3, 2: 4, 3: 50}[px]))
    assert out[out.px == 3].t.is_unique


def test_draws_with_replacement(spark):
    """Of few steps each draw is one of its own: some steps come often, some never."""
    few = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("t"))
    out = sampling.sample_steps(few, ["id"], "t", F.lit(True), F.col("t"), 40).groupBy("id", "t").count().toPandas()
    per = out.groupby("id")["count"]
    assert (per.sum() == 40).all() and per.max().mean() > 6 and abs(out["count"].var() - 3.6) < 1.0  # binomial: 40 draws of 10


def test_orbit_order(spark):
    up, down = spark.createDataFrame([(0, 10), (1, 200)], "t int, doy int"), spark.createDataFrame([(0, 100)], "t int, doy int")
    assert [r["doy"] for r in sampling.orbit_union(up, down).orderBy("ordinal").collect()] == [10, 200, 100]


def test_vectors(spark):
    z = values(spark, vectors.standardized(F.col("v"), [2.0, 3.0], [1.0, 1.0]), ([2.0, 4.0],), schema="v array<double>")[0]
    assert z[0] == 0.0 and abs(z[1] - 1.0) < 1e-8
    e = values(spark, vectors.doy_encoding(F.col("d"), 6), (50,), schema="d int")[0]
    want = [f(50 * 10000 ** (-2 * i / 6)) for i in range(3) for f in (math.sin, math.cos)]
    assert np.allclose(e, want)
    q = values(spark, vectors.doy_frequencies(F.col("d"), 3), (73,), schema="d int")[0]
    angle = 73 / 365 * 2 * math.pi * np.exp(np.linspace(0, math.log(365), 3))
    assert np.allclose(q, [*np.sin(angle), *np.cos(angle)])
    assert values(spark, vectors.linear(F.col("v"), [[1, 2], [0, -1]], [0.5, 0]), ([3.0, 4.0],), schema="v array<double>") == [[11.5, -4.0]]
    assert values(spark, vectors.relu(F.col("v")), ([-1.0, 2.0],), schema="v array<double>") == [[0.0, 2.0]]
    with pytest.raises(ValueError):
        vectors.fused(F.col("a"), F.col("b"), "mean")


def test_grid_audit_far_from_the_origin(spark):
    """Half a cell, or a hundredth, is a shift wherever on the map; noise of computing is none, and another cell size is another grid."""
    north, base = 5_000_000.0, (100, 90, 32632, 10.0, 0.0, 600_000.0, 0.0, -10.0)
    kind = "grid_id int, width int, height int, epsg int, a double, b double, c double, d double, e double, f double"
    grids = spark.createDataFrame([(k, *base, north) for k in range(6)], kind)
    moved = [(0, *base, north + 1e-9), (1, *base, north + 5.0), (2, *base[:5], base[5] - 5.0, *base[6:], north), (3, *base, north - 0.1), (4, *base[:3], 10.01, *base[4:], north), (5, *base, north), (9, *base, north)]
    got = dict(map(tuple, profile.grid_audit(spark.createDataFrame(moved, kind), grids).collect()))
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 9: None}


def test_patches_and_windows(spark):
    p = grid.patch(F.col("y"), F.col("x"), 500, 1200, 1200)["patch"]
    assert values(spark, p, (20, 1100), schema="y int, x int") == ["1000_0_1200_500"]
    w = grid.windows(spark.createDataFrame([(5000, 4100)], "width int, height int"), 2048).collect()
    assert len(w) == 9 and max((r["row"], r["col"], r["w"], r["h"]) for r in w) == (2, 2, 904, 4)
    s = grid.subtiles(spark.createDataFrame([(0.0, 0.0, 45000.0, 20000.0)], "minx double, miny double, maxx double, maxy double")).orderBy("col").collect()
    assert [(r["row"], r["x1"] - r["x0"]) for r in s] == [(0, 20000.0), (0, 20000.0), (0, 5000.0)]
    affine = grid.scaled(grid.shifted(grid.origin(F.lit(100.0), F.lit(200.0), 10.0), F.lit(2), F.lit(3)), 4)
    assert tuple(spark.range(1).select(affine.alias("a")).first()["a"]) == (40.0, 0.0, 120.0, 0.0, -40.0, 170.0)


def test_block_mean(spark):
    rows = spark.createDataFrame([(y, x, {(0, 0): 1}.get((y, x), 2)) for y in range(5) for x in range(5)], "y int, x int, v int")
    out = {(r["y"], r["x"]): r["v"] for r in grid.block_mean(rows, "v", 2, F.lit(5), F.lit(5), whole_numbers=True).collect()}
    assert len(out) == 4 and out[0, 0] == 1 and out[1, 1] == 2


def test_snap_and_dense(spark):
    points = spark.createDataFrame([(0.2, 9.9, 1, 5), (0.4, 9.7, 0, 6), (1.2, 9.9, 0, 7)], "px double, py double, k int, value int")
    out = {(r["y"], r["x"]): r["value"] for r in grid.snap_to_grid(points, 1.0, 0.0, -1.0, 10.0, F.col("k")).collect()}
    assert out == {(0, 0): 6, (0, 1): 7}
    full = grid.grid_pixels(spark.createDataFrame([(2, 2)], "width int, height int")).select("y", "x")
    z = grid.dense(full, spark.createDataFrame([(0, 1, [1.0, 2.0])], "y int, x int, z array<double>"), "z", 2)
    assert {(r["y"], r["x"]): r["z"] for r in z.collect()} == {(0, 0): [0, 0], (0, 1): [1, 2], (1, 0): [0, 0], (1, 1): [0, 0]}


def test_zones(spark):
    rows = [(0.0, 0.0), (5.0, 60.0), (10.0, 75.0), (-180.0, 10.0), (30.0, -0.1), (180.0, 10.0)]
    zone = crs.utm_zone(F.col("lon"), F.col("lat"))
    assert values(spark, crs.epsg(zone, F.col("lat")), *rows, schema="lon double, lat double") == [32631, 32632, 32633, 32601, 32736, 32660]


def test_utm_known_point(spark):
    east, north = crs.to_utm(F.lit(3.0), F.lit(45.0), F.lit(31))
    e, n = spark.range(1).select(east, north).first()
    assert abs(e - 500000) < 1e-6 and abs(n - 4982950.4002) < 0.01  # arc of the meridian times the scale
    lon, lat = crs.from_utm(F.lit(612345.0), F.lit(5012345.0), F.lit(31), F.lit(False))
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).select(*crs.to_utm(F.col("lon"), F.col("lat"), F.lit(31))).first()
    assert abs(back[0] - 612345) < 1e-3 and abs(back[1] - 5012345) < 1e-3


def test_bilinear(spark):
    src = spark.createDataFrame([(0, 0, 0.0), (1, 0, 2.0)], "y int, x int, v double")
    out = {r["y"]: r["v"] for r in stitch.bilinear(src, "v", 2, 1, 2).where("x = 0").collect()}
    assert out == {0: 0.0, 1: 1.0, 2: 2.0, 3: 2.0}


def test_stitch_and_round_trip(spark):
    rows = spark.createDataFrame([(0, 0, "a", 1.0), (0, 0, "b", 2.0), (0, 1, "a", 3.0)], "y int, x int, name string, v double")
    assert sorted((r["x"], r["winner"], r["v"], r["n_patches"]) for r in stitch.stitch(rows, "name", ["v"]).collect()) == [(0, "b", 2.0, 2), (1, "a", 3.0, 1)]
    full = spark.createDataFrame([(y, x, float(y * 7 + x)) for y in range(7) for x in range(7)], "y int, x int, v double")
    named = full.withColumns(grid.patch(F.col("y"), F.col("x"), 3, 7, 7))
    again = stitch.stitch(named, "patch", ["v"]).select("y", "x", "v")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, full.collect()))
    window = stitch.target_window(spark.createDataFrame([(2.5, 3.5, 0.0, 1.0)], "minx double, maxx double, miny double, maxy double"), (0.0, 10.0, 1.0), 10, 10).first()
    assert (window["col0"], window["col1"]) == (2, 4)


def test_touching_boxes(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "a int, minx double, miny double, maxx double, maxy double")
    b = spark.createDataFrame([(9, 1.0, 0.0, 2.0, 1.0)], "b int, minx double, miny double, maxx double, maxy double")
    assert [tuple(r) for r in vector.boxes_meeting(a, b, 0.7, "a", "b").collect()] == [(1, 9)]


def test_fixed_polygons(spark):
    rings = [(1, 0, 0, 2.3, 2.1), (1, 0, 1, 12.7, 3.4), (1, 0, 2, 9.2, 13.6), (2, 0, 0, 0.4, 9.3), (2, 0, 1, 5.2, 10.1), (2, 0, 2, 4.1, 15.2), (2, 0, 3, 0.9, 14.8)]
    pixels = spark.range(256).select((F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"))
    inside = vector.pixels_inside(spark.createDataFrame(rings, "feature_id int, ring_id int, seq int, vx double, vy double"), pixels)
    assert dict(map(tuple, inside.groupBy("feature_id").count().collect())) == {1: 55, 2: 20}
    assert vector.union_mask(inside).count() <= 75


def test_hull(spark):
    rng = np.random.default_rng(1)
    points = [(1, float(x), float(y)) for x, y in rng.normal(size=(500, 2))] + [(2, 1.0, 1.0), (2, 1.0, 1.0)]
    hull = vector.convex_hulls(spark.createDataFrame(points, "g int, vx double, vy double"), "g").toPandas()
    one = hull[hull.g == 1].sort_values("seq")[["vx", "vy"]].to_numpy()
    nxt = np.roll(one, -1, axis=0)
    for _, x, y in points[:500]:
        assert (((nxt - one)[:, 0] * (y - one[:, 1]) - (nxt - one)[:, 1] * (x - one[:, 0])) >= -1e-9).all()
    assert len(hull[hull.g == 2]) == 1


def test_splits(spark):
    tiles = spark.createDataFrame([(f"t{k}",) for k in range(5)], "tile_id string")
    assert sorted(r["count"] for r in ledger.balanced_split(tiles, 2).groupBy("worker").count().collect()) == [2, 3]
    for a, b, want in ((1, 1, {1: 2, 2: 3}), (0, 1, {2: 5}), (1, 0, {1: 5})):
        assert dict(map(tuple, ledger.ratio_split(tiles, a, b).groupBy("pool").count().collect())) == want
    assert ledger.open_tiles(tiles, tiles.limit(2)).count() == 3
    with pytest.raises(ValueError):
        ledger.ratio_split(tiles, 0, 0)


def test_dates(spark):
    span = spark.sql("SELECT DATE '2023-01-01' AS start, DATE '2023-02-10' AS end")
    chunks = [(str(r["chunk_start"]), str(r["chunk_end"])) for r in catalog.date_chunks(span).orderBy("chunk").collect()]
    assert chunks == [("2023-01-01", "2023-01-15"), ("2023-01-16", "2023-01-30"), ("2023-01-31", "2023-02-10")]
    year = spark.sql("SELECT DATE '2023-01-01' AS start, DATE '2023-12-31' AS end")
    parts = catalog.date_partitions(year, 7).orderBy("part").collect()
    assert (str(parts[0]["part_end"]), str(parts[1]["part_start"]), str(parts[6]["part_end"])) == ("2023-02-21", "2023-02-22", "2023-12-31")
    assert all((b["part_start"] - a["part_end"]).days == 1 for a, b in zip(parts, parts[1:]))


def test_catalog_ends(spark):
    rows = spark.sql("SELECT 1 AS item_id, TIMESTAMP_NTZ '2023-01-02 00:00:00' AS acquired, 10.0D AS cloud_cover, 0D AS minx, 0D AS miny, 1D AS maxx, 1D AS maxy, 'a' AS orbit UNION ALL SELECT 2, TIMESTAMP_NTZ '2023-01-01 12:00:00', 50D, 0D, 0D, 1D, 1D, 'b'")
    assert [r["item_id"] for r in catalog.search_optical(rows, (1, 1, 2, 2), "2023-01-01", "2023-01-02", 50).collect()] == [1]
    assert [r["item_id"] for r in catalog.search_radar(rows, (1, 1, 2, 2), "2023-01-01", "2023-01-02", "b").collect()] == [2]


def test_names(spark):
    t = F.col("t")
    df = spark.createDataFrame([("zone32642_r19_c14",), ("tile_zone1",)], "t string")
    assert [tuple(r) for r in df.select(*(names.tile_part(t, k) for k in (1, 2, 3))).collect()] == [(32642, 19, 14), (None, None, None)]
    assert values(spark, names.listed_tile(F.col("p")), ("file:/a/tile_zone1_r2_c3.tif",), schema="p string") == ["zone1_r2_c3"]
    assert values(spark, names.network_error(F.col("m")), ("Read Timeout",), ("bad value",), schema="m string") == [True, False]
    assert values(spark, names.duration(F.col("s")), (3725,), schema="s int") == ["1h 2m 5s"]


def test_masks(spark):
    mask = spark.createDataFrame([(y, x, 1) for y in range(3) for x in range(5)], "y int, x int, value int")
    assert max(r["x"] for r in treemask.square_mask(mask, 3, 5).collect()) == 2
    assert {(r["y"], r["x"]) for r in treemask.square_mask(mask.where("y = 0 and x > 0"), 3, 5).collect()} == {(0, 1), (0, 2)}  # the grid's sides, not the set cells'
    assert tuple(profile.mask_fraction(spark.createDataFrame([(0,), (1,), (2,), (1,)], "value int")).first()) == (4, 2, 0.5)
    fine = spark.createDataFrame([(0, x, x < 1, 40) for x in range(10)] + [(0, 10 + x, x < 2, 40) for x in range(10)], "fy int, fx int, tree boolean, lc int")
    assert [r["x"] for r in treemask.tree_mask(fine).collect()] == [1]  # a mean of 0.1 is not above it


def test_locality_and_sinks(spark, tmp_path):
    assert values(spark, layout.morton(F.col("y"), F.col("x")), (0, 1), (1, 0), (3, 3), (2, 1), schema="y int, x int") == [1, 2, 15, 9]
    rows = spark.createDataFrame([("a", date(2023, 1, 5), 0, 0, 7), ("b", date(2023, 2, 5), 0, 0, 8)], "tile_id string, date date, y int, x int, v int")
    sinks.write_mosaic(rows, str(tmp_path / "m"))
    assert sinks.read_mosaic(spark, str(tmp_path / "m")).where("tile_id = 'a' and month = 1").count() == 1
    assert sinks.not_written(rows, rows.where("tile_id = 'a'"), ["tile_id"]).count() == 1
    sinks.write_list(rows, str(tmp_path / "l"))
    assert [r["tile_id"] for r in lists.text_list(spark, str(tmp_path / "l")).collect()] == ["a", "b"]
    assert lists.nth_line(lists.text_list(spark, str(tmp_path / "l")), 2).first()["tile_id"] == "b"


def test_encoder_by_its_formulas():
    """One sample, number by number, from the published formulas of the layers."""
    shape = score.EncoderShape(2, 4, 2, 1, 6)
    w = {k: v.astype(float) for k, v in score.random_weights(shape, 9).items()}
    x = np.random.default_rng(4).normal(size=(1, 3, 3))
    lin = lambda v, name, sep=".": [sum(a * b for a, b in zip(row, v)) + c for row, c in zip(w[f"{name}{sep}weight"], w[f"{name}{sep}bias"])]
    sig = lambda v: 1 / (1 + math.exp(-v))

    def norm(v, name):
        m = sum(v) / len(v)
        var = sum((a - m) ** 2 for a in v) / len(v)
        return [(a - m) / math.sqrt(var + 1e-5) * g + b for a, g, b in zip(v, w[f"{name}.weight"], w[f"{name}.bias"])]

    rows = []
    for *bands, doy in x[0]:
        e = lin([max(0, v) for v in lin(bands, "embedding.0")], "embedding.2")
        day = [f(doy * 10000 ** (-2 * i / 4)) for i in range(2) for f in (math.sin, math.cos)]
        rows.append([a + b for a, b in zip(e, day)])
    at = "transformer_encoder.layers.0"
    qkv = [lin(r, f"{at}.self_attn.in_proj", "_") for r in rows]
    mixed = [[0.0] * 4 for _ in rows]
    for h in range(2):
        for i, a in enumerate(qkv):
            score_ = [math.exp(sum(a[2 * h + j] * b[4 + 2 * h + j] for j in range(2)) / math.sqrt(2)) for b in qkv]
            for j in range(2):
                mixed[i][2 * h + j] = sum(s * b[8 + 2 * h + j] for s, b in zip(score_, qkv)) / sum(score_)
    rows = [norm([a + b for a, b in zip(r, lin(m, f"{at}.self_attn.out_proj"))], f"{at}.norm1") for r, m in zip(rows, mixed)]
    rows = [norm([a + b for a, b in zip(r, lin([max(0, v) for v in lin(r, f"{at}.linear1")], f"{at}.linear2"))], f"{at}.norm2") for r in rows]
    name, state, scores = "attn_pool.temporal_context", [0.0] * 4, []
    for r in rows:
        a = [sum(p * q for p, q in zip(row, r)) + c for row, c in zip(w[f"{name}.weight_ih_l0"], w[f"{name}.bias_ih_l0"])]
        b = [sum(p * q for p, q in zip(row, state)) + c for row, c in zip(w[f"{name}.weight_hh_l0"], w[f"{name}.bias_hh_l0"])]
        new = [math.tanh(a[8 + k] + sig(a[k] + b[k]) * b[8 + k]) for k in range(4)]
        state = [(1 - sig(a[4 + k] + b[4 + k])) * new[k] + sig(a[4 + k] + b[4 + k]) * state[k] for k in range(4)]
        scores.append(math.exp(lin(state, "attn_pool.query")[0]))
    want = [sum(s * r[k] for s, r in zip(scores, rows)) / sum(scores) for k in range(4)]
    assert np.allclose(score.encode(x, w, shape)[0], want, atol=1e-12)


def test_encoder_batches(spark):
    shape = score.EncoderShape(2, 8, 2, 1, 16)
    w = score.random_weights(shape, 5)
    x = np.random.default_rng(2).normal(size=(6, 4, 3)).astype(np.float32)
    whole = score.encode(x, w, shape)
    assert np.allclose(whole, np.concatenate([score.encode(x[k : k + 1], w, shape) for k in range(6)]), atol=1e-5)
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(6)], "px int, s array<array<float>>").repartition(3)
    out = score.score_batches(df, ["s"], "px", lambda: lambda a: score.encode(a, w, shape), 8).orderBy("px").collect()
    assert np.allclose([r["z"] for r in out], whole, atol=1e-5)
    with pytest.raises(ValueError):
        score.two_sensor_scorer(shape, shape, w, w, np.eye(8), fusion="mean")


def test_partition_labels(spark):
    rows = [(date(2023, 1, 2), date(2023, 1, 2)), (date(2023, 1, 2), date(2023, 1, 9)), (date(2023, 1, 2), date(2023, 3, 4)), (date(2022, 12, 2), date(2023, 1, 4))]
    label = names.partition_label(F.col("a"), F.col("b"), F.lit(3), "S1")
    assert values(spark, label, *rows, schema="a date, b date") == ["S1_P3_20230102", "S1_P3_20230102-09", "S1_P3_20230102-0304", "S1_P3_20221202-20230104"]


def test_stored_values(spark):
    rows = [(None,), (math.nan,), (-3.0,), (7.9,), (1e9,)]
    assert values(spark, optical.stored_value(F.col("v")), *rows, schema="v double") == [0, 0, 0, 7, 65535]

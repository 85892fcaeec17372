"""Cubes bucketed by pixel, weights from files, reports of tiles that may be missing."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.operators import profile, score, treemask
from pixelseries.plans import queries
from pixelseries.sources import aligned, arrays, lists


def test_no_shuffle_between_scans_and_scorer(spark, small, capsys):
    out = queries.aligned_score(spark, small)
    out.explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan and "Exchange rangepartitioning" not in plan
    assert plan.count("Bucketed: true") == 2 and "BroadcastHashJoin" in plan


def test_days_are_the_same_with_and_without_a_broadcast(spark, small):
    rows = queries.V.cube(spark, small).select("px", "date", "b0")
    times = aligned.time_dimension(rows)
    assert [r["t"] for r in times.orderBy("date").collect()] == list(range(times.count()))
    want = {(r["px"], r["date"], r["b0"]) for r in rows.collect()}
    for most in (0, 10**6):
        back = aligned.with_days(aligned.with_steps(rows, times, most=most), times, most=most)
        assert {(r["px"], r["date"], r["b0"]) for r in back.collect()} == want
        assert back.where(F.dayofyear("date") != F.col("doy")).isEmpty()


def test_odd_rows_of_a_time_dimension(spark):
    rows = spark.createDataFrame([("a", "2021-01-03"), ("a", "2021-01-03"), ("a", None), ("b", "2020-12-31")], "k string, date string").withColumn("date", F.to_date("date"))
    assert sorted((r["k"], r["t"], r["doy"]) for r in aligned.time_dimension(rows, "k").collect()) == [("a", 0, 3), ("b", 0, 366)]
    assert aligned.time_dimension(rows.where("false"), "k").isEmpty()


@pytest.fixture
def model():
    a, b = score.EncoderShape(3), score.EncoderShape(2)
    reduce = np.random.default_rng(3).normal(0, 0.2, (16, 32)).astype(np.float32)
    return a, b, score.model_arrays(score.random_weights(a, 1), score.random_weights(b, 2), reduce, np.full(16, 0.5, np.float32))


def test_weights_from_a_file_score_like_those_in_memory(tmp_path, model):
    a, b, w = model
    path = f"file://{tmp_path}/w.npz"
    score.save_arrays(path, {score.WRAPPED + k: v for k, v in w.items()} | {"projector.0.weight": np.zeros(3)})
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 40, 4)), rng.normal(size=(5, 40, 3))
    own = score.two_sensor_scorer(a, b, score.random_weights(a, 1), score.random_weights(b, 2), w["dim_reducer.0.weight"], w["dim_reducer.0.bias"])
    assert np.array_equal(score.checked_model(score.load_arrays(path), a, b, 16)(x, y), own(x, y))


@pytest.mark.parametrize("fault", ["missing", "unexpected", "shape"])
def test_weights_that_do_not_fit_are_an_error(model, fault):
    a, b, w = model
    name = "s1_backbone.embedding.0.weight"
    bad = {"missing": {k: v for k, v in w.items() if k != name}, "unexpected": w | {"s3.x": w[name]}, "shape": w | {name: w[name][:, :1]}}[fault]
    with pytest.raises(ValueError, match="s3.x" if fault == "unexpected" else name):
        score.checked_model(bad, a, b, 16)
    with pytest.raises(ValueError, match="dim_reducer.0.weight is"):
        score.checked_model(w, a, b, 16, "sum")


def test_missing_tiles_are_reported(spark):
    rows = spark.createDataFrame([("t1", 0, 0, 5), ("t1", 1, 2, 0)], "tile_id string, y int, x int, v int")
    grids = spark.createDataFrame([("t1", 32642, 10.0, 0.0, 3.0, 0.0, -10.0, 4.0)], "tile_id string, epsg int, a double, b double, c double, d double, e double, f double")
    asked = spark.createDataFrame([("t1",), ("t1",), ("t2",), (None,)], "tile_id string")
    out = {r["tile_id"]: r for r in profile.asked_tiles(asked, profile.tile_report(rows, "v", 0, "tile_id"), grids, "tile_id").collect()}
    assert len(out) == 3 and (out["t1"]["found"], out["t1"]["width"], out["t1"]["epsg"], out["t1"]["transform"]) == (True, 3, 32642, [10.0, 0.0, 3.0, 0.0, -10.0, 4.0])
    assert (out["t2"]["found"], out["t2"]["width"], out["t2"]["epsg"]) == (False, None, None) and not out[None]["found"]


def test_the_last_collection_is_on_top(spark):
    layers = lambda rows: spark.createDataFrame(rows, "layer_seq int, y int, x int, value int")
    out = treemask.collections_mosaic(layers([(9, 0, 0, 1), (8, 0, 1, 2)]), layers([(1, 0, 0, 3), (0, 0, 0, 4)]))
    assert sorted(map(tuple, out.collect())) == [(0, 0, 3), (0, 1, 2)]


def test_listed_files(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    files = spark.createDataFrame([("tile_b.tif", b"x"), ("tile_a.tif", b""), ("tile_c.npy", b"y"), ("tile_a.tif", b"z")], "file string, content binary")
    arrays.put_files(files, path)
    assert [r["tile_id"] for r in lists.tiles_in(spark, path).collect()] == ["a", "b"]

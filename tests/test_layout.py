"""Morton ranges, what a scan by them opens, and shuffled shards."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelseries.operators import layout


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.sampled_from([1, 2, 5, 10_000]))
def test_ranges_hold_the_rectangle(y0, h, x0, w, most) -> None:
    ranges = layout.morton_ranges(y0, y0 + h, x0, x0 + w, most)
    inside = {layout.interleaved(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}
    held = [k for a, b in ranges for k in range(a, b + 1)]
    assert inside <= set(held) and len(held) == len(set(held)) and len(ranges) <= most
    assert most < 10_000 or set(held) == inside  # enough ranges are exact


def test_keys_of_large_places(spark) -> None:
    places = [(0, 65536), (65536, 0), (1 << 30, 3), ((1 << 31) - 1, (1 << 31) - 1)]
    got = spark.createDataFrame(places, "y int, x int").select(layout.morton(F.col("y"), F.col("x"))).collect()
    assert [r[0] for r in got] == [layout.interleaved(y, x) for y, x in places]


def test_a_small_block_opens_few_row_groups(spark, tmp_path) -> None:
    """1 % of the pixels of 512 x 512 lie in at most 5 % of the row groups, and in far more of a table in order of rows."""
    rows = spark.range(512 * 512).select(F.floor(F.col("id") / 512).cast("int").alias("y"), (F.col("id") % 512).cast("int").alias("x"), F.xxhash64("id").alias("v"))
    layout.by_locality(rows, 4).write.option("parquet.block.size", "16384").option("parquet.page.size", "4096").option("parquet.block.size.row.check.min", "100").option("parquet.page.size.row.check.min", "100").parquet(str(tmp_path / "z"))
    y0, x0 = 200, 333
    ranges = layout.morton_ranges(y0, y0 + 51, x0, x0 + 51)
    bounds = []
    for f in glob.glob(str(tmp_path / "z/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        k = meta.schema.names.index("morton")
        bounds += [(s.min, s.max, meta.row_group(g).num_rows) for g in range(meta.num_row_groups) for s in [meta.row_group(g).column(k).statistics]]
    total = sum(n for *_, n in bounds)
    opened = sum(n for a, b, n in bounds if any(a <= high and low <= b for low, high in ranges))
    assert len(bounds) > 100 and total == 512 * 512 and opened <= 0.05 * total
    found = layout.block_by_ranges(spark.read.parquet(str(tmp_path / "z")), y0, y0 + 51, x0, x0 + 51)
    assert found.count() == 51 * 51 and "PushedFilters" in (plan := found._jdf.queryExecution().toString()) and "Or(" in plan


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_permutation(n) -> None:
    out = layout.permuted(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.1 and (layout.permuted(np.arange(n), n, 6) != out).mean() > 0.9


def test_shards_are_exact_and_shuffled(spark) -> None:
    rows = spark.range(1003).withColumn("number", F.col("id"))
    got = layout.shuffled_shards(rows, "number", 1003, 100).toPandas()
    assert got.groupby("shard").size().tolist() == [100] * 10 + [3]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got.shard == 0].number.between(0, 99).mean() < 0.4
    again = layout.shuffled_shards(rows.repartition(7), "number", 1003, 100).toPandas()
    assert got.sort_values("number").reset_index(drop=True).equals(again.sort_values("number").reset_index(drop=True))


def test_all_sensors_in_one_row(spark) -> None:
    optical = spark.createDataFrame([(1, "2023-01-02", 2, [1.0]), (1, "2023-01-01", 1, [0.5]), (2, "2023-01-01", 1, [0.7])], "px int, date string, doy int, v array<double>")
    radar = spark.createDataFrame([(1, "2023-01-03", 3, [9.0], "ascending"), (3, "2023-01-03", 3, [8.0], "descending")], "px int, date string, doy int, v array<double>, orbit string")
    got = {r.px: tuple([(s.doy, s.v[0]) for s in x] for x in (r.s2, r.s1a, r.s1d)) for r in layout.training_rows(optical, radar, "px").collect()}
    assert got == {1: ([(1, 0.5), (2, 1.0)], [(3, 9.0)], []), 2: ([(1, 0.7)], [], []), 3: ([], [], [(3, 8.0)])}

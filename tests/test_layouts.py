"""Streams read tables of one file and of a folder of part files alike."""

from __future__ import annotations

from pathlib import Path

import pytest

from pixelseries.plans import queries
from pixelseries.streaming import arrivals as A

STREAMS = ("stream_daily_radar", "stream_daily_first", "stream_daily_pixels", "stream_sliding_activity", "stream_once")


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    """The small tables, events as a folder of three part files."""
    at = tmp_path_factory.mktemp("tables") / "sf"
    at.mkdir()  # a folder of our own: the given one may be read-only, and copytree would copy its mode
    for table in Path(small).iterdir():
        if table.name != "events.parquet":
            (at / table.name).symlink_to(table)
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(f"{at}/events.parquet")
    return str(at)


def test_either_layout_streams_what_the_batch_reads(spark, small, folders, tmp_path):
    for k, sf_dir in enumerate((small, folders)):
        batch = spark.read.parquet(f"{sf_dir}/events.parquet")
        out = A.drained(A.table_stream(spark, sf_dir, "events"), str(tmp_path / str(k)))
        assert out.count() == batch.count() > 0
        assert out.exceptAll(batch).isEmpty()


@pytest.mark.parametrize("name", STREAMS)
def test_stream_queries_over_folders(spark, small, folders, name):
    one, parts = (queries.QUERIES[name](spark, d) for d in (small, folders))
    assert one.count() > 0 and one.exceptAll(parts).isEmpty() and parts.exceptAll(one).isEmpty()

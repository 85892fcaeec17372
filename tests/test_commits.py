"""Committed outputs: reruns, damage, failed writes, audits."""

from __future__ import annotations

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from pixelseries.sources import commits

KEYS = ["tile_id", "date"]


def rows_of(spark, tiles: str = "abc", add: int = 0):
    made = [(t, date(2023, 1, 1 + k), y, 10 * k + y + add) for t in tiles for k in range(2) for y in range(5)]
    return spark.createDataFrame(made, "tile_id string, date date, y int, v int")


def table(df) -> list[tuple]:
    return sorted(map(tuple, df.select("tile_id", "date", "y", "v").collect()))


def parts(root: str, tile: str) -> list[str]:
    return sorted(glob.glob(f"{root}/data/write=*/tile_id={tile}/date=*/*.parquet"))


def test_the_same_write_twice_gives_the_same_rows(spark, tmp_path) -> None:
    root = str(tmp_path)
    for _ in range(2):
        commits.write(rows_of(spark), root, KEYS)
        assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark))
    commits.write(rows_of(spark, "b", 100), root, KEYS)  # replaces b alone
    assert table(commits.read(spark, root, KEYS)) == sorted(table(rows_of(spark, "ac")) + table(rows_of(spark, "b", 100)))
    assert commits.read(spark, root, KEYS).schema.simpleString() == rows_of(spark).schema.simpleString()


def test_unfinished_writes_are_not_seen(spark, tmp_path) -> None:
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        commits.read(spark, root, KEYS)
    assert commits.valid(spark, root, KEYS) is None
    rows_of(spark, "z").write.partitionBy(*KEYS).parquet(f"{root}/data/write=staged")  # died before it published
    commits.write(rows_of(spark, "a"), root, KEYS)
    assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark, "a"))
    bad = rows_of(spark, "q").withColumn("v", F.when(F.col("y") == 4, F.raise_error(F.lit("broke"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="broke"):
        commits.write(bad, root, KEYS)
    assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark, "a"))


def test_a_run_resumes_and_writes_nothing_twice(spark, tmp_path) -> None:
    root = str(tmp_path)
    first = commits.write_missing(rows_of(spark, "ab"), root, KEYS)
    assert first.count() == 4
    more = commits.write_missing(rows_of(spark, "abc"), root, KEYS)
    assert {r.tile_id for r in more.collect()} == {"c"}
    assert commits.write_missing(rows_of(spark, "abc"), root, KEYS) is None
    assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark))


@pytest.mark.parametrize("damage", ["truncated", "missing", "folder", "replaced", "overwritten"])
def test_a_damaged_output_is_written_anew(spark, tmp_path, damage) -> None:
    root = str(tmp_path)
    commits.write(rows_of(spark), root, KEYS)
    hurt, other = parts(root, "b")[0], parts(root, "c")[0]
    content, crc = open(hurt, "rb").read(), os.path.join(os.path.dirname(hurt), f".{os.path.basename(hurt)}.crc")
    os.path.exists(crc) and os.remove(crc)
    if damage in ("missing", "folder"):
        os.remove(hurt)
        if damage == "folder":
            os.rmdir(os.path.dirname(hurt))
    else:
        open(hurt, "wb").write({"truncated": content[: len(content) // 2], "replaced": open(other, "rb").read(), "overwritten": b"\0" * len(content)}[damage])
    if damage == "replaced":  # readable, of the same number of rows, with other values
        spark.createDataFrame([(y, 999) for y in range(5)], "y int, v int").coalesce(1).write.parquet(f"{root}-x")
        open(hurt, "wb").write(open(glob.glob(f"{root}-x/*.parquet")[0], "rb").read())
    assert {(r.tile_id, r.date.day) for r in commits.valid(spark, root, KEYS).collect()} == {(t, k) for t in "abc" for k in (1, 2)} - {("b", 1)}
    made = commits.write_missing(rows_of(spark), root, KEYS)
    assert [(r.tile_id, r.date.day, r.rows) for r in made.collect()] == [("b", 1, 5)]
    assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark))


def test_an_output_that_fails_its_audit_is_not_done(spark, tmp_path) -> None:
    root = str(tmp_path)

    def audit(rows):  # no pixel without a value
        return rows.groupBy(*KEYS).agg(F.min("v").alias("low")).where("low > 0")

    commits.write(rows_of(spark).withColumn("v", F.when(F.col("tile_id") == "a", 0).otherwise(F.col("v") + 1)), root, KEYS)
    assert {r.tile_id for r in commits.valid(spark, root, KEYS, audit).collect()} == {"b", "c"}
    made = commits.write_missing(rows_of(spark, add=1), root, KEYS, audit)
    assert {r.tile_id for r in made.collect()} == {"a"}
    assert commits.valid(spark, root, KEYS, audit).count() == 6


def test_old_writes_are_named_for_deletion(spark, tmp_path) -> None:
    root = str(tmp_path)
    commits.write(rows_of(spark), root, KEYS)
    assert commits.superseded(spark, root, KEYS) == []
    commits.write(rows_of(spark, "ab"), root, KEYS)
    assert commits.superseded(spark, root, KEYS) == []  # c is still of the first
    commits.write(rows_of(spark, "c"), root, KEYS)
    gone = commits.superseded(spark, root, KEYS)
    assert len(gone) == 3 and all(os.path.isdir(p) for p in gone)


def test_many_small_outputs_share_folders(spark, tmp_path) -> None:
    """Packed outputs resume, are replaced one by one and mended like others, also beside outputs with folders of their own."""
    root, many = str(tmp_path), [f"t {k}+%" for k in range(60)]
    commits.write(rows_of(spark, many), root, KEYS, packs=3)
    assert len(glob.glob(f"{root}/packs/write=*/__pack=*")) == 3 and not os.path.exists(f"{root}/data")
    assert table(commits.read(spark, root, KEYS)) == table(rows_of(spark, many)) and commits.valid(spark, root, KEYS).count() == 120
    assert commits.write_missing(rows_of(spark, many), root, KEYS, packs=3) is None
    commits.write(rows_of(spark, many[:1], 100), root, KEYS, packs=3)
    commits.write(rows_of(spark, "b"), root, KEYS)
    want = table(rows_of(spark, many[:1], 100).union(rows_of(spark, [*many[1:], "b"])))
    assert table(commits.read(spark, root, KEYS)) == want == table(commits.read(spark, root, KEYS, whole_only=False))
    hurt = sorted(glob.glob(f"{root}/packs/write=*/__pack=0/*.parquet"), key=os.path.getsize)[-1]
    os.remove(hurt)
    good = commits.valid(spark, root, KEYS).count()
    assert 60 < good < 122
    mended = commits.write_missing(rows_of(spark, many[:1], 100).union(rows_of(spark, [*many[1:], "b"])), root, KEYS, packs=3)
    assert mended.count() == 122 - good and table(commits.read(spark, root, KEYS)) == want and commits.valid(spark, root, KEYS).count() == 122

"""Dense arrays: byte ranges, predicates, patches, manifests."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelseries.sources import arrays


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, file) -> None:
        self.file, self.bytes, self.reads = file, 0, 0

    def read_at(self, n: int, at: int) -> bytes:
        self.bytes, self.reads = self.bytes + n, self.reads + 1
        return self.file.read_at(n, at)


def window_of(data: st.DataObject, shape: tuple[int, ...]) -> arrays.Window:
    def part(n: int) -> tuple[int, int]:
        a = data.draw(st.integers(0, n - 1))
        return a, data.draw(st.integers(a + 1, n))

    return tuple(part(n) for n in shape)


@settings(max_examples=60, deadline=None)
@given(st.data(), st.tuples(*[st.integers(1, 6)] * 4), st.booleans(), st.sampled_from(["<u2", ">f4", "<f8", "|u1"]), st.sampled_from([0, 16]))
def test_a_window_is_the_slice_and_costs_its_bytes(tmp_path_factory, data, shape, fortran, kind, gap) -> None:
    cube = np.arange(math.prod(shape)).reshape(shape).astype(kind)
    at = tmp_path_factory.mktemp("npy") / "a.npy"
    np.save(at, np.asfortranarray(cube) if fortran else cube)
    head, window = arrays.header(str(at)), window_of(data, shape)
    with arrays.opened(str(at))[0].open_input_file(str(at)) as f:
        counted = Counted(f)
        got = arrays.read_window(counted, head, window, gap)
    assert np.array_equal(got, cube[tuple(slice(a, b) for a, b in window)])
    assert counted.bytes == got.nbytes if gap == 0 else got.nbytes <= counted.bytes <= got.nbytes + gap * got.size


def test_scan_equals_array_whatever_the_partitions(spark, tmp_path) -> None:
    cube = np.random.default_rng(1).integers(0, 9000, (3, 40, 30, 4)).astype("u2")
    np.save(tmp_path / "c.npy", cube)
    np.save(tmp_path / "f.npy", np.asfortranarray(cube))
    for target in (500, 20_000, arrays.TARGET):
        rows = arrays.read_arrays(spark, str(tmp_path), target=target)
        assert rows.schema["v"].dataType.elementType.simpleString() == "int"
        out = rows.where("t >= 1 AND y < 25 AND y > 3 AND x = 7").toPandas()
        assert len(out) == 2 * 2 * 21
        for r in out.itertuples():
            assert list(r.v) == cube[r.t, r.y, r.x].tolist()
    whole = arrays.read_arrays(spark, str(tmp_path / "c.npy"), target=3000)
    assert whole.count() == 3 * 40 * 30 and whole.select(F.sum(F.aggregate("v", F.lit(0), lambda a, b: a + b))).first()[0] == int(cube.astype(int).sum())


def test_predicates_decide_what_is_planned(tmp_path) -> None:
    """A block of 1 % of the pixels is planned as 1 % of the bytes, in whole partitions of its own."""
    np.save(tmp_path / "a.npy", np.zeros((5, 100, 100, 3), "f4"))
    np.save(tmp_path / "b.npy", np.zeros((5, 100, 100, 3), "f4"))
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan, StringContains

    heads = [arrays.header(p) for p in arrays.files_of(str(tmp_path))]
    reader = arrays.ArrayReader(heads, "f4", arrays.TARGET, 0)
    left = list(reader.pushFilters([IsNotNull(("y",)), GreaterThanOrEqual(("y",), 10), LessThan(("y",), 20), GreaterThanOrEqual(("x",), 90), EqualTo(("path",), str(tmp_path / "a.npy")), odd := StringContains(("path",), "a")]))
    assert left == [odd]
    assert sum(p.planned() for p in reader.partitions()) == 5 * 10 * 10 * 3 * 4
    assert [r.num_rows for p in reader.partitions() for r in reader.read(p)] == [100] * 5
    list(reader.pushFilters([LessThan(("t",), 0)]))
    assert reader.partitions() == []


def test_the_scan_takes_predicates_over(spark, tmp_path, capfd) -> None:
    np.save(tmp_path / "a.npy", np.arange(1000, dtype="i8").reshape(1, 10, 100))
    rows = arrays.read_arrays(spark, str(tmp_path / "a.npy")).where("y = 3 AND x < 5")
    assert "Filter" not in rows._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] and rows.count() == 5
    assert rows.schema["v"].dataType.elementType.simpleString() == "bigint"


def test_headers_tell_shapes(spark, tmp_path) -> None:
    np.save(tmp_path / "bands.npy", np.zeros((4, 6, 5, 10), "u2"))
    np.save(tmp_path / "doys.npy", np.arange(4, dtype="i4"))
    np.save(tmp_path / "masks.npy", np.zeros((4, 6, 5), "?"))
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:6] for r in arrays.array_info(spark, str(tmp_path)).collect()}
    assert got == {"bands.npy": (4, 6, 5, 10, "uint16"), "doys.npy": (4, 1, 1, 1, "int32"), "masks.npy": (4, 6, 5, 1, "bool")}


def test_missing_and_broken_files_are_errors(spark, tmp_path) -> None:
    (tmp_path / "x.npy").write_bytes(b"no array here")
    np.save(tmp_path / "short.npy", np.zeros(100))
    (tmp_path / "short.npy").write_bytes((tmp_path / "short.npy").read_bytes()[:-8])
    for name, said in (("none.npy", "no such array file"), ("x.npy", "not a .npy file"), ("short.npy", "shorter than its header")):
        with pytest.raises(Exception, match=said):
            arrays.read_arrays(spark, str(tmp_path / name)).count()
        with pytest.raises(Exception, match=said):
            arrays.array_info(spark, str(tmp_path / name)).count()


LAYOUT = {"optical": {"steps": 3, "height": 4, "width": 4, "channels": 2, "dtype": "uint16"}, "roi": {"steps": 1, "height": 4, "width": 4, "channels": 1, "dtype": "uint8"}}


def patch_rows(spark, scale: int = 1):
    rows = [(f"p{k}", "optical", t, y, x, [float(scale * (k + 1)), float(10 * t + y)]) for k in range(3) for t in (0, 2) for y in range(3) for x in (0, 3)]
    return spark.createDataFrame(rows + [("p0", "roi", 0, 1, 1, [1.0])], "name string, sensor string, t int, y int, x int, v array<double>")


def test_patches_are_dense_and_padded(spark, tmp_path) -> None:
    at = str(tmp_path / "patches")
    arrays.write_patches(patch_rows(spark), at, LAYOUT)
    for k in range(3):
        got = np.load(f"{at}/p{k}/optical.npy")
        want = np.zeros((3, 4, 4, 2), "u2")
        for t in (0, 2):
            for y in range(3):
                want[t, y, [0, 3]] = (k + 1, 10 * t + y)
        assert got.dtype == np.uint16 and np.array_equal(got, want)
    assert np.load(f"{at}/p0/roi.npy").sum() == 1 and arrays.damaged(spark, at).collect() == []
    back = arrays.read_arrays(spark, at).where("v[0] > 0").count()
    assert back == patch_rows(spark).count()


def test_reruns_replace_and_stray_files_are_not_seen(spark, tmp_path) -> None:
    at = str(tmp_path / "patches")
    for _ in range(2):
        arrays.write_patches(patch_rows(spark), at, LAYOUT, overwrite=False)
    assert len(arrays.manifest(at)) == 4
    first = arrays.read_arrays(spark, at).count()
    np.save(f"{at}/p0/stray.npy", np.zeros((1, 4, 4, 1), "u1"))
    (tmp_path / "patches/p1/optical.npy.unfinished").write_bytes(b"half")
    assert arrays.read_arrays(spark, at).count() == first
    arrays.write_patches(patch_rows(spark, 7).where("name = 'p1'"), at, LAYOUT, overwrite=False)  # one anew, the others stay
    assert np.load(f"{at}/p1/optical.npy")[0, 0, 0, 0] == 14 and np.load(f"{at}/p2/optical.npy")[0, 0, 0, 0] == 3 and arrays.read_arrays(spark, at).count() == first
    arrays.write_patches(patch_rows(spark).where("name = 'p2'"), at, LAYOUT)
    assert [x["name"] for x in arrays.manifest(at)] == ["p2/optical.npy"]


def test_a_failed_write_changes_nothing(spark, tmp_path) -> None:
    at = str(tmp_path / "patches")
    arrays.write_patches(patch_rows(spark), at, LAYOUT)
    before = arrays.manifest(at)
    for bad in ("70000.0", "1.5"):
        with pytest.raises(Exception, match="cannot hold"):
            arrays.write_patches(patch_rows(spark).withColumn("v", F.expr(f"array({bad}D, 0D)")), at, LAYOUT)
    with pytest.raises(Exception, match="which has 3"):
        arrays.write_patches(patch_rows(spark).withColumn("t", F.lit(9)), at, LAYOUT)
    assert arrays.manifest(at) == before and np.load(f"{at}/p1/optical.npy")[0, 0, 0, 0] == 2


def test_damage_is_found(spark, tmp_path) -> None:
    at = str(tmp_path / "patches")
    arrays.write_patches(patch_rows(spark), at, LAYOUT)
    (tmp_path / "patches/p0/optical.npy").unlink()
    whole = (tmp_path / "patches/p1/optical.npy").read_bytes()
    (tmp_path / "patches/p1/optical.npy").write_bytes(whole[:-1] + b"\7")
    (tmp_path / "patches/p2/optical.npy").write_bytes(whole[:-1])
    assert sorted(map(tuple, arrays.damaged(spark, at).collect())) == [("p0/optical.npy", "missing"), ("p1/optical.npy", "content"), ("p2/optical.npy", "size")]

"""Dense .npy cubes (T, H, W, C) as a Spark data source: scans read byte ranges, writers put fixed patches in place.

A scan plans from headers alone. Predicates on t, y, x and path cut the window of each file before its partitions are made; a partition is a
range of steps or of rows of one step, of about `target` bytes, and its task reads just the byte ranges of its window (gaps of up to `gap`
bytes are read over). Files may be in C or Fortran order; of fewer than four dimensions the missing last ones count as 1.
Paths are files or folders, of any store that Arrow reads (local and shared folders, S3, GCS, HDFS). A path that does not exist, or is no
.npy file, is an error when the scan is planned.

The writer takes rows sorted by file and step and holds one step of one patch at a time. It writes under temporary names; the
commit gives the files their names and then publishes a manifest (names, sizes, CRC-32) by one rename. Scans of a folder with a
manifest see its files only, so a failed or running write shows nothing, and a rerun replaces what it wrote before.
"""

from __future__ import annotations

import ast
import io
import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
TARGET = 32 << 20
GAP = 1 << 12
ROWS = 1 << 16

Window = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Header:
    """What the head of a .npy file says."""

    path: str
    shape: tuple[int, ...]
    dtype: str
    fortran: bool
    start: int
    size: int

    @property
    def cube(self) -> tuple[int, int, int, int]:
        return (*self.shape, 1, 1, 1, 1)[:4]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def header(path: str) -> Header:
    """Reads a few hundred bytes."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(f"no such array file: {path}")
    with store.open_input_file(at) as f:
        head = f.read_at(min(info.size, 12), 0)
        if head[:6] != b"\x93NUMPY" or len(head) < 12:
            raise ValueError(f"not a .npy file: {path}")
        wide = head[6] > 1
        size, start = struct.unpack_from("<I" if wide else "<H", head, 8)[0], 12 if wide else 10
        said = ast.literal_eval(f.read_at(size, start).decode("utf-8" if head[6] > 2 else "latin1"))
    kind, shape = np.dtype(said["descr"]), tuple(said["shape"])
    if kind.hasobject or kind.fields or len(shape) > 4:
        raise ValueError(f"not an array of numbers of up to four dimensions: {path}")
    if start + size + kind.itemsize * math.prod(shape) > info.size:
        raise ValueError(f"the file is shorter than its header says: {path}")
    return Header(path, shape, kind.str, said["fortran_order"], start + size, info.size)


def files_of(path: str) -> list[str]:
    """The array files of a path: itself, those its manifest names, or those below it."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such array file: {path}")
    if info.type == pafs.FileType.File:
        return [path]
    if (named := manifest(path)) is not None:
        return [f"{path.rstrip('/')}/{x['name']}" for x in named]
    found = store.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(path.rstrip("/") + x.path.removeprefix(at.rstrip("/")) for x in found if x.type == pafs.FileType.File and x.path.endswith(".npy"))


def manifest(path: str) -> list[dict] | None:
    """name, size and crc32 of the files that the last committed write published."""
    store, at = opened(path)
    where = f"{at.rstrip('/')}/{MANIFEST}"
    if store.get_file_info(where).type != pafs.FileType.File:
        return None
    with store.open_input_file(where) as f:
        return json.loads(f.read())


def ranges(shape: tuple[int, ...], window: Window, item: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in bytes of the window's stretches, in order; the last dimension lies closest."""
    whole = len(shape)
    while whole > 0 and window[whole - 1] == (0, shape[whole - 1]):
        whole -= 1
    inner = math.prod(shape[whole:]) * item
    if whole == 0:
        yield 0, inner
        return
    steps = [math.prod(shape[k + 1 :]) * item for k in range(whole)]
    low, high = window[whole - 1]
    for at in product(*(range(a, b) for a, b in window[: whole - 1])):
        yield sum(i * s for i, s in zip(at, steps)) + low * steps[whole - 1], (high - low) * inner


def joined(parts: Iterable[tuple[int, int]], gap: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (offset, length) that take in several parts where no more than gap bytes lie between; with the parts' places in them."""
    start = end = None
    held: list[tuple[int, int]] = []
    for offset, length in parts:
        if held and offset - end <= gap and offset + length - start <= TARGET:
            held.append((offset - start, length))
        else:
            if held:
                yield start, end - start, held
            start, held = offset, [(0, length)]
        end = offset + length
    if held:
        yield start, end - start, held


def read_window(file: pa.NativeFile, head: Header, window: Window, gap: int = GAP) -> np.ndarray:
    """The window (t, y, x, c) of a file as an array, by its byte ranges."""
    item = np.dtype(head.dtype).itemsize
    shape, part = head.cube, window
    if head.fortran:
        shape, part = shape[::-1], part[::-1]
    out = io.BytesIO()
    for offset, length, pieces in joined(ranges(shape, part, item), gap):
        got = memoryview(file.read_at(length, head.start + offset))
        for at, size in pieces:
            out.write(got[at : at + size])
    array = np.frombuffer(out.getbuffer(), head.dtype).reshape([b - a for a, b in part])
    return array.transpose() if head.fortran else array


@dataclass
class Piece(InputPartition):
    head: Header
    window: Window

    def planned(self) -> int:
        """Bytes that its window has."""
        return np.dtype(self.head.dtype).itemsize * math.prod(b - a for a, b in self.window)


def value_type(heads: list[Header]) -> tuple[str, str]:
    """SQL and numpy type that hold the values of all files."""
    kinds = {np.dtype(h.dtype) for h in heads}
    floats = [k for k in kinds if k.kind == "f"]
    if any(k.kind not in "fiub" or k == np.dtype("u8") for k in kinds):
        raise ValueError(f"no column type for {sorted(map(str, kinds))}")
    wide = any(k.kind in "iu" and k.itemsize + (k.kind == "u") > 4 for k in kinds)
    if floats:
        large = any(k.itemsize > 4 for k in floats) or any(k.kind != "f" and k.itemsize > 2 for k in kinds)
        return ("double", "f8") if large else ("float", "f4")
    return ("bigint", "i8") if wide else ("int", "i4")


@dataclass
class ArrayReader(DataSourceReader):
    heads: list[Header]
    kind: str
    target: int
    gap: int
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of t, y and x and the names of files; what is not wholly taken over goes back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "path" and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
                continue
            if isinstance(f, IsNotNull) and name in ("path", "t", "y", "x"):
                continue
            if name not in ("t", "y", "x") or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.value is None:
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high.get(name, 1 << 62), f.value + (not isinstance(f, LessThan)))

    def partitions(self) -> list[Piece]:
        out = []
        for head in self.heads:
            if self.paths is not None and head.path not in self.paths:
                continue
            t, y, x = ((max(0, self.low.get(n, 0)), min(size, self.high.get(n, size))) for n, size in zip("tyx", head.cube))
            if min(b - a for a, b in (t, y, x)) <= 0:
                continue
            row = np.dtype(head.dtype).itemsize * head.cube[3] * (x[1] - x[0])
            step = row * (y[1] - y[0])
            steps, rows = max(1, self.target // max(1, step)), max(1, self.target // max(1, row))
            for t0 in range(*t, steps):
                for y0 in range(*y, rows if step > self.target else max(1, y[1] - y[0])):
                    y1 = min(y[1], y0 + rows) if step > self.target else y[1]
                    out.append(Piece(head, ((t0, min(t[1], t0 + steps)), (y0, y1), x, (0, head.cube[3]))))
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, at = opened(piece.head.path)
        (t0, t1), (y0, y1), (x0, x1), (_, c) = piece.window
        rows = max(1, ROWS // max(1, x1 - x0))
        with store.open_input_file(at) as f:
            for t in range(t0, t1):
                for y in range(y0, y1, rows):
                    part = ((t, t + 1), (y, min(y1, y + rows)), (x0, x1), (0, c))
                    values = read_window(f, piece.head, part, self.gap).reshape(-1).astype(self.kind)
                    n = len(values) // max(1, c)
                    dy, dx = np.divmod(np.arange(n, dtype=np.int32), np.int32(x1 - x0))
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, max(1, c), dtype=np.int32)[: n + 1]), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.repeat(piece.head.path, n), pa.array(np.full(n, t, np.int32)), pa.array(dy + np.int32(y)), pa.array(dx + np.int32(x0)), v], ["path", "t", "y", "x", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class PatchWriter(DataSourceArrowWriter):
    """Rows (name, sensor, t, y, x, v), sorted by name, sensor and t, as files name/sensor.npy. layout: for each sensor its steps, height,
    width, channels and dtype; cells without a row are 0."""

    def __init__(self, path: str, layout: dict[str, dict], overwrite: bool) -> None:
        self.path, self.layout, self.overwrite, self.turn = path.rstrip("/"), layout, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        done: list[dict] = []
        now: tuple[str, str] | None = None
        out: _Cube | None = None
        try:
            for b in batches:
                names, sensors, steps, ys, xs = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                values = b.column(5)
                change = (names[1:] != names[:-1]) | (sensors[1:] != sensors[:-1]) | (steps[1:] != steps[:-1])
                cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(names)] if len(names) else []
                for i, j in zip(cuts, cuts[1:]):
                    if now != (names[i], sensors[i]):
                        if out is not None:
                            done.append(out.close())
                        now = names[i], sensors[i]
                        out = _Cube(store, root, "/".join(now), self.turn, self.layout[now[1]])
                    out.add(int(steps[i]), ys[i:j], xs[i:j], values.slice(i, j - i))
            if out is not None:
                done.append(out.close())
                out = None
        finally:
            if out is not None:
                out.drop()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        for f in files:
            store.move(f"{root}/{f['temporary']}", f"{root}/{f['name']}")
        before = {x["name"]: x for x in manifest(self.path) or []}
        new = {f["name"]: {k: f[k] for k in ("name", "size", "crc32")} for f in files}
        kept = new if self.overwrite else before | new
        with store.open_output_stream(f"{root}/{MANIFEST}.{self.turn}") as f:
            f.write(json.dumps([kept[k] for k in sorted(kept)]).encode())
        store.move(f"{root}/{MANIFEST}.{self.turn}", f"{root}/{MANIFEST}")
        for name in before.keys() - kept.keys():
            if store.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                if store.get_file_info(f"{root}/{f['temporary']}").type == pafs.FileType.File:
                    store.delete_file(f"{root}/{f['temporary']}")


class _Cube:
    """A file being written, one step after the other."""

    def __init__(self, store: pafs.FileSystem, root: str, name: str, turn: str, layout: dict) -> None:
        self.store, self.root, self.name = store, root, f"{name}.npy"
        self.temporary = f"{name}.npy.{turn}-{uuid.uuid4().hex}"  # of this attempt alone
        self.kind = np.dtype(layout["dtype"])
        self.steps, self.size = layout["steps"], (layout["height"], layout["width"], layout["channels"])
        store.create_dir(f"{root}/{self.temporary}".rsplit("/", 1)[0], recursive=True)
        self.file = store.open_output_stream(f"{root}/{self.temporary}")
        self.bytes = self.crc = self.next = 0
        self.plane: np.ndarray | None = None
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": self.kind.str, "fortran_order": False, "shape": (self.steps, *self.size)})
        self._put(head.getvalue())

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes, self.crc = self.bytes + len(data), zlib.crc32(data, self.crc)

    def _flush(self) -> None:
        if self.plane is not None:
            self._put(self.plane.tobytes())
            self.plane, self.next = None, self.next + 1

    def add(self, t: int, y: np.ndarray, x: np.ndarray, values: pa.Array) -> None:
        if not 0 <= t < self.steps:
            raise ValueError(f"step {t} of {self.name}, which has {self.steps}")
        if self.plane is None or t != self.next:
            self._flush()
            if t < self.next:
                raise ValueError(f"steps of {self.name} are not in order")
            while self.next < t:
                self._put(bytes(self.kind.itemsize * math.prod(self.size)))
                self.next += 1
            self.plane = np.zeros(self.size, self.kind)
        v = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        made = v.astype(self.kind)
        if self.kind.kind in "iub" and not np.array_equal(made, v):
            raise ValueError(f"{self.name}: {self.kind} cannot hold all values")
        self.plane[y, x] = made

    def close(self) -> dict:
        self._flush()
        while self.next < self.steps:
            self._put(bytes(self.kind.itemsize * math.prod(self.size)))
            self.next += 1
        self.file.close()
        return {"name": self.name, "temporary": self.temporary, "size": self.bytes, "crc32": self.crc}

    def drop(self) -> None:
        self.file.close()
        self.store.delete_file(f"{self.root}/{self.temporary}")


class ArrayCubes(DataSource):
    """Options: path; for scans target and gap (bytes); for writers layout (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "arraycubes"

    def _heads(self) -> list[Header]:
        if not hasattr(self, "heads"):
            self.heads = [header(p) for p in files_of(self.options["path"])]
        return self.heads

    def schema(self) -> str:
        return f"path string, t int, y int, x int, v array<{value_type(self._heads())[0]}>"

    def reader(self, schema: StructType) -> ArrayReader:
        heads = self._heads()
        return ArrayReader(heads, value_type(heads)[1], int(self.options.get("target", TARGET)), int(self.options.get("gap", GAP)))

    def writer(self, schema: StructType, overwrite: bool) -> PatchWriter:
        return PatchWriter(self.options["path"], json.loads(self.options["layout"]), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the scan takes predicates over
    spark.dataSource.register(ArrayCubes)
    return spark


def read_arrays(spark: SparkSession, path: str, target: int = TARGET, gap: int = GAP) -> DataFrame:
    """(path, t, y, x, v) of the .npy files of a path; filters on path, t, y and x decide what is read."""
    return _registered(spark).read.format("arraycubes").option("target", target).option("gap", gap).load(path)


def array_info(spark: SparkSession, path: str) -> DataFrame:
    """path, steps, height, width, channels, dtype, size_mb of the .npy files of a path, from their headers, read by tasks."""
    names = spark.createDataFrame([(p,) for p in files_of(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [header(p) for p in b.column(0).to_pylist()]
            parts = [pa.array(x, pa.int32()) for x in zip(*(h.cube for h in heads))] if heads else [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *parts, pa.array([np.dtype(h.dtype).name for h in heads]), pa.array([h.size / 1024 / 1024 for h in heads], pa.float64())], ["path", "steps", "height", "width", "channels", "dtype", "size_mb"])

    return names.mapInArrow(run, "path string, steps int, height int, width int, channels int, dtype string, size_mb double")


def write_patches(rows: DataFrame, path: str, layout: dict[str, dict], overwrite: bool = True) -> None:
    """Writes rows (name, sensor, t, y, x, v), v being an array of numbers, as one file for each name and sensor of layout: see PatchWriter.
    Of rows for the same cell the greatest v stays."""
    keys = ("name", "sensor", "t", "y", "x")
    ready = rows.select("name", "sensor", *(F.col(k).cast("int").alias(k) for k in ("t", "y", "x")), F.col("v").cast("array<double>").alias("v"))
    dealt = ready.repartition("name", "sensor").sortWithinPartitions(*keys, "v")
    _registered(rows.sparkSession)
    dealt.write.format("arraycubes").option("path", path).option("layout", json.dumps(layout)).mode("overwrite" if overwrite else "append").save()


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(name, fault) of the files that a folder's manifest names and that are missing or have another size or CRC-32."""
    named = manifest(path)
    if named is None:
        raise FileNotFoundError(f"no manifest in {path}")
    root = path.rstrip("/")
    rows = spark.createDataFrame([(x["name"], x["size"], x["crc32"]) for x in named], "name string, size long, crc32 long").repartition(max(1, len(named) // 64))

    def fault(name: str, size: int, crc: int) -> str | None:
        store, at = opened(f"{root}/{name}")
        info = store.get_file_info(at)
        if info.type != pafs.FileType.File:
            return "missing"
        if info.size != size:
            return "size"
        found = 0
        with store.open_input_file(at) as f:
            while part := f.read(1 << 22):
                found = zlib.crc32(part, found)
        return "content" if found != crc else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fault(*x) for x in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["name", "fault"])

    return rows.mapInArrow(run, "name string, fault string").where("fault IS NOT NULL")


def put_files(files: DataFrame, path: str) -> None:
    """Writes each row (file, content) as a file of the folder, by the task that holds it. A file appears under its name only when it is
    whole, so a task that is run again does no harm."""
    store, at = opened(path)
    store.create_dir(at, recursive=True)

    def put(rows: Iterator[Row]) -> None:
        store, at = opened(path)
        for r in rows:
            part = f"{at}/_{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            store.move(part, f"{at}/{r['file']}")

    files.select("file", "content").foreachPartition(put)

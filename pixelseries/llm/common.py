"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session
    (tests), and an error on a cluster, where other machines would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Paths of the tables that are stored while it is open; they go at its end, but for those to keep, which are then the
    outer one's, if there is one."""

    def __init__(self, outer: Scratch | None) -> None:
        self.paths: list[str] = []
        self.outer = outer

    def keep(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.remove(t._stored_at)
            if self.outer is not None:
                self.outer.paths.append(t._stored_at)


_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables that are stored inside, when they are needed no more: nothing that is returned may read them, but
    for the kept ones."""
    held = Scratch(getattr(_OPEN, "scratch", None))
    _OPEN.scratch = held
    try:
        yield held
    finally:
        _OPEN.scratch = held.outer
        for p in held.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := getattr(_OPEN, "scratch", None)) is not None:
        held.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """rows, a stored table of a few narrow columns, to be broadcast if there are not too many; else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether each row is a row of a file as it was read, perhaps filtered or with other columns, and none comes twice."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row): the documents as structs, each with a number that names it alone and stays the same however often and by
    whichever tasks they are read. Rows of files are named by file and place in it; others are stored first."""
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    if not _rows_of_files(docs):
        copy = stored(docs.select(doc), "rows")
        _keep(copy)
        return keyed(copy).select("doc.doc", "row")
    placed = docs.select(doc, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = placed.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("nth"))
    files = stored(files, "files")
    _keep(files)
    return placed.join(small(files), "file").select("doc", (F.shiftleft("nth", 40) + F.col("at")).alias("row"))


def _keep(table: DataFrame) -> None:
    if (held := getattr(_OPEN, "scratch", None)) is not None:
        held.keep(table)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of all k, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column without nulls, of equal lengths, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def running(rows: DataFrame, group: str, cell: Sequence[Column], inside: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums: what the rows of the group that come before have together, by the cells' order and then
    by the order inside. Only a cell's rows meet in one task; of the others just the cells' sums are needed."""
    keys = [f"__cell{k}" for k in range(len(cell))]
    rows = rows.withColumns(dict(zip(keys, cell)) | {f"__add_{n}": c.cast("long") for n, c in sums.items()})
    before = Window.partitionBy(group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(group, *keys).agg(*(F.sum(f"__add_{n}").alias(f"__all_{n}") for n in sums))
    first = each.select(group, *keys, *(F.coalesce(F.sum(f"__all_{n}").over(before), F.lit(0)).alias(f"__first_{n}") for n in sums))
    above = Window.partitionBy(group, *keys).orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__own_{n}": F.coalesce(F.sum(f"__add_{n}").over(above), F.lit(0)) for n in sums})
    out = rows.join(first, [group, *keys]).withColumns({n: (F.col(f"__first_{n}") + F.col(f"__own_{n}")).cast("long") for n in sums})
    return out.drop(*keys, *(f"__{k}_{n}" for k in ("add", "own", "first") for n in sums))


def numbered(rows: DataFrame, group: str, cell: Sequence[Column], inside: Sequence[Column], name: str) -> DataFrame:
    """rows with gapless numbers from 0 in each group."""
    return running(rows, group, cell, inside, {name: F.lit(1)})

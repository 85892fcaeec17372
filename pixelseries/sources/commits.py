"""Committed outputs: tables whose outputs (a tile, a day, a month: the rows of one key) are there as a whole or not at all.

A write stages its files in a folder of its own, reads them back to count and digest each output's rows, and then publishes a manifest of
one file. Readers go through the manifests: of each output they see the rows of its last published write, so unfinished and failed
writes show nothing and a rerun replaces what it repeats. What is published can be audited: an output is valid if its files can be
read, hold as many rows as were counted with the same digest, and pass an audit of the caller's. write_missing writes just the outputs
that are not valid, so a run resumes where it stopped and mends what was damaged.

    root/data/write=<id>/<keys>/...      files of a write, a folder for each output
    root/packs/write=<id>/__pack=<n>/... the same of many small outputs, which share folders and files
    root/manifest/write=<id>/...         its outputs: keys, rows, digest, folder, version
    root/schema/write=<id>/...           an empty table with the columns of the write

One writer at a time is meant to publish; of two with the same version the greater id counts, for all readers alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Audit = Callable[[DataFrame], DataFrame]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # nothing published yet
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _digests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rows, digest: the count, and a sum of hashes of all columns, which does not depend on the order of rows."""
    columns = sorted(c for c in rows.columns if c not in keys)
    hashed = F.xxhash64(*columns) if columns else F.lit(0).cast("long")
    return rows.withColumn("__digest", hashed).groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.col("__digest").cast("decimal(38,0)")).cast("string").alias("digest"))


def outputs(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame | None:
    """keys, write, version, rows, digest, folder of what is published last of each output; None before the first write."""
    found = _read(spark, f"{root}/manifest")
    if found is None:
        return None
    last = Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("write"))
    return found.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").select(*keys, "write", "version", "rows", "digest", "folder")


def _schema(spark: SparkSession, root: str, write: str) -> StructType:
    return spark.read.parquet(f"{root}/schema/write={write}").schema


def write(rows: DataFrame, root: str, keys: Sequence[str], packs: int | None = None) -> DataFrame:
    """Stages and publishes rows; the outputs that they have replace earlier ones. Returns what was published. Keys must not be null.
    With packs the outputs are dealt into that many folders by a hash of their keys: a folder for each of very many small outputs
    costs more than its rows. A damaged file then hurts all outputs that it holds."""
    spark, turn = rows.sparkSession, uuid.uuid4().hex
    staged = f"{root}/{'data' if packs is None else 'packs'}/write={turn}"
    if packs is None:
        rows.write.partitionBy(*keys).parquet(staged)
    else:
        rows.withColumn("__pack", F.pmod(F.xxhash64(*keys), F.lit(packs))).repartition(packs, "__pack").write.partitionBy("__pack").parquet(staged)
    before = _read(spark, f"{root}/manifest")
    version = (before.agg(F.max("version")).first()[0] or 0) + 1 if before is not None else 1
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{root}/schema/write={turn}")
    types = [rows.schema[k] for k in keys]
    back = spark.read.schema(rows.schema).parquet(staged)
    # the folder as a name, not as a part of an address, in which blanks and the like are encoded
    folder = F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", "(write=.*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    folders = back.select(*keys, folder.alias("folder")).groupBy(*keys).agg(F.min("folder").alias("folder"))
    made = _digests(back.select(*rows.columns), keys).join(folders, list(keys)).withColumn("version", F.lit(version).cast("long"))
    made = made.select(*(F.col(t.name).cast(t.dataType) for t in types), "rows", "digest", "folder", "version")
    made.coalesce(1).write.parquet(f"{root}/manifest/write={turn}")  # one file: its rename is the commit
    return spark.read.parquet(f"{root}/manifest/write={turn}")


def read(spark: SparkSession, root: str, keys: Sequence[str], whole_only: bool = True) -> DataFrame:
    """The rows of all published outputs. Only their folders are listed and read: the manifest names them, and their list is no longer
    than Spark's own list of the files. With whole_only a file or folder that cannot be read is an error, else its rows are missing; as
    folders may be gone, all are then listed and those that do not count sorted out by a join."""
    last = outputs(spark, root, keys)
    found = [] if last is None else last.select("folder", "version", "write").distinct().orderBy("folder").collect()
    if not found:
        raise FileNotFoundError(f"nothing is published in {root}")
    schema = _schema(spark, root, max((r["version"], r["write"]) for r in found)[1])
    marked = StructType([*schema.fields]).add("write", "string")
    single, packed = ([r["folder"] for r in found if ("/__pack=" in r["folder"]) == many] for many in (False, True))
    current = lambda rows: rows.join(last.select(*keys, "write"), [*keys, "write"], "left_semi").select(*schema.names)
    lenient = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").schema(marked)
    out = []
    if single and whole_only:
        out.append(spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*(f"{root}/data/{f}" for f in single)).select(*schema.names))
    elif single:
        out.append(current(lenient.parquet(f"{root}/data")))
    if packed and whole_only:  # a folder may hold outputs that were replaced since
        out.append(current(spark.read.option("basePath", f"{root}/packs").schema(marked).parquet(*(f"{root}/packs/{f}" for f in packed))))
    elif packed:
        out.append(current(lenient.parquet(f"{root}/packs")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def valid(spark: SparkSession, root: str, keys: Sequence[str], audit: Audit | None = None) -> DataFrame | None:
    """The keys of outputs that are there as published and pass the audit, a function from rows to the keys that pass; None before the first write."""
    last = outputs(spark, root, keys)
    if last is None:
        return None
    rows = read(spark, root, keys, whole_only=False)
    found = _digests(rows, keys).withColumnsRenamed({"rows": "__rows", "digest": "__digest"})
    same = last.join(found, list(keys)).where("rows = __rows AND digest = __digest").select(*keys)
    return same if audit is None else same.join(audit(rows).select(*keys).distinct(), list(keys), "left_semi")


def write_missing(rows: DataFrame, root: str, keys: Sequence[str], audit: Audit | None = None, packs: int | None = None) -> DataFrame | None:
    """Writes the outputs that are not valid. Returns what was published, None if nothing had to be."""
    done = valid(rows.sparkSession, root, keys, audit)
    todo = rows if done is None else rows.join(done, list(keys), "left_anti")
    return None if done is not None and todo.isEmpty() else write(todo, root, keys, packs)


def superseded(spark: SparkSession, root: str, keys: Sequence[str]) -> list[str]:
    """Paths of published writes none of whose outputs counts any more, which may be deleted. Staged ones are not named: they may be running."""
    last, every = outputs(spark, root, keys), _read(spark, f"{root}/manifest")
    if last is None or every is None:
        return []
    old = every.groupBy("write").agg(F.max(F.when(F.col("folder").contains("/__pack="), "packs").otherwise("data")).alias("data")).join(last.select("write").distinct(), "write", "left_anti")
    return [f"{root}/{part}/write={r['write']}" for r in old.orderBy("write").collect() for part in ("manifest", r["data"], "schema")]

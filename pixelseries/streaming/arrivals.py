"""Structured Streaming forms of the batch operators. Event time is `ts`; what is later than the watermark is dropped."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pixelseries.functions.radar import db_code


def scene_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """New Parquet files of a folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(stream: DataFrame, column: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def once(stream: DataFrame, key: str = "item_id") -> DataFrame:
    """Each item once within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark([key])


def daily_first(stream: DataFrame, valid: str = "valid") -> DataFrame:
    """(day, y, x, item_id): first valid item of each day and pixel, once the day is complete."""
    day = F.window("ts", "1 day").alias("w")
    return stream.where(valid).groupBy(day, "y", "x").agg(F.min("item_id").alias("item_id")).select(F.to_date("w.start").alias("day"), "y", "x", "item_id")


def daily_radar(stream: DataFrame) -> DataFrame:
    """(day, orbit, pol, y, x, code): first item with a code above 0, once the day is complete."""
    rows = stream.withColumn("code", db_code(F.col("amp"))).where("code <> 0")
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "orbit", "pol", "y", "x").agg(F.min_by("code", "item_id").alias("code"))
    return out.select(F.to_date("w.start").alias("day"), "orbit", "pol", "y", "x", "code")


def daily_pixels(stream: DataFrame, *keys: str) -> DataFrame:
    """Running count of a key's observations by day; for update mode."""
    out = stream.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), *keys, "n")


def sliding_activity(stream: DataFrame, width: str = "10 days", step: str = "1 day") -> DataFrame:
    out = stream.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def spells(stream: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Runs of observations with no gap that long."""
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ledger_upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "tile_id") -> StreamingQuery:
    """Appends the keys of each batch that the ledger does not hold yet."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key).distinct()
        try:
            new = new.join(spark.read.parquet(path), key, "left_anti")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session
    (tests), and an error on a cluster, where other machines would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return (found or f"file://{tempfile.mkdtemp(prefix='spark-')}").rstrip("/")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file, or the files of its folder, as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # of the store that holds it, whichever Spark reads
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def settled(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an aggregating stream over all that is there now and returns its complete result as of the end."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/rows")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns what it has appended."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")

"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing and sharding, each stage's rows written
as Parquet in the shared folder and read again by the next.

All stages work row by row and keep the documents' columns, extra ones too, whatever their names; the last one adds shard,
slot, grown_shard, size, text_crc32 and law. Null, empty and blank texts fail the quality rules and go. Rows with a null doc_id
are documents like others: of a group of near copies the least doc_id stays, one without an id only if no copy has one.
Rows that share a doc_id are judged each by its own text. Ties and repeated rows: copies in all columns are near copies of
each other, and one stays. Very long texts are judged whole. An empty table gives an empty result from every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelseries.llm import decontam, mixing, neardup, quality, sharding
from pixelseries.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_by_key(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_target_weights),
    ("sharding", sharding_by_key),
]

#: XXH64, CRC-32 and the trained models have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

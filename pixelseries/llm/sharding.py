"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a table of the ring. When
shards are appended, a row stays or moves into an added shard, and only the fraction that the added shards need moves.

Slots number the rows of a shard without gaps. A shard is cut into cells by a hash of its rows' contents, rows are numbered
inside each cell, and the cells' sizes give each cell's first slot, so no task ever holds a whole shard.

A null text has no bytes and the CRC of the empty text. A null key goes where the key 0 goes. Repeated rows and equal
texts are rows of their own with slots of their own, in any order among themselves. Very long texts count whole. An empty
table gives an empty result. Extra columns are ignored by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, numbered, scratch, small, stored

SHARDS = 40
CELL_ROWS = 100_000
DEAL = 16
#: Multiplier of the generator by which the published algorithm jumps; a fixed value.
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys, after Lamping and Veach (2014)."""
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            at[moving] = ahead[moving]
            state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards))

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def place(docs: DataFrame, shards: int = SHARDS, cell_rows: int = CELL_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the carried columns, size, text_crc32, law, shard, slot, grown_shard (the shard with one shard more)."""
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        *carry,
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(key, text).alias("spread"),
    )
    rows = stored(rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)}), "placed")
    cells = max(1, -(-rows.count() // (shards * cell_rows)))
    # a shard can be hot (null ids are one key); its cells are by content, and rows of equal content are spread over DEAL cells more
    each = F.col("row") if "row" in carry else F.monotonically_increasing_id()
    deal = F.pmod(each, F.lit(DEAL)) if cells > 1 else F.lit(0)
    rows = numbered(rows.withColumn("deal", deal), "shard", [F.pmod("spread", F.lit(cells)), F.col("deal")], [F.col(c) for c in ("doc_id", "spread", "text_crc32", "size")], "slot")
    return rows.select("doc_id", *carry, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with all their columns, and where they go: shard, slot, grown_shard, size, text_crc32, law. A column of
    the documents that has such a name stays as given_<name>, with more underscores where that is taken too."""
    held = keyed(docs)
    with scratch(docs.sparkSession) as tables:
        placed = stored(place(held.select("row", "doc.doc_id", "doc.text"), carry=("row",), **options).drop("doc_id"), "places")
        tables.keep(placed)
    added = [c for c in placed.columns if c != "row"]
    own, taken = [], {*added, *docs.columns}
    for c in docs.columns:
        name = c if c not in added else f"given_{c}"
        while c in added and name in taken:
            name += "_"
        taken.add(name)
        own.append(F.col("doc").getField(c).alias(name))
    return held.join(small(placed), "row").select(*own, *added)

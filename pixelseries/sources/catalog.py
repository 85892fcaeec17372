"""Scene catalog: one row for each item, with its footprint, time, orbit, cloud cover and assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.functions.radar import orbit_name

BOX = ("minx", "miny", "maxx", "maxy")


def overlaps(box: Sequence[float | Column], columns: Sequence[str] = BOX) -> Column:
    """Whether a footprint meets the box; touching counts."""
    minx, miny, maxx, maxy = (b if isinstance(b, Column) else F.lit(float(b)) for b in box)
    a, b, c, d = map(F.col, columns)
    return (a <= maxx) & (c >= minx) & (b <= maxy) & (d >= miny)


def search_optical(scenes: DataFrame, box: Sequence[float], start: str, end: str, max_cloud: float) -> DataFrame:
    """Items that meet the box between start and end (its whole last second) with less than the highest cloud cover."""
    t = F.col("acquired")
    return scenes.where(overlaps(box) & (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND")) & (F.col("cloud_cover") < max_cloud))


def search_radar(scenes: DataFrame, box: Sequence[float], start: str, end: str, orbit: str = "both") -> DataFrame:
    t = F.col("acquired")
    found = scenes.where(overlaps(box) & (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND")))
    return found if orbit == "both" else found.where(F.col("orbit") == orbit)


def date_chunks(spans: DataFrame, days: int = 15) -> DataFrame:
    """Each row's range from start to end (dates, inclusive) as consecutive chunks: chunk, chunk_start, chunk_end."""
    starts = F.posexplode(F.sequence("start", "end", F.expr(f"INTERVAL {days} DAYS"))).alias("chunk", "chunk_start")
    return spans.select("*", starts).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("end")))


def search_chunked(scenes: DataFrame, spans: DataFrame, days: int = 15) -> DataFrame:
    """The items of every chunk, each item once, in the first chunk that has it."""
    chunks = date_chunks(spans, days)
    day = F.to_date("acquired")
    months = F.explode(F.sequence(F.trunc("chunk_start", "month"), F.trunc("chunk_end", "month"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    keyed = chunks.select("chunk", "chunk_start", "chunk_end", months)  # a month makes the range join an equi-join
    hits = scenes.withColumn("month", F.trunc(day, "month")).join(keyed, "month").where(day.between(F.col("chunk_start"), F.col("chunk_end")))
    return keep_first(hits.drop("month", "chunk_start", "chunk_end"), ["item_id"], ["chunk", "acquired"])


def date_partitions(spans: DataFrame, n: int) -> DataFrame:
    """Each row's range of whole days cut into n pieces of equally many seconds, snapped to dates, without gap or overlap."""
    piece = F.floor((F.datediff("end", "start").cast("long") + 1) * 86400 / F.lit(n))
    day = lambda k: F.date_add("start", F.floor(k * piece / 86400).cast("int"))
    rows = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    finish = F.when(F.col("part") == n - 1, F.col("end")).otherwise(F.date_sub(day(F.col("part") + 1), 1))
    return rows.withColumns({"part_start": day(F.col("part")), "part_end": finish})


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def item_order(scenes: DataFrame) -> DataFrame:
    """item_seq: an item's place in its day, by time and id, from 0."""
    place = Window.partitionBy(F.to_date("acquired")).orderBy("acquired", "item_id")
    return scenes.withColumn("item_seq", F.row_number().over(place) - 1)


def by_day(scenes: DataFrame) -> DataFrame:
    """date, n_items, items (ids in item order)."""
    order = F.array_sort(F.collect_list(F.struct("acquired", "item_id")))
    days = scenes.groupBy(F.to_date("acquired").alias("date")).agg(F.count("*").alias("n_items"), order.alias("items"))
    return days.withColumn("items", F.col("items.item_id"))


def by_day_and_orbit(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy(F.to_date("acquired").alias("date"), orbit_name(F.col("orbit")).alias("orbit")).agg(F.count("*").alias("n_items"))


def footprint(scenes: DataFrame, *keys: str) -> DataFrame:
    """Union of the items' boxes."""
    return scenes.groupBy(*keys).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def with_assets(scenes: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Items that have all the needed assets; the others are no data."""
    own = F.array(*map(F.lit, needed))
    return scenes.where(F.size(F.array_intersect("assets", own)) == len(set(needed)))

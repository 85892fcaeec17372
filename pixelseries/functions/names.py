"""Names of tiles, patches, mosaics and partitions, and message classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_ID = r"^(?:tile_)?zone(\d+)_r(\d+)_c(\d+)"
#: What network failures say; fixed values.
NETWORK_WORDS = (
    "timeout", "connection", "network", "exceeded the maximum allowed time", "read timeout", "connect timeout", "unreachable", "refused", "reset", "temporary failure",
    "service unavailable",
)


def tile_part(tile_id: Column, part: int) -> Column:
    """1: EPSG code, 2: row, 3: column of a tile id; null if it is none."""
    return F.when(tile_id.rlike(TILE_ID), F.regexp_extract(tile_id, TILE_ID, part).cast("int"))


def tile_name(epsg: Column, row: Column, col: Column) -> Column:
    return F.concat(F.lit("tile_zone"), epsg.cast("string"), F.lit("_r"), row.cast("string"), F.lit("_c"), col.cast("string"))


def listed_tile(path: Column) -> Column:
    """Tile id of a file path tile_<id>.tif."""
    return F.regexp_replace(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("tile_"), F.lit("")), r"\.[^.]*$", "")


def mosaic_name(date: Column, pol: Column | None = None, orbit: Column | None = None) -> Column:
    day = F.date_format(date, "yyyy-MM-dd")
    return F.concat(day, F.lit("_mosaic")) if pol is None else F.concat_ws("_", day, pol, orbit)


def partition_label(start: Column, end: Column, index: Column, prefix: str) -> Column:
    """Name of a date range: its first day, then as much of the last one as differs."""
    day = lambda c, form: F.date_format(c, form)
    last = (
        F.when(start == end, "")
        .when(day(start, "yyyyMM") == day(end, "yyyyMM"), F.concat(F.lit("-"), day(end, "dd")))
        .when(F.year(start) == F.year(end), F.concat(F.lit("-"), day(end, "MMdd")))
        .otherwise(F.concat(F.lit("-"), day(end, "yyyyMMdd")))
    )
    return F.concat(F.lit(f"{prefix}_P"), index.cast("string"), F.lit("_"), day(start, "yyyyMMdd"), last)


def year_bounds(year: Column) -> tuple[Column, Column]:
    """First and last second of a year."""
    return F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(year, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))


def iso_time(text: Column) -> Column:
    """The time of an ISO text, with or without a final Z; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast("timestamp_ntz")


def network_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(NETWORK_WORDS))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)

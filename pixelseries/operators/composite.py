"""Optical and radar day composites over a region of interest.

The optical composite looks at scene classes first, so only valid observations of the region are ever shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.functions.mix import mixed
from pixelseries.functions.optical import INVALID_CLASSES, class_label, harmonized, percent, valid_class
from pixelseries.functions.radar import db_code, finite_positive

PIXEL = ("y", "x")


def first_valid(obs: DataFrame, roi: DataFrame, invalid: Sequence[int] = INVALID_CLASSES) -> DataFrame:
    """(date, y, x, item_seq): for each day and ROI pixel the lowest item whose class is valid. A bare minimum of an int
    is a hash aggregate with a partial step before the shuffle."""
    seen = obs.where(valid_class(F.col("scl"), invalid)).join(roi.select(*PIXEL), list(PIXEL), "left_semi")
    return seen.groupBy("date", *PIXEL).agg(F.min("item_seq").alias("item_seq"))


def coverage(selected: DataFrame, roi: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, pct): share of ROI pixels that have a row."""
    size = roi.agg(F.count("*").alias("roi_pixels"))  # one row
    days = selected.groupBy(*keys).agg(F.count("*").alias("n"))
    return days.join(F.broadcast(size)).withColumn("pct", percent(F.col("n"), F.col("roi_pixels"))).drop("roi_pixels")


def passing(covered: DataFrame, min_coverage: float) -> DataFrame:
    """Rows with at least the least coverage; equality passes."""
    return covered.where(F.col("pct") >= min_coverage)


def day_mosaic(obs: DataFrame, roi: DataFrame, bands: Sequence[str], min_coverage: float = 5.0, invalid: Sequence[int] = INVALID_CLASSES) -> DataFrame:
    """(date, y, x, item_seq, bands): first valid items of the days that pass the gate, bands freed of the offset. The bands come
    along with the choice in one hash aggregate, whose exchange the coverage shares."""
    seen = obs.where(valid_class(F.col("scl"), invalid)).join(roi.select(*PIXEL), list(PIXEL), "left_semi")
    chosen = seen.groupBy("date", *PIXEL).agg(F.min("item_seq").alias("item_seq"), *(F.min_by(b, "item_seq").alias(b) for b in bands))
    days = passing(coverage(chosen, roi, "date"), min_coverage).select("date")
    return chosen.join(days, "date", "left_semi").withColumns({b: harmonized(F.col(b), F.col("date")) for b in bands})


def fallback(obs: DataFrame, roi: DataFrame, chosen: DataFrame, seed: int = 17) -> DataFrame:
    """(date, y, x, item_seq): for days and ROI pixels without a valid item, one of their items, that of the least hash."""
    rest = obs.join(roi.select(*PIXEL), list(PIXEL), "left_semi").join(chosen.select("date", *PIXEL), ["date", *PIXEL], "left_anti")
    h = mixed(F.col("y"), F.col("x"), F.unix_date("date"), F.col("item_seq"), seed=seed)
    return rest.groupBy("date", *PIXEL).agg(F.min_by("item_seq", h).alias("item_seq"))


def class_histogram(obs: DataFrame, roi: DataFrame) -> DataFrame:
    """(date, scl, label, n, pct of ROI pixels)."""
    counted = obs.groupBy("date", "scl").agg(F.count("*").alias("n"))
    size = roi.agg(F.count("*").alias("roi_pixels"))
    return counted.join(F.broadcast(size)).select("date", "scl", class_label(F.col("scl")).alias("label"), "n", percent(F.col("n"), F.col("roi_pixels")).alias("pct"))


def radar_item_coverage(sar: DataFrame, roi_pixels: int, union: bool = False) -> DataFrame:
    """(date, orbit, pol, pct): coverage by valid amplitudes; of an item's several tiles the highest one's, or with
    union=True that of all together."""
    ok = sar.where(finite_positive(F.col("amp")))
    keys = ["date", "orbit", "pol"]
    if union:
        return ok.select(*keys, *PIXEL).distinct().groupBy(*keys).agg(percent(F.count("*"), F.lit(roi_pixels)).alias("pct"))
    each = ok.select(*keys, "tile", *PIXEL).distinct().groupBy(*keys, "tile").agg(percent(F.count("*"), F.lit(roi_pixels)).alias("pct"))
    return each.groupBy(*keys).agg(F.max("pct").alias("pct"))


def radar_mosaic(sar: DataFrame) -> DataFrame:
    """(date, orbit, pol, y, x, code): of several items of a day, orbit and polarisation the first with a code above 0."""
    coded = sar.withColumn("code", db_code(F.col("amp"))).where("code <> 0")
    return coded.groupBy("date", "orbit", "pol", *PIXEL).agg(F.min_by("code", "item_id").alias("code"))


def with_source_count(mosaic: DataFrame, sar: DataFrame) -> DataFrame:
    """mosaic with n_sources: the items that its day, orbit and polarisation has, whether or not they are seen in it."""
    counts = sar.groupBy("date", "orbit", "pol").agg(F.countDistinct("item_id").alias("n_sources"))
    return mosaic.join(counts, ["date", "orbit", "pol"])


def radar_groups(sar: DataFrame, roi_pixels: int) -> DataFrame:
    """(date, orbit, pol, n, pct): all groups that have items, n their valid pixels over all items, pct the best item's."""
    keys = ["date", "orbit", "pol"]
    each = sar.groupBy(*keys, "tile", *PIXEL).agg(F.max(finite_positive(F.col("amp")).cast("int")).alias("ok"))
    tiles = each.groupBy(*keys, "tile").agg(F.sum("ok").alias("n"))
    return tiles.groupBy(*keys).agg(F.sum("n").alias("n"), percent(F.max("n"), F.lit(roi_pixels)).alias("pct"))


def radar_status(groups: DataFrame, min_coverage: float = 10.0, failed: Column | None = None) -> DataFrame:
    """Adds status to (date, orbit, pol, n, pct): failed (where told so), no_data, skipped (too little coverage) or success."""
    status = F.when(F.lit(False) if failed is None else failed, "failed").when(F.col("n") == 0, "no_data")
    return groups.withColumn("status", status.when(F.col("pct") < min_coverage, "skipped").otherwise("success"))


def status_summary(status: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and whether the group is fine: some success, or nothing but skips."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "skipped", "no_data", "failed")]
    out = status.groupBy(*keys).agg(*counts, F.count("*").alias("n_all"))
    return out.withColumn("ok", (F.col("n_success") > 0) | (F.col("n_skipped") == F.col("n_all")))


def run_verdict(groups: DataFrame, *keys: str) -> DataFrame:
    """Of each run: groups that are fine, all groups, and all/partial/none."""
    out = groups.groupBy(*keys).agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_groups"))
    return out.withColumn("verdict", F.when(F.col("n_ok") == F.col("n_groups"), "all").when(F.col("n_ok") > 0, "partial").otherwise("none"))

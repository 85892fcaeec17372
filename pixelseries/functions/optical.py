"""Scene classes and radiometric offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that are not valid observations; fixed values. Water, thin cirrus and snow count as valid.
INVALID_CLASSES = (0, 1, 2, 3, 8, 9)

#: Labels of the twelve scene classes; fixed values.
CLASS_LABELS = {
    0: "No data",
    1: "Saturated or defective",
    2: "Dark area pixels",
    3: "Cloud shadows",
    4: "Vegetation",
    5: "Not vegetated",
    6: "Water",
    7: "Unclassified",
    8: "Cloud medium probability",
    9: "Cloud high probability",
    10: "Thin cirrus",
    11: "Snow",
}

#: Names of the bands by their codes; fixed values.
BAND_NAMES = {
    "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge1", "B06": "rededge2", "B07": "rededge3", "B08": "nir", "B8A": "nir08", "B11": "swir16", "B12": "swir22", "SCL": "scl",
}

#: Statistics by which optical and radar bands are standardised, in the cubes' band order; fixed values.
OPTICAL_MEAN = (1711.0938, 1308.8511, 1546.4543, 3010.1293, 3106.5083, 2068.3044, 2685.0845, 2931.5889, 2514.6928, 1899.4922)
OPTICAL_STD = (1926.1026, 1862.9751, 1803.1792, 1741.7837, 1677.4543, 1888.7862, 1736.3090, 1715.8104, 1514.5199, 1398.4779)
RADAR_MEAN = (5484.0407, 3003.7812)
RADAR_STD = (1871.2334, 1726.0670)

OFFSET = 1000
OFFSET_AFTER = "2022-01-25"


def valid_class(scl: Column, invalid: Sequence[int] = INVALID_CLASSES) -> Column:
    """Whether a scene class is valid; null and NaN count as class 0."""
    value = F.coalesce(F.nanvl(scl.cast("double"), F.lit(0.0)), F.lit(0.0))
    return ~value.isin(*map(float, invalid))


def class_label(scl: Column) -> Column:
    names = F.create_map(*(x for k, v in CLASS_LABELS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(names, scl.cast("int")), F.lit("Unknown"))


def harmonized(value: Column, date: Column, offset: int = OFFSET, after: str = OFFSET_AFTER) -> Column:
    """Values of `offset` and more lose it strictly after the cut-off day; others stay."""
    return F.when((date > F.lit(after).cast("date")) & (value >= offset), value - offset).otherwise(value)


def legacy_classes(classes: Column) -> Column:
    """Whether a product's collected classes are exactly no-data and vegetation, the mark of one to make anew."""
    return F.array_sort(F.array_distinct(classes.cast("array<int>"))) == F.array(F.lit(0), F.lit(4))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; 0 if there is no whole."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def stored_value(value: Column, highest: int = 65535) -> Column:
    """Null and NaN as 0, the no-data value; the rest clamped to the stored type and truncated."""
    known = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(float(highest)), F.greatest(F.lit(0.0), known)).cast("int")

"""Polygons: rasterisation, box joins, bounds, centroids, hulls. Range conditions get a bin, so they are equi-joins."""

from __future__ import annotations

import uuid

import pyarrow as pa
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.sources.lists import edges
from pixelseries.streaming.arrivals import work_folder


def crossings(rings: DataFrame, rows: DataFrame) -> DataFrame:
    """(feature_id, y, cross_x): where edges cross the centre lines y + 0.5 of pixel rows. Each edge lists its own rows."""
    e = edges(rings).where("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(lo - 0.5).cast("int"), (F.ceil(hi - 0.5) - 1).cast("int")
    e = e.withColumns({"first": first, "last": last}).where("last >= first")
    each = e.select("feature_id", "x1", "y1", "x2", "y2", F.explode(F.sequence("first", "last")).alias("y")).join(rows.select("y").distinct(), "y", "left_semi")
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return each.select("feature_id", "y", at.alias("cross_x"))


def pixels_inside(rings: DataFrame, pixels: DataFrame) -> DataFrame:
    """(feature_id, y, x) of pixels whose centre is inside by the even-odd rule. Of each row the pixels between crossings
    in pairs are inside, so the pixels join with spans, not with edges."""
    cross = crossings(rings, pixels).groupBy("feature_id", "y").agg(F.array_sort(F.collect_list("cross_x")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.struct(F.get("c", 2 * k).alias("a"), F.get("c", 2 * k + 1).alias("b")))
    spans = cross.select("feature_id", "y", F.explode(pairs).alias("s"))
    xs = F.sequence(F.floor(F.col("s.a") - 0.5).cast("int") + 1, F.floor(F.col("s.b") - 0.5).cast("int"))
    cells = spans.where(F.floor(F.col("s.b") - 0.5) >= F.floor(F.col("s.a") - 0.5) + 1).select("feature_id", "y", F.explode(xs).alias("x"))
    return cells.join(pixels.select("y", "x"), ["y", "x"], "left_semi").select("feature_id", "y", "x")


def union_mask(inside: DataFrame) -> DataFrame:
    """(y, x) inside any feature."""
    return inside.select("y", "x").distinct()


LEVELS = (-20, 40)
BOX = ("minx", "miny", "maxx", "maxy")
CELL = ("at", "bx", "by")


def box_level(bin_size: float) -> Column:
    """The level of a box whose cells, bin_size * 2 ** level wide, are no smaller than the box: it lies in four of them at most."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.when(extent > 0, F.ceil(F.log2(extent / bin_size))).otherwise(LEVELS[0])
    return F.least(F.greatest(level, F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def box_cells(rows: DataFrame, bin_size: float, others: Sequence[int]) -> DataFrame:
    """rows with own (their level) and at, bx, by: the cells of each box at its own level and at those higher ones that others have."""
    at = F.array_distinct(F.concat(F.array("own"), F.filter(F.lit(list(others)).cast("array<int>"), lambda k: k > F.col("own"))))
    rows = rows.withColumn("own", box_level(bin_size)).withColumn("at", F.explode(at))
    size = F.lit(bin_size) * F.pow(F.lit(2.0), F.col("at"))
    for name, low, high in (("bx", "minx", "maxx"), ("by", "miny", "maxy")):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    return rows


def _listed(left: DataFrame, right: DataFrame, bin_size: float) -> tuple[DataFrame, DataFrame, Column]:
    """The distinct boxes of both sides by cell (at, bx, by) with n, how many rows have them, l_ and r_ before their columns, and the condition
    under which two in a cell meet. The levels are few (one for each power of two), so each box lists few cells."""
    sides = [rows.select(*BOX).dropna().groupBy(*BOX).agg(F.count("*").alias("n")) for rows in (left, right)]
    levels = [sorted(r[0] for r in rows.select(box_level(bin_size)).distinct().collect()) for rows in sides]
    a, b = (
        box_cells(rows, bin_size, others).select("at", "bx", "by", *(F.col(c).alias(f"{tag}_{c}") for c in (*BOX, "own", "n")))
        for rows, others, tag in zip(sides, levels[::-1], "lr")
    )
    return a, b, F.expr("at = greatest(l_own, r_own) and l_minx <= r_maxx and r_minx <= l_maxx and l_miny <= r_maxy and r_miny <= l_maxy")


def _with_box(rows: DataFrame, tag: str, *columns: str) -> DataFrame:
    return rows.select(*columns, *(F.col(c).alias(f"{tag}_{c}") for c in BOX))


def _small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """rows, to be broadcast if there are not too many."""
    return F.broadcast(rows) if rows.count() <= most else rows


#: Pairs in a task, and of a block of left rows; the ids in such a block, at least and at most; the ids of a slice of a right box's rows.
TASK_PAIRS, BLOCK_PAIRS = 32_000_000, 4_000_000
BLOCK_IDS = (64, 256)
SLICE_IDS = 128


def boxes_meeting(left: DataFrame, right: DataFrame, bin_size: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of boxes (minx, miny, maxx, maxy) that overlap or touch, however different their sizes: a pair meets at the level of its larger
    box, where either lies in four cells at most, and counts in the cell of its overlap's lower left corner only. Rows with the same box are
    tested once; the pairs of distinct boxes are then joined with the rows that have them, so the rest of the work is the pairs returned.
    Those come by blocks: ids of left rows with the same box, times a slice of the ids that they meet. The left id repeats for a slice's
    length and the slice for each left id, so that formats with runs and dictionaries store a pair in a few bits; and blocks have about as
    many pairs each, so that tasks have too. A task sorts its blocks with their slices before it unfolds them: without that stop Spark's
    generated code would hold all pairs of a block at once."""
    a, b, meet = _listed(left, right, bin_size)
    size = F.lit(bin_size) * F.pow(F.lit(2.0), F.col("at"))
    corner = (F.floor(F.greatest("l_minx", "r_minx") / size) == F.col("bx")) & (F.floor(F.greatest("l_miny", "r_miny") / size) == F.col("by"))
    l_box, r_box = ([f"{tag}_{c}" for c in BOX] for tag in "lr")
    met = a.join(b, list(CELL)).where(meet & corner).select(*l_box, *r_box, "l_n", "r_n")
    spark, path = left.sparkSession, f"{work_folder(left.sparkSession)}/boxes-{uuid.uuid4().hex}"
    met.groupBy(*l_box).agg(F.max("l_n").alias("l_n"), F.sum("r_n").alias("meets"), F.count("*").alias("boxes")).write.parquet(path)
    found = spark.read.parquet(path)
    pairs, boxes = (n or 0 for n in found.agg(F.sum(F.col("l_n").cast("double") * F.col("meets")), F.sum("boxes")).first())
    parts = int(max(pairs // TASK_PAIRS, min(pairs // (TASK_PAIRS // 16), 2 * spark.sparkContext.defaultParallelism))) + 1
    ids = F.least(F.greatest(F.lit(BLOCK_PAIRS) / F.col("meets"), F.lit(BLOCK_IDS[0])), F.lit(BLOCK_IDS[1]))
    rows = _with_box(left, "l", left_id).join(_small(found), l_box)
    blocks = _ids(rows.withColumn("block", F.pmod(F.xxhash64(left_id), F.ceil(F.col("l_n") / ids))), left_id, "block", *l_box)
    blocks = blocks.repartitionByRange(parts, *l_box, "block").withColumnRenamed("ids", "l_ids")
    most, n = 1_000_000, right.count()
    others = _with_box(right.dropna(subset=list(BOX)), "r", right_id).withColumn("block", F.pmod(F.xxhash64(right_id), F.lit(n // most + 1)))
    at = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / SLICE_IDS).cast("int"))
    slices = _ids(others, right_id, "block", *r_box).select(*r_box, F.explode(F.transform(at, lambda k: F.slice("ids", k * SLICE_IDS + 1, SLICE_IDS))).alias("r_ids"))
    met = met.select(*l_box, *r_box)
    both = blocks.join(F.broadcast(met) if boxes <= most else met, l_box).join(F.broadcast(slices) if n <= most else slices, r_box)
    both = both.sortWithinPartitions(*l_box, "block")
    return both.select(F.explode("l_ids").alias(left_id), "r_ids").select(left_id, F.explode("r_ids").alias(right_id))


def _ids(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """keys and ids, the list of name, with those that are null, which a list of bare values leaves out."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(name).alias("id"))).alias("ids")).withColumn("ids", F.col("ids.id"))


def bounds(rings: DataFrame, pixel: float, *keys: str) -> DataFrame:
    """Bounds of the vertices, and the raster size that covers them."""
    out = rings.groupBy(*keys).agg(F.min("vx").alias("minx"), F.min("vy").alias("miny"), F.max("vx").alias("maxx"), F.max("vy").alias("maxy"))
    return out.withColumns({"width": F.ceil((F.col("maxx") - F.col("minx")) / pixel), "height": F.ceil((F.col("maxy") - F.col("miny")) / pixel)})


def centroids(rings: DataFrame, *keys: str) -> DataFrame:
    """Area-weighted centroid (exact for polygons that do not overlap)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    e = edges(rings).groupBy(*keys).agg(F.sum(cross).alias("double_area"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"))
    return e.where("double_area <> 0").select(*keys, (F.col("mx") / (3 * F.col("double_area"))).alias("cx"), (F.col("my") / (3 * F.col("double_area"))).alias("cy"))


def union_moments(rings: DataFrame, strip: float, *keys: str) -> DataFrame:
    """keys, area, cx, cy of the union of all polygons of a key, however they overlap. The plane is cut into strips `strip` high, and these into
    slabs at every vertex and crossing of edges. Inside a slab the edges do not cross: sorted by x, their features' insides (even-odd)
    open and close, and every stretch with a feature inside is a trapezoid. Areas and moments are quadratic in y, so Simpson's rule gives
    them exactly, and they are added up. Edges meet in pairs inside their strips only."""
    e = edges(rings).where("y1 <> y2").join(rings.select("feature_id", *keys).distinct(), "feature_id")
    up = F.col("y1") < F.col("y2")
    ends = {n: F.when(up, F.col(a)).otherwise(F.col(b)) for n, a, b in (("xa", "x1", "x2"), ("ya", "y1", "y2"), ("xb", "x2", "x1"), ("yb", "y2", "y1"))}
    e = e.select(*keys, "feature_id", *(c.alias(n) for n, c in ends.items())).withColumn("m", (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))).withColumn("o", F.col("xa") - F.col("m") * F.col("ya"))
    of = [*keys, "strip"]
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("ya") / strip), F.floor(F.col("yb") / strip))))
    low, high = F.col("strip") * F.lit(strip), (F.col("strip") + 1) * F.lit(strip)
    own = e.select(*of, F.explode(F.array(low, high, F.greatest("ya", low), F.least("yb", high))).alias("y"))
    other = e.select(*of, F.col("m").alias("m2"), F.col("o").alias("o2"), F.col("ya").alias("ya2"), F.col("yb").alias("yb2"))
    cross = e.join(other, of).where("m < m2").withColumn("y", (F.col("o2") - F.col("o")) / (F.col("m") - F.col("m2")))
    cross = cross.where((F.col("y") > F.greatest("ya", "ya2", low)) & (F.col("y") < F.least("yb", "yb2", high))).select(*of, "y")
    cuts = own.unionByName(cross).distinct()
    slabs = cuts.select(*of, F.col("y").alias("y0"), F.lead("y").over(Window.partitionBy(*of).orderBy("y")).alias("y1")).where("y1 IS NOT NULL")
    slabs = slabs.withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    lines = e.join(slabs, of).where("ya < mid AND mid < yb").select(*of, "y0", "y1", "mid", "feature_id", "m", "o", (F.col("o") + F.col("m") * F.col("mid")).alias("x"))
    slab = Window.partitionBy(*of, "y0").orderBy("x", F.desc("turn"), "feature_id", "m")
    turn = F.when(F.row_number().over(Window.partitionBy(*of, "y0", "feature_id").orderBy("x", "m")) % 2 == 1, 1).otherwise(-1)
    lines = lines.withColumn("turn", turn).withColumn("inside", F.sum("turn").over(slab))
    sides = lines.withColumn("opens", F.col("inside") == F.col("turn")).where("opens OR inside = 0")  # before an opening nothing was inside
    sign = F.when(F.col("opens"), -1.0).otherwise(1.0)
    x = lambda y: F.col("o") + F.col("m") * F.col(y)
    simpson = lambda f: sign * (F.col("y1") - F.col("y0")) / 6 * (f("y0") + 4 * f("mid") + f("y1"))
    sums = sides.select(*keys, simpson(x).alias("area"), simpson(lambda y: x(y) * x(y) / 2).alias("mx"), simpson(lambda y: x(y) * F.col(y)).alias("my"))
    out = sums.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("mx").alias("mx"), F.sum("my").alias("my")).where("area > 0")
    return out.select(*keys, "area", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy"))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners counter-clockwise from the leftmost one."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def convex_hulls(points: DataFrame, key: str, part_rows: int = 50_000) -> DataFrame:
    """(key, seq, vx, vy): hull corners, counter-clockwise from the leftmost. A hull's corners are among those of the hulls of
    any parts: of each x only the lowest and highest point is kept, and a key's points are dealt by a hash into parts of about
    `part_rows` points, whose few corners then meet."""
    ends = points.groupBy(key, "vx").agg(F.min("vy").alias("lo"), F.max("vy").alias("hi"))
    ends = ends.select(key, F.col("vx").cast("double").alias("vx"), F.explode(F.array_distinct(F.array(F.col("lo").cast("double"), F.col("hi").cast("double")))).alias("vy"))
    parts = max(1, -(-points.count() // part_rows))
    dealt = ends.withColumn("part", F.pmod(F.xxhash64("vx", "vy"), F.lit(parts)))

    def run(table: pa.Table) -> pa.Table:
        hull = _hull(list(zip(table.column("vx").to_pylist(), table.column("vy").to_pylist())))
        n = len(hull)
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * n, table.schema.field(key).type), "seq": pa.array(range(n), pa.int32()), "vx": pa.array([p[0] for p in hull], pa.float64()), "vy": pa.array([p[1] for p in hull], pa.float64())})

    kind = dict(points.dtypes)[key]
    schema = f"{key} {kind}, seq int, vx double, vy double"
    return dealt.groupBy(key, "part").applyInArrow(run, schema).groupBy(key).applyInArrow(run, schema)


def meets_any(windows_: DataFrame, rings: DataFrame, bin_size: float) -> DataFrame:
    """Windows (with their boxes) whose box meets that of some feature: the test before any exact one. No pairs are made: a distinct box looks
    in its cells for the first that it meets."""
    a, b, meet = _listed(windows_, bounds(rings, 1.0, "feature_id"), bin_size)
    met = a.join(b.withColumnsRenamed({c: f"r_{c}" for c in CELL}), F.expr(" and ".join(f"{c} = r_{c}" for c in CELL)) & meet, "left_semi")
    found = met.select(*(F.col(f"l_{c}").alias(c) for c in BOX)).distinct()
    return windows_.join(found, list(BOX), "left_semi").select(*windows_.columns)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])

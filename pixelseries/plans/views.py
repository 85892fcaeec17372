"""Canonical views (optical and radar observations, cubes, masks, grids) over the given tables, as DataFrames and as the
DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.functions.optical import valid_class
from pixelseries.functions.radar import db_code

PIXELS = 256
RADAR_PIXELS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Optical observations of 16 x 16 pixels, several items a pixel and day: px, y, x, date, item_seq, scl, p0."""
    px = (F.col("l_partkey") % PIXELS).cast("int")
    rows = table(spark, d, "lineitem").select(
        px.alias("px"),
        F.make_date(F.year("l_shipdate") + 26, F.month("l_shipdate"), F.lit(1)).alias("date"),
        F.col("l_linenumber").cast("int").alias("item_seq"),
        ((F.col("l_orderkey") + F.col("l_suppkey")) % 12).cast("int").alias("scl"),
        (F.floor("l_extendedprice").cast("long") % 10000).cast("int").alias("p0"),
    )
    out = rows.groupBy("px", "date", "item_seq").agg(F.min("scl").alias("scl"), F.max("p0").alias("p0"))
    return out.withColumns({"y": F.floor(F.col("px") / 16).cast("int"), "x": F.col("px") % 16})


def roi(spark: SparkSession, d: str) -> DataFrame:
    px = (F.col("l_partkey") % PIXELS).cast("int")
    out = table(spark, d, "lineitem").select(px.alias("px")).where(F.col("px") * 7 % 10 < 8).distinct()
    return out.select("px", F.floor(F.col("px") / 16).cast("int").alias("y"), (F.col("px") % 16).alias("x"))


def sar(spark: SparkSession, d: str) -> DataFrame:
    """Radar observations of 8 x 8 pixels: item_id, px, y, x, ts, date, orbit, pol, tile, amp."""
    return sar_rows(table(spark, d, "events"))


def sar_rows(events: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    kind, px = F.col("event_type"), (F.col("user_id") % RADAR_PIXELS).cast("int")
    orbit = F.when(kind.isin("view", "click"), "ascending").when(kind.isin("purchase", "signup"), "descending")
    return events.select(
        F.col("event_id").alias("item_id"), px.alias("px"), F.floor(px / 8).cast("int").alias("y"), (px % 8).alias("x"), "ts", F.to_date("ts").alias("date"),
        F.coalesce(orbit, F.lit("unknown")).alias("orbit"), F.when(F.col("event_id") % 2 == 0, "vv").otherwise("vh").alias("pol"),
        (F.col("event_id") % 3).cast("int").alias("tile"), F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(F.col("value") / 100).alias("amp"),
    )


def radar_cube(spark: SparkSession, d: str) -> DataFrame:
    """One radar observation a pixel, orbit and date: px, orbit, date, doy, vv, vh (the highest code; 0: none), v."""
    best = lambda pol: F.coalesce(F.max(F.when(F.col("pol") == pol, F.col("code"))), F.lit(0)).alias(pol)
    rows = sar(spark, d).where("orbit <> 'unknown'").withColumn("code", db_code(F.col("amp")))
    out = rows.groupBy("px", "orbit", "date").agg(best("vv"), best("vh"))
    return out.withColumns({"doy": F.dayofyear("date"), "v": F.array(F.col("vv").cast("double"), F.col("vh").cast("double"))})


def cube(spark: SparkSession, d: str) -> DataFrame:
    """One observation a pixel and date, of the lowest item: px, y, x, date, year, doy, valid, b0, b1, b2, v."""
    best = F.min_by(F.col("scl") * F.lit(10000) + F.col("p0"), "item_seq")  # both in one int: a hash aggregate
    rows = obs(spark, d).groupBy("px", "y", "x", "date").agg(best.alias("both"))
    p0 = F.col("both") % 10000
    rows = rows.select("px", "y", "x", "date", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), valid_class(F.floor(F.col("both") / 10000)).alias("valid"), p0.alias("b0"))
    rows = rows.withColumns({"b1": (F.col("b0") * 3 + F.col("px")) % 10000, "b2": (F.col("b0") * 7 + F.col("px")) % 10000})
    return rows.withColumn("v", F.array(*(F.col(b).cast("double") for b in ("b0", "b1", "b2"))))


def fine(spark: SparkSession, d: str) -> DataFrame:
    """Land cover at a fine resolution: fy, fx, tree, lc."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 50).cast("int").alias("fy"), (k % 50).cast("int").alias("fx"), (F.col("p_size") > 40).alias("tree"), F.when(k % 3 == 0, 40).otherwise(30).alias("lc"))


def rep(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of pixels, 25 a row: vec_id, y, x, z."""
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 25).cast("int").alias("y"), (F.col("vec_id") % 25).cast("int").alias("x"), F.col("embedding").cast("array<double>").alias("z"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles_of(table(spark, d, "supplier"))


def tiles_of(suppliers: DataFrame) -> DataFrame:
    """The same of a table or stream of suppliers."""
    s = F.col("s_suppkey")
    name = F.concat(F.lit("zone"), (F.col("s_nationkey") % 6 + 32642).cast("string"), F.lit("_r"), F.floor(s / 10).cast("string"), F.lit("_c"), (s % 10).cast("string"))
    return suppliers.select(name.alias("tile_id"), s.alias("nr"))


def pts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 36000 / F.lit(100.0) - 180).alias("lon"), (k * 8111 % 16800 / F.lit(100.0) - 84).alias("lat"))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orbit = F.when(F.col("o_orderstatus") == "F", "ascending").when(F.col("o_orderstatus") == "O", "descending")
    return table(spark, d, "orders").select(
        k.alias("item_id"), F.col("o_orderdate").alias("acquired"), orbit.alias("orbit"), (F.floor("o_totalprice").cast("long") % 101).cast("double").alias("cloud_cover"),
        (c * 7 % 358 - 180).cast("double").alias("minx"), (c * 13 % 158 - 80).cast("double").alias("miny"), (c * 7 % 358 - 178).cast("double").alias("maxx"), (c * 13 % 158 - 78).cast("double").alias("maxy"),
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last day of the scenes of each year: year, start, end."""
    day = F.to_date("acquired")
    return scenes(spark, d).groupBy(F.year("acquired").alias("year")).agg(F.min(day).alias("start"), F.max(day).alias("end"))


def rings(spark: SparkSession, d: str) -> DataFrame:
    """A quadrilateral for each supplier: feature_id, ring_id, seq, vx, vy."""
    s = F.col("s_suppkey")
    x, y = s * 7 % 40, s * 11 % 40
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("vx"), (y + dy).cast("double").alias("vy"))
    corners = F.array(corner(F.lit(0.3), F.lit(0.1)), corner(5.7 + s % 5, F.lit(1.4)), corner(4.2 + s % 3, 6.6 + s % 7), corner(F.lit(0.9), 5.8 + s % 2))
    out = table(spark, d, "supplier").select(s.alias("feature_id"), F.lit(0).alias("ring_id"), F.posexplode(corners).alias("seq", "p"))
    return out.select("feature_id", "ring_id", "seq", "p.vx", "p.vy")


#: The same rows in DuckDB SQL, by name, in an order in which each may use those before it.
SQL = {
    "obs": """SELECT px, date, item_seq, min(scl) AS scl, max(p0) AS p0, px // 16 AS y, px % 16 AS x FROM (
        SELECT l_partkey % 256 AS px, make_date(year(l_shipdate) + 26, month(l_shipdate), 1) AS date, l_linenumber AS item_seq,
            (l_orderkey + l_suppkey) % 12 AS scl, CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS p0 FROM lineitem) GROUP BY ALL""",
    "roi": "SELECT DISTINCT px, px // 16 AS y, px % 16 AS x FROM (SELECT l_partkey % 256 AS px FROM lineitem) WHERE (px * 7) % 10 < 8",
    "first_valid": """SELECT date, o.px, o.y, o.x, min(item_seq) AS item_seq FROM obs o JOIN roi USING (px)
        WHERE scl NOT IN (0, 1, 2, 3, 8, 9) GROUP BY ALL""",
    "covered": "SELECT date, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM roi) AS pct FROM first_valid GROUP BY date",
    "sar": """SELECT event_id AS item_id, user_id % 64 AS px, (user_id % 64) // 8 AS y, user_id % 8 AS x, ts, CAST(ts AS DATE) AS date,
        CASE WHEN event_type IN ('view', 'click') THEN 'ascending' WHEN event_type IN ('purchase', 'signup') THEN 'descending' ELSE 'unknown' END AS orbit,
        CASE WHEN event_id % 2 = 0 THEN 'vv' ELSE 'vh' END AS pol, event_id % 3 AS tile, CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE value / 100 END AS amp FROM events""",
    "coded": """SELECT *, CASE WHEN amp > 0 THEN CAST(floor(least(32767::DOUBLE, greatest(0::DOUBLE, (20 * log10(amp) + 50) * 200))) AS INTEGER) ELSE 0 END AS code FROM sar""",
    "cube": """SELECT px, px // 16 AS y, px % 16 AS x, date, year(date) AS year, dayofyear(date) AS doy, scl NOT IN (0, 1, 2, 3, 8, 9) AS valid,
        p0 AS b0, (p0 * 3 + px) % 10000 AS b1, (p0 * 7 + px) % 10000 AS b2 FROM obs QUALIFY row_number() OVER (PARTITION BY px, date ORDER BY item_seq) = 1""",
    "radar_cube": """SELECT px, orbit, date, dayofyear(date) AS doy, coalesce(max(code) FILTER (pol = 'vv'), 0) AS vv, coalesce(max(code) FILTER (pol = 'vh'), 0) AS vh
        FROM coded WHERE orbit <> 'unknown' GROUP BY px, orbit, date""",
    "fine": "SELECT p_partkey // 50 AS fy, p_partkey % 50 AS fx, p_size > 40 AS tree, CASE WHEN p_partkey % 3 = 0 THEN 40 ELSE 30 END AS lc FROM part",
    "tree_mask": "SELECT fy // 2 AS y, fx // 2 AS x, avg(tree::INT::DOUBLE) AS cover FROM fine GROUP BY ALL HAVING avg(tree::INT::DOUBLE) > 0.1 AND max(lc) = 40",
    "rep": "SELECT vec_id, vec_id // 25 AS y, vec_id % 25 AS x, embedding::DOUBLE[] AS z FROM embeddings",
    "tiles": "SELECT concat('zone', 32642 + s_nationkey % 6, '_r', s_suppkey // 10, '_c', s_suppkey % 10) AS tile_id, s_suppkey AS nr FROM supplier",
    "pts": "SELECT c_custkey AS id, ((c_custkey * 37) % 36000) / 100.0::DOUBLE - 180 AS lon, ((c_custkey * 8111) % 16800) / 100.0::DOUBLE - 84 AS lat FROM customer",
    "scenes": """SELECT o_orderkey AS item_id, o_orderdate AS acquired, CASE o_orderstatus WHEN 'F' THEN 'ascending' WHEN 'O' THEN 'descending' END AS orbit,
        (CAST(floor(o_totalprice) AS BIGINT) % 101)::DOUBLE AS cloud_cover, ((o_custkey * 7) % 358 - 180)::DOUBLE AS minx, ((o_custkey * 13) % 158 - 80)::DOUBLE AS miny,
        ((o_custkey * 7) % 358 - 178)::DOUBLE AS maxx, ((o_custkey * 13) % 158 - 78)::DOUBLE AS maxy FROM orders""",
    "spans": "SELECT year(acquired) AS year, min(acquired::DATE) AS first_day, max(acquired::DATE) AS last_day FROM scenes GROUP BY ALL",
    "corners": """SELECT s_suppkey AS feature_id, unnest([
        {'seq': 0, 'vx': (s_suppkey * 7) % 40 + 0.3::DOUBLE, 'vy': (s_suppkey * 11) % 40 + 0.1::DOUBLE},
        {'seq': 1, 'vx': (s_suppkey * 7) % 40 + (5.7::DOUBLE + s_suppkey % 5), 'vy': (s_suppkey * 11) % 40 + 1.4::DOUBLE},
        {'seq': 2, 'vx': (s_suppkey * 7) % 40 + (4.2::DOUBLE + s_suppkey % 3), 'vy': (s_suppkey * 11) % 40 + (6.6::DOUBLE + s_suppkey % 7)},
        {'seq': 3, 'vx': (s_suppkey * 7) % 40 + 0.9::DOUBLE, 'vy': (s_suppkey * 11) % 40 + (5.8::DOUBLE + s_suppkey % 2)}]) AS c FROM supplier""",
    "rings": "SELECT feature_id, c.seq AS seq, c.vx AS vx, c.vy AS vy FROM corners",
    "edges": """SELECT feature_id, vx AS x1, vy AS y1, coalesce(lead(vx) OVER w, first(vx) OVER w2) AS x2, coalesce(lead(vy) OVER w, first(vy) OVER w2) AS y2 FROM rings
        WINDOW w AS (PARTITION BY feature_id ORDER BY seq), w2 AS (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}

USES = {
    "first_valid": ("obs", "roi"), "covered": ("first_valid", "roi"), "coded": ("sar",), "radar_cube": ("coded",), "cube": ("obs",), "tree_mask": ("fine",),
    "spans": ("scenes",), "rings": ("corners",), "edges": ("rings",),
}


def with_views(body: str, *names: str) -> str:
    """The SQL with the named views, and those they use, as common table expressions."""
    needed: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        needed.add(n)
        todo += USES.get(n, ())
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in SQL.items() if n in needed) + "\n" + body

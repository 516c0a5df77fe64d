"""The shared test tables seen as pixels, zones, scenes, rasters, features and map elements.

Every shape is derived by Spark from the tables, so it grows with them. The SQL beside each shape derives the same in
DuckDB; the queries' SQL is put together from these parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.operators.spatial import join_zones
from landheat.operators.filters import in_bbox
from landheat.operators.pivot import pivot_bands, with_indices
from landheat.operators.thermal import with_scene_constants, with_temperature

LINE_BANDS = ["B2_Blue", "B3_Green", "B4_Red", "B5_NIR", "B6_SWIR1", "B10_TIR", "B11_TIR"]
CATEGORIES = ["residential", "commercial", "industrial", "green", "water"]
#: The orders' years as train and test.
CFG = Config(train_start=1995, train_end=1999, test_start=2000, test_end=2001)
BOX = CFG.bbox


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratio(whole, by: int):
    return whole.cast("double") / float(by)


def place(key) -> dict:
    """lon and lat of a whole-number key, spread over the box and a little beyond it."""
    return {"lon": _ratio(799474 + (key % 440) * 10, 10000), "lat": _ratio(128005 + ((key * 37) % 430) * 10, 10000)}


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIXEL_LONG rows: an order is a pixel at a time, its lines are bands."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    at = place(F.col("o_orderkey"))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    value = F.when(n <= 5, q / 100).when(n == 6, 7 + q / 12.5).when(n == 7, 6 + q / 12.5)
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("T"), F.col("o_custkey") % 8).alias("tile_id"),
        at["lat"].alias("lat"),
        at["lon"].alias("lon"),
        F.get(F.array(*map(F.lit, LINE_BANDS)), n - 1).alias("band"),
        value.alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderpriority").alias("lulc_class"),
    )


_BANDS_SQL = " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(LINE_BANDS, 1))
PIXELS_SQL = f"""
    pixels AS (
        SELECT 'T' || (o_custkey % 8) AS tile_id, CAST(128005 + ((o_orderkey * 37) % 430) * 10 AS DOUBLE) / 10000 AS lat,
               CAST(799474 + (o_orderkey % 440) * 10 AS DOUBLE) / 10000 AS lon, CASE l_linenumber {_BANDS_SQL} END AS band,
               CASE WHEN l_linenumber <= 5 THEN l_quantity / 100 WHEN l_linenumber = 6 THEN 7 + l_quantity / 12.5 WHEN l_linenumber = 7 THEN 6 + l_quantity / 12.5 END AS value,
               o_orderdate AS timestamp, o_orderpriority AS lulc_class
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
IN_BOX_SQL = f"lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the box, one row each, with year and indices."""
    return with_indices(pivot_bands(pixels(spark, sf_dir).filter(in_bbox(BOX)), LINE_BANDS))


_PIVOT_SQL = ", ".join(f"min(value) FILTER (band = '{b}') AS {b}" for b in LINE_BANDS)
WIDE_SQL = f"""{PIXELS_SQL},
    pivoted AS (SELECT tile_id, lat, lon, timestamp, lulc_class, {_PIVOT_SQL} FROM pixels WHERE {IN_BOX_SQL} GROUP BY ALL),
    wide AS (
        SELECT *, CAST(year(timestamp) AS INTEGER) AS year, (B5_NIR - B4_Red) / nullif(B5_NIR + B4_Red + 1e-10, 0) AS ndvi,
               (B6_SWIR1 - B5_NIR) / nullif(B6_SWIR1 + B5_NIR + 1e-10, 0) AS ndbi
        FROM pivoted)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone per nation in a 5 x 5 tiling: a triangle, a square with a hole, or a square, in turn."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    i, j = k % 5, F.floor(k / 5)
    x = lambda d: _ratio(7995 + 8 * i + d, 100)
    y = lambda d: _ratio(12800 + 86 * j + d, 1000)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = lambda *points: F.array(*points, points[0])
    square = ring(point(x(0), y(0)), point(x(8), y(0)), point(x(8), y(86)), point(x(0), y(86)))
    hole = ring(point(x(2), y(20)), point(x(5), y(20)), point(x(5), y(61)), point(x(2), y(61)))
    triangle = ring(point(x(0), y(0)), point(x(8), y(0)), point(x(8), y(86) - 0.00037))
    rings = F.when(k % 3 == 0, F.array(triangle)).when(k % 3 == 1, F.array(square, hole)).otherwise(F.array(square))
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.col("n_regionkey"))
    return n.select(k.alias("zone_id"), category.alias("zoning_category"), F.array(rings).alias("polygons"))


_CATEGORY_SQL = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES))
ZONES_SQL = f"""
    zones AS (
        SELECT CAST(n_nationkey AS BIGINT) AS zone_id, CASE n_regionkey {_CATEGORY_SQL} END AS zoning_category, n_nationkey % 3 AS shape,
               CAST(7995 + 8 * (n_nationkey % 5) AS DOUBLE) / 100 AS x0, CAST(7995 + 8 * (n_nationkey % 5) + 8 AS DOUBLE) / 100 AS x1,
               CAST(12800 + 86 * (n_nationkey // 5) AS DOUBLE) / 1000 AS y0, CAST(12800 + 86 * (n_nationkey // 5) + 86 AS DOUBLE) / 1000 AS y1,
               CAST(7995 + 8 * (n_nationkey % 5) + 2 AS DOUBLE) / 100 AS hx0, CAST(7995 + 8 * (n_nationkey % 5) + 5 AS DOUBLE) / 100 AS hx1,
               CAST(12800 + 86 * (n_nationkey // 5) + 20 AS DOUBLE) / 1000 AS hy0, CAST(12800 + 86 * (n_nationkey // 5) + 61 AS DOUBLE) / 1000 AS hy1
        FROM nation)"""
INSIDE_SQL = """
    lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 AND CASE shape
        WHEN 0 THEN (lon - x0) * (y1 - 0.00037 - y0) > (lat - y0) * (x1 - x0)
        WHEN 1 THEN NOT (lon BETWEEN hx0 AND hx1 AND lat BETWEEN hy0 AND hy1) ELSE TRUE END"""


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_zones(wide(spark, sf_dir), zones(spark, sf_dir))


ZONED_SQL = f"{WIDE_SQL}, {ZONES_SQL}, zoned AS (SELECT wide.*, zone_id, zoning_category FROM wide LEFT JOIN zones ON {INSIDE_SQL})"


def scene_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of seven of the eight tiles."""
    t = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("t")).distinct().filter("t < 7")
    add = lambda base: (base + F.col("t") * 0.5)
    return t.select(
        F.concat(F.lit("T"), "t").alias("scene_id"),
        add(774.8853).alias("k1_constant_band_10"),
        add(1321.0789).alias("k2_constant_band_10"),
        add(480.8883).alias("k1_constant_band_11"),
        add(1201.1442).alias("k2_constant_band_11"),
    )


def tempered(spark: SparkSession, sf_dir: str, mode: str = "column") -> DataFrame:
    """Zoned pixels inside a zone, with temperatures."""
    rows = zoned(spark, sf_dir).filter("zoning_category is not null")
    return with_temperature(with_scene_constants(rows, scene_meta(spark, sf_dir)), CFG, mode)


def _bt_sql(n: int, k1: float, k2: float) -> str:
    t = "CAST(substr(tile_id, 2) AS INTEGER)"
    inner = f"({k1} + {t} * 0.5::DOUBLE) / nullif(B{n}_TIR, 0) + 1"
    return f"CASE WHEN {t} < 7 AND {inner} > 0 THEN ({k2} + {t} * 0.5::DOUBLE) / nullif(ln({inner}), 0) END AS bt{n}"


_A = CFG.coefficients
TEMPERED_SQL = f"""{ZONED_SQL},
    covered AS (
        SELECT *, CASE WHEN ndvi IS NULL OR ndvi < {CFG.ndvi_soil} THEN 0 WHEN ndvi > {CFG.ndvi_veg} THEN 1
                  ELSE ((ndvi - {CFG.ndvi_soil}) / ({CFG.ndvi_veg}::DOUBLE - {CFG.ndvi_soil}::DOUBLE)) ** 2 END::DOUBLE AS pv,
               {_bt_sql(10, 774.8853, 1321.0789)}, {_bt_sql(11, 480.8883, 1201.1442)}
        FROM zoned WHERE zoning_category IS NOT NULL),
    emitting AS (
        SELECT *, {CFG.eps_soil10}::DOUBLE * (1 - pv) + {CFG.eps_veg10}::DOUBLE * pv AS eps10, {CFG.eps_soil11}::DOUBLE * (1 - pv) + {CFG.eps_veg11}::DOUBLE * pv AS eps11 FROM covered),
    windowed AS (
        SELECT *, bt10 - bt11 AS bt10_minus_bt11,
               bt10 + {_A[0]}::DOUBLE + {_A[1]} * (bt10 - bt11) + {_A[2]} * (bt10 - bt11) ** 2
               + ({_A[3]} + {_A[4]}::DOUBLE * {CFG.water_vapour}) * (1 - (eps10 + eps11) / 2) + ({_A[5]} + {_A[6]}::DOUBLE * {CFG.water_vapour}) * (eps10 - eps11) AS sw
        FROM emitting)"""


def r4(expression: str, places: int = 4) -> str:
    """SQL of functions.indices.rounded."""
    by = f"1e{places}"
    return f"sign({expression}) * floor(abs({expression}) * {by} + 0.5) / {by}"


def qa_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality pixels from events: a scene per event type."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.col("event_type").alias("scene"), (k % 64).alias("qrow"), (F.floor(k / 64) % 64).alias("qcol"), F.lit(64).alias("qheight"), F.lit(64).alias("qwidth"),
        (F.floor(F.coalesce("value", F.lit(0.0))) % 64).cast("int").alias("qa"), *(v.alias(n) for n, v in place(k).items()), k.alias("event_id"),
    )


QA_SQL = """
    cells AS (
        SELECT event_type AS scene, event_id % 64 AS qrow, (event_id // 64) % 64 AS qcol, CAST(floor(coalesce(value, 0)) % 64 AS INTEGER) AS qa,
               CAST(799474 + (event_id % 440) * 10 AS DOUBLE) / 10000 AS lon, CAST(128005 + ((event_id * 37) % 430) * 10 AS DOUBLE) / 10000 AS lat, event_id
        FROM events)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from orders: l2 scenes are the finished ones."""
    o = read(spark, sf_dir, "orders")
    at = place(F.col("o_orderkey"))
    base = F.concat(F.lit("/"), "o_orderkey", F.lit("/"))
    names = F.when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, ("red", "nir08", "swir16", "qa_pixel")))).otherwise(F.array(*map(F.lit, ("red", "nir08", "swir16", "lwir11", "qa_pixel", "B10", "B11"))))
    return o.select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("scene_id"),
        F.when(F.col("o_orderstatus") == "F", "l2").otherwise("toa").alias("collection"),
        F.col("o_orderdate").cast("timestamp").alias("acquired"),
        F.concat(F.lit("landsat-"), (8 + F.col("o_custkey") % 2).cast("string")).alias("platform"),
        (F.col("o_custkey") % 40).cast("double").alias("cloud_cover"),
        (F.col("o_custkey") % 5).cast("int").alias("wrs_path"),
        F.length("o_orderpriority").cast("int").alias("wrs_row"),
        F.array(at["lon"] - 0.01, at["lat"] - 0.01, at["lon"] + 0.01, at["lat"] + 0.01).alias("bbox"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.concat(base, n))).alias("assets"),
    )


CATALOG_SQL = """
    catalog AS (
        SELECT 'S' || o_orderkey AS scene_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'l2' ELSE 'toa' END AS collection, o_orderdate AS acquired,
               'landsat-' || (8 + o_custkey % 2) AS platform, CAST(o_custkey % 40 AS DOUBLE) AS cloud_cover, CAST(o_custkey % 5 AS INTEGER) AS wrs_path,
               CAST(length(o_orderpriority) AS INTEGER) AS wrs_row, CAST(799474 + (o_orderkey % 440) * 10 AS DOUBLE) / 10000 AS lon,
               CAST(128005 + ((o_orderkey * 37) % 430) * 10 AS DOUBLE) / 10000 AS lat, o_orderkey % 3 <> 0 AS thermal
        FROM orders)"""

"""The registered queries of the library's own operators, each beside the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.functions import geometry, indices, reproject, thermal
from landheat.ml import train as ml
from landheat.operators import analysis, encode, filters, matrix, pivot, quality, report, sample, spatial, split
from landheat.plans import tables as t
from landheat.sources import osm, pixels, scenes, vector, zones as zone_files
from landheat.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, places: int = 4):
    return indices.rounded(F.col(name), places).alias(name)


PIXEL = "tile_id, lat, lon, timestamp, lulc_class"
PIXEL_KEYS = ["tile_id", "lat", "lon", "timestamp", "lulc_class"]
r4 = t.r4


# --- pixels -------------------------------------------------------------------------------------------------------


@query(f"WITH {t.WIDE_SQL} SELECT year, lulc_class, {r4('avg(ndvi)')} AS mean_ndvi, count(*) AS n FROM wide GROUP BY year, lulc_class")
def mean_ndvi(spark, sf_dir):
    """Mean vegetation index by year and class."""
    rows = t.wide(spark, sf_dir).groupBy("year", "lulc_class").agg(F.avg("ndvi").alias("mean_ndvi"), F.count(F.lit(1)).alias("n"))
    return rows.select("year", "lulc_class", _r("mean_ndvi"), "n")


@query(f"WITH {t.WIDE_SQL} SELECT {PIXEL}, {', '.join(t.LINE_BANDS)}, year, {r4('ndvi')} AS ndvi, {r4('ndbi')} AS ndbi FROM wide")
def band_pivot(spark, sf_dir):
    """One row per pixel with a column per band."""
    return t.wide(spark, sf_dir).select(*PIXEL_KEYS, *t.LINE_BANDS, "year", _r("ndvi"), _r("ndbi"))


@query(f"WITH {t.PIXELS_SQL} SELECT tile_id, lat, lon, timestamp, {', '.join(f'''min(value) FILTER (band = '{b}') AS {b}''' for b in t.LINE_BANDS)} FROM pixels GROUP BY tile_id, lat, lon, timestamp")
def band_pivot_without_class(spark, sf_dir):
    """The pivot without the class in its key."""
    return pivot.pivot_bands(t.pixels(spark, sf_dir), t.LINE_BANDS, ["tile_id", "lat", "lon", "timestamp"])


@query(f"WITH {t.PIXELS_SQL} SELECT band, count(*) AS n, {r4('sum(value)', 2)} AS total FROM pixels WHERE {t.IN_BOX_SQL} GROUP BY band")
def bbox_filter(spark, sf_dir):
    """B1: pixels in the box, by band."""
    rows = t.pixels(spark, sf_dir).filter(filters.in_bbox(t.BOX)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("band", "n", _r("total", 2))


@query(f"WITH {t.PIXELS_SQL} SELECT DISTINCT band FROM pixels")
def distinct_bands(spark, sf_dir):
    """The bands that occur."""
    return report.distinct_values(t.pixels(spark, sf_dir), "band")


@query(
    f"""WITH {t.PIXELS_SQL} SELECT count(*) AS rows, min(epoch_ms(timestamp)) AS first_ms, max(epoch_ms(timestamp)) AS last_ms,
        count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad_values, count(*) > 1000 AS enough,
        coalesce(min(epoch_ms(timestamp)) > 1600000000000, false) AS recent, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) = 0 AS clean FROM pixels"""
)
def pixel_read_check(spark, sf_dir):
    """A5: what a read of the pixel table must hold."""
    return pixels.read_check(t.pixels(spark, sf_dir))


@query(f"WITH {t.PIXELS_SQL} SELECT * FROM pixels ORDER BY timestamp DESC, tile_id, lat, lon, band, value LIMIT 5000")
def latest_pixels(spark, sf_dir):
    """the last rows by time."""
    return report.latest(t.pixels(spark, sf_dir), 5000, ties=("tile_id", "lat", "lon", "band", "value"))


@query(f"WITH {t.PIXELS_SQL} SELECT * FROM pixels ORDER BY tile_id, lat, lon, timestamp, band, value LIMIT 5")
def first_pixels(spark, sf_dir):
    """a spot check in a fixed order."""
    return report.first_rows(t.pixels(spark, sf_dir), ["tile_id", "lat", "lon", "timestamp", "band", "value"])


# --- zones --------------------------------------------------------------------------------------------------------


@query(f"WITH {t.ZONED_SQL} SELECT {PIXEL}, zone_id, zoning_category FROM zoned")
def zone_join(spark, sf_dir):
    """Each pixel with the zone that holds it."""
    return t.zoned(spark, sf_dir).select(*PIXEL_KEYS, "zone_id", "zoning_category")


@query(f"WITH {t.ZONED_SQL} SELECT zoning_category, count(*) AS n FROM zoned GROUP BY zoning_category")
def zone_distribution(spark, sf_dir):
    """D3, F1: pixels by category, rarest first."""
    return report.zone_distribution(t.zoned(spark, sf_dir))


@query(f"WITH {t.ZONED_SQL} SELECT count(*) AS rows, count(zoning_category) AS inside, count(*) - count(zoning_category) AS outside, {r4('count(zoning_category) * 100.0::DOUBLE / count(*)')} AS coverage_percent FROM zoned")
def zone_coverage(spark, sf_dir):
    """Pixels inside and outside all zones."""
    return report.coverage(t.zoned(spark, sf_dir)).select("rows", "inside", "outside", _r("coverage_percent"))


_KM2 = geometry.KM2_PER_DEGREE2


@query(
    f"""WITH {t.ZONES_SQL}, sized AS (
            SELECT zoning_category, CASE shape WHEN 0 THEN (x1 - x0) * (y1 - 0.00037 - y0) / 2 WHEN 1 THEN (x1 - x0) * (y1 - y0) - (hx1 - hx0) * (hy1 - hy0) ELSE (x1 - x0) * (y1 - y0) END * {_KM2}::DOUBLE AS area FROM zones)
        SELECT zoning_category, count(*) AS n, {r4('sum(area)')} AS area_km2, {r4(f'sum(area) * 100 / {geometry.bbox_km2(t.BOX)}::DOUBLE')} AS percent_of_bbox FROM sized GROUP BY zoning_category"""
)
def zone_areas(spark, sf_dir):
    """Areas by category."""
    return spatial.area_stats(t.zones(spark, sf_dir), t.BOX).select("zoning_category", "n", _r("area_km2"), _r("percent_of_bbox"))


@query(
    f"""WITH {t.ZONES_SQL}, points AS (
            SELECT c_name AS name, CAST(799474 + (c_custkey % 440) * 10 AS DOUBLE) / 10000 AS lon, CAST(128005 + ((c_custkey * 37) % 430) * 10 AS DOUBLE) / 10000 AS lat,
                   CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'water' WHEN 2 THEN 'green' ELSE 'residential' END AS expected FROM customer),
        found AS (SELECT name, lon, lat, expected, arg_min(zoning_category, zone_id) AS found FROM points LEFT JOIN zones ON {t.INSIDE_SQL} GROUP BY ALL)
        SELECT *, CASE WHEN expected IS NULL THEN 'info' WHEN found IS NULL THEN 'coverage_gap' WHEN found = expected THEN 'match' ELSE 'mismatch' END AS status FROM found"""
)
def check_points(spark, sf_dir):
    """Control points (customers) against the zones."""
    c = t.read(spark, sf_dir, "customer")
    at = t.place(F.col("c_custkey"))
    want = F.get(F.array(F.lit(None), F.lit("water"), F.lit("green"), F.lit("residential")), F.col("c_nationkey") % 4)
    return spatial.check_points(c.select(F.col("c_name").alias("name"), at["lon"].alias("lon"), at["lat"].alias("lat"), want.alias("expected")), t.zones(spark, sf_dir))


def _part_zones(spark, sf_dir):
    """Rectangles around places of parts; some lie over the box's edge, some are tiny or large, some are alike."""
    p = t.read(spark, sf_dir, "part")
    at = t.place(F.col("p_partkey") % 900)
    w, h = F.col("p_size") / 1000.0, (F.col("p_partkey") % 7 + 1) / 1000.0
    x0, y0 = at["lon"], at["lat"]
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    open_ring = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h))
    category = F.get(F.array(*map(F.lit, t.CATEGORIES)), F.col("p_partkey") % 5)
    return p.select(F.col("p_partkey").alias("zone_id"), category.alias("zoning_category"), F.array(F.array(open_ring)).alias("polygons"))


_PART_SQL = f"""
    parts AS (
        SELECT p_partkey AS zone_id, p_partkey % 5 AS c, CAST(799474 + ((p_partkey % 900) % 440) * 10 AS DOUBLE) / 10000 AS x0,
               CAST(128005 + (((p_partkey % 900) * 37) % 430) * 10 AS DOUBLE) / 10000 AS y0, p_size / 1000.0::DOUBLE AS w, (p_partkey % 7 + 1) / 1000.0::DOUBLE AS h FROM part),
    cut AS (SELECT *, least(x0 + w, {t.BOX[2]}) - greatest(x0, {t.BOX[0]}) AS cw, least(y0 + h, {t.BOX[3]}) - greatest(y0, {t.BOX[1]}) AS ch FROM parts),
    judged AS (SELECT *, CASE WHEN cw <= 0 OR ch <= 0 THEN 'empty' WHEN cw * ch < {geometry.LEAST_AREA}::DOUBLE THEN 'degenerate' WHEN cw * ch * {_KM2}::DOUBLE > {geometry.MOST_AREA_KM2} THEN 'oversized' ELSE 'kept' END AS reason FROM cut)"""


@query(f"WITH {_PART_SQL} SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def clip_reasons(spark, sf_dir):
    """Zones cut to the box, by what becomes of them."""
    return spatial.reason_counts(spatial.clipped_zones(_part_zones(spark, sf_dir), t.BOX))


@query(f"WITH {_PART_SQL} SELECT zone_id, {r4('CASE WHEN cw > 0 AND ch > 0 THEN cw * ch ELSE 0 END * 1e6', 3)} AS area FROM judged")
def clip_areas(spark, sf_dir):
    """What is left of each zone's area, in millionths of a square degree."""
    cut = spatial.clipped_zones(_part_zones(spark, sf_dir), t.BOX)
    area = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + geometry.polygon_area(p)) * 1e6
    return cut.groupBy("zone_id").agg(F.sum(area).alias("area")).select("zone_id", _r("area", 3))


@query(f"WITH {_PART_SQL}, k AS (SELECT CASE c {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(t.CATEGORIES))} END AS zoning_category, x0, y0, w, h FROM parts) SELECT zoning_category, count(DISTINCT (x0, y0, w, h)) AS n FROM k GROUP BY zoning_category")
def distinct_zones(spark, sf_dir):
    """Zones without repeats, by category."""
    return spatial.dedup_zones(_part_zones(spark, sf_dir)).groupBy("zoning_category").agg(F.count(F.lit(1)).alias("n"))


# --- temperature --------------------------------------------------------------------------------------------------

_TEMPERATURES = ["pv", "eps10", "eps11", "bt10", "bt11", "bt10_minus_bt11", "lst"]


def _tempered_select(rows):
    return rows.select(*PIXEL_KEYS, *(_r(c) for c in _TEMPERATURES), "has_thermal_split")


@query(f"WITH {t.TEMPERED_SQL} SELECT {PIXEL}, {', '.join(f'{r4(c)} AS {c}' for c in _TEMPERATURES[:-1])}, {r4('sw')} AS lst, true AS has_thermal_split FROM windowed")
def surface_temperature(spark, sf_dir):
    """Split-window temperature wherever both thermal bands are columns."""
    return _tempered_select(t.tempered(spark, sf_dir))


@query(f"WITH {t.TEMPERED_SQL} SELECT {PIXEL}, {', '.join(f'{r4(c)} AS {c}' for c in _TEMPERATURES[:-1])}, {r4('coalesce(sw, bt10)')} AS lst, sw IS NOT NULL AS has_thermal_split FROM windowed")
def surface_temperature_by_row(spark, sf_dir):
    """H10, mode "row": each row takes the first source that it has."""
    return _tempered_select(t.tempered(spark, sf_dir, "row"))


@query(f"WITH {t.TEMPERED_SQL} SELECT sw IS NOT NULL AS has_thermal_split, count(*) AS n FROM windowed GROUP BY 1")
def thermal_split_distribution(spark, sf_dir):
    """Rows by whether the split window gave their temperature."""
    return report.flag_distribution(t.tempered(spark, sf_dir, "row"))


_SHARE = f"greatest(0, least(1, (ndvi - {t.CFG.ndvi_soil}) / ({t.CFG.ndvi_veg}::DOUBLE - {t.CFG.ndvi_soil}::DOUBLE)))"


@query(
    f"""WITH {t.TEMPERED_SQL} SELECT {PIXEL}, {r4(f'bt10 / pow(0.004::DOUBLE * {_SHARE} + 0.986::DOUBLE, 0.25)')} AS quick,
        {r4(f'bt10 / (1 + ({thermal.WAVELENGTH}::DOUBLE * bt10 / {thermal.RHO}::DOUBLE) * ln(eps10))')} AS documented, {r4('bt10 - 273.15')} AS celsius FROM windowed WHERE bt10 IS NOT NULL AND ndvi IS NOT NULL"""
)
def single_channel(spark, sf_dir):
    """Temperatures from one thermal band."""
    rows = t.tempered(spark, sf_dir).filter("bt10 is not null and ndvi is not null")
    quick, documented = thermal.quick_single_channel(F.col("bt10"), F.col("ndvi"), t.CFG), thermal.single_channel(F.col("bt10"), F.col("eps10"))
    return rows.select(*PIXEL_KEYS, indices.rounded(quick, 4).alias("quick"), indices.rounded(documented, 4).alias("documented"), indices.rounded(indices.celsius(F.col("bt10")), 4).alias("celsius"))


# --- encoding and matrix ------------------------------------------------------------------------------------------


def _by_row(spark, sf_dir):
    return t.tempered(spark, sf_dir, "row")


_ENC = "(n * mean + 10 * overall) / (n + 10)"
_STATS_SQL = f"""{t.TEMPERED_SQL}, rows AS (SELECT *, coalesce(sw, bt10) AS lst FROM windowed), g AS (SELECT avg(lst) AS overall FROM rows),
    zc AS (SELECT zoning_category, avg(lst) AS mean, count(lst) AS n FROM rows GROUP BY 1), lc AS (SELECT lulc_class, avg(lst) AS mean, count(lst) AS n FROM rows GROUP BY 1),
    ze AS (SELECT zoning_category, {_ENC} AS zoning_category_encoded FROM zc, g), le AS (SELECT lulc_class, {_ENC} AS lulc_class_encoded FROM lc, g)"""


@query(f"WITH {_STATS_SQL} SELECT DISTINCT lulc_class, zoning_category, {r4('lulc_class_encoded')} AS lulc_class_encoded, {r4('zoning_category_encoded')} AS zoning_category_encoded FROM rows JOIN ze USING (zoning_category) JOIN le USING (lulc_class)")
def target_encoding(spark, sf_dir):
    """Smoothed mean temperature of each class and zone category."""
    rows = encode.encode(_by_row(spark, sf_dir), "lst", ["lulc_class", "zoning_category", "lulc_class"])
    return rows.select("lulc_class", "zoning_category", _r("lulc_class_encoded"), _r("zoning_category_encoded")).distinct()


@query(
    f"""WITH {t.TEMPERED_SQL}, rows AS (SELECT *, coalesce(sw, bt10) AS lst, CAST(CAST(round(lat * 10000) AS BIGINT) // 10 % 5 AS INTEGER) AS fold FROM windowed),
        folds AS (SELECT DISTINCT fold FROM rows), g AS (SELECT folds.fold, avg(lst) AS overall FROM folds JOIN rows ON folds.fold <> rows.fold GROUP BY 1),
        s AS (SELECT folds.fold, zoning_category, avg(lst) AS mean, count(lst) AS n FROM folds JOIN rows ON folds.fold <> rows.fold GROUP BY 1, 2)
        SELECT DISTINCT rows.zoning_category, rows.fold, {r4('(coalesce(n, 0) * coalesce(mean, overall) + 10 * overall) / (coalesce(n, 0) + 10)')} AS zoning_category_encoded
        FROM rows JOIN g ON rows.fold = g.fold LEFT JOIN s ON rows.fold = s.fold AND rows.zoning_category = s.zoning_category"""
)
def folded_encoding(spark, sf_dir):
    """Out-of-fold encoding in one pass; the SQL makes a pass per fold."""
    fold = (F.floor(F.round(F.col("lat") * 10000) / 10) % 5).cast("int")
    rows = encode.encode_folded(_by_row(spark, sf_dir), "lst", ["zoning_category"], ["tile_id"], 5, fold=fold)
    return rows.select("zoning_category", fold.alias("fold"), _r("zoning_category_encoded")).distinct()


_MATRIX_NUMBERS = ["ndvi", "ndbi", *t.LINE_BANDS, *_TEMPERATURES[:-1]]
_MATRIX_SQL = f"""{_STATS_SQL}, matrix AS (
        SELECT tile_id, {r4('lat')} AS lat, {r4('lon')} AS lon, year, CAST(dayofyear(timestamp) AS INTEGER) AS doy, {r4('lulc_class_encoded')} AS lulc_class_encoded,
               {r4('zoning_category_encoded')} AS zoning_category_encoded, {', '.join(f'{r4(c)} AS {c}' for c in _MATRIX_NUMBERS)}, {r4('lst')} AS lst, sw IS NOT NULL AS has_thermal_split,
               CASE WHEN year BETWEEN {t.CFG.train_start} AND {t.CFG.train_end} THEN 'train' WHEN year BETWEEN {t.CFG.test_start} AND {t.CFG.test_end} THEN 'test' ELSE 'ignore' END AS split
        FROM rows JOIN ze USING (zoning_category) JOIN le USING (lulc_class))"""


def _matrix(spark, sf_dir):
    return matrix.assemble(encode.encode(_by_row(spark, sf_dir), "lst", ["lulc_class", "zoning_category"]), t.CFG)


def _stored_matrix(spark, sf_dir):
    """The matrix as a table on storage, for operators that read it more than once."""
    return written(_matrix(spark, sf_dir), "matrix")


@query(f"WITH {_MATRIX_SQL} SELECT * FROM matrix WHERE split <> 'ignore' AND lst IS NOT NULL")
def matrix_build(spark, sf_dir):
    """The dense feature matrix."""
    return _matrix(spark, sf_dir)


_KEPT = f"WITH {_MATRIX_SQL}, kept AS (SELECT * FROM matrix WHERE split <> 'ignore' AND lst IS NOT NULL)"


@query(f"{_KEPT} SELECT year, split, count(*) AS n FROM kept GROUP BY year, split UNION ALL SELECT NULL, NULL, count(*) FROM kept")
def partition_counts(spark, sf_dir):
    """Rows by year and split, and their total."""
    return report.partition_counts(_matrix(spark, sf_dir))


@query(
    f"""{_KEPT}, u AS (UNPIVOT (SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(ndvi AS DOUBLE) AS ndvi, CAST(lst AS DOUBLE) AS lst FROM kept) ON COLUMNS(*) INTO NAME "column" VALUE v)
        SELECT "column", 'double' AS kind, (SELECT count(*) FROM kept) AS rows, (SELECT count(*) FROM kept) - count(v) AS nulls, min(v) AS least, max(v) AS most,
               CASE "column" WHEN 'lst' THEN count(*) FILTER (v NOT BETWEEN 250 AND 360) = 0 WHEN 'ndvi' THEN count(*) FILTER (v NOT BETWEEN -1 AND 1) = 0 END AS in_range
        FROM u GROUP BY "column" """
)
def matrix_expectations(spark, sf_dir):
    """Nulls and ranges of the matrix."""
    rows = filters.require_columns(_matrix(spark, sf_dir)).select("lat", "lon", "ndvi", "lst")
    return filters.expectations(rows, {"lst": (250.0, 360.0), "ndvi": (-1.0, 1.0)})


def _ranks(rate: float) -> str:
    step = sample.grid_step(rate)
    return f"ranked AS (SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY lon) AS rx, dense_rank() OVER (PARTITION BY year ORDER BY lat) AS ry FROM kept) SELECT year, lon, lat, count(*) AS n FROM ranked WHERE rx % {step} = 0 AND ry % {step} = 0 GROUP BY year, lon, lat"


@query(f"{_KEPT}, {_ranks(0.1)}")
def grid_sample(spark, sf_dir):
    """The systematic grid sample."""
    return sample.load(_stored_matrix(spark, sf_dir), False, "systematic-grid", 0.1).groupBy("year", "lon", "lat").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_KEPT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY year, zoning_category_encoded ORDER BY lon, lat, tile_id) AS r FROM kept) SELECT year, zoning_category_encoded, lon, lat, tile_id FROM ranked WHERE r % 5 = 0")
def stratified_sample(spark, sf_dir):
    """Every fifth row of each year and zone category."""
    return sample.load(_stored_matrix(spark, sf_dir), False, "stratified-zoning", 0.2).select("year", "zoning_category_encoded", "lon", "lat", "tile_id")


@query(f"{_KEPT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY year, zoning_category_encoded ORDER BY lon, lat, tile_id) AS r FROM kept) SELECT count(*) AS before, count(*) FILTER (r % 5 = 0) AS after, coalesce(count(*) FILTER (r % 5 = 0) / count(*)::DOUBLE, 0) AS achieved FROM ranked")
def sampling_report(spark, sf_dir):
    """What the stratified sample keeps."""
    rows = _stored_matrix(spark, sf_dir)
    return sample.sampling_report(rows, sample.sample(rows, "stratified-zoning", 0.2))


@query(f"{_KEPT} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, 0::BIGINT AS dropped FROM kept")
def split_counts(spark, sf_dir):
    """Rows by split mark."""
    return split.split_counts(split.temporal_split(_matrix(spark, sf_dir)))


@query(f"WITH {t.WIDE_SQL}, s AS (SELECT *, CASE WHEN year BETWEEN 1995 AND 1999 THEN 'train' WHEN year BETWEEN 2000 AND 2001 THEN 'test' END AS split FROM wide), l AS (SELECT max(year) AS y FROM s WHERE split = 'train') SELECT split, split = 'train' AND year = y AS is_val, count(*) AS n FROM s, l WHERE split IS NOT NULL GROUP BY 1, 2")
def year_split(spark, sf_dir):
    """Years as the split where there is no mark, and the last train year as validation."""
    rows = split.with_validation(split.temporal_split(t.wide(spark, sf_dir), train=(1995, 1999), test=(2000, 2001)), PIXEL_KEYS, by="year")
    return rows.groupBy("split", "is_val").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {t.WIDE_SQL} SELECT DISTINCT CAST(dayofyear(timestamp) AS INTEGER) AS doy, coalesce(nullif({r4('sin(dayofyear(timestamp) * (2 * pi() / 366))')}, 0), 0) AS season_sin, {r4('cos(dayofyear(timestamp) * (2 * pi() / 366))')} AS season_cos FROM wide")
def seasonal_features(spark, sf_dir):
    """The day of the year on a circle."""
    rows = ml.with_season(t.wide(spark, sf_dir).withColumn("doy", F.dayofyear("timestamp")))
    return rows.select("doy", _r("season_sin"), _r("season_cos")).distinct()


@query("WITH s AS (SELECT 'LC08_L2SP_142051_' || strftime(o_orderdate, '%Y%m%d') || '_02' AS scene, o_orderdate FROM orders) SELECT scene, CAST(dayofyear(any_value(o_orderdate)) AS INTEGER) AS doy, count(*) AS n FROM s GROUP BY scene")
def doy_from_scene_id(spark, sf_dir):
    """H5: the day of the year in a scene's name."""
    o = t.read(spark, sf_dir, "orders").select(F.concat(F.lit("LC08_L2SP_142051_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_02")).alias("scene"))
    return o.select("scene", indices.doy_from_scene_id("scene").alias("doy")).groupBy("scene", "doy").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH u AS (SELECT sum(l_extendedprice) / sum(l_quantity) AS unit FROM lineitem), p AS (SELECT l_extendedprice AS y, l_quantity * {r4('unit')} AS pred FROM lineitem, u)
        SELECT {r4('avg(abs(y - pred))', 2)} AS mae, {r4('sqrt(avg((y - pred) * (y - pred)))', 2)} AS rmse, {r4('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))')} AS r2, {r4('100 * avg(abs((y - pred) / y)) FILTER (y <> 0)', 2)} AS mape FROM p"""
)
def regression_metrics(spark, sf_dir):
    """Errors of a price guessed from the mean unit price."""
    lines = t.read(spark, sf_dir, "lineitem")
    unit = lines.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit")).select(_r("unit"))
    found = report.regression_metrics(lines.join(F.broadcast(unit)), "l_extendedprice", F.col("l_quantity") * F.col("unit"))
    return found.select(_r("mae", 2), _r("rmse", 2), _r("r2"), _r("mape", 2))


@query(f"{_KEPT}, b AS (SELECT lst AS y, bt10 AS pred FROM kept WHERE split = 'test' AND bt10 IS NOT NULL) SELECT {r4('avg(abs(y - pred))')} AS mae, {r4('sqrt(avg((y - pred) * (y - pred)))')} AS rmse, {r4('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y))')} AS r2, {r4('100 * avg(abs((y - pred) / y))')} AS mape FROM b")
def single_band_baseline(spark, sf_dir):
    """One band's temperature as a predictor, on the test rows."""
    return ml.baseline(_matrix(spark, sf_dir), single="bt10").select(_r("mae"), _r("rmse"), _r("r2"), _r("mape"))


@query()
def train_and_evaluate(spark, sf_dir):
    """A model of the matrix with all features, and its errors on the test rows."""
    rows = ml.with_season(_stored_matrix(spark, sf_dir))
    model = ml.fit(split.with_validation(rows, ["tile_id", "lat", "lon", "year", "doy"]), ml.feature_names(rows), ml.TrainConfig())
    return ml.evaluation(model, rows)


# --- analysis -----------------------------------------------------------------------------------------------------

def _grid_sql(size: int) -> str:
    """Cells and grid of `size` x `size` over the box."""
    cell = lambda v, a, b: f"least(floor(({v} - {a}) / (({b}::DOUBLE - {a}::DOUBLE) / {size})), {size - 1})::BIGINT"
    return f"WITH {_STATS_SQL}, cells AS (SELECT year, {cell('lon', t.BOX[0], t.BOX[2])} AS ix, {cell('lat', t.BOX[1], t.BOX[3])} AS iy, lst AS v FROM rows WHERE lst IS NOT NULL), grid AS (SELECT year, ix, iy, avg(v) AS mean, count(v) AS n FROM cells GROUP BY GROUPING SETS ((year, ix, iy), (ix, iy)))"


_GRID_N, _FINE_N = 25, 250
_GRID_MEANS = f"SELECT year, ix, iy, {r4('mean')} AS mean, n FROM grid"
_SMOOTHED = f"SELECT a.year, a.ix, a.iy, {r4('sum(b.mean * b.n) / sum(b.n)')} AS mean FROM grid a JOIN grid b ON a.year IS NOT DISTINCT FROM b.year AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY a.year, a.ix, a.iy"


@query(f"{_grid_sql(_GRID_N)} {_GRID_MEANS}")
def gridded_mean(spark, sf_dir):
    """Mean temperature on a coarse grid, by year and over all years."""
    return analysis.gridded_mean(_by_row(spark, sf_dir), "lst", t.BOX, _GRID_N).select("year", "ix", "iy", _r("mean"), "n")


@query(f"{_grid_sql(_GRID_N)} {_SMOOTHED}")
def smoothed_grid(spark, sf_dir):
    """The coarse grid averaged over neighbours."""
    return analysis.smoothed_grid(analysis.gridded_mean(_by_row(spark, sf_dir), "lst", t.BOX, _GRID_N)).select("year", "ix", "iy", _r("mean"))


@query(f"{_grid_sql(_FINE_N)} {_GRID_MEANS}")
def gridded_mean_fine(spark, sf_dir):
    """Mean temperature on the operator's own 250 x 250 cells, by year and over all years."""
    return analysis.gridded_mean(_by_row(spark, sf_dir), "lst", t.BOX).select("year", "ix", "iy", _r("mean"), "n")


@query(f"{_grid_sql(_FINE_N)} {_SMOOTHED}")
def smoothed_grid_fine(spark, sf_dir):
    """The grid of 250 x 250 cells averaged over neighbours."""
    return analysis.smoothed_grid(analysis.gridded_mean(_by_row(spark, sf_dir), "lst", t.BOX)).select("year", "ix", "iy", _r("mean"))


@query(
    f"""{_KEPT}, p AS (SELECT ndvi AS x, lst AS y, zoning_category_encoded AS v FROM kept WHERE ndvi IS NOT NULL), s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
        q AS (SELECT v, (x - x0) * 30 / (x1 - x0) AS a, (y - y0) * 17 / (y1 - y0) AS b FROM p, s),
        w AS (SELECT v, a, b, pow(a - floor(a + 0.5), 2) + 3.0 * pow(b - floor(b + 0.5), 2) < pow(a - floor(a) - 0.5, 2) + 3.0 * pow(b - floor(b) - 0.5, 2) AS one FROM q)
        SELECT CAST(CASE WHEN one THEN floor(a + 0.5) ELSE floor(a) END AS BIGINT) AS hx, CAST(CASE WHEN one THEN floor(b + 0.5) ELSE floor(b) END AS BIGINT) AS hy, CASE WHEN one THEN 1 ELSE 2 END AS lattice, count(*) AS n, {r4('avg(v)')} AS mean
        FROM w GROUP BY 1, 2, 3"""
)
def hexbin(spark, sf_dir):
    """Temperature over vegetation in hexagons."""
    return analysis.hexbin(_stored_matrix(spark, sf_dir), "ndvi", "lst", "zoning_category_encoded").select("hx", "hy", "lattice", "n", _r("mean"))


@query(f"{_KEPT} SELECT {r4('corr(ndvi, lst)')} AS r, count(*) AS n FROM kept WHERE ndvi IS NOT NULL AND lst IS NOT NULL")
def vegetation_correlation(spark, sf_dir):
    """Correlation of vegetation and temperature."""
    return analysis.pearson(_matrix(spark, sf_dir), "ndvi", "lst").select(_r("r"), "n")


@query(f"{_KEPT} SELECT year, CASE WHEN count(lst) >= 2 THEN {r4('avg(lst)')} END AS mean, count(lst) AS n FROM kept GROUP BY year")
def yearly_trend(spark, sf_dir):
    """Mean temperature by year."""
    return analysis.yearly_trend(_matrix(spark, sf_dir), "lst").select("year", _r("mean"), "n")


@query(f"{_KEPT} SELECT lat, lon, {r4('avg(bt10)')} AS bt10, {r4('avg(bt11)')} AS bt11, {r4('avg(bt10 - bt11)')} AS difference FROM kept WHERE year BETWEEN 1996 AND 2000 GROUP BY lat, lon")
def composite(spark, sf_dir):
    """Means per pixel over several years."""
    return analysis.composite(_matrix(spark, sf_dir), (1996, 2000)).select("lat", "lon", _r("bt10"), _r("bt11"), _r("difference"))


# --- quality bands and rasters ------------------------------------------------------------------------------------

_CLEAR = "qa >= 0 AND (qa & 31) = 0"
_CLOUD_SQL = f"WITH {t.QA_SQL}, c AS (SELECT scene, count(*) FILTER (qa <> 0 AND {t.IN_BOX_SQL}) AS total, count(*) FILTER (qa <> 0 AND {_CLEAR} AND {t.IN_BOX_SQL}) AS clear FROM cells GROUP BY scene), p AS (SELECT *, CASE WHEN total = 0 THEN -1 ELSE (total - clear) * 100.0::DOUBLE / total END AS cloud_percent FROM c)"


@query(f"{_CLOUD_SQL} SELECT scene, total, clear, {r4('cloud_percent')} AS cloud_percent, NOT (cloud_percent > 95 AND cloud_percent >= 0) AS accepted FROM p")
def cloud_gate(spark, sf_dir):
    """Cloud shares of scenes, and which the gate accepts."""
    clouds = quality.aoi_cloud(t.qa_cells(spark, sf_dir), t.BOX)
    return quality.gated(clouds.drop("cloud_percent"), clouds, 95.0).select("scene", "total", "clear", _r("cloud_percent"), "accepted")


@query(
    f"""WITH {t.QA_SQL}, q AS (SELECT scene, qrow, qcol, max(qa) AS qa FROM cells GROUP BY ALL),
        px AS (SELECT event_type AS scene, event_id % 128 AS row, (event_id // 128) % 96 AS col, event_id FROM events),
        j AS (SELECT px.*, qa FROM px LEFT JOIN q ON px.scene = q.scene AND px.row * 64 // 128 = qrow AND px.col * 64 // 96 = qcol)
        SELECT scene, count(*) AS n, count(qa) AS judged, sum(event_id)::BIGINT AS ids FROM j WHERE qa IS NULL OR ({_CLEAR}) GROUP BY scene"""
)
def clear_pixels(spark, sf_dir):
    """Pixels by the quality of their nearest cell."""
    k = F.col("event_id")
    px = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("scene"), (k % 128).alias("row"), (F.floor(k / 128) % 96).alias("col"), F.lit(128).alias("height"), F.lit(96).alias("width"), "event_id")
    cells = t.qa_cells(spark, sf_dir).groupBy("scene", "qrow", "qcol", "qheight", "qwidth").agg(F.max("qa").alias("qa"))
    kept = quality.clear_pixels(quality.join_qa(px, cells))
    return kept.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.count("qa").alias("judged"), F.sum("event_id").alias("ids"))


_KEYS = ["B2", "B4", "B10", "ST_B10", "X9"]


@query(
    f"""WITH s AS (SELECT list_value({', '.join(f"'{k}'" for k in _KEYS)})[event_id % 5 + 1] AS k, floor(coalesce(value, 0) * 100) AS dn FROM events),
        v AS (SELECT CASE k WHEN 'B2' THEN 'B2_Blue' WHEN 'B4' THEN 'B4_Red' WHEN 'B10' THEN 'B10_TIR' ELSE k END AS band,
                     CASE WHEN k IN ('B2', 'B4', 'B10') THEN dn * 0.0000275::DOUBLE + -0.1::DOUBLE WHEN k = 'ST_B10' THEN dn * 0.00341802::DOUBLE + 149.0 ELSE dn * 1.0 + 0.0 END AS value FROM s WHERE dn <> 0 AND NOT isnan(dn) AND NOT isinf(dn))
        SELECT band, count(*) AS n, {r4(f"sum({r4('value', 6)})", 2)} AS total FROM v GROUP BY band"""
)
def band_scaling(spark, sf_dir):
    """Stored numbers in the bands' units."""
    e = t.read(spark, sf_dir, "events")
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % 5).cast("int"))
    rows = filters.valid_numbers(e.select(key.alias("k"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("double").alias("dn")))
    rows = rows.select(indices.band_name(F.col("k")).alias("band"), indices.rounded(indices.scaled(F.col("dn"), F.col("k")), 6).alias("v"))
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).select("band", "n", _r("total", 2))


def _utm_sql() -> str:
    """The inverse projection as published, with its series written out; constants are the ellipsoid's."""
    e2 = reproject.FLATTENING * (2 - reproject.FLATTENING)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    a, k0 = reproject.SEMI_MAJOR, reproject.SCALE
    d = "::DOUBLE"
    waves = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    foot = " + ".join(["mu", *(f"{w}{d} * sin({2 * k + 2} * mu)" for k, w in enumerate(waves))])
    ep2 = f"{e2 / (1 - e2)}{d}"
    return f"""
        WITH p AS (SELECT event_id, 350000.0{d} + (event_id % 6000 + 0.5{d}) * 30 AS x, 1470000.0{d} - ((event_id * 7) % 6000 + 0.5{d}) * 30 AS y FROM events),
        m AS (SELECT *, y / {k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)}{d} AS mu FROM p), f AS (SELECT *, {foot} AS f FROM m),
        u AS (SELECT event_id, f, tan(f) AS tn, tan(f) ** 2 AS t, {ep2} * cos(f) ** 2 AS c, {a}{d} / sqrt(1 - {e2}{d} * sin(f) ** 2) AS n,
                     {a * (1 - e2)}{d} / pow(1 - {e2}{d} * sin(f) ** 2, 1.5) AS r, x FROM f),
        v AS (SELECT *, (x - {reproject.FALSE_EASTING}{d}) / (n * {k0}{d}) AS d FROM u),
        w AS (SELECT event_id,
                     degrees(f - n * tn / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * {ep2}) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * {ep2} - 3 * c ** 2) * d ** 6 / 720)) AS lat,
                     degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * {ep2} + 24 * t ** 2) * d ** 5 / 120) / cos(f)) + 43 * 6 - 177 AS lon FROM v)
        SELECT event_id, {r4('lat', 6)} AS lat, {r4('lon', 6)} AS lon FROM w"""


@query(_utm_sql())
def utm_to_lat_lon(spark, sf_dir):
    """Projected pixel centres in degrees (events as pixels of zone 44)."""
    k = F.col("event_id")
    rows = t.read(spark, sf_dir, "events").select(
        "event_id",
        indices.pixel_centre(F.lit(350000.0), F.lit(30.0), k % 6000).alias("x"),
        indices.pixel_centre(F.lit(1470000.0), F.lit(-30.0), (k * 7) % 6000).alias("y"),
        reproject.utm_zone(F.lit("WGS 84 / UTM zone 44N")).alias("utm_zone"),
    )
    return reproject.located(rows).select("event_id", _r("lat", 6), _r("lon", 6))


@query("SELECT CASE WHEN value IS NULL THEN 'failed' ELSE 'done' END AS status, count(DISTINCT user_id) AS scenes, count(*) AS bands, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS bytes FROM events GROUP BY 1")
def run_stats(spark, sf_dir):
    """What an ingestion run did (events as bands of users' scenes)."""
    e = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("scene"), F.when(F.col("value").isNull(), "failed").otherwise("done").alias("status"), F.length("props").alias("length"))
    return report.run_stats(e)


# --- catalog ------------------------------------------------------------------------------------------------------

_OVERLAP = f"lon - 0.01 <= {t.BOX[2]} AND lon + 0.01 >= {t.BOX[0]} AND lat - 0.01 <= {t.BOX[3]} AND lat + 0.01 >= {t.BOX[1]}"


@query(f"WITH {t.CATALOG_SQL} SELECT scene_id, wrs_path || '/' || wrs_row || '/' || strftime(acquired, '%Y-%m-%d') AS scene_key FROM catalog WHERE collection = 'l2' AND acquired BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31 23:59:59' AND cloud_cover < 10 AND thermal AND {_OVERLAP}")
def catalog_search(spark, sf_dir):
    """Scenes of a collection by time, place, cloud and assets."""
    cfg = t.Config(years=(1996, 1999))
    rows = t.catalog(spark, sf_dir).withColumn("assets", scenes.keyed_assets(F.col("assets")))
    found = scenes.with_required_assets(scenes.catalog_filter(rows, cfg, "l2"))
    return found.select("scene_id", scenes.scene_key().alias("scene_key"))


@query(
    f"""WITH {t.CATALOG_SQL}, l2 AS (SELECT wrs_path, wrs_row, CAST(acquired AS DATE) AS day, arg_max(o_orderkey, (acquired, scene_id)) AS o, arg_max(thermal, (acquired, scene_id)) AS has_st FROM catalog WHERE collection = 'l2' GROUP BY ALL)
        SELECT c.scene_id, l2.o AS l2_order, (CASE WHEN thermal THEN 4 ELSE 2 END + CASE WHEN has_st THEN 2 ELSE 1 END)::INTEGER AS assets FROM catalog c JOIN l2 ON c.wrs_path = l2.wrs_path AND c.wrs_row = l2.wrs_row AND CAST(c.acquired AS DATE) = l2.day WHERE collection = 'toa'"""
)
def scene_match(spark, sf_dir):
    """Scenes seen at both levels, with assets of each."""
    rows = t.catalog(spark, sf_dir).withColumn("assets", scenes.keyed_assets(F.col("assets")))
    found = scenes.match_scenes(rows.filter("collection = 'l2'"), rows.filter("collection = 'toa'"))
    order = F.split(F.try_element_at("assets", F.lit("QA_PIXEL")), "/")
    return found.select("scene_id", F.get(order, F.lit(1)).cast("long").alias("l2_order"), F.size("assets").alias("assets"))


@query(f"WITH {t.CATALOG_SQL} SELECT platform, count(*) AS n FROM catalog GROUP BY platform")
def platform_counts(spark, sf_dir):
    """Scenes by platform."""
    return scenes.platform_counts(t.catalog(spark, sf_dir))


@query(f"WITH {t.CATALOG_SQL}, b AS (SELECT scene_id, o_orderkey, unnest(['B4', 'ST_B10']) AS band, thermal FROM catalog) SELECT scene_id, band, 'https://host/' || o_orderkey || '/' || CASE band WHEN 'B4' THEN 'red' ELSE 'lwir11' END AS href FROM b WHERE band = 'B4' OR thermal")
def scene_bands(spark, sf_dir):
    """Links of the listed bands."""
    rows = t.catalog(spark, sf_dir).withColumn("assets", scenes.keyed_assets(F.col("assets")))
    return scenes.scene_bands(rows, ["B4", "ST_B10"]).select("scene_id", "band", scenes.resolve_url(F.col("href"), "https://host/").alias("href"))


@query(f"WITH {t.CATALOG_SQL} SELECT CAST(year(acquired) AS INTEGER) AS year, arg_min(scene_id, (acquired, scene_id)) AS scene_id, min(acquired) AS acquired FROM catalog WHERE cloud_cover < 20 GROUP BY 1")
def representative_scene(spark, sf_dir):
    """E5: the first clear scene of each year."""
    return analysis.representative_scene(t.catalog(spark, sf_dir))


@query("SELECT 'S' || o_orderkey AS scene_id, CASE WHEN o_orderkey % 2 = 0 THEN 700 + (o_orderkey % 50) ELSE 774.8853::DOUBLE END AS k1_constant_band_10, 1201.1442::DOUBLE AS k2_constant_band_11 FROM orders")
def thermal_constants(spark, sf_dir):
    """Constants from a scene's metadata, or the defaults."""
    k = F.col("o_orderkey")
    mtl = F.concat(F.lit('{"LANDSAT_METADATA_FILE": {"LEVEL1_THERMAL_CONSTANTS": {"K1_CONSTANT_BAND_10": "'), (700 + k % 50).cast("string"), F.lit('"}}}'))
    rows = t.read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), k).alias("scene_id"), F.when(k % 2 == 0, mtl).alias("mtl"))
    return scenes.with_constants(rows).select("scene_id", "k1_constant_band_10", "k2_constant_band_11")


# --- map elements and vectors -------------------------------------------------------------------------------------

_TAGS = [{"landuse": "residential"}, {"waterway": "river"}, {"leisure": "park", "landuse": "retail"}, {"landuse": "railway"}, {}, {"natural": "water"}, {"building": "yes"}]


def elements(spark, sf_dir):
    """Map elements: parts are nodes (some are unknown), an order's lines a way, customers' orders a relation."""
    part, lines, orders = (t.read(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    at = t.place(F.col("p_partkey"))
    cast = "map<string,string>"
    tags = F.array(*(F.create_map(*(F.lit(x) for kv in g.items() for x in kv)).cast(cast) if g else F.create_map().cast(cast) for g in _TAGS))
    members = "array<struct<type: string, ref: long, role: string>>"
    null = lambda kind: F.lit(None).cast(kind)
    nodes = part.filter("p_partkey % 50 != 0").select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), at["lon"].alias("lon"), at["lat"].alias("lat"), null(cast).alias("tags"), null("array<long>").alias("nodes"), null(members).alias("members"))
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    own = lines.groupBy("l_orderkey").agg(F.transform(order, lambda x: x.l_partkey).alias("n"))
    loop = F.when(F.col("l_orderkey") % 2 == 0, F.concat("n", F.slice("n", 1, 1))).otherwise(F.col("n"))
    tag = lambda k: F.get(tags, (k % len(_TAGS)).cast("int"))
    ways = own.select(F.lit("way").alias("type"), F.col("l_orderkey").alias("id"), null("double").alias("lon"), null("double").alias("lat"), tag(F.col("l_orderkey")).alias("tags"), loop.alias("nodes"), null(members).alias("members"))
    member = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 3 == 0, "inner").otherwise("outer").alias("role"))
    relations = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(member)).alias("m"))
    relations = relations.select(F.lit("relation").alias("type"), F.col("o_custkey").alias("id"), null("double").alias("lon"), null("double").alias("lat"), tag(F.col("o_custkey")).alias("tags"), null("array<long>").alias("nodes"), F.col("m").alias("members"))
    return nodes.unionByName(ways).unionByName(relations)


@query(
    """WITH w AS (
            SELECT l_orderkey AS id, l_orderkey % 7 AS tag, count(*) + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n, count(*) FILTER (l_partkey % 50 = 0) AS missing,
                   arg_min(l_partkey, (l_linenumber, l_partkey)) = arg_max(l_partkey, (l_linenumber, l_partkey)) OR l_orderkey % 2 = 0 AS looped
            FROM lineitem GROUP BY l_orderkey),
        k AS (SELECT *, CASE tag WHEN 0 THEN 'residential' WHEN 1 THEN 'water' WHEN 2 THEN 'green' WHEN 5 THEN 'water' END AS category FROM w WHERE tag <> 4),
        s AS (SELECT CASE WHEN category IS NULL THEN 'excluded' WHEN missing > 0 OR n < 4 THEN 'missing_nodes' WHEN tag = 1 AND NOT looped THEN 'open_waterway' ELSE 'kept' END AS status, coalesce(category, CASE tag WHEN 3 THEN 'railway' ELSE 'unknown' END) AS what FROM k)
        SELECT status, what, count(*) AS n FROM s GROUP BY status, what"""
)
def way_classes(spark, sf_dir):
    """What becomes of the ways."""
    rows = elements(spark, sf_dir)
    of = lambda kind: rows.filter(F.col("type") == kind)
    lines = osm.way_lines(of("way").select("id", "nodes"), of("node"))
    return osm.status_counts(osm.way_zones(of("way").select("id", "tags"), lines))


@query(
    """WITH w AS (SELECT l_orderkey AS id, count(*) + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n, count(*) FILTER (l_partkey % 50 = 0) AS missing,
                   arg_min(l_partkey, (l_linenumber, l_partkey)) = arg_max(l_partkey, (l_linenumber, l_partkey)) OR l_orderkey % 2 = 0 AS looped FROM lineitem GROUP BY l_orderkey),
        good AS (SELECT id FROM w WHERE missing = 0 AND n + CASE WHEN looped THEN 0 ELSE 1 END >= 4),
        r AS (SELECT o_custkey AS id, o_custkey % 7 AS tag, count(good.id) FILTER (o_orderkey % 3 <> 0) AS outers FROM orders LEFT JOIN good ON o_orderkey = good.id GROUP BY o_custkey),
        k AS (SELECT *, CASE tag WHEN 0 THEN 'residential' WHEN 1 THEN 'water' WHEN 2 THEN 'green' WHEN 5 THEN 'water' END AS category FROM r WHERE tag <> 4)
        SELECT id, category, CASE WHEN category IS NULL THEN 'excluded' WHEN outers > 0 THEN 'kept' ELSE 'missing_nodes' END AS status, CASE WHEN category IS NOT NULL AND outers > 0 THEN outers ELSE 0 END::BIGINT AS polygons FROM k"""
)
def relation_shapes(spark, sf_dir):
    """Relations as sets of polygons."""
    rows = elements(spark, sf_dir)
    of = lambda kind: rows.filter(F.col("type") == kind)
    lines = osm.way_lines(of("way").select("id", "nodes"), of("node"))
    found = osm.relation_zones(of("relation").select("id", "tags", "members"), lines)
    return found.select("id", "category", "status", F.coalesce(F.size("polygons"), F.lit(0)).cast("long").alias("polygons"))


@query()
def element_zones(spark, sf_dir):
    """Map elements as zones, repaired, cut to the box, and without repeats."""
    found = osm.as_zones(osm.element_zones(elements(spark, sf_dir)))
    kept = spatial.kept_zones(spatial.clipped_zones(found, t.BOX))
    return kept.groupBy("zoning_category").agg(F.count(F.lit(1)).alias("n"))


def _features(spark, sf_dir):
    """GeoJSON features of customers: points, pairs of points, squares and lines in turn."""
    c = t.read(spark, sf_dir, "customer")
    at = t.place(F.col("c_custkey"))
    p = lambda dx, dy: F.format_string("[%s, %s]", (at["lon"] + dx).cast("string"), (at["lat"] + dy).cast("string"))
    join = lambda *parts: F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    square = join(join(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 1.0), p(0.0, 0.0)))
    turn = F.col("c_custkey") % 5
    kind = F.get(F.array(*map(F.lit, ("Point", "MultiPoint", "Polygon", "MultiPolygon", "LineString"))), turn.cast("int"))
    coordinates = F.when(turn == 0, p(0.0, 0.0)).when(turn == 1, join(p(0.0, 0.0), p(2.0, 2.0))).when(turn == 2, square).when(turn == 3, join(square)).otherwise(join(p(0.0, 0.0), p(1.0, 1.0)))
    properties = F.create_map(F.lit("class"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return c.select(F.lit("customers").alias("file"), F.col("c_custkey").alias("feature"), properties.alias("properties"), kind.alias("kind"), coordinates.alias("coordinates"))


@query(
    f"""WITH c AS (SELECT *, c_custkey % 5 AS turn, CAST(799474 + (c_custkey % 440) * 10 AS DOUBLE) / 10000 AS x, CAST(128005 + ((c_custkey * 37) % 430) * 10 AS DOUBLE) / 10000 AS y FROM customer WHERE c_custkey % 5 < 4)
        SELECT 'v_' || c_custkey AS tile_id, {r4('x + CASE turn WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.5 END')} AS lon, {r4('y + CASE turn WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.25 END')} AS lat,
               CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name ELSE 'unknown' END AS lulc_class FROM c"""
)
def vector_records(spark, sf_dir):
    """Features as records at their centroids."""
    rows = vector.geojson_records(_features(spark, sf_dir), "v")
    return rows.select("tile_id", _r("lon"), _r("lat"), "lulc_class")


_LINE = '{"type":"Feature","properties":{"zoning_category":"~"},"geometry":{"type":"MultiPolygon","coordinates":[[[[~,~],[~,~],[~,~],[~,~]]]]}}'
_LINE_PARTS = ("name", "x0", "y0", "x0 + w", "y0", "x0 + w", "y0 + h", "x0", "y0 + h")
_LINE_SQL = " || ".join(x for pair in zip([f"'{part}'" for part in _LINE.split("~")], [*(f"({p})::VARCHAR" for p in _LINE_PARTS), "''"]) for x in pair)


@query(f"WITH {_PART_SQL}, k AS (SELECT *, CASE c {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(t.CATEGORIES))} END AS name FROM parts) SELECT {_LINE_SQL} AS value FROM k")
def zone_lines(spark, sf_dir):
    """Zones as lines of GeoJSON."""
    return zone_files.feature_lines(_part_zones(spark, sf_dir))

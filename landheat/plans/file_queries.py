"""Registered queries that go through files: each writes tables in a source's own format to the shared folder, reads them
back through the source, and is held against the SQL of the same tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.functions import geometry, indices
from landheat.ml import train as ml
from landheat.operators import encode, filters, matrix, report, spatial, split
from landheat.plans import pipelines, queries as q, tables as t
from landheat.plans.queries import query
from landheat.sources import osm, pixels, raster, scenes, zones as zone_files
from landheat.sources.shared import written_folder

r4 = t.r4
#: Features, elements or scenes of one written JSON document.
PAGE = 1000


def folder(spark: SparkSession, name: str) -> str:
    return f"{written_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_documents(df: DataFrame, path: str) -> None:
    """(part, value): each value as a file of its own, as the readers of multi-line JSON expect."""
    df.select("value").write.option("maxRecordsPerFile", 1).text(path)


def write_collections(features: DataFrame, path: str) -> None:
    """(part, value): features as GeoJSON texts, gathered into one FeatureCollection per part."""
    every = features.groupBy("part").agg(F.array_join(F.collect_list("value"), ",").alias("all"))
    write_documents(every.select("part", F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "all", F.lit("]}")).alias("value")), path)


def zone_folder(spark: SparkSession, sf_dir: str) -> str:
    path, rows = folder(spark, "zones"), t.zones(spark, sf_dir)
    lines = rows.select("zone_id", F.struct(*rows.columns).alias("z")).select(F.floor(F.col("zone_id") / PAGE).alias("part"), "z.*")
    write_collections(lines.select("part", zone_files.feature_line().alias("value")), path)
    return path


def meta_folder(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "scenes")
    files = F.create_map(F.lit("B10"), F.lit("x"))
    scenes.write_scene_metadata(t.scene_meta(spark, sf_dir).withColumn("band_files", files), path)
    return path


def pixel_folder(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "pixels")
    pixels.write_pixels(t.pixels(spark, sf_dir), path)
    return path


@query(f"WITH {t.PIXELS_SQL} SELECT tile_id, band, count(*) AS n, {r4('sum(value)', 2)} AS total, min(timestamp) AS first FROM pixels GROUP BY tile_id, band")
def pixel_files(spark, sf_dir):
    """The pixel table, written by scene and read back."""
    rows = pixels.read_pixels(spark, pixel_folder(spark, sf_dir)).groupBy("tile_id", "band")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("timestamp").alias("first"))
    return rows.select("tile_id", "band", "n", indices.rounded(F.col("total"), 2).alias("total"), "first")


@query(
    f"""WITH k AS (SELECT DISTINCT o_custkey % 8 AS t FROM orders)
        SELECT 'T' || t AS scene_id, 'B10.tif' AS file, {r4('774.8853::DOUBLE + t * 0.5')} AS k1_constant_band_10, {r4('1321.0789::DOUBLE + t * 0.5')} AS k2_constant_band_10,
               {r4('480.8883::DOUBLE + t * 0.5')} AS k1_constant_band_11, {r4('1201.1442::DOUBLE + t * 0.5')} AS k2_constant_band_11 FROM k WHERE t < 7"""
)
def scene_metadata_files(spark, sf_dir):
    """Scene metadata, written a folder per scene and read back."""
    rows = scenes.read_scene_metadata(spark, meta_folder(spark, sf_dir))
    return rows.select("scene_id", F.element_at("band_files", "B10").alias("file"), *(indices.rounded(F.col(c), 4).alias(c) for c in scenes.CONSTANT_NAMES))


@query(q.ORACLE_SQL["zone_areas"])
def zone_collection_files(spark, sf_dir):
    """Zones as GeoJSON, written and read back; their areas by category."""
    rows = spatial.area_stats(zone_files.read_zones(spark, zone_folder(spark, sf_dir)), t.BOX)
    return rows.select("zoning_category", "n", *(indices.rounded(F.col(c), 4).alias(c) for c in ("area_km2", "percent_of_bbox")))


_SEARCH = t.Config(years=(1992, 1998), max_cloud=38.0)


def catalog_pages(spark: SparkSession, sf_dir: str) -> str:
    """Saved search pages of the catalog."""
    path, c = folder(spark, "pages"), t.catalog(spark, sf_dir)
    properties = F.struct(
        F.date_format("acquired", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "platform", F.col("cloud_cover").alias("eo:cloud_cover"),
        F.col("wrs_path").cast("string").alias("landsat:wrs_path"), F.col("wrs_row").alias("landsat:wrs_row"),
    )
    assets = F.transform_values("assets", lambda k, v: F.struct(v.alias("href")))
    rows = c.select(F.floor(F.substring("scene_id", 2, 20).cast("long") / PAGE).alias("part"), F.struct(F.col("scene_id").alias("id"), "collection", "bbox", properties.alias("properties"), assets.alias("assets")).alias("f"))
    write_documents(rows.groupBy("part").agg(F.collect_list("f").alias("features")).select("part", F.to_json(F.struct("features")).alias("value")), path)
    return path


@query(
    f"""WITH {t.CATALOG_SQL}, found AS (SELECT * FROM catalog WHERE year(acquired) BETWEEN {_SEARCH.years[0]} AND {_SEARCH.years[1]} AND cloud_cover < {_SEARCH.max_cloud} AND {q._OVERLAP}),
        l2 AS (SELECT wrs_path, wrs_row, CAST(acquired AS DATE) AS day, arg_max(thermal, (acquired, scene_id)) AS has_st FROM found WHERE collection = 'l2' GROUP BY ALL)
        SELECT c.scene_id, c.wrs_path, c.wrs_row, c.cloud_cover, (CASE WHEN thermal THEN 4 ELSE 2 END + CASE WHEN has_st THEN 2 ELSE 1 END)::INTEGER AS files, 774.8853::DOUBLE AS k1_constant_band_10
        FROM found c JOIN l2 ON c.wrs_path = l2.wrs_path AND c.wrs_row = l2.wrs_row AND CAST(c.acquired AS DATE) = l2.day WHERE collection = 'toa'"""
)
def catalog_files(spark, sf_dir):
    """Search pages to matched scenes with their metadata, through files at both ends."""
    out = folder(spark, "found-scenes")
    pipelines.discover_scenes(spark, catalog_pages(spark, sf_dir), out, _SEARCH, "l2", "toa")
    return scenes.read_scene_metadata(spark, out).select("scene_id", "wrs_path", "wrs_row", "cloud_cover", F.size("band_files").alias("files"), "k1_constant_band_10")


@query(q.ORACLE_SQL["way_classes"])
def element_files(spark, sf_dir):
    """Map elements as saved answers, read back; what becomes of the ways."""
    path, rows = folder(spark, "elements"), q.elements(spark, sf_dir)
    parts = rows.select(F.concat_ws("-", "type", F.floor(F.col("id") / PAGE)).alias("part"), F.struct(*rows.columns).alias("e"))
    write_documents(parts.groupBy("part").agg(F.collect_list("e").alias("elements")).select("part", F.to_json(F.struct("elements")).alias("value")), path)
    found = osm.element_zones(osm.read_elements(spark, path)).filter("type = 'way'")
    return osm.status_counts(found)


@query(q.ORACLE_SQL["matrix_build"])
def matrix_files(spark, sf_dir):
    """Pixel, scene and zone files to the matrix on storage, read back."""
    out = folder(spark, "matrix")
    pipelines.build_matrix(spark, pixel_folder(spark, sf_dir), meta_folder(spark, sf_dir), zone_folder(spark, sf_dir), out, t.CFG, "row")
    return matrix.read_matrix(spark, out).drop("ST_B10")


@query(q.ORACLE_SQL["yearly_trend"])
def analysis_files(spark, sf_dir):
    """The analysis tables of a matrix on storage; the yearly trend."""
    out = folder(spark, "matrix")
    matrix.write_matrix(q._matrix(spark, sf_dir), out)
    return pipelines.analysis_tables(spark, out, t.BOX)["trend"].select("year", indices.rounded(F.col("mean"), 4).alias("mean"), "n")


@query(f"WITH v AS ({q.ORACLE_SQL['vector_records']}) SELECT lon, lat, lulc_class, count(*) AS n FROM v GROUP BY ALL")
def vector_files(spark, sf_dir):
    """GeoJSON features to the pixel table, through files at both ends."""
    path, out, rows = folder(spark, "features"), folder(spark, "vector-pixels"), q._features(spark, sf_dir)
    geometry_text = F.concat(F.lit('{"type": "'), "kind", F.lit('", "coordinates": '), "coordinates", F.lit("}"))
    value = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json("properties"), F.lit(', "geometry": '), geometry_text, F.lit("}"))
    write_collections(rows.select(F.floor(F.col("feature") / PAGE).alias("part"), value.alias("value")), path)
    pipelines.vector_pixels(spark, path, out, "v")
    found = pixels.read_pixels(spark, out).select(*(indices.rounded(F.col(c), 4).alias(c) for c in ("lon", "lat")), "lulc_class")
    return found.groupBy("lon", "lat", "lulc_class").agg(F.count(F.lit(1)).alias("n"))


# --- operators that no query above calls ----------------------------------------------------------------------------


@query(f"""WITH {t.TEMPERED_SQL}, rows AS (SELECT *, coalesce(sw, bt10) AS lst FROM windowed), g AS (SELECT avg(lst) AS overall FROM rows)
           SELECT lulc_class, {r4('avg(lst)')} AS mean, count(lst) AS n, {r4('any_value(overall)')} AS overall FROM rows, g GROUP BY lulc_class""")
def category_means(spark, sf_dir):
    """Mean target and count of each class beside the overall mean."""
    rows = t.tempered(spark, sf_dir, "row")
    found = encode.category_stats(rows, "lulc_class", "lst").join(F.broadcast(report.global_mean(rows, "lst").withColumnRenamed("mean", "overall")))
    return found.select("lulc_class", indices.rounded(F.col("mean"), 4).alias("mean"), "n", indices.rounded(F.col("overall"), 4).alias("overall"))


@query(f"""WITH {t.WIDE_SQL} SELECT 'complete' AS kept, count(*) FILTER (B10_TIR IS NOT NULL AND ndvi IS NOT NULL) AS n FROM wide
           UNION ALL SELECT 'finite', count(*) FILTER (B6_SWIR1 IS NOT NULL) FROM wide UNION ALL SELECT 'target', count(*) FILTER (ndbi IS NOT NULL) FROM wide""")
def kept_rows(spark, sf_dir):
    """Rows that are complete, have finite places and values, and have a target."""
    rows = t.wide(spark, sf_dir)
    kept = {"complete": filters.complete(rows, ["B10_TIR", "ndvi"]), "finite": filters.valid_places(rows, "B6_SWIR1"), "target": filters.has_target(rows, "ndbi")}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    """WITH s AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN '"' || o_orderkey || '"' WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN 'x' || o_orderkey END AS text, o_orderkey % 3 = 0 AS timed, o_orderdate FROM orders)
        SELECT TRY_CAST(trim(text, '"') AS INTEGER) AS number, CASE WHEN timed THEN o_orderdate ELSE TIMESTAMP '2000-01-01' END AS time, count(*) AS n FROM s GROUP BY ALL"""
)
def lenient_fields(spark, sf_dir):
    """Numbers within quotes, and a fixed time where there is none."""
    o, k = t.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("x"), k))
    time = F.when(k % 3 == 0, F.col("o_orderdate").cast("timestamp"))
    return o.select(indices.flexible_int(text).alias("number"), indices.or_epoch(time).alias("time")).groupBy("number", "time").agg(F.count(F.lit(1)).alias("n"))


_C = f"CASE p_partkey % 5 {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(t.CATEGORIES))} END"


@query(f"SELECT {_C} AS zoning_category, count(*) AS polygons, count(*) FILTER (p_partkey % 3 = 0) AS crossing FROM part GROUP BY 1")
def crossing_rings(spark, sf_dir):
    """Zones whose ring crosses itself (every third part's rectangle has two corners exchanged)."""
    rows = q._part_zones(spark, sf_dir)
    twisted = lambda r: F.array(F.get(r, 0), F.get(r, 2), F.get(r, 1), F.get(r, 3))
    rows = rows.withColumn("polygons", F.when(F.col("zone_id") % 3 == 0, F.transform("polygons", lambda p: F.transform(p, twisted))).otherwise(F.col("polygons")))
    return spatial.crossing_counts(spatial.repaired(rows))


@query(
    f"""WITH {q._PART_SQL}, k AS (SELECT c, greatest(x0, {t.BOX[0]}) AS a, greatest(y0, {t.BOX[1]}) AS b, least(x0 + w, {t.BOX[2]}) AS d, least(y0 + h, {t.BOX[3]}) AS e FROM judged WHERE reason = 'kept')
        SELECT CASE c {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(t.CATEGORIES))} END AS zoning_category, count(DISTINCT (a, b, d, e)) AS n FROM k GROUP BY 1"""
)
def kept_polygons(spark, sf_dir):
    """Zones from GeoJSON files, cut to the box and numbered anew, without repeats."""
    path, rows = folder(spark, "part-zones"), q._part_zones(spark, sf_dir)
    write_collections(rows.select(F.floor(F.col("zone_id") / PAGE).alias("part"), zone_files.feature_line().alias("value")), path)
    kept = spatial.kept_zones(spatial.clipped_zones(zone_files.read_zones(spark, path), t.BOX))
    return kept.groupBy("zoning_category").agg(F.countDistinct("zone_id").alias("n"))


# --- binary rasters ------------------------------------------------------------------------------------------------

#: Orders of a raster scene, by rows of so many pixels; its quality band has half as many each way.
_SIDE = 32
_RASTER_BANDS = {k: b for k, b in enumerate(raster.PIXEL_BANDS, 1)}
_RASTER_CLOUD = 25.0


def _encode(group: pd.DataFrame) -> pd.DataFrame:
    """One band file of a scene; every thirteenth scene's B6 is damaged."""
    one = group.iloc[0]
    scene, band, side = int(one["scene"]), one["band"], _SIDE // int(one["every"])
    values = np.zeros((side, side), np.uint16)
    values[group["row"], group["col"]] = group["dn"]
    origin, step = (one["x0"], one["y0"]), (0.001 * int(one["every"]),) * 2
    content = raster.encoded(values, origin, step, strip_rows=5, deflate=scene % 2 == 0, order="<>"[scene % 3 == 0])
    return pd.DataFrame({"scene": [f"S{scene}"], "band": [band], "content": [b"damaged" if band == "B6" and scene % 13 == 5 else content]})


def raster_folder(spark: SparkSession, sf_dir: str) -> str:
    """Scenes of 1,024 orders each: a pixel an order, a band a line number, and a quality cell for four orders."""
    path, o, lines = folder(spark, "rasters"), t.read(spark, sf_dir, "orders"), t.read(spark, sf_dir, "lineitem")
    k, size = F.col("o_orderkey").cast("long"), _SIDE * _SIDE
    scene = F.floor(k / size)
    place = o.select(
        "o_orderkey", "o_custkey", scene.alias("scene"), F.floor(k % size / _SIDE).alias("row"), (k % _SIDE).alias("col"),
        ((799500 + scene % 10 * 300).cast("double") / 10000.0).alias("x0"), (F.when(scene % 11 == 10, 133000).otherwise(132000 - scene % 7 * 500).cast("double") / 10000.0).alias("y0"),
    )
    at = ["scene", "x0", "y0", "row", "col"]
    names = F.create_map(*(F.lit(v) for kv in _RASTER_BANDS.items() for v in kv))
    dn = lines.filter(F.col("l_linenumber") <= len(_RASTER_BANDS)).join(place, F.col("l_orderkey") == F.col("o_orderkey"))
    dn = dn.groupBy(*at, F.try_element_at(names, F.col("l_linenumber").cast("int")).alias("band")).agg((F.min(F.col("l_quantity").cast("int")) * 100).alias("dn"))
    cloudy = F.col("o_custkey") % F.when(F.col("scene") % 5 == 0, 2).otherwise(16) == 0
    cells = place.withColumns({"row": F.floor(F.col("row") / 2), "col": F.floor(F.col("col") / 2)}).groupBy(*at).agg(F.min(F.when(cloudy, 8).otherwise(64)).alias("dn"))
    rows = dn.withColumn("every", F.lit(1)).unionByName(cells.withColumns({"band": F.lit(raster.QA_BAND), "every": F.lit(2)}))
    raster.write_rasters(rows.groupBy("scene", "band").applyInPandas(_encode, "scene string, band string, content binary"), path)
    return path


_RASTER_SQL = f"""
    o AS (SELECT o_orderkey, o_custkey, o_orderkey // 1024 AS s, o_orderkey % 1024 // 32 AS r, o_orderkey % 32 AS c,
                 CAST(799500 + o_orderkey // 1024 % 10 * 300 AS DOUBLE) / 10000.0 AS x0,
                 CAST(CASE WHEN o_orderkey // 1024 % 11 = 10 THEN 133000 ELSE 132000 - o_orderkey // 1024 % 7 * 500 END AS DOUBLE) / 10000.0 AS y0 FROM orders),
    g AS (SELECT s, x0, y0, r, c, CASE l_linenumber {' '.join(f"WHEN {k} THEN '{b}'" for k, b in _RASTER_BANDS.items())} END AS band, min(CAST(l_quantity AS INTEGER)) * 100 AS dn
          FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_linenumber <= {len(_RASTER_BANDS)} GROUP BY ALL),
    q AS (SELECT s, x0, y0, r // 2 AS qr, c // 2 AS qc, min(CASE WHEN o_custkey % CASE WHEN s % 5 = 0 THEN 2 ELSE 16 END = 0 THEN 8 ELSE 64 END) AS qa FROM o GROUP BY ALL),
    cells AS (SELECT *, x0 + (qc + 0.5) * 0.002::DOUBLE AS lon, y0 + (qr + 0.5) * -0.002::DOUBLE AS lat FROM q),
    seen AS (SELECT s, count(*) AS total, count(*) FILTER (qa & 31 = 0) AS clear FROM cells WHERE {t.IN_BOX_SQL} GROUP BY s),
    gate AS (SELECT DISTINCT q.s, coalesce((total - clear) * 100.0::DOUBLE / total, -1) AS percent FROM q LEFT JOIN seen USING (s))"""


@query(
    f"""WITH {_RASTER_SQL}, v AS (
            SELECT g.s, band, {r4('x0 + (c + 0.5) * 0.001::DOUBLE')} AS lon, {r4('y0 + (r + 0.5) * -0.001::DOUBLE')} AS lat,
                   {r4("CASE WHEN band = 'ST_B10' THEN dn * 0.00341802::DOUBLE + 149.0 ELSE dn * 0.0000275::DOUBLE - 0.1 END", 6)} AS value
            FROM g JOIN (SELECT s, qr, qc, qa FROM q) q ON g.s = q.s AND r // 2 = qr AND c // 2 = qc JOIN gate ON g.s = gate.s
            WHERE qa & 31 = 0 AND percent <= {_RASTER_CLOUD} AND dn <> 0 AND NOT (band = 'B6' AND g.s % 13 = 5))
        SELECT 'S' || s AS tile_id, CASE band WHEN 'B4' THEN 'B4_Red' WHEN 'B5' THEN 'B5_NIR' WHEN 'B6' THEN 'B6_SWIR1' WHEN 'B10' THEN 'B10_TIR' WHEN 'B11' THEN 'B11_TIR' ELSE band END AS band,
               count(*) AS n, CAST(sum(CAST(round(value * 1e6) AS BIGINT)) AS BIGINT) AS millionths, min(lon) AS west, max(lat) AS north, TIMESTAMP '2000-01-01' AS timestamp FROM v GROUP BY s, band"""
)
def raster_files(spark, sf_dir):
    """Binary rasters through the cloud gate to the pixel table, and back."""
    path, out = raster_folder(spark, sf_dir), folder(spark, "raster-pixels")
    pipelines.ingest_scenes(spark, path, out, t.Config(max_aoi_cloud=_RASTER_CLOUD))
    rows = pixels.read_pixels(spark, out).groupBy("tile_id", "band", "timestamp")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1e6).cast("long")).alias("millionths"), F.min("lon").alias("west"), F.max("lat").alias("north"))


@query(f"WITH {_RASTER_SQL} SELECT DISTINCT 'S' || s AS scene, band, 'ValueError: not a raster file of this kind' AS reason FROM g WHERE band = 'B6' AND s % 13 = 5")
def rejected_rasters(spark, sf_dir):
    """The band files that can't be decoded."""
    return raster.rejected_files(spark, raster_folder(spark, sf_dir)).drop("path")


@query(f"""WITH {_RASTER_SQL} SELECT 'S' || s AS scene, r AS row, c AS col, dn::DOUBLE AS dn FROM g WHERE band = 'B4' AND r BETWEEN 7 AND 12 AND c < 9 AND s IN (1, 3)
           UNION ALL SELECT 'S' || d.s, r, c, 0 FROM (SELECT DISTINCT s FROM g WHERE band = 'B4' AND s IN (1, 3)) d, range(7, 13) a(r), range(0, 9) b(c)
           WHERE NOT EXISTS (SELECT 1 FROM g WHERE band = 'B4' AND g.s = d.s AND g.r = a.r AND g.c = b.c)""")
def raster_window(spark, sf_dir):
    """The pixels of one band of two scenes within a window; the conditions reach the source."""
    rows = raster.read_grid(spark, raster_folder(spark, sf_dir), raster.PIXEL_BANDS)
    return rows.filter("band = 'B4' and scene in ('S1', 'S3') and row >= 7 and row <= 12 and col < 9").select("scene", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "dn")


@query(
    f"""WITH {_RASTER_SQL} SELECT 'S' || g.s AS tile_id, count(*) FILTER (g.s = 2) AS decoded, count(*) FILTER (g.s <> 2) AS kept, {r4("sum(CASE WHEN g.s = 2 THEN 0 ELSE -1.5 END)", 1)} AS marks
        FROM g JOIN (SELECT s, qr, qc, qa FROM q) q ON g.s = q.s AND r // 2 = qr AND c // 2 = qc WHERE qa & 31 = 0 AND g.s IN (1, 2, 3) AND NOT (band = 'B6' AND g.s % 13 = 5) GROUP BY g.s"""
)
def reprocessed_scenes(spark, sf_dir):
    """One scene decoded again; its rows in the pixel table are replaced, the others' stay."""
    path, out = raster_folder(spark, sf_dir), folder(spark, "raster-pixels")
    pixels.write_pixels(raster.scene_pixels(spark, path, scenes=["S1", "S2", "S3"]).withColumn("value", F.lit(-1.5)), out)
    raster.reprocess(spark, path, out, ["S2"])
    old = F.col("value") == -1.5
    rows = pixels.read_pixels(spark, out).groupBy("tile_id").agg(F.count_if(~old).alias("decoded"), F.count_if(old).alias("kept"), F.sum(F.when(old, F.col("value")).otherwise(0.0)).alias("marks"))
    return rows.withColumn("marks", indices.rounded(F.col("marks"), 1))


# --- splits, features and reports over stored tables ------------------------------------------------------------------


@query(f"{q._KEPT}, n AS (SELECT count(*) AS n, floor(count(*) * 0.8)::BIGINT AS train FROM kept) SELECT train, n - train AS test, greatest(1, floor(train * 0.15)::BIGINT) AS validation FROM n")
def exact_shares(spark, sf_dir):
    """Four fifths of the rows for training, and of these 15 % held out, to the row."""
    rows = split.shuffled_split(q._stored_matrix(spark, sf_dir), ["tile_id", "lat", "lon", "year", "doy"])
    rows = split.with_validation(rows, ["tile_id", "lat", "lon", "year", "doy"])
    mark = F.col("split")
    return rows.agg(F.count_if(mark == "train").alias("train"), F.count_if(mark == "test").alias("test"), F.count_if("is_val").alias("validation"))


_FEATURES = ("B10_TIR", "B11_TIR", "B2_Blue", "B3_Green", "B4_Red", "B5_NIR", "B6_SWIR1", "eps10", "eps11", "lat", "lon", "lulc_class_encoded", "ndbi", "ndvi", "pv", "zoning_category_encoded")


@query(f"{q._KEPT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known FROM kept" for c in _FEATURES))
def model_features(spark, sf_dir):
    """The numeric columns of the matrix that neither leak the target nor mark rows, and how often each is known."""
    rows = q._matrix(spark, sf_dir)
    names = ml.feature_names(rows)
    counts = rows.agg(*(F.count(c).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("known")) for c in names))).alias("f")).select("f.*")


@query(q.ORACLE_SQL["regression_metrics"])
def metrics_files(spark, sf_dir):
    """Metrics written as JSON and read back."""
    path, found = folder(spark, "metrics"), q.QUERIES["regression_metrics"](spark, sf_dir)
    pixels.write_metrics(found, path)
    return spark.read.schema(found.schema).json(path)


@query(f"WITH {t.PIXELS_SQL} SELECT tile_id, count(*) AS n, TRUE AS listed FROM pixels GROUP BY tile_id")
def file_inventory(spark, sf_dir):
    """The files of a pixel table by name and size; each scene's rows lie in files that are listed."""
    path = pixel_folder(spark, sf_dir)
    files = pixels.file_inventory(spark, path).filter("mb > 0").select("file_name", F.lit(True).alias("listed")).distinct()
    rows = pixels.read_pixels(spark, path).groupBy("tile_id", F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(files, "file_name", "left").groupBy("tile_id").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce("listed", F.lit(False))).alias("listed"))

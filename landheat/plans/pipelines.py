"""The pipelines as jobs over files on shared storage: each is a composition of the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.functions import thermal as formulas
from landheat.ml import train as ml
from landheat.operators import analysis, encode, filters, matrix, pivot, report, sample, spatial, split, thermal
from landheat.sources import osm, pixels, raster, scenes, vector, zones
from landheat.sources.shared import written


#: Variables that the analysis takes from a matrix, where it has them.
ANALYSED = ("lat", "lon", "year", "ndvi", "lst", "bt10", "bt11", "zoning_category_encoded")


def wide_pixels(spark: SparkSession, pixel_path: str, zoning_path: str, cfg: Config) -> DataFrame:
    """Sampled pixels in the box, one row each, with their indices and zones."""
    rows = filters.sampled(pixels.read_pixels(spark, pixel_path), cfg.sample_rate, pivot.PIXEL)
    rows = pivot.with_indices(pivot.pivot_bands(rows.filter(filters.in_bbox(cfg.bbox))))
    joined = spatial.join_zones(rows, zones.read_zones(spark, zoning_path, cfg.category_column).withColumnRenamed(cfg.category_column, "zoning_category"))
    return joined if cfg.category_column == "zoning_category" else joined.withColumnRenamed("zoning_category", cfg.category_column)


def build_matrix(spark: SparkSession, pixel_path: str, meta_path: str, zoning_path: str, out: str, cfg: Config, mode: str = "column", present: list[str] | None = None) -> dict[str, int]:
    """Pixels, scene metadata and zones to the partitioned feature matrix; its rows and columns.

    present: the bands that the input holds, where the pivot's columns alone should not tell (see thermal).
    """
    cfg.checked()
    rows = filters.in_zone(wide_pixels(spark, pixel_path, zoning_path, cfg), cfg.category_column)
    rows = thermal.with_temperature(thermal.with_scene_constants(rows, scenes.read_scene_metadata(spark, meta_path)), cfg, mode, present)
    categories = ["lulc_class", cfg.category_column]
    if cfg.folds > 1:
        rows = encode.encode_folded(rows, "lst", categories, ["tile_id", "lat", "lon", "timestamp"], cfg.folds, cfg.smoothing)
    else:
        rows = encode.encode(rows, "lst", categories, cfg.smoothing)
    return matrix.write_matrix(matrix.assemble(rows, cfg), out)


def discover_scenes(spark: SparkSession, page_path: str, out: str, cfg: Config, l2: str, toa: str | None = None, scene_ids: list[str] | None = None) -> None:
    """Saved catalog pages to scene metadata; with a second collection, scenes that both have, with bands of each."""
    rows = scenes.read_catalog(spark, page_path).withColumn("assets", scenes.keyed_assets(F.col("assets")))
    rows = scenes.catalog_filter(rows, cfg, None, scene_ids)
    surface = rows.filter(F.col("collection") == l2)
    found = scenes.with_required_assets(surface) if toa is None else scenes.match_scenes(surface, rows.filter(F.col("collection") == toa))
    found = scenes.with_constants(found, cfg=cfg).withColumnRenamed("assets", "band_files").withColumn("acquisition_datetime", F.col("acquired").cast("string"))
    columns = ["scene_id", "acquisition_datetime", "cloud_cover", "wrs_path", "wrs_row", "band_files", *scenes.CONSTANT_NAMES]
    scenes.write_scene_metadata(found.select(*columns), out)


def ingest_scenes(spark: SparkSession, raster_path: str, out: str, cfg: Config) -> DataFrame:
    """Rasters of the scenes that the cloud gate accepts to the pixel table; gives the files that can't be decoded."""
    pixels.write_pixels(raster.scene_pixels(spark, raster_path, cfg.bbox, cfg.max_aoi_cloud), out)
    return raster.rejected_files(spark, raster_path)


def prepare_zones(spark: SparkSession, element_path: str, out: str, cfg: Config, points: DataFrame | None = None) -> dict[str, DataFrame]:
    """Saved map elements to zones; the reports tell what became of elements and polygons."""
    found = osm.element_zones(osm.read_elements(spark, element_path))
    judged = spatial.clipped_zones(osm.as_zones(found), cfg.bbox)
    kept = spatial.kept_zones(judged)
    zones.write_zones(kept, out)
    reports = {"elements": osm.status_counts(found), "polygons": spatial.reason_counts(judged), "areas": spatial.area_stats(kept, cfg.bbox)}
    return reports if points is None else reports | {"points": spatial.check_points(points, kept)}


def train_model(spark: SparkSession, matrix_path: str, report_path: str, cfg: ml.TrainConfig = ml.TrainConfig(), strategy: str = "none", rate: float = 0.1) -> dict[str, DataFrame]:
    """P5: the matrix to a saved model, its metrics on test rows, a baseline and feature weights."""
    rows = filters.require_columns(matrix.read_matrix(spark, matrix_path))
    rows = ml.with_season(split.temporal_split(sample.load(rows, strategy == "none", strategy, rate)))
    model = ml.fit(split.with_validation(rows, ["tile_id", "lat", "lon", "year", "doy"]), ml.feature_names(rows), cfg)
    found = {"metrics": ml.evaluation(model, rows), "importances": ml.importances(model)}
    if "ST_B10" in rows.columns:
        found["baseline"] = ml.baseline(rows)
    pixels.write_metrics(found["metrics"], f"{report_path}/metrics")
    ml.save(model, f"{report_path}/model")
    return found


def quick_run(spark: SparkSession, pixel_path: str, cfg: Config = Config(), train: ml.TrainConfig = ml.TrainConfig(depth=6, rounds=50, rate=0.1)) -> dict[str, DataFrame]:
    """Pixels straight to a model of single-band temperature on a shuffled split, and its latest predictions."""
    keys = ["tile_id", "lat", "lon", "timestamp"]
    rows = pivot.with_indices(pivot.pivot_bands(pixels.read_pixels(spark, pixel_path), keys=keys))
    bt = formulas.brightness_temperature(F.col("B10_TIR"), F.lit(cfg.k1_10), F.lit(cfg.k2_10))
    rows = rows.withColumn("bt10", bt).withColumn("lst", formulas.quick_single_channel(F.col("bt10"), F.col("ndvi"), cfg))
    rows = filters.has_target(split.shuffled_split(written(rows, "quick-run"), keys))
    features = filters.numeric_features(rows.drop("B10_TIR", "ST_B10"))
    rows = filters.complete(rows, ["ndvi", "bt10"])
    known = [f for f in features if f not in ("lat", "lon")] + ["lat", "lon"]
    filled = rows.agg(*(F.count(f).alias(f) for f in known)).first()
    model = ml.fit(split.with_validation(rows, keys), [f for f in known if filled[f]], train)
    return {"metrics": ml.evaluation(model, rows), "importances": ml.importances(model), "latest": ml.inspection(model, rows.filter("split = 'test'"))}


def analysis_tables(spark: SparkSession, matrix_path: str, box: tuple[float, float, float, float] = Config.bbox, size: int = 250) -> dict[str, DataFrame]:
    """Gridded means, trend, correlation, hexagons and a composite of the matrix."""
    stored = matrix.read_matrix(spark, matrix_path)
    rows = filters.analysis_projection(stored, {c: c for c in ANALYSED})
    out = {f"grid_{v}": analysis.smoothed_grid(analysis.gridded_mean(rows, v, box, size)) for v in ("lst", "ndvi") if v in rows.columns}
    out |= {"trend": analysis.yearly_trend(rows, "lst"), "correlation": analysis.pearson(rows, "ndvi", "lst"), "hexbin": analysis.hexbin(rows, "ndvi", "lst", "zoning_category_encoded"), "years": report.distinct_values(rows, "year")}
    if {"bt10", "bt11"} <= set(rows.columns):
        out["composite"] = analysis.composite(rows, (0, 9999))
    return out


def vector_pixels(spark: SparkSession, path: str, out: str, source: str, kind: str = "geojson") -> None:
    """Features of GeoJSON files or shapefiles to the pixel table."""
    rows = vector.geojson_records(zones.read_features(spark, path), source) if kind == "geojson" else vector.read_shapefiles(spark, path, source)
    rows.write.mode("overwrite").option("compression", "snappy").parquet(out)

"""Zones as GeoJSON files and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates stay text at first: their depth depends on the geometry's type.
FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
_RING = "array<array<double>>"


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """Polygons of a GeoJSON geometry; null for other types."""
    one = F.from_json(coordinates, f"array<{_RING}>")
    many = F.from_json(coordinates, f"array<array<{_RING}>>")
    rings = lambda polygon: F.transform(polygon, _points)
    return F.when(kind == "Polygon", F.array(rings(one))).when(kind == "MultiPolygon", F.transform(many, rings))


def outer_points(kind: Column, coordinates: Column) -> Column:
    """The points that a centroid is the mean of: the point or points, or all vertices of outer rings."""
    flat = F.from_json(coordinates, "array<double>")
    points = F.when(kind == "Point", F.array(flat)).when(kind == "MultiPoint", F.from_json(coordinates, _RING))
    finite = F.filter(_points(points), lambda p: p.x.isNotNull() & p.y.isNotNull() & ~F.isnan(p.x) & ~F.isnan(p.y))
    return F.coalesce(finite, F.flatten(F.transform(polygons_of(kind, coordinates), lambda rings: F.element_at(rings, 1))))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, properties, kind, coordinates), one row per feature of FeatureCollections."""
    files = spark.read.schema(FEATURES).option("multiLine", True).json(path).filter("type = 'FeatureCollection'")
    rows = files.select(F.input_file_name().alias("file"), F.posexplode("features").alias("feature", "f"))
    return rows.select("file", "feature", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def zones_of(features: DataFrame, category: str = "zoning_category") -> DataFrame:
    """(zone_id, zoning_category, polygons): polygons only; ids go by file and place in it."""
    order = F.xxhash64("file").bitwiseAND(0x7FFFFFFF) * 1_000_000_000
    rows = features.select((order + F.col("feature")).alias("zone_id"), F.try_element_at("properties", F.lit(category)).alias("zoning_category"), polygons_of(F.col("kind"), F.col("coordinates")).alias("polygons"))
    return rows.filter(F.col("polygons").isNotNull())


def read_zones(spark: SparkSession, path: str, category: str = "zoning_category") -> DataFrame:
    return zones_of(read_features(spark, path), category)


def feature_line() -> Column:
    """A zone's columns as one line of GeoJSON, a MultiPolygon with its category."""
    coordinates = F.transform("polygons", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p.x, p.y))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("zoning_category").alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return F.to_json(feature)


def feature_lines(zones: DataFrame) -> DataFrame:
    """(value): each zone as one line of GeoJSON."""
    return zones.select(feature_line().alias("value"))


def write_zones(zones: DataFrame, path: str) -> None:
    """Zones as GeoJSON lines, which readers of large collections take as they come."""
    feature_lines(zones).write.mode("overwrite").text(path)

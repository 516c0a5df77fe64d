"""Vector files as pixel rows: GeoJSON and shapefiles, one record per feature at its centroid."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landheat.functions.geometry import vertex_mean
from landheat.operators.filters import finite
from landheat.schemas import PIXEL_LONG
from landheat.sources.shared import spread
from landheat.sources.zones import outer_points

# Property names that may hold a land class, in order of preference.
CLASS_KEYS = ("lulc_class", "lulc", "class", "type", "landuse", "category", "lu_code", "description", "name", "label")
BAND = "lulc_class"
UNKNOWN = "unknown"


def class_label(properties: Column, keys: tuple[str, ...] = CLASS_KEYS) -> Column:
    """The first property of the list that holds text, else "unknown"."""
    found = [F.try_element_at(properties, F.lit(k)) for k in keys]
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in found), F.lit(UNKNOWN))


def _records(rows: DataFrame) -> DataFrame:
    """PIXEL_LONG rows of (tile_id, x, y, label)."""
    found = rows.filter(finite(F.col("x")) & finite(F.col("y")))
    return found.select("tile_id", F.col("y").alias("lat"), F.col("x").alias("lon"), F.lit(BAND).alias("band"), F.lit(1.0).alias("value"), F.timestamp_millis(F.lit(0)).alias("timestamp"), F.col("label").alias("lulc_class")).to(T.StructType.fromDDL(PIXEL_LONG))


def geojson_records(features: DataFrame, source: str) -> DataFrame:
    """Features (see read_features) as records `<source>_<feature>`; geometries without points are skipped."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  what is generated is not put into each of its uses again
    rows = spread(features).withColumn("points", once(outer_points(F.col("kind"), F.col("coordinates"))))
    rows = rows.withColumn("c", once(vertex_mean(F.col("points")))).filter("c is not null")
    return _records(rows.select(F.concat(F.lit(f"{source}_"), "feature").alias("tile_id"), "c.x", "c.y", class_label(F.col("properties")).alias("label")))


def _shapes(content: bytes) -> Iterator[tuple[int, float, float]]:
    """(record number, x, y) at the vertex mean of each shape's first part. The record number counts null shapes too."""
    at = 100
    while at + 12 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] % 10 if len(body) >= 4 else 0
        if kind == 1:
            yield number, *struct.unpack("<2d", body[4:20])
        elif kind in (3, 5, 8):
            if kind == 8:
                first, last, base = 0, struct.unpack("<i", body[36:40])[0], 40
            else:
                parts, points = struct.unpack("<2i", body[36:44])
                starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                first, last, base = starts[0], starts[1], 44 + 4 * parts
            numbers = struct.unpack(f"<{2 * (last - first)}d", body[base + 16 * first : base + 16 * last])
            if last > first:
                yield number, sum(numbers[::2]) / (last - first), sum(numbers[1::2]) / (last - first)


def _labels(content: bytes) -> Iterator[tuple[int, str]]:
    """(record number, text) of the first character or number field of each record, deleted ones included."""
    n, header, width = struct.unpack("<iHH", content[4:12])
    at, place = 32, 1
    field = None
    while at < header - 1 and content[at] != 0x0D:
        kind, size = chr(content[at + 11]), content[at + 16]
        if field is None and kind in "CN":
            field = (place, size)
        place += size
        at += 32
    for k in range(n if field else 0):
        row = content[header + k * width : header + (k + 1) * width]
        yield k + 1, row[field[0] : field[0] + field[1]].decode("utf-8", "replace").strip(" \0")


def _each(read):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                rows = list(read(bytes(content)))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame([(path.rpartition(".")[0], *r) for r in rows[k : k + 10_000]], columns=["file", "number", *(["x", "y"] if read is _shapes else ["label"])])

    return run


def read_shapefiles(spark: SparkSession, path: str, source: str) -> DataFrame:
    """All .shp files under path as records `<source>_<record>`, with the label of the sibling .dbf's record.

    A file is one row of a binary scan and decodes within one task; what follows is joined on file and record.
    """
    files = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    shapes = files("shp").mapInPandas(_each(_shapes), "file string, number int, x double, y double")
    labels = files("dbf").mapInPandas(_each(_labels), "file string, number int, label string")
    rows = shapes.join(labels, ["file", "number"], "left")
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit(UNKNOWN))
    return _records(rows.select(F.concat(F.lit(f"{source}_"), "number").alias("tile_id"), "x", "y", label.alias("label")))

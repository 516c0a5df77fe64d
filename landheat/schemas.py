"""Fixed schemas and names of the tables that flow through the library."""

from __future__ import annotations

PIXEL_LONG = "tile_id string, lat double, lon double, band string, value double, timestamp timestamp, lulc_class string"

# Fields of a scene's metadata file.
SCENE_META = (
    "scene_id string, acquisition_datetime string, cloud_cover double, wrs_path int, wrs_row int, band_files map<string,string>, "
    "k1_constant_band_10 double, k2_constant_band_10 double, k1_constant_band_11 double, k2_constant_band_11 double, processing_level string"
)

#: Rings of a polygon: the outer one first, then holes. A zone may hold several polygons.
ZONE = "zone_id long, zoning_category string, polygons array<array<array<struct<x: double, y: double>>>>"

# Canonical band names by provider key, and their scale and offset.
BAND_NAMES = {
    "B2": "B2_Blue",
    "B3": "B3_Green",
    "B4": "B4_Red",
    "B5": "B5_NIR",
    "B6": "B6_SWIR1",
    "B10": "B10_TIR",
    "B11": "B11_TIR",
    "ST_B10": "ST_B10",
}
BANDS = list(BAND_NAMES.values())
OPTICAL_SCALE, OPTICAL_OFFSET = 0.0000275, -0.1
THERMAL_SCALE, THERMAL_OFFSET = 0.00341802, 149.0
SCALES = {k: (OPTICAL_SCALE, OPTICAL_OFFSET) for k in ("B2", "B3", "B4", "B5", "B6", "B10", "B11")} | {"ST_B10": (THERMAL_SCALE, THERMAL_OFFSET)}

# Provider asset names and band keys.
ASSET_KEYS = {"red": "B4", "nir08": "B5", "swir16": "B6", "lwir11": "ST_B10", "qa_pixel": "QA_PIXEL"}
REQUIRED_ASSETS = ("B4", "B5", "B6", "QA_PIXEL", "ST_B10")

# Column names that readers of the matrix know.
MATRIX_BASE = ["tile_id", "lat", "lon", "year", "doy", "lulc_class_encoded", "zoning_category_encoded", "ndvi", "ndbi", "lst"]
MATRIX_EXTRA = ["pv", "eps10", "eps11", "bt10", "bt11", "bt10_minus_bt11", "has_thermal_split"]
MATRIX_REQUIRED = ["lon", "lat", "ndvi", "lst", "split", "year", "doy"]

#: Rows of a page of written tables: what a condition on the coordinates reads or skips at once.
PAGE_ROWS = 2048

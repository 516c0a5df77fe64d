"""From long pixel rows to one row per pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.functions import indices
from landheat.schemas import BANDS

PIXEL = ["tile_id", "lat", "lon", "timestamp", "lulc_class"]


def pivot_bands(df: DataFrame, bands: list[str] = BANDS, keys: list[str] = PIXEL) -> DataFrame:
    """One row per pixel with a column per band; where a band repeats the least value holds.

    The bands are listed, so no job looks for them, and the minima of all bands are taken in one aggregation by pixel,
    on the map side first. (`pivot` groups by pixel and band before it groups by pixel, so it shuffles every long row,
    and twice.)
    """
    return df.groupBy(*keys).agg(*(F.min(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands))


def with_indices(df: DataFrame) -> DataFrame:
    """Adds year, ndvi and ndbi; an index is null where a band of it is missing."""
    have = set(df.columns)
    null = F.lit(None).cast("double")
    ndvi = indices.ndvi() if {"B4_Red", "B5_NIR"} <= have else null
    ndbi = indices.ndbi() if {"B5_NIR", "B6_SWIR1"} <= have else null
    return df.withColumns({"year": F.year("timestamp"), "ndvi": ndvi, "ndbi": ndbi})

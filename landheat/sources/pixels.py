"""Pixel and matrix tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.schemas import PAGE_ROWS, PIXEL_LONG
from landheat.sources.shared import by_place

EARLIEST_MS = 1_600_000_000_000


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """All pixel files under path, with the fixed schema."""
    return spark.read.schema(PIXEL_LONG).parquet(path)


def write_pixels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per scene. With mode "overwrite" only the scenes at hand are replaced.

    Adaptive execution cuts large scenes into tasks by size. Rows of a file follow the Morton code of their place, and
    pages are short, so a box of coordinates reads just the pages about it.
    """
    rows = by_place(df.hint("rebalance", "tile_id"), ["tile_id"], ["band"])
    rows = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tile_id")
    rows.option("compression", "snappy").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def read_check(df: DataFrame, least_rows: int = 1000) -> DataFrame:
    """(rows, first_ms, last_ms, bad_values, enough, recent, clean): what a read of a pixel table must hold."""
    ms = F.unix_millis("timestamp")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.count_if(bad).alias("bad_values"))
    return sums.withColumns({"enough": F.col("rows") > least_rows, "recent": F.coalesce(F.col("first_ms") > EARLIEST_MS, F.lit(False)), "clean": F.col("bad_values") == 0})


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, mb) of the Parquet files under path, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), (F.col("length") / 1e6).alias("mb")).orderBy("file_name")


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row metrics table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)

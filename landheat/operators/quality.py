"""Quality bands: nearest cells, cloud shares, and the gate that rejects cloudy scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.operators.filters import in_bbox, qa_clear, qa_counts

NO_OVERLAP = -1.0


def join_qa(pixels: DataFrame, qa: DataFrame) -> DataFrame:
    """Pixels (scene, row, col, width, height) with the qa of the nearest cell of their scene's quality band.

    qa: (scene, qrow, qcol, qheight, qwidth, qa). A scene without one keeps its pixels with a null qa. The size of a
    scene's band is one row per scene; the cells join on scene, row and column.
    """
    sizes = qa.groupBy("scene").agg(F.max("qheight").alias("qheight"), F.max("qwidth").alias("qwidth"))
    rows = pixels.join(sizes, "scene", "left")
    at = lambda i, n, q: F.least(F.greatest(F.floor(F.col(i) * F.col(q) / F.col(n)), F.lit(0)), F.col(q) - 1)
    rows = rows.withColumns({"qrow": at("row", "height", "qheight"), "qcol": at("col", "width", "qwidth")})
    return rows.join(qa.select("scene", "qrow", "qcol", "qa"), ["scene", "qrow", "qcol"], "left").select(*pixels.columns, "qa")


def clear_pixels(joined: DataFrame) -> DataFrame:
    """Rows whose qa is clear; without a quality band nothing is filtered."""
    return joined.filter(F.col("qa").isNull() | qa_clear("qa"))


def aoi_cloud(qa: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(scene, total, clear, cloud_percent): the cloudy share of a scene's filled pixels in the box; -1 without any."""
    counted = in_bbox(box) & qa_counts()
    sums = qa.groupBy("scene").agg(F.count_if(counted).alias("total"), F.count_if(counted & qa_clear()).alias("clear"))
    share = F.try_divide((F.col("total") - F.col("clear")) * 100.0, F.col("total").cast("double"))
    return sums.withColumn("cloud_percent", F.coalesce(share, F.lit(NO_OVERLAP)))


def gated(scenes: DataFrame, clouds: DataFrame, most_percent: float) -> DataFrame:
    """Scenes with `accepted`: false only where the share is known and above the limit."""
    known = clouds.select("scene", "cloud_percent")
    rows = scenes.join(known, "scene", "left")
    percent = F.coalesce("cloud_percent", F.lit(NO_OVERLAP))
    return rows.withColumn("accepted", ~((percent > most_percent) & (percent >= 0)))

"""Counts, distributions and metrics: one aggregation each, small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zone_distribution(df: DataFrame, category: str = "zoning_category") -> DataFrame:
    """(category, n), rarest first; pixels outside all zones are the null category."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy("n", category)


def flag_distribution(df: DataFrame, flag: str = "has_thermal_split") -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


def coverage(joined: DataFrame, category: str = "zoning_category") -> DataFrame:
    """(rows, inside, outside, coverage_percent) of pixels joined to zones."""
    sums = joined.agg(F.count(F.lit(1)).alias("rows"), F.count(category).alias("inside"))
    share = F.coalesce(F.try_divide(F.col("inside") * 100.0, F.col("rows").cast("double")), F.lit(0.0))
    return sums.select("rows", "inside", (F.col("rows") - F.col("inside")).alias("outside"), share.alias("coverage_percent"))


def global_mean(df: DataFrame, target: str) -> DataFrame:
    """(mean): null where no row has a target."""
    return df.agg(F.avg(target).alias("mean"))


def partition_counts(df: DataFrame) -> DataFrame:
    """(year, split, n), and the total as the row without year and split."""
    return df.rollup(F.struct("year", "split").alias("p")).agg(F.count(F.lit(1)).alias("n")).select("p.year", "p.split", "n").orderBy("year", "split")


def regression_metrics(df: DataFrame, y: str | Column = "y", pred: str | Column = "pred") -> DataFrame:
    """(mae, rmse, r2, mape): mape in percent over the rows whose y isn't 0; all NaN without rows.

    Rows with a null on either side are left out.
    """
    y, pred = (F.col(c) if isinstance(c, str) else c for c in (y, pred))
    rows = df.select(y.cast("double").alias("y"), pred.cast("double").alias("p")).na.drop()
    e = F.col("y") - F.col("p")
    sums = rows.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("sse"),
        (F.var_pop("y") * F.count("y")).alias("sst"),
        (F.avg(F.when(F.col("y") != 0, F.abs(e / F.nullif(F.col("y"), F.lit(0.0))))) * 100).alias("mape"),
    )
    nan = F.lit(float("nan"))
    r2 = 1 - F.try_divide(F.col("sse"), F.col("sst"))
    return sums.select(*(F.coalesce(c, nan).alias(n) for n, c in (("mae", F.col("mae")), ("rmse", F.col("rmse")), ("r2", r2), ("mape", F.col("mape")))))


def run_stats(bands: DataFrame) -> DataFrame:
    """(status, scenes, bands, bytes) of an ingestion run, from its (scene, band, status, length) rows."""
    return bands.groupBy("status").agg(F.countDistinct("scene").alias("scenes"), F.count(F.lit(1)).alias("bands"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def latest(df: DataFrame, n: int = 5000, ts: str = "timestamp", ties: tuple[str, ...] = ("tile_id", "lat", "lon")) -> DataFrame:
    """The n last rows by time, in a fixed order; each task keeps n at most."""
    return df.orderBy(F.desc(ts), *ties).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)

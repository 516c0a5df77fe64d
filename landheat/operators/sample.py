"""Spatial samples of the matrix, alike on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landheat.sources.shared import written

ZONE_COLUMNS = ("zoning_category", "zoning_target_encoded", "zoning_category_encoded")


def grid_step(rate: float) -> int:
    return max(1, round(1 / math.sqrt(rate)))


def stratum_step(rate: float) -> int:
    return max(1, round(1 / rate))


def systematic_grid(df: DataFrame, rate: float) -> DataFrame:
    """Every step-th distinct longitude and latitude of each year; rate <= 0 or >= 1 keeps all.

    Dense ranks are those of the distinct coordinates, so only these are ranked, never the rows; rows with a null
    coordinate are out and shift no rank. The kept ones are written first, so the planner knows their size and
    broadcasts them where they are few; then no row is shuffled.
    """
    if rate <= 0 or rate >= 1:
        return df
    step = grid_step(rate)
    if step == 1:
        return df.filter("lon is not null and lat is not null")
    out = df
    for axis in ("lon", "lat"):
        values = df.filter("lon is not null and lat is not null").select("year", axis).distinct()
        rank = F.row_number().over(Window.partitionBy("year").orderBy(axis))
        kept = values.withColumn("__rank", rank).filter(F.col("__rank") % step == 0)
        kept = written(kept.select(F.col("year").alias("__year"), F.col(axis).alias(f"__{axis}")), "kept-coordinates")
        out = out.join(kept, F.col("year").eqNullSafe(F.col("__year")) & (F.col(axis) == F.col(f"__{axis}")), "left_semi")
    return out


def stratified(df: DataFrame, rate: float, zone_columns: tuple[str, ...] = ZONE_COLUMNS) -> DataFrame:
    """Every step-th row of each (year, zone) by longitude, then latitude and tile; without a zone column the grid sample.

    Rows are dealt by ranges of the whole order, which a sketch of it makes equally full, and sorted within: so a stratum
    of any size, even one at a single longitude, is dealt over many tasks, and no window runs over rows. A row's rank
    is its place in its range, less that of its stratum's first row there, plus the stratum's rows in the ranges before;
    only these counts, a row for each stratum of a range, are added up.
    """
    zone = next((c for c in zone_columns if c in df.columns), None)
    if zone is None:
        return systematic_grid(df, rate)
    if rate <= 0 or rate >= 1:
        return df
    step = stratum_step(rate)
    own = [F.col(c) for c in ("year", zone, *(c for c in ("lon", "lat", "tile_id") if c in df.columns))]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # no column of theirs meets one of ours
    order = [f"o{k}" for k in range(len(own))]
    rows = df.filter("lon is not null").select(row, *(c.alias(n) for c, n in zip(own, order)))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    place = [F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")]
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))  # noqa: E731  null is a stratum of its own
    rows = written(rows.select("row", named("o0").alias("y"), named("o1").alias("z"), *place), "ranked-rows")
    counts = rows.groupBy("y", "z", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("y", "z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("y", "z", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "strata-of-ranges")
    rank = F.col("place") + F.col("shift") + 1
    return rows.join(counts, ["y", "z", "part"]).filter(rank % step == 0).select("row.*")


def sample(df: DataFrame, strategy: str = "none", rate: float = 0.1) -> DataFrame:
    strategies = {"none": lambda d, r: d, "systematic-grid": systematic_grid, "stratified-zoning": stratified}
    if strategy not in strategies:
        raise ValueError(f"unknown strategy {strategy}; one of {sorted(strategies)}")
    return strategies[strategy](df, rate)


def load(df: DataFrame, full_resolution: bool = True, strategy: str = "none", rate: float = 0.1) -> DataFrame:
    """Rows with a target, sampled unless full resolution is asked for."""
    rows = df.filter(F.col("lst").isNotNull())
    return rows if full_resolution else sample(rows, strategy, rate)


def sampling_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, achieved): row counts and their ratio, 0 for an empty input."""
    marked = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    sums = marked.agg(F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("before"), F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("after"))
    return sums.withColumn("achieved", F.coalesce(F.try_divide(F.col("after"), F.col("before")), F.lit(0.0)))

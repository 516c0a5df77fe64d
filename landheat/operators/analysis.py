"""Summaries of the matrix for maps and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers up to 2 ** 18 are added up in steps of 2 ** -44: the last bit of doubles from 256 on.
STEP_BITS, MOST_EXACT = 44, float(1 << 18)


def exact_mean(x: Column) -> Column:
    """The mean by a sum of whole steps, so that it does not depend on the order of rows; plain where a number is out of range."""
    fits = F.abs(x) < MOST_EXACT
    steps = F.when(fits, (x * float(1 << STEP_BITS))).cast("long").cast("decimal(20,0)")
    mean = F.sum(steps).cast("double") / float(1 << STEP_BITS) / F.count(x)
    return F.when(F.count_if(~fits) > 0, F.avg(x)).when(F.count(x) > 0, mean)


def gridded_mean(df: DataFrame, value: str, box: tuple[float, float, float, float], size: int = 250) -> DataFrame:
    """(year, ix, iy, mean, n) on a size x size grid over the box; rows without a year are the means over all years.

    Pixels without a year count in these only.
    """
    x0, y0, x1, y1 = box
    cell = lambda v, low, high: F.least(F.floor((F.col(v) - low) / ((high - low) / size)), F.lit(size - 1))
    rows = df.filter(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1) & F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.select("year", cell("lon", x0, x1).alias("ix"), cell("lat", y0, y1).alias("iy"), F.col(value).alias("v"))
    grouped = rows.groupingSets([["year", "ix", "iy"], ["ix", "iy"]], "year", "ix", "iy")
    grouped = grouped.agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.grouping("year").alias("all_years"))
    return grouped.filter("all_years = 1 or year is not null").drop("all_years")


def smoothed_grid(grid: DataFrame) -> DataFrame:
    """Each cell's mean over its 3 x 3 neighbourhood, weighted by rows; one shuffle of nine times the cells."""
    shift = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = grid.withColumn("d", F.explode(shift)).withColumn("own", (F.col("d.dx") == 0) & (F.col("d.dy") == 0))
    spread = spread.select("year", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"), "mean", "n", "own")
    sums = spread.groupBy("year", "ix", "iy").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.max("own").alias("own"))
    return sums.filter("own").drop("own")


def hexbin(df: DataFrame, x: str, y: str, value: str | None, gridsize: int = 30, least: int = 1) -> DataFrame:
    """(hx, hy, lattice, n, mean) on hexagons that span the data: gridsize across, gridsize / sqrt(3) up.

    Hexagon centres are two shifted rectangular lattices; a point belongs to the nearer centre.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(value) if value else F.lit(None)).cast("double").alias("v"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    spans = F.broadcast(rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    rows = rows.join(spans)  # one row by its making
    up = int(gridsize / 3**0.5)
    u = F.coalesce(F.try_divide((F.col("x") - F.col("x0")) * gridsize, F.col("x1") - F.col("x0")), F.lit(0.0))
    v = F.coalesce(F.try_divide((F.col("y") - F.col("y0")) * up, F.col("y1") - F.col("y0")), F.lit(0.0))
    rows = rows.select("v", u.alias("a"), v.alias("b"))
    rows = rows.select("v", "a", "b", F.floor(F.col("a") + 0.5).alias("i1"), F.floor(F.col("b") + 0.5).alias("j1"), F.floor("a").alias("i2"), F.floor("b").alias("j2"))
    far = lambda i, j, s: (F.col("a") - F.col(i) - s) ** 2 + 3.0 * (F.col("b") - F.col(j) - s) ** 2
    first = far("i1", "j1", 0.0) < far("i2", "j2", 0.5)
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    bins = rows.groupBy(pick("i1", "i2").alias("hx"), pick("j1", "j2").alias("hy"), F.when(first, 1).otherwise(2).alias("lattice"))
    return bins.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).filter(F.col("n") >= least)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(r, n) over rows with both values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return rows.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def yearly_trend(df: DataFrame, value: str, least: int = 2) -> DataFrame:
    """(year, mean, n): the yearly mean, null for years with fewer rows than `least`."""
    sums = df.groupBy("year").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return sums.withColumn("mean", F.when(F.col("n") >= least, F.col("mean"))).orderBy("year")


def composite(df: DataFrame, years: tuple[int, int], keys: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Means per pixel over a range of years: bt10, bt11 and their difference; the same in any order of rows."""
    rows = df.filter(F.col("year").between(*years))
    return rows.groupBy(*keys).agg(exact_mean(F.col("bt10")).alias("bt10"), exact_mean(F.col("bt11")).alias("bt11"), exact_mean(F.col("bt10") - F.col("bt11")).alias("difference"))


def representative_scene(scenes: DataFrame, most_cloud: float = 20.0, time: str = "acquired") -> DataFrame:
    """The first scene of each year below the cloud limit, by time and then id."""
    rows = scenes.filter(F.col("cloud_cover") < most_cloud).withColumn("year", F.year(time))
    first = F.min(F.struct(F.col(time).alias("t"), F.col("scene_id").alias("id")))
    best = rows.groupBy("year").agg(first.alias("best"))
    return best.select("year", F.col("best.id").alias("scene_id"), F.col("best.t").alias(time))


def ranked_importance(df: DataFrame, n: int = 15, weight: str = "importance") -> DataFrame:
    """The n features of most weight, by name where equal."""
    return df.orderBy(F.desc(weight), "feature").limit(n)



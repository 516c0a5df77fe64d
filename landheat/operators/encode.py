"""Smoothed target encoding of categories, plain or out of fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landheat.sources.shared import written


def category_stats(df: DataFrame, category: str, target: str) -> DataFrame:
    """(category, mean, n): average and count of the targets that are not null."""
    return df.groupBy(category).agg(F.avg(target).alias("mean"), F.count(target).alias("n"))


def smoothed(mean: Column, n: Column, overall: Column, smoothing: float) -> Column:
    return F.try_divide(n * mean + smoothing * overall, n + smoothing)


def distinct_names(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def encode(df: DataFrame, target: str, categories: list[str], smoothing: float = 10.0, fit_filter: Column | None = None, on_missing: str = "null") -> DataFrame:
    """Adds <category>_encoded: the category's mean target, drawn to the overall mean by `smoothing`.

    Means come from all rows, or those of fit_filter. A null category, or one without targets, has null, or with
    on_missing="mean" the overall mean. The rows are written to the shared folder once, so whatever gave them does not
    run again for the statistics; one pass over two or three of their columns gives those of all categories and the
    overall mean. Statistics have a row per category: the planner broadcasts small ones by their measured size and
    shuffles larger ones.
    """
    if on_missing not in ("null", "mean"):
        raise ValueError(f"unknown on_missing {on_missing}")
    names, df = distinct_names(categories), written(df, "rows-to-encode")
    fit = df if fit_filter is None else df.filter(fit_filter)
    sets = fit.select(target, *names).groupingSets([*([n] for n in names), []], *names)
    stats = written(sets.agg(F.avg(target).alias("mean"), F.count(target).alias("n"), F.grouping_id().alias("set")), "target-stats")
    whole = (1 << len(names)) - 1
    overall = stats.filter(F.col("set") == whole).select(F.col("mean").alias("__overall"))  # one row
    for k, name in enumerate(names):
        own = stats.filter((F.col("set") == whole - (1 << (len(names) - 1 - k))) & F.col(name).isNotNull())
        own = own.join(F.broadcast(overall)).select(name, smoothed(F.col("mean"), F.col("n"), F.col("__overall"), smoothing).alias(f"{name}_encoded"))
        df = df.join(own, name, "left")
        if on_missing == "mean":
            df = df.join(F.broadcast(overall)).withColumn(f"{name}_encoded", F.coalesce(f"{name}_encoded", "__overall")).drop("__overall")
    return df


def fold_of(keys: list[str], k: int) -> Column:
    """A row's fold by a hash of its keys, alike on any partitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(k)).cast("int")


def encode_folded(df: DataFrame, target: str, categories: list[str], keys: list[str], k: int = 5, smoothing: float = 10.0, fold: Column | None = None) -> DataFrame:
    """Adds <category>_encoded from the rows of the other folds only; null or unseen categories have those rows' mean.

    One pass: sums per (category, fold), their totals per category, and totals less a fold's own give what k passes
    would. Folds go by a hash of the keys unless `fold` gives them. k <= 1 is the plain encoding.
    """
    if k <= 1:
        return encode(df, target, categories, smoothing)
    df = df.withColumn("__fold", fold_of(keys, k) if fold is None else fold)
    own = df.groupBy("__fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    every = Window.partitionBy(F.lit(1))  # k rows
    others = own.select("__fold", F.try_divide(F.sum("s").over(every) - F.coalesce("s", F.lit(0.0)), F.sum("n").over(every) - F.col("n")).alias("__overall"))
    df = df.join(F.broadcast(others), "__fold")
    for category in distinct_names(categories):
        sums = df.filter(F.col(category).isNotNull()).groupBy(category, "__fold").agg(F.coalesce(F.sum(target), F.lit(0.0)).alias("s"), F.count(target).alias("n"))
        total = sums.groupBy(category).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
        # a fold without rows of a category asks for no statistics of it, so the folds that occur are enough
        stats = sums.join(total, category).select(category, "__fold", (F.col("all_s") - F.col("s")).alias("__s"), (F.col("all_n") - F.col("n")).alias("__n"))
        n = F.coalesce("__n", F.lit(0))
        mean = F.coalesce(F.try_divide(F.col("__s"), F.col("__n")), F.col("__overall"))
        df = df.join(stats, [category, "__fold"], "left").withColumn(f"{category}_encoded", smoothed(mean, n, F.col("__overall"), smoothing)).drop("__s", "__n")
    return df.drop("__fold", "__overall")

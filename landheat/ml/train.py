"""Boosted-tree regression of surface temperature, its evaluation and its explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landheat.functions.indices import season
from landheat.ml import boosting
from landheat.ml.boosting import BoostConfig as TrainConfig
from landheat.ml.boosting import BoostedTrees
from landheat.operators import analysis, filters, report


def with_season(df: DataFrame) -> DataFrame:
    """Adds season_sin and season_cos of doy; without doy, of the years since the first."""
    if "doy" in df.columns:
        s, c = season(F.col("doy"))
        return df.withColumns({"season_sin": s, "season_cos": c})
    first = df.agg(F.min("year").alias("__first"))
    s, c = season(F.col("year") - F.col("__first"))
    return df.join(F.broadcast(first)).withColumns({"season_sin": s, "season_cos": c}).drop("__first")


def feature_names(df: DataFrame, target: str = "lst") -> list[str]:
    """Numeric columns that neither leak the target nor mark rows."""
    clean = filters.without_leaks(df)
    return [n for n, k in clean.dtypes if k in ("double", "float", "int", "bigint") and n not in (target, "is_val")]


def fit(df: DataFrame, features: list[str], cfg: TrainConfig = TrainConfig(), target: str = "lst") -> BoostedTrees:
    """Trees on the train rows with a target. Rows marked is_val are not learned from, but end the rounds (see boosting.fit).

    Gaps in a feature are missing values, which each split sends to the side where they lose least.
    """
    held = F.col("is_val") if "is_val" in df.columns else None
    return boosting.fit(df.filter(F.col("split") == "train"), features, target, cfg, held)


def predict(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """df with `pred`."""
    return df.withColumn("pred", model.column({f: F.col(f) for f in model.features}))


def evaluation(model: BoostedTrees, df: DataFrame, target: str = "lst") -> DataFrame:
    """Metrics on the test rows; all NaN without any."""
    return report.regression_metrics(predict(model, df.filter("split = 'test'")), target, "pred")


def baseline(df: DataFrame, target: str = "lst", single: str = "ST_B10") -> DataFrame:
    """Metrics of the single-channel temperature as a predictor, on the test rows."""
    return report.regression_metrics(df.filter("split = 'test'"), target, single)


def importances(model: BoostedTrees) -> DataFrame:
    """(feature, importance), heaviest first, 15 at most; a row per feature is all that the driver holds."""
    rows = [(name, float(share)) for name, share in zip(model.features, model.gains())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").transform(analysis.ranked_importance)


def permutation_importance(model: BoostedTrees, df: DataFrame, features: list[str], keys: list[str], rows: int = 10_000, target: str = "lst", seed: int = 42) -> DataFrame:
    """(feature, rmse_rise): how much worse test rows are predicted when one feature is dealt anew among them.

    At most `rows` test rows are taken, by a hash of their keys; the feature's values, in another hash order, are
    joined on by row number.
    """
    order = lambda s: F.xxhash64(F.lit(s), *keys)
    sample = df.filter("split = 'test'").orderBy(order(seed), *keys).limit(rows)
    numbered = sample.withColumn("__n", F.row_number().over(Window.orderBy(order(seed), *keys)))  # `rows` rows at most
    base = report.regression_metrics(predict(model, numbered), target, "pred").select(F.col("rmse").alias("base"))
    parts = []
    for k, feature in enumerate(features):
        dealt = numbered.select(F.col(feature).alias("__v"), F.row_number().over(Window.orderBy(order(seed + k + 1), *keys)).alias("__n"))
        changed = numbered.drop(feature).join(dealt, "__n").withColumnRenamed("__v", feature)
        rmse = report.regression_metrics(predict(model, changed), target, "pred").select(F.lit(feature).alias("feature"), "rmse")
        parts.append(rmse.join(F.broadcast(base)).select("feature", (F.col("rmse") - F.col("base")).alias("rmse_rise")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("rmse_rise"), "feature")


def inspection(model: BoostedTrees, df: DataFrame, n: int = 5000, target: str = "lst") -> DataFrame:
    """The last n rows by time with temperatures in Celsius and the error."""
    rows = report.latest(predict(model, df), n)
    return rows.select("timestamp", "lat", "lon", (F.col(target) - 273.15).alias("true_c"), (F.col("pred") - 273.15).alias("pred_c"), (F.col("pred") - F.col(target)).alias("error"))


def save(model: BoostedTrees, path: str) -> None:
    """The model as one line of JSON; its size is bounded by its rounds, not by rows."""
    SparkSession.getActiveSession().createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def saved(path: str) -> BoostedTrees:
    return BoostedTrees.from_json(SparkSession.getActiveSession().read.text(path).first().value)

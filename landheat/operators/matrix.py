"""The dense feature matrix: its columns, its split, its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.functions.indices import rounded
from landheat.schemas import MATRIX_BASE, MATRIX_EXTRA, PAGE_ROWS
from landheat.sources.shared import by_place


def split_label(cfg: Config, year: str = "year") -> Column:
    """train, test or ignore; where the ranges overlap train wins."""
    y = F.col(year)
    return F.when(y.between(cfg.train_start, cfg.train_end), "train").when(y.between(cfg.test_start, cfg.test_end), "test").otherwise("ignore")


def matrix_columns(df: DataFrame, cfg: Config) -> list[str]:
    """Base columns in their order, then the others that belong in the matrix, sorted."""
    base = [f"{cfg.category_column}_encoded" if c == "zoning_category_encoded" else c for c in MATRIX_BASE]
    return base + sorted(c for c in df.columns if (c.startswith(("B", "ST_")) or c in MATRIX_EXTRA) and c not in base)


def assemble(df: DataFrame, cfg: Config) -> DataFrame:
    """The matrix rows: floating columns at 4 places, labelled by split, without ignored and incomplete rows."""
    df = df.withColumn("doy", F.dayofyear("timestamp"))
    kinds = dict(df.dtypes)
    columns = [rounded(F.col(c).cast("double"), 4).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in matrix_columns(df, cfg)]
    out = df.select(*columns, split_label(cfg).alias("split")).filter("split != 'ignore'")
    return out.na.drop(subset=["lst", "lat", "lon"])


def write_matrix(df: DataFrame, path: str) -> dict[str, int]:
    """Overwrites the table under path, by year and split; gives its rows and columns, counted while it is written.

    Adaptive execution cuts a large (year, split) into tasks of spark.sql.adaptive.advisoryPartitionSizeInBytes, so
    tasks and files grow in number with the rows, not in size. Rows of a file follow the Morton code of their place,
    and pages are short, so a box of coordinates reads just the pages about it.
    """
    seen = Observation("matrix")
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", "year", "split")
    rows = by_place(rows, ["year", "split"], ["lat", "lon"])
    rows.write.mode("overwrite").partitionBy("year", "split").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return {"rows": seen.get["rows"], "columns": len(df.columns)}


def read_matrix(spark, path: str) -> DataFrame:
    """The matrix with year and split from its folders; FileNotFoundError where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("recursiveFileLookup", "false").parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no Parquet files under {path}") from e

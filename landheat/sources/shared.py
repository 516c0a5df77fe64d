"""Tables written to the folder that the whole cluster shares, for results that are used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landheat.functions.indices import morton


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    In local mode a temporary folder takes its place where it is unset; on a cluster that would be lost data, so
    there the setting must be given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written_folder(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A path for a new table among them."""
    return f"{written_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, cut from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, before work that costs far more than moving them: a small file is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def by_place(df: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """The rows of each task sorted by `first`, the Morton code of lon and lat, and `last`.

    The code is a column until then: as an expression of the sort it would be worked out anew for both rows of every
    comparison. Its name is longer than any of theirs.
    """
    code = "_" * (max(map(len, df.columns)) + 1)
    return df.withColumn(code, morton(F.col("lon"), F.col("lat"))).sortWithinPartitions(*first, code, *last).drop(code)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_written(spark: SparkSession) -> None:
    """Removes all tables that this application has written; call it once no result that rests on them is needed."""
    removed(spark, written_folder(spark))

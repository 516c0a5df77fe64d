"""What several operators share: input tables, tables written for reuse, running totals over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landheat.sources.shared import written

__all__ = ["SPACES", "held_out", "running_total", "sized_slices", "slices", "table", "text_key", "written"]

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: str) -> Column:
    """A key column without nulls, so that plain equi-joins and windows treat null as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves that remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket_rows: int = 1 << 20) -> DataFrame:
    """Adds `out`: the sum of value over the rows before this one within keys, in a fixed order.

    The order is (hash bucket of `order`, `order`), so one key's rows are dealt over many windows, and only one subtotal
    per (key, bucket) meets in a window per key. There are as many buckets as give about bucket_rows rows each if all
    rows had one key, 256 at least. df is read twice and counted: hand over a written table. keys must not hold nulls
    (see text_key); rows that tie on `order` get adjoining places.
    """
    buckets = max(256, -(-df.count() // bucket_rows))
    bucket, part, before = "__bucket", "__part", "__before"
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn(part, value)
    subtotal = rows.groupBy(*keys, bucket).agg(F.sum(part).alias(part))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    subtotal = subtotal.select(*keys, bucket, F.coalesce(F.sum(part).over(w), F.lit(0)).alias(before))
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(part).over(w), F.lit(0)))
    return rows.join(subtotal, [*keys, bucket]).withColumn(out, F.col(out) + F.col(before)).drop(bucket, part, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts in that column take up to most_bytes; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

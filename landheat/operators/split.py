"""Train, test and validation marks: always a column, never separate tables that must stay aligned."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landheat.sources.shared import written

def temporal_split(df: DataFrame, split: str = "split", year: str = "year", train: tuple[int, int] = (2024, 2031), test: tuple[int, int] = (2032, 2033)) -> DataFrame:
    """Rows marked train or test in `split`; others go. Without the column, years decide, with a warning."""
    if split not in df.columns:
        warnings.warn(f"no column {split}: years {train} train, {test} test", stacklevel=2)
        y = F.col(year)
        df = df.withColumn(split, F.when(y.between(*train), "train").when(y.between(*test), "test"))
    return df.filter(F.col(split).isin("train", "test"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """(train, test, dropped)."""
    s = F.col(split)
    marked = s.isin("train", "test")
    return df.agg(F.count_if(s == "train").alias("train"), F.count_if(s == "test").alias("test"), F.count_if(marked.isNull() | ~marked).alias("dropped"))


#: Bits of the hash that one pass over it tells apart, and how many hashes the driver may look at one by one.
PASS_BITS, MOST_HASHES = 16, 100_000


def _kth(hashes: DataFrame, k: int) -> tuple[int, int]:
    """The k-th smallest value of the column `h`, and how many of the k have it; k from 1 to the number of rows.

    Each pass counts the values by their next bits, which tells the range that the k-th lies in; a range of few values
    is looked at whole. So at most four counts of 65,536 ranges come to the driver, whatever the number of rows.
    """
    low, bits = -(1 << 63), 64
    while True:
        own = hashes if bits == 64 else hashes.filter(F.col("h").between(low, low + (1 << bits) - 1))
        if bits < 64 and own.count() <= MOST_HASHES:
            found = sorted(r.h for r in own.collect())
            t = found[k - 1]
            return t, k - found.index(t)
        if bits == 0:
            return low, k
        bits -= PASS_BITS
        # the sign bit turned over, so that the order is that of unsigned numbers
        place = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), bits).bitwiseAND(F.lit((1 << PASS_BITS) - 1))
        for at, n in sorted((r.at, r["count"]) for r in own.groupBy(place.alias("at")).count().collect()):
            if k <= n:
                low += at << bits
                break
            k -= n


def with_first(df: DataFrame, keys: list[str], share: float, out: str, least: int = 0, among: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds `out`: true for exactly max(least, int(n * share)) of the n rows (of those that `among` names, false for others).

    They are those with the smallest hashes of their keys, found by counting hashes, so no rows are sorted or gathered
    and the choice is alike on any partitioning. Where rows that share their keys lie on the border, their other
    columns decide; only such rows are ranked. df is read three times or so: hand over a written table.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    hashed = F.xxhash64(F.lit(seed), *keys)
    hashes = written(df.filter(among).select(hashed.alias("h")), "split-hashes")
    n = hashes.count()
    k = min(n, max(least, int(n * share)))
    if not k:
        return df.withColumn(out, F.lit(False))
    border, taken = _kth(hashes, k)
    if hashes.filter(F.col("h") == border).count() == taken:
        return df.withColumn(out, among & (hashed <= border))
    at_border = among & (hashed == border)
    rest = df.filter(~at_border).withColumn(out, among & (hashed < border))
    order = Window.orderBy(*(F.col(f"`{c}`") for c in df.columns))  # rows that share one key
    some = df.filter(at_border).withColumn(out, F.row_number().over(order) <= taken)
    return rest.unionByName(some)


def shuffled_split(df: DataFrame, keys: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Marks exactly int(n * share) of the rows train, the others test, by a hash of their keys (see with_first)."""
    rows = with_first(df, keys, share, "__train", seed=seed)
    return rows.withColumn("split", F.when(F.col("__train"), "train").otherwise("test")).drop("__train")


def with_validation(df: DataFrame, keys: list[str], share: float = 0.15, by: str = "hash") -> DataFrame:
    """Adds is_val to train rows: exactly max(1, int(n * share)) of these by hash of the keys (see with_first), or with
    by="year" those of the last train year."""
    train = F.col("split") == "train"
    if by == "year":
        last = df.filter(train).agg(F.max("year").alias("__last"))
        return df.join(F.broadcast(last)).withColumn("is_val", train & (F.col("year") == F.col("__last"))).drop("__last")
    return with_first(df, keys, share, "is_val", 1, train, seed=7)
